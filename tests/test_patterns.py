"""Texts that patterns need, and the join that looks for them first."""

import random
import re

import pytest

from labelloom.functions.patterns import required_texts
from labelloom.operators import joins


@pytest.mark.parametrize(
    ("pattern", "expected"),
    [
        ("^Light .*Q$", ["light "]), ("abc|def", ["abc", "def"]), ("abc|d?", []), ("(car|truck)s?", ["car", "truck"]), ("(?:ab)?cd+e", ["cd"]), ("x{0,2}yz", ["yz"]), ("x{3}", ["x"]),
        (r"a\.b\d+c", ["a.b"]), ("[abc]def[]]", []), ("[^a-z]q", ["q"]), ("(?=look)at", ["at"]), ("(?!not)this", ["this"]), ("(?<name>abc)d", ["abc"]), (r"\Qabc\E", []), ("(?i)abc", []),
        ("a|", []), ("", []), (None, []), ("ab(c", []), ("straße", ["stra"]), (r"\p{L}+xy", ["xy"]), ("ab*c+?d", ["a"]), ("(a|(b|cc)d)ee", ["ee"]), ("[a[bc]]zz", ["zz"]), ("*a", []), ("((ab)+)*", []),
    ],
)
def test_required_texts(pattern, expected):
    found = required_texts(pattern)
    assert found == expected or (pattern in ("ab*c+?d",) and found in (["a"], ["c"], ["d"]))


def test_matches_hold_a_required_text():
    pick = random.Random(9)

    def part(depth):
        kind = pick.random()
        if kind < 0.55 or not depth:
            return pick.choice(["a", "b", "ab", "cab", ".", "[ab]", "[^c]", r"\w", r"\."])
        if kind < 0.75:
            return f"({pick.choice(['', '?:', '?='])}{sequence(depth - 1)})"
        return f"(?:{sequence(depth - 1)}|{sequence(depth - 1)})"

    def sequence(depth):
        return "".join(part(depth) + pick.choice(["", "", "", "?", "*", "+", "{2}", "{0,1}", "+?"]) for _ in range(pick.randint(1, 4)))

    told = 0
    for _ in range(3000):
        pattern = sequence(2)
        needs = required_texts(pattern)
        told += bool(needs)
        for _ in range(12):
            text = "".join(pick.choice("abcABC.") for _ in range(pick.randint(0, 9)))
            if needs and re.search(pattern, text, re.IGNORECASE):
                assert any(need in text.lower() for need in needs), (pattern, text, needs)
    assert told > 1000


def test_many_patterns(spark):
    """20,000 patterns: labels meet only those whose text they hold, and a few without text."""
    n = 20_000
    rules = spark.range(n).selectExpr(
        "CASE WHEN id % 4000 = 0 THEN concat('^[w]ord', id, '$') WHEN id % 5000 = 1 THEN '[0-9]{9}' ELSE concat('word', id, '[a-z]*') END AS pattern", "concat('v', id) AS canonical_value", "0.7D AS confidence"
    )
    labels = spark.range(300).selectExpr("concat('a WORD', id * 61, 'x') AS label").union(spark.createDataFrame([("Word4000",), ("123456789",), ("",)], "label string"))
    index = joins.pattern_index(rules)
    assert joins.pattern_candidates(labels, index).count() < 3000
    found = {(r.label, r.pattern, r.canonical_value) for r in joins.regex_matches(labels, rules).collect()}
    expected = set()
    table = [(r.pattern, r.canonical_value) for r in rules.collect()]
    tried = [(re.compile(p, re.IGNORECASE), p, v) for p, v in table]
    for (label,) in labels.collect():
        expected |= {(label, p, v) for compiled, p, v in tried if compiled.search(label)}
    assert found == expected and len(found) > 300
