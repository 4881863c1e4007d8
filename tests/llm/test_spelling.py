"""Spelling variants against brute force."""

import random
import zlib
from collections import Counter, defaultdict

import pytest

from labelloom.llm import spelling
from tests.conftest import SF
from tests.llm.data import EDGE, edge


def plain(docs):
    """{word: (n, n_near, form, form_n, root)} from (id, text) pairs."""
    met = Counter()
    for doc_id, text in docs:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        run = ""
        for c in low + " ":
            if "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c
                continue
            if run:
                code = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                met[run if code % 97 else run[: code % len(run)] + run[code % len(run) + 1 :]] += 1
            run = ""
    words = {w: n for w, n in met.items() if len(w) >= 5 and n >= 3}
    patterns = defaultdict(set)
    for w in words:
        for k in range(len(w)):
            patterns[w[:k] + "*" + w[k + 1 :]].add(w)
        for k in range(len(w) + 1):
            patterns[w[:k] + "*" + w[k:]].add(w)
    near = defaultdict(set)
    for group in patterns.values():
        for w in group:
            near[w] |= {v for v in group if v != w and (len(v) != len(w) or sum(a != b for a, b in zip(v, w, strict=True)) == 1)}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None
    found = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        found[w] = (words[w], len(near[w]), form[w], words.get(form[w]), root)
    return found


def as_dict(rows):
    found = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in rows}
    assert len(found) == len(rows)
    return found


def test_pairs_of_random_lists():
    pick = random.Random(4)
    for _ in range(300):
        short, letters = pick.randint(0, 4), "abcdé"[: pick.randint(1, 5)]
        words = sorted({"".join(pick.choice(letters) for _ in range(short + pick.randint(0, 1))) for _ in range(pick.choice([2, 30, 200]))})
        width = pick.randint(1, short + 2)
        query, found = spelling.near_pairs(words, short, width)
        places = range(len(words))
        expected = [(a, b) for a in places for b in places if 0 <= spelling.one_edit(words[a], words[b]) < width and min(len(words[a]), len(words[b])) == short]
        assert sorted(zip(query.tolist(), found.tolist(), strict=True)) == expected


@pytest.mark.parametrize("block_words", [spelling.BLOCK_WORDS, 40, 3])
def test_equals_brute_force(spark, block_words):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = spelling.variants(docs, block_words=block_words).collect()
    assert as_dict(found) == plain([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_chains_ties_and_umlauts(spark):
    lines = ["abcdef " * 40 + "abcdeg " * 40, "abcde " * 20 + "bcde " * 9, "abcdé " * 9, "zbcdé " * 4, "zzcdé " * 3, "ABCDÉ " * 4, "x" * 100_000, " ".join(["lonely"] * 3)]
    rows = [(k, line) for k, line in enumerate(lines)]
    found = as_dict(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert found == plain(rows)
    assert found["abcde"][2] == "abcdef"  # the smaller of two equally frequent ones
    assert found["lonely"] == (3, 0, None, None, "lonely")


def test_edges(spark):
    found = as_dict(spelling.variants(edge(spark)).collect())
    assert found == plain([(r[0], r[1]) for r in EDGE])
    assert spelling.variants(edge(spark, [])).collect() == []


def test_one_edit_gives_the_place():
    assert [spelling.one_edit(*p) for p in [("ab", "ab"), ("ab", "abc"), ("abc", "bc"), ("axc", "abc"), ("abcd", "badc"), ("a", "abc"), ("", "a")]] == [-1, 2, 0, 1, -1, -1, 0]
