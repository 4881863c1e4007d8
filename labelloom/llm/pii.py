"""Personal data by patterns and a skip-chain conditional random field (operator 10).

Patterns give the base spans. The field labels tokens that hold a digit or ``@`` (all others
can only be plain): potentials on a token's shape and its neighbours' shapes, on neighbouring
labels, and on the labels of distant tokens with the same digits or the same text. Its
weights maximise the pseudo-likelihood of the base labels in a bounded sample of documents;
loopy message passing then makes the labels of each document agree, and tokens that it holds
to be personal data with high probability become further spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: The weights are learned from about this many documents.
SAMPLE_DOCUMENTS = 4000
ROUNDS = 8
SURE = 0.9
_LABELS = len(KINDS) + 1  # the last stands for plain text
_PLAIN = _LABELS - 1
_NONE = _LABELS  # no neighbour
_SHAPES, _SIZES, _AROUND = 512, 8, 64

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits either begins a match at its first digit or at none.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"[^ \t-\r]+")
_PART = re.compile(r"[^,;|<>\"'()\[\]{}]+")
_MARK = re.compile(r"[0-9@]").search
_TRIM = ".,;:!?%&*#$|\"'<>"


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    twice = "0246813579"
    total = sum(map(int, digits[-1::-2])) + sum(int(twice[int(d)]) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) in code points, by kind and start."""
    spans = [(0, *s) for s in _emails(text)] if "@" in text else []
    if not _has_digit(text):
        return spans
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            spans.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            spans.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                spans.append((3, *m.span()))
    return spans


_has_digit = re.compile(r"[0-9]").search
_RUNS = ((re.compile(r"[^\W\d_]+"), "a"), (re.compile(r"[0-9]+"), "9"))


def _shape(token: str) -> str:
    for run, mark in _RUNS:
        token = run.sub(mark, token.strip(_TRIM))
    return token


def _code(text: str, size: int) -> int:
    import zlib

    return zlib.crc32(text.encode("utf-8", "surrogatepass")) % size


def _pieces(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    """(start, end, label) of the tokens of a text: its words, cut at the borders of base
    spans, and outside of these at punctuation. The label is the least kind of the base spans
    around a token, of which any number may overlap."""
    ordered = sorted((s, e, k) for k, s, e in spans)
    at, open_spans = 0, []
    for word in _WORD.finditer(text):
        start, end = word.span()
        open_spans = [x for x in open_spans if x[1] > start]
        while at < len(ordered) and ordered[at][0] < end:
            if ordered[at][1] > start:
                open_spans.append(ordered[at])
            at += 1
        if not open_spans:
            if _MARK(word.group()):
                for part in _PART.finditer(text, start, end):
                    yield *part.span(), _PLAIN
            else:
                yield start, end, _PLAIN
            continue
        borders = sorted({start, end} | {b for s, e, _ in open_spans for b in (s, e) if start < b < end})
        for low, high in zip(borders, borders[1:]):  # noqa: B905 - neighbours
            label = min((k for s, e, k in open_spans if s <= low and high <= e), default=_PLAIN)
            if label != _PLAIN:
                yield low, high, label
            else:
                for part in _PART.finditer(text, low, high):
                    yield *part.span(), _PLAIN


def nodes_of(text: str, spans: list[tuple[int, int, int]]) -> list[tuple]:
    """(start, end, shape, size, shape before, shape after, touches the token before, key,
    label) of each token with a digit or @; texts are read once from left to right."""
    found: list[tuple] = []
    waiting = None  # the node that lacks the token after it
    before, last_end = "", 0

    def finish(after: str) -> None:
        found.append((*waiting[:5], _code(_shape(after), _AROUND), *waiting[5:]))

    for start, end, label in _pieces(text, spans):
        token = text[start:end]
        if waiting is not None:
            finish(token)
            waiting = None
        if _MARK(token):
            own = token.strip(_TRIM)
            digits = re.sub("[^0-9]", "", own)
            cut = token.find(own)
            touches = bool(found) and not text[last_end:start].strip()
            key = digits if len(digits) >= 6 else own.lower()
            waiting = (
                start + cut, start + cut + len(own), _code(_shape(token), _SHAPES), min(len(digits), 20) // 3 if len(digits) < 20 else 7, _code(_shape(before), _AROUND),
                touches, key, label,
            )
            last_end = waiting[1]
        before = token
    if waiting is not None:
        finish("")
    return found


def _partners(nodes: list[tuple]) -> list[int]:
    """For each token the number of the last one before it with the same key, or -1."""
    last: dict[str, int] = {}
    out = []
    for i, node in enumerate(nodes):
        out.append(last.get(node[7], -1))
        last[node[7]] = i
    return out


_EVIDENCE = ("shape", "size", "left", "right", "before", "after", "same_before", "same_after", "label")


def evidence(texts: DataFrame) -> DataFrame:
    """Counts of equal training cases over a table with a ``text`` column."""

    def cases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                nodes = nodes_of(text, base_spans(text))
                same = _partners(nodes)
                later = {j: i for i, j in enumerate(same) if j >= 0}
                for i, n in enumerate(nodes):
                    before = nodes[i - 1][8] if n[6] else _PLAIN if n[0] else _NONE
                    after = nodes[i + 1][8] if i + 1 < len(nodes) and nodes[i + 1][6] else _PLAIN
                    rows.append((*n[2:6], before, after, nodes[same[i]][8] if same[i] >= 0 else _NONE, nodes[later[i]][8] if i in later else _NONE, n[8]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in zip(*rows)], list(_EVIDENCE))

    found = texts.mapInArrow(cases, ", ".join(f"{c} int" for c in _EVIDENCE))
    return found.groupBy(*_EVIDENCE).agg(F.count(F.lit(1)).alias("n"))


def train(cases: list[tuple], steps: int = 300, penalty: float = 1e-3) -> dict:
    """Weights of greatest pseudo-likelihood; label weights between neighbours are shared by
    both sides, as are those between tokens of one key."""
    import numpy as np

    sizes = {"shape": (_SHAPES, _LABELS), "size": (_SIZES, _LABELS), "left": (_AROUND, _LABELS), "right": (_AROUND, _LABELS), "chain": (_LABELS + 1, _LABELS + 1), "skip": (_LABELS + 1, _LABELS + 1)}
    w = {k: np.zeros(s) for k, s in sizes.items()}
    w["shape"][:, _PLAIN] = 1.0  # what was never seen is plain
    if not cases:
        return w
    shape, size, left, right, before, after, sb, sa, label, n = np.asarray(cases, dtype=np.int64).T
    weight = n / n.sum()
    speed = {k: np.full(s, 1e-8) for k, s in sizes.items()}
    k = np.arange(_LABELS)
    start = {name: a.copy() for name, a in w.items()}
    for _ in range(steps):
        logits = w["shape"][shape] + w["size"][size] + w["left"][left] + w["right"][right] + w["chain"][before][:, :_LABELS] + w["chain"][:_LABELS, after].T + w["skip"][sb][:, :_LABELS] + w["skip"][:_LABELS, sa].T
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(label)), label] -= 1
        g = p * weight[:, None]
        grads = {name: penalty * (w[name] - start[name]) for name in w}
        for name, where in (("shape", shape), ("size", size), ("left", left), ("right", right)):
            np.add.at(grads[name], where, g)
        for name, a, b in (("chain", before, after), ("skip", sb, sa)):
            np.add.at(grads[name], (a[:, None], k[None, :]), g)
            np.add.at(grads[name], (k[None, :], b[:, None]), g)
        for name in w:
            speed[name] += grads[name] ** 2
            w[name] -= 0.5 * grads[name] / np.sqrt(speed[name])
    return w


def marginals(nodes: list[tuple], edges: list[tuple[int, int, str]], w: dict, rounds: int = ROUNDS):
    """Label probabilities of each token by damped sum-product messages on all edges."""
    import numpy as np

    starts, shape, size, left, right, touches = (np.array([n[i] for n in nodes]) for i in (0, 2, 3, 4, 5, 6))
    alone = w["chain"][_PLAIN][:_LABELS]
    own = w["shape"][shape] + w["size"][size] + w["left"][left] + w["right"][right]
    own = own + np.where(touches[:, None], 0.0, np.where(starts[:, None] > 0, alone, w["chain"][_NONE][:_LABELS]))
    followed = np.append(touches[1:], False)
    own = own + np.where(followed[:, None], 0.0, w["chain"][:_LABELS, _PLAIN])
    first = {j for _, j, kind in edges if kind == "skip"}
    last = {i for i, _, kind in edges if kind == "skip"}
    own += np.where(np.array([i in first for i in range(len(nodes))])[:, None], 0.0, w["skip"][_NONE][:_LABELS])
    own += np.where(np.array([i in last for i in range(len(nodes))])[:, None], 0.0, w["skip"][:_LABELS, _NONE])
    belief = own
    if edges:
        a, b = np.array([e[0] for e in edges]), np.array([e[1] for e in edges])
        pair = np.stack([w[e[2]][:_LABELS, :_LABELS] for e in edges])
        to_b, to_a = np.zeros((len(edges), _LABELS)), np.zeros((len(edges), _LABELS))

        def send(cavity, potentials):
            x = cavity[:, :, None] + potentials
            top = x.max(axis=1)
            out = top + np.log(np.exp(x - top[:, None, :]).sum(axis=1))
            return out - out.mean(axis=1, keepdims=True)

        for _ in range(rounds):
            belief = own.copy()
            np.add.at(belief, b, to_b)
            np.add.at(belief, a, to_a)
            to_b, to_a = (to_b + send(belief[a] - to_a, pair)) / 2, (to_a + send(belief[b] - to_b, pair.transpose(0, 2, 1))) / 2
        belief = own.copy()
        np.add.at(belief, b, to_b)
        np.add.at(belief, a, to_a)
    p = np.exp(belief - belief.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def further_spans(texts: list[tuple[str, list[tuple[int, int, int]]]], w: dict, sure: float = SURE) -> list[list[tuple[int, int, int]]]:
    """For each (text, base spans), spans of sure tokens outside the base spans."""
    nodes, edges, whose = [], [], []
    for d, (text, spans) in enumerate(texts):
        own = nodes_of(text, spans)
        offset = len(nodes)
        edges += [(offset + i - 1, offset + i, "chain") for i, n in enumerate(own) if n[6]]
        edges += [(offset + j, offset + i, "skip") for i, j in enumerate(_partners(own)) if j >= 0]
        nodes += own
        whose += [d] * len(own)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not nodes:
        return out
    p = marginals(nodes, edges, w)
    best = p.argmax(axis=1)
    before = None
    for i, n in enumerate(nodes):
        # a token whose label says that it lies in a base span is covered already
        if n[8] != _PLAIN or best[i] == _PLAIN or p[i, best[i]] < sure:
            before = None
            continue
        spans = out[whose[i]]
        if before == i - 1 and n[6] and spans and spans[-1][0] == best[i]:
            spans[-1] = (spans[-1][0], spans[-1][1], n[1])
        else:
            spans.append((int(best[i]), n[0], n[1]))
        before = i
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def weights(docs: DataFrame, text: str = "text", sample: int = SAMPLE_DOCUMENTS) -> dict:
    """Weights learned from about ``sample`` texts that hold a digit or @, chosen by hash."""
    some = docs.select(F.col(text).alias("text")).where(F.col("text").rlike("[0-9@]"))
    step = max(1, -(-some.count() // sample))
    chosen = some.where(F.pmod(F.xxhash64("text"), F.lit(step)) == 0)
    cases = evidence(chosen).orderBy(*_EVIDENCE)
    return train([tuple(r) for r in cases.collect()])


def finder(spark, w: dict):
    """Arrow UDF text -> struct of counts and span lists."""
    shared = spark.sparkContext.broadcast(w)
    names = [f"n_{k}" for k in KINDS]

    @F.arrow_udf(", ".join(f"{n} long" for n in names) + ", base string, spans string")
    def find(column: pa.Array) -> pa.Array:
        texts = [t or "" for t in column.to_pylist()]
        base = [base_spans(t) for t in texts]
        todo = [i for i, t in enumerate(texts) if "@" in t or _has_digit(t)]
        every = list(base)
        for at in range(0, len(todo), 500):
            part = todo[at : at + 500]
            for i, more in zip(part, further_spans([(texts[i], base[i]) for i in part], shared.value)):
                every[i] = base[i] + more
        counts = [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in range(len(KINDS))]
        return pa.StructArray.from_arrays([*counts, pa.array([_joined(b) for b in base]), pa.array([_joined(b) for b in every])], [*names, "base", "spans"])

    return find


def personal_data(docs: DataFrame, w: dict | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: counts of base spans by kind, and base and all spans as
    ``kind:start:end`` in code points, by kind and start.

    Null and empty texts have no spans. Repeated rows give repeated results, null ids stay
    null, other columns are not read, an empty table gives no rows. Where two kinds fit one
    place, both base spans are given.
    """
    find = finder(docs.sparkSession, weights(docs, text) if w is None else w)
    return docs.select(F.col(doc_id).alias("doc_id"), find(F.col(text)).alias("p")).select("doc_id", "p.*")
