"""Product codes against a plain search over all entries."""

import hashlib

import numpy as np
import pytest

from labelloom.llm import veccode
from tests.conftest import SF

TYPE = "vec_id long, embedding array<float>, label int, codes string, error string, v string"


def plain(rows, entries=256, rounds=4, parts=4):
    """Codebooks and {vec_id: [(codes, error)]} of rows (vec_id, vector), by brute force."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = [[int(np.floor(1024 * float(c))) for c in v] for _, v in rows]
    width = len(x[0]) // parts
    cut = [[v[p * width : (p + 1) * width] for v in x] for p in range(parts)]
    books = [[list(v) for v in c[:entries]] for c in cut]

    def nearest(part, book):
        return min(((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(book)))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for part in cut[p]:
                groups.setdefault(nearest(part, books[p])[1], []).append(part)
            for k, members in groups.items():
                books[p][k] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    found = {}
    for (vec_id, _), *cuts in zip(rows, *cut, strict=True):
        best = [nearest(part, book) for part, book in zip(cuts, books, strict=True)]
        found.setdefault(vec_id, []).append(([k for _, k in best], sum(d for d, _ in best)))
    return books, found


def test_search_finds_the_first_nearest():
    rng = np.random.default_rng(3)
    for kind in (np.float64, object):
        for _ in range(30):
            points = rng.integers(-9, 9, (60, 3)).astype(kind)
            entries = rng.integers(-9, 9, (rng.integers(1, 40), 3)).astype(kind)
            distances = np.stack([((points - e) ** 2).sum(axis=1) for e in entries], axis=1).astype(np.int64)
            index, best = veccode.nearest(points, entries)
            assert index.tolist() == distances.argmin(axis=1).tolist()
            assert [int(b) for b in best] == distances.min(axis=1).tolist()


def test_equals_brute_force(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").limit(120)
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    coded, codebooks = veccode.compress(table, entries=20, rounds=3)
    books, expected = plain(rows, 20, 3)
    assert codebooks.entries == books
    assert codebooks.digest == hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    labels = {}
    found = coded.collect()
    for r in found:
        assert [(r["codes"], r["error"])] == expected[r["vec_id"]]
        labels[r["label"]] = labels.get(r["label"], 0) + r["error"]
    assert all(r["label_error"] == labels[r["label"]] for r in found) and len(found) == 120
    near = {r["vec_id"]: r["vector"] for r in veccode.reconstruct(coded, codebooks).collect()}
    for vec_id, vector in rows:
        assert sum((np.floor(1024 * a) - 1024 * b) ** 2 for a, b in zip(map(float, vector), near[vec_id], strict=True)) == expected[vec_id][0][1]


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [
        (1, [0.5, -0.25, 0.0, 1.0]), (1, [0.5, -0.25, 0.0, 1.0]), (2, None), (3, [nan, 0.0, 0.0, 0.0]), (4, [inf, 0.0, 0.0, 0.0]), (5, [None, 0.0, 0.0, 0.0]),
        (None, [0.1, 0.2, 0.3, 0.4]), (6, [-0.0001, 0.0, 0.0, 0.0]), (7, [30000.0, -30000.0, 0.0, 0.0]),
    ]
    rows = [(i, v, None if i in (1, None) else 3, "own", "own", "own") for i, v in vectors]
    coded, codebooks = veccode.compress(spark.createDataFrame(rows, TYPE), entries=2, rounds=2)
    kept = [(i, v) for i, v in vectors if v and None not in v and all(np.isfinite(v))]
    books, expected = plain([(i, [float(np.float32(c)) for c in v]) for i, v in kept], 2, 2)
    found = coded.collect()
    assert codebooks.entries == books
    assert sorted(str(r["vec_id"]) for r in found) == sorted(str(i) for i, _ in kept)
    assert all((r["codes"], r["error"]) in expected[r["vec_id"]] for r in found)
    nulls = [r for r in found if r["label"] is None]
    assert len(nulls) == 3 and {r["label_error"] for r in nulls} == {sum(r["error"] for r in nulls)}


def test_empty_and_ragged(spark):
    empty, codebooks = veccode.compress(spark.createDataFrame([], TYPE))
    assert empty.collect() == [] and codebooks.digest == hashlib.sha256(b"").hexdigest()
    ragged = spark.createDataFrame([(1, [0.0] * 4, 1, "", "", ""), (2, [0.0] * 8, 1, "", "", "")], TYPE)
    with pytest.raises(ValueError):
        veccode.compress(ragged)
