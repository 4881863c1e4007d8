"""Groups of texts as words and numbers: the same places, and little that goes to disk."""

import os
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from labelloom.llm import lmscore
from tests.llm.data import LONG, text

TEXTS = ["", " a", "a b c d e f", "x" * 70_000 + " y", "A\tbb  ccc\ndddd eeeee", "été 中文 z", LONG, *(text(i, 80) for i in range(40)), None]


def grouped(spark):
    rows = spark.createDataFrame([(i, t, i % 5 != 0) for i, t in enumerate(TEXTS)], "doc_id long, text string, train boolean").coalesce(1)
    bodies = [b" ".join(lmscore.words_of((t or "").encode())) + b"\n" for t in TEXTS]
    return rows, bodies


def test_groups_hold_the_places_of_their_texts(spark):
    rows, bodies = grouped(spark)
    (row,) = lmscore._groups(rows).collect()
    group = lmscore.Group(row.asDict(recursive=True)["packed"])
    assert [group.body(i) for i in range(len(bodies))] == bodies and group.sizes.tolist() == [len(b) for b in bodies]
    ranks = np.arange(256, dtype=np.uint8)[None, :].repeat(65536, axis=0)
    n, level, hashes, triple, near = group.places(ranks)
    find = group.place_finder(near, group.tails())
    at, want = find(0, len(group.ids)), Counter()
    run = lmscore.Run(bodies, ranks, hashed=True)
    for have, k in zip([level, *hashes, triple], [run.level, *run.hashes, run.two.astype(np.int64) << 8 | run.byte]):
        assert np.array_equal(have[at], k)
    for place, trains in zip(np.split(at, run.ends[:-1]), row["trains"]):
        want.update(place.tolist() if trains else [])
    assert {i: m for i, m in enumerate(n.tolist()) if m} == dict(want)
    codes, m = group.triples()
    taught = np.concatenate([np.full(len(b), t) for b, t in zip(bodies, row["trains"])])
    assert dict(zip(codes.tolist(), m.tolist())) == Counter(triple[at][taught].tolist())


def test_counts_are_packed_whole():
    counts = np.array([[0, 0, 0], [1, 0, 255], [256, 1 << 31, 7]])
    assert np.array_equal(lmscore._counts(lmscore._packed_counts(counts), 3), counts)
    assert np.array_equal(lmscore._counts(lmscore._packed_counts(counts << 20), 3), counts << 20)
    assert lmscore._counts(lmscore._packed_counts(counts[:0]), 3).shape == (0, 3)


def test_hashes_are_not_stored_and_shuffles_do_not_stay(spark):
    rows, bodies = grouped(spark)
    local = [str(d) for d in spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString()]

    def shuffles():
        return {f for d in local for _, _, files in os.walk(d) for f in files if f.startswith("shuffle_")}

    before = shuffles()
    found = lmscore.scores(rows, F.col("train"))
    assert not shuffles() - before
    assert found.count() == len(bodies)
    _, ready, _ = lmscore.prepared(rows)
    assert "keys" not in ready.schema.simpleString()


def test_a_group_of_one_short_text(spark):
    """Fewer bytes than a context has, and no byte beyond the first places of words."""
    for one in ("", "a", "ab c"):
        rows = spark.createDataFrame([(1, one, True)], "doc_id long, text string, train boolean").coalesce(1)
        (row,) = lmscore._groups(rows).collect()
        n, _, _, triple, _ = lmscore.Words(row.asDict(recursive=True)["packed"]).places()
        assert n.sum() == len(one) + 1 == len(triple)
