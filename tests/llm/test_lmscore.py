"""The language model uses all of its input: every context, every learning text, every error."""

import random
import string
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from labelloom.llm import lmscore
from tests.llm.data import LONG, text


def table(spark, texts, parts=3):
    rows = [(i, t, i % 5 != 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, train boolean").repartition(parts)


def contexts_of(body):
    """(kind, context, byte before, byte) at every place of a text."""
    padded = b" " * 6 + body
    for i, byte in enumerate(body, 6):
        yield (0, padded[i - 3 : i]), padded[i - 2 : i], byte
        yield (1, padded[i - 5 : i]), padded[i - 2 : i], byte
        yield (2, padded[padded.rindex(b" ", 0, i) + 1 : i]), padded[i - 2 : i], byte


def test_every_context_has_its_own_counts(spark):
    rng = random.Random(7)
    texts = [" ".join("".join(rng.choices(string.ascii_lowercase, k=9)) for _ in range(900)) for _ in range(40)]
    _, ready, tables = lmscore.prepared(table(spark, texts))
    want, held = Counter(), set()
    for i, t in enumerate(texts):
        for context, two, byte in contexts_of(t.encode() + b"\n"):
            held.add(context)
            if i % 5:
                want[context, min(int(tables["ranks"][two[0] << 8 | two[1], byte]), lmscore.NODES)] += 1
    keys, counts = [], []
    for row in ready.select("contexts").collect():
        found, n = lmscore._contexts(row.asDict(recursive=True))
        keys.append(found.keys)
        counts.append(n)
    keys, first = np.unique(np.concatenate(keys), return_index=True)
    assert len(held) == len(keys) > 1 << lmscore.SLOT_BITS - 3
    counts = np.concatenate(counts)[first]
    assert Counter(want.values()) == Counter(counts[counts > 0].astype(int).tolist())


def test_blocks_of_contexts_grow_with_the_input():
    assert [lmscore.blocks_for(n * lmscore.BLOCK_BYTES) for n in (0, 1, 2, 3, 1000)] == [1, 1, 2, 4, 1024]


def test_blocks_and_groups_do_not_change_the_counts(spark, monkeypatch):
    rows = table(spark, [text(i, 200) for i in range(30)])

    def sums():
        total = {}
        for row in lmscore.prepared(rows)[1].select("contexts").collect():
            found, n = lmscore._contexts(row.asDict(recursive=True))
            total |= {int(k): tuple(c) for k, c in zip(found.keys, n.tolist())}
        return total

    one = sums()
    monkeypatch.setattr(lmscore, "BLOCK_BYTES", 1 << 12)
    assert sums() == one


def test_weights_are_fitted_on_all_learning_texts(spark):
    texts = [LONG + " " + "qz" * 40_000] + [text(i, 30) for i in range(400)]
    rows = table(spark, texts).withColumn("train", F.lit(True))
    _, ready, tables = lmscore.prepared(rows)
    found = lmscore.fit(ready, tables["ranks"])
    bodies = [t.encode() + b"\n" for t in texts]
    keys = np.unique(np.concatenate([h for _, p, at in lmscore.runs(bodies) for h in lmscore.Run(p, tables["ranks"], at).hashes]) >> np.uint64(4))
    model = tables | {"table": lmscore.Table(keys)}
    counts = np.zeros((len(keys), 8), dtype=np.float32)
    for _, p, at in lmscore.runs(bodies):
        run = lmscore.Run(p, tables["ranks"], at, model["table"])
        for context in run.contexts:
            np.add.at(counts, (context, run.level), 1)
    want = lmscore.fit_mixer(bodies, model, counts)
    assert np.allclose(found["weights"], want["weights"], atol=1e-3) and np.allclose(found["map"], want["map"], atol=1e-3)
    part = lmscore.fit_mixer([b[: lmscore.PIECE] for b in bodies[:300]], model, counts)
    assert not np.allclose(found["map"], part["map"], atol=1e-3)


def model_of(bodies):
    run = lmscore.Run(bodies)
    n = Counter(zip(run.two.tolist(), run.byte.tolist()))

    class Found:
        def toArrow(self):
            import pyarrow as pa

            return pa.table({"two": [t for t, _ in n], "byte": [b for _, b in n], "n": list(n.values())})

    ranks, rest, left = lmscore.rank_tables(Found())
    run = lmscore.Run(bodies, ranks)
    counts = np.zeros((1 << lmscore.SLOT_BITS - 3, 8), dtype=np.float32)
    for context in run.contexts:
        np.add.at(counts, (context, run.level), 1)
    odds, sure = lmscore.odds_of(counts)
    return lmscore.fit_mixer(bodies, {"ranks": ranks, "rest": rest, "left": left, "odds": odds, "sure": sure}, counts)


def test_short_texts_adapt_too():
    model = model_of([text(i, 60).encode() + b"\n" for i in range(20)])
    body = b"theta zeta eta iota " * 12
    assert len(body) * lmscore.NODES < 2 * 1024
    states = [None]
    adapted = lmscore.bits_of([body], model, states=states)[0]
    fixed = lmscore.bits_of([body], model, rate=0.0, map_rate=0.0)[0]
    assert adapted != fixed and not np.array_equal(states[0][0], model["weights"].reshape(4, -1))
    first = lmscore.bits_of([body[: lmscore.STEP]], model)[0]
    assert np.isclose(first, lmscore.bits_of([body[: lmscore.STEP]], model, rate=0.0, map_rate=0.0)[0])


def test_pieces_go_on_where_the_last_one_ended(monkeypatch):
    model = model_of([text(i, 60).encode() + b"\n" for i in range(20)])
    body = (text(3, 60) + " " + "nospace" * 90 + " " + text(4, 60)).encode() + b"\n"
    whole = lmscore.Run([body], model["ranks"]).hashes
    bits = lmscore.text_bits([body, body], model)
    monkeypatch.setattr(lmscore, "PIECE", lmscore.STEP)
    cut = [lmscore.Run(p, model["ranks"], leads) for _, p, leads in lmscore.runs([body])]
    assert len(cut) > 10
    assert all(np.array_equal(np.concatenate([r.hashes[k] for r in cut]), whole[k]) for k in range(3))
    assert bits[0] == bits[1] and np.allclose(lmscore.text_bits([body, body], model), bits, rtol=0.02)


def test_equal_places_are_worked_out_once():
    """Places are far fewer than bytes, and stand for all of them."""
    bodies = [text(i % 7, 300).encode() + b"\n" for i in range(60)]
    ranks = np.arange(256, dtype=np.uint8)[None, :].repeat(65536, axis=0)
    trains = [i % 3 > 0 for i in range(60)]
    n, level, train, hashes = lmscore.places(bodies, ranks, trains)
    assert n.sum() == sum(map(len, bodies)) and len(n) < n.sum() / 5
    want = Counter()
    for body, t in zip(bodies, trains):
        run = lmscore.Run([body], ranks, hashed=True)
        want.update(zip(run.level.tolist(), [t] * len(body), *(h.tolist() for h in run.hashes)))
    assert Counter(dict(zip(zip(level.tolist(), train.tolist(), *(h.tolist() for h in hashes)), n.tolist()))) == want
    assert all(len(x) == 0 for x in lmscore.places([], ranks)[:3])


def test_rows_of_a_batch_come_one_at_a_time():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"grp": [1, 2, 3], "bodies": [b"a", b"b", b"c"]})
    rows = lmscore._rows(iter([batch]))
    assert next(rows) == {"grp": 1, "bodies": b"a"} and [r["grp"] for r in rows] == [2, 3]
