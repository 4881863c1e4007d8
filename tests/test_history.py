"""Folds over histories against step-by-step Python."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from labelloom.operators import history


def fold(values, patience, delta):
    best, best_epoch, counter = values[0], 1, 0
    for epoch, v in enumerate(values[1:], 2):
        if v < best - delta:
            best, best_epoch, counter = v, epoch, 0
        else:
            counter += 1
        if counter >= patience:
            return best, best_epoch, counter, epoch
    return best, best_epoch, counter, 0


@settings(max_examples=300, deadline=None)
@given(
    st.lists(st.integers(-40, 40), min_size=1, max_size=60), st.integers(1, 8), st.integers(0, 5), st.integers(1, 20)
)
def test_chained_summaries_equal_the_fold(values, patience, delta, size):
    frame = pd.DataFrame({"epoch": np.arange(1, len(values) + 1), "value": np.array(values, float)})
    parts = [history._summarise(frame.iloc[i : i + size], patience, delta) for i in range(0, len(frame), size)]
    state = (None, 0, 0, 0)
    for part in parts:
        state = history._step(state, part, patience, delta)
    assert state == fold([float(v) for v in values], patience, delta)


@pytest.mark.parametrize("mode", ["min", "max"])
def test_early_stopping_over_many_parts(spark, mode):
    rng = random.Random(3)
    data = {e: [round(rng.uniform(0, 100) - i * 0.05 * (e % 3), 2) for i in range(90 + e * 40)] for e in range(6)}
    df = spark.createDataFrame([(e, i, v) for e, vs in data.items() for i, v in enumerate(vs, 1)], "experiment_id long, epoch long, value double")
    out = history.early_stopping(df, patience=25, min_delta=0.5, mode=mode, rows_per_part=13)
    sign = 1 if mode == "min" else -1
    for r in out.collect():
        best, epoch, counter, stop = fold([v * sign for v in data[r.experiment_id]], 25, 0.5)
        assert (r.best_value, r.best_epoch, r.counter, r.stopped_epoch or 0) == (best * sign, epoch, counter, stop)


def test_checkpoints_flags(spark):
    values = [3.0, 5.0, 5.0, 4.0, 7.0, 1.0]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values, 1)], "experiment_id long, epoch long, value double")
    out = sorted(history.checkpoints(df, keep=2, rows_per_part=2).collect(), key=lambda r: r.epoch)
    assert [r.is_new_best for r in out] == [True, True, False, False, True, False]
    assert [r.is_best for r in out] == [False, False, False, False, True, False]
    assert [r.is_latest for r in out] == [False] * 5 + [True]
    assert [r.is_kept for r in out] == [False] * 4 + [True] * 2
    assert [r.best_value for r in out] == [3.0, 5.0, 5.0, 5.0, 7.0, 7.0]


def replay(events):
    """Curation as a state machine over one stream of actions."""
    state, out, pending = {}, {}, 0
    for entry, ts, event_id, action in sorted(events, key=lambda e: (e[1], e[2])):
        now = state.get(entry)
        legal = action == "create" or (action == "submit" and now == "draft") or (action in ("approve", "reject") and now == "pending_review")
        if legal:
            new = {"create": "draft", "submit": "pending_review", "approve": "approved", "reject": "rejected"}[action]
            pending += (new == "pending_review") - (now == "pending_review")
            state[entry] = new
        out[event_id] = (legal, state.get(entry), pending)
    return out


def test_curation_equals_the_state_machine(spark):
    rng = random.Random(11)
    start = dt.datetime(2024, 1, 1)
    events = []
    for i in range(500):
        entry = 0 if rng.random() < 0.5 else rng.randrange(1, 6)
        action = rng.choice(["create", "submit", "submit", "approve", "reject"])
        events.append((entry, start + dt.timedelta(minutes=rng.randrange(4000)), i, action))
    df = spark.createDataFrame(events, "entry_id long, ts timestamp, event_id long, action string").withColumn("hour", F.date_trunc("hour", "ts"))
    got = {r.event_id: (r.legal, r.status, r.pending) for r in history.curation(df, limit=2).collect()}
    assert got == replay(events)


def test_best_and_latest_metric_skip_null_and_keep_first(spark):
    df = spark.createDataFrame(
        [(1, 1, 1, None, "a"), (1, 2, 2, 5.0, "b"), (1, 3, 3, 5.0, "c"), (1, 4, 4, 9.0, "d")],
        "experiment_id long, ts long, event_id long, value double, event_type string",
    )
    best = history.best_metric(df).first()
    assert (best.value, best.event_id) == (5.0, 2)
    assert history.best_metric(df, "max").first().event_id == 4
    assert history.latest_metric(df).first().event_id == 4


def test_early_stopping_summaries_are_bounded_and_skip_nulls(spark):
    import numpy as np
    import pandas as pd

    from labelloom.operators import history

    falling = pd.DataFrame({"value": np.linspace(9, 1, 5000), "epoch": np.arange(1, 5001)})
    part = history._summarise(falling, 10, 0.0001)
    assert all(len(v) <= 10 for k, v in part.items() if k != "n")
    rows = [(1, 1, 5.0), (1, 2, None), (1, 3, 1.0), (1, 4, float("nan")), (1, 5, 0.5)]
    got = history.early_stopping(spark.createDataFrame(rows, "experiment_id long, epoch long, value double"), patience=3).first()
    assert (got.best_value, got.best_epoch, got.counter, got.stopped_epoch) == (0.5, 5, 0, None)


def test_null_groups_stay(spark):
    from labelloom.operators import merge_split, stats

    images = spark.createDataFrame([(i, None if i % 2 else "a") for i in range(10)], "id long, dataset string")
    assert merge_split.random_split(images, group=["dataset"]).count() == 10
    labels = spark.createDataFrame([(None, "Car", None), ("a", "Van", None)], "dataset string, label string, ontology_class string")
    assert stats.class_distribution(labels, ["dataset"]).count() == 2


def test_paths_reach_the_root_and_odd_versions_pass(spark):
    from pyspark.sql import functions as F

    from labelloom.functions import versions
    from labelloom.operators import hierarchy

    parts = "a.b.c.d.e.f".split(".")
    nodes = [("root", None)] + [(".".join(parts[: i + 1]), ".".join(parts[:i]) or "root") for i in range(6)]
    found = {r.value: r.path for r in hierarchy.resolve(spark.createDataFrame(nodes, "value string, parent string")).collect()}
    assert found["a.b.c.d.e.f"] == " > ".join(n for n, _ in nodes)
    assert spark.range(1).select(versions.parse(F.lit("1.0.0-rc1"))["major"]).first()[0] == 1
