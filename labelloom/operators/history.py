"""Metric history, checkpoints, versions and curation events.

One experiment or entry may own most of the log. Ordered scans are cut into buckets
(see :mod:`labelloom.operators.skew`); folds are summarised per bucket and then chained.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom import config
from labelloom.functions import versions
from labelloom.operators.skew import bucketed_lag, bucketed_row_number, bucketed_running, join_group_summary, ranged, top_k

ORDER = ("ts", "event_id")


def best_metric(metrics: DataFrame, mode: str = "min", order: Sequence[str] = ORDER) -> DataFrame:
    """Best value per experiment, null skipped, the first on ties."""
    sign = 1 if mode == "min" else -1
    best = F.min(F.struct((F.col("value") * sign).alias("v"), *order)).alias("_b")
    return metrics.where("value IS NOT NULL").groupBy("experiment_id").agg(best).select(
        "experiment_id", (F.col("_b.v") * sign).alias("value"), *[f"_b.{c}" for c in order]
    )


def latest_metric(metrics: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    last = F.max(F.struct(*order, "value", "event_type")).alias("_l")
    return metrics.groupBy("experiment_id").agg(last, F.count(F.lit(1)).alias("entries")).select(
        "experiment_id", *[f"_l.{c}" for c in (*order, "value", "event_type")], "entries"
    )


def metrics_of(metrics: DataFrame, experiment: Column, order: Sequence[str] = ORDER) -> DataFrame:
    return metrics.where(experiment).orderBy("experiment_id", *order)


def with_epoch(metrics: DataFrame, bucket: str | None = None, order: Sequence[str] = ORDER) -> DataFrame:
    """Number the entries of each experiment from 1.

    The log is cut into ranges of even size by its own quantiles, or by ``bucket``, a column
    that does not decrease along the order.
    """
    if bucket is not None:
        return bucketed_row_number(metrics, ["experiment_id"], bucket, order, "epoch")
    return bucketed_row_number(ranged(metrics, ["experiment_id"], order), ["experiment_id"], "_range", order, "epoch").drop("_range")


_SUMMARY = (
    "experiment_id long, part long, n long, head array<long>, record_value array<double>, record_at array<long>, "
    "out_value array<double>, out_epoch array<long>, out_counter array<long>, out_stop array<long>"
)
_STATE = "experiment_id long, best_value double, best_epoch long, counter long, stopped_epoch long"
_COLUMNS = ["experiment_id", "best_value", "best_epoch", "counter", "stopped_epoch"]


def _summarise(pdf: pd.DataFrame, patience: int, delta: float) -> dict[str, object]:
    """What one part of a history, in epoch order, does to an incoming best value.

    A best value can only be replaced by a running minimum of the part, so the outcome is
    worked out per running minimum; between them the counter grows by one per row. A first
    improvement at row ``patience`` or later comes too late, so only the running minima
    before it are kept: at most ``patience``, however long the part.
    """
    values, epochs = pdf["value"].to_numpy(float), pdf["epoch"].to_numpy(int)
    n = len(values)
    low = np.minimum.accumulate(values)
    at = np.flatnonzero(np.concatenate(([True], low[1:] < low[:-1])))
    records = values[at]
    # First running minimum that is better by more than delta, for each of them.
    after = np.searchsorted(-records, -(records - delta), side="right")
    k = len(at)
    waited = np.append(at, n)[after] - at - 1
    stops = waited >= patience
    # Follow each running minimum to the one at which the part ends or stops, by doubling.
    final = np.where(stops | (after >= k), np.arange(k), np.minimum(after, k - 1))
    while (final[final] != final).any():
        final = final[final]
    final = final[: np.searchsorted(at, patience)]
    return {
        "n": n,
        "head": epochs[:patience].tolist(),
        "record_value": records[: len(final)].tolist(),
        "record_at": at[: len(final)].tolist(),
        "out_value": records[final].tolist(),
        "out_epoch": epochs[at[final]].tolist(),
        "out_counter": np.where(stops[final], patience, waited[final]).tolist(),
        "out_stop": np.where(stops[final], epochs[np.minimum(at[final] + patience, n - 1)], 0).tolist(),
    }


def _step(state: tuple, p: dict, patience: int, delta: float) -> tuple:
    """State (best, epoch, counter, stop) after one more part; ``best`` is None before the first."""
    best, epoch, counter, stop = state
    if stop:
        return state
    if best is None:
        return p["out_value"][0], p["out_epoch"][0], p["out_counter"][0], p["out_stop"][0]
    records = np.asarray(p["record_value"])
    hit = int(np.searchsorted(-records, -(best - delta), side="right"))
    idle = int(p["record_at"][hit]) if hit < len(records) else int(p["n"])
    if counter + idle >= patience:
        return best, epoch, patience, int(p["head"][patience - counter - 1])
    if hit < len(records):
        return p["out_value"][hit], p["out_epoch"][hit], p["out_counter"][hit], p["out_stop"][hit]
    return best, epoch, counter + idle, 0


def _runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Consecutive rows of equal keys, also across the borders of Arrow batches."""
    pending = None
    for batch in batches:
        rows = batch if pending is None else pd.concat([pending, batch], ignore_index=True)
        if len(rows) == 0:
            continue
        k = rows[keys].to_numpy()
        starts = np.concatenate(([0], np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1))
        for i, j in zip(starts[:-1], starts[1:]):
            yield rows.iloc[i:j]
        pending = rows.iloc[starts[-1] :]
    if pending is not None and len(pending):
        yield pending


def early_stopping(
    metrics: DataFrame,
    patience: int = config.EARLY_STOP_PATIENCE,
    min_delta: float = config.EARLY_STOP_DELTA,
    mode: str = "min",
    rows_per_part: int = 250_000,
) -> DataFrame:
    """Best value, its epoch, the waiting counter and the stop epoch of each experiment.

    The best value moves only on an improvement above ``min_delta``; after ``patience``
    epochs without one the experiment stops. ``metrics`` has experiment_id, epoch (dense,
    from 1) and value; rows without a value (null or NaN) are passed over. Parts of bounded size are summarised in parallel and the
    summaries, not the rows, are chained per experiment.
    """
    sign = 1.0 if mode == "min" else -1.0
    rows = metrics.select(
        "experiment_id", "epoch", (F.col("value") * sign).alias("value"),
        F.floor((F.col("epoch") - 1) / rows_per_part).cast("long").alias("part"),
    ).where(F.col("value").isNotNull() & ~F.isnan("value"))

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = []
        for run in _runs(batches, ["experiment_id", "part"]):
            head = run.iloc[0]
            found.append({"experiment_id": int(head["experiment_id"]), "part": int(head["part"]), **_summarise(run, patience, min_delta)})
            if len(found) == 500:
                yield pd.DataFrame(found)
                found = []
        if found:
            yield pd.DataFrame(found)

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Summaries come in order; only the running state of one experiment is held.
        experiment, state, done = None, (None, 0, 0, 0), []
        for batch in batches:
            for p in batch.to_dict("records"):
                if p["experiment_id"] != experiment:
                    if experiment is not None:
                        done.append((experiment, state[0] * sign, *state[1:]))
                    experiment, state = p["experiment_id"], (None, 0, 0, 0)
                state = _step(state, p, patience, min_delta)
            yield pd.DataFrame(done, columns=_COLUMNS)
            done = []
        if experiment is not None:
            yield pd.DataFrame([(experiment, state[0] * sign, *state[1:])], columns=_COLUMNS)

    ordered = rows.repartition("experiment_id", "part").sortWithinPartitions("experiment_id", "part", "epoch")
    summaries = ordered.mapInPandas(summarise, _SUMMARY)
    chained = summaries.repartition("experiment_id").sortWithinPartitions("experiment_id", "part").mapInPandas(chain, _STATE)
    return chained.withColumn("stopped_epoch", F.nullif("stopped_epoch", F.lit(0)))


def checkpoints(metrics: DataFrame, keep: int = config.CHECKPOINTS_KEPT, rows_per_part: int = 250_000) -> DataFrame:
    """Per saved checkpoint: was it the best so far, is it the best or the latest of all,
    and is it among the last ``keep``. Higher is better; the first of equals stays best."""
    rows = metrics.withColumn("_part", F.floor((F.col("epoch") - 1) / rows_per_part))
    scanned = bucketed_running(rows, ["experiment_id"], "_part", ["epoch"], "value", "best_value", how="max")
    before = bucketed_lag(scanned, ["experiment_id"], "_part", ["epoch"], "best_value", "_previous")
    summary = metrics.groupBy("experiment_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.max("epoch").alias("_last"),
        F.max(F.struct("value", (-F.col("epoch")).alias("e"))).alias("_best"),
    )
    joined = join_group_summary(before, summary, ["experiment_id"], "_n", ["epoch"])
    return joined.select(
        "experiment_id", "epoch", "value", "best_value",
        (F.col("_previous").isNull() | (F.col("value") > F.col("_previous"))).alias("is_new_best"),
        (F.col("epoch") == -F.col("_best.e")).alias("is_best"),
        (F.col("epoch") == F.col("_last")).alias("is_latest"),
        (F.col("epoch") > F.col("_last") - keep).alias("is_kept"),
    )


def parent_versions(log: DataFrame) -> DataFrame:
    """Each version of a data set with the version before it, in version order."""
    parsed = (
        log.select("dataset", "version").distinct()
        .withColumn("_v", versions.parse(F.col("version")))
        .withColumn("_minor", F.struct("_v.major", "_v.minor"))
    )
    linked = bucketed_lag(parsed, ["dataset"], "_minor", ["_v", "version"], "version", "parent_version")
    return linked.select("dataset", "version", "parent_version")


def curation(events: DataFrame, limit: int = config.MAX_PENDING_REVIEW) -> DataFrame:
    """Replay curation actions: create, submit, approve, reject.

    A create starts a draft. The first submit after it leads to review and the first
    decision after that ends it; every other action is illegal and changes nothing. The
    open reviews over all entries are counted along, and marked where above the limit.
    Both scans, per entry and over all, run over ranges of even size.
    """
    order = list(ORDER)
    action = F.col("action")
    rows = events.withColumn("_create", (action == "create").cast("long"))
    placed_rows = ranged(rows.select("entry_id", *order, "action", "_create"), ["entry_id"], order)
    numbered = bucketed_running(placed_rows, ["entry_id"], "_range", order, "_create", "session").drop("_range")
    at = F.struct(*order)
    key = ["entry_id", "session"]
    submits = numbered.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.min(F.when(action == "submit", at)).alias("_submit"))
    with_submit = join_group_summary(numbered, submits, key, "_n", order)
    decides = action.isin("approve", "reject") & (at > F.col("_submit"))
    decisions = with_submit.groupBy(*key).agg(
        F.count(F.lit(1)).alias("_m"), F.min(F.when(decides, F.struct(*order, "action"))).alias("_decision")
    )
    placed = join_group_summary(with_submit.drop("_n"), decisions, key, "_m", order).drop("_m")
    started = F.col("session") > 0
    decided_at = F.when(F.col("_decision").isNotNull(), F.struct(*[F.col(f"_decision.{c}") for c in order]))
    legal = (action == "create") | (started & ((at == F.col("_submit")) | (at == decided_at)))
    verdict = F.when(F.col("_decision.action") == "approve", "approved").otherwise("rejected")
    status = (
        F.when(~started, None)
        .when(at >= decided_at, verdict)
        .when(at >= F.col("_submit"), "pending_review")
        .otherwise("draft")
    )
    judged = placed.select(
        "entry_id", *order, "action", "session",
        F.coalesce(legal, F.lit(False)).alias("legal"), status.alias("status"),
    )
    # A new draft takes an entry that was still under review out of it.
    left_open = submits.join(decisions, key).where("session > 0 AND _submit IS NOT NULL AND _decision IS NULL").select(
        "entry_id", (F.col("session") + 1).alias("session"), F.lit(1).alias("_open")
    )
    change = (
        F.when(~F.col("legal"), 0)
        .when(F.col("action") == "submit", 1)
        .when(F.col("action") == "create", -F.coalesce("_open", F.lit(0)))
        .otherwise(-1)
    )
    moved = judged.join(left_open, ["entry_id", "session"], "left").withColumn("_change", change).drop("_open")
    counted = bucketed_running(ranged(moved, [], order), [], "_range", order, "_change", "pending")
    return counted.select("entry_id", *order, "action", "legal", "status", "pending", (F.col("pending") > limit).alias("over_limit"))


def current_status(curated: DataFrame) -> DataFrame:
    last = F.max(F.struct(*ORDER, "status")).alias("_l")
    return curated.where("status IS NOT NULL").groupBy("entry_id").agg(last).select("entry_id", F.col("_l.status").alias("status"))


def top_metrics(metrics: DataFrame, k: int) -> DataFrame:
    """The ``k`` lowest values per experiment."""
    return top_k(metrics.where("value IS NOT NULL"), ["experiment_id"], ["value", *ORDER], k)
