"""Best metric as state against the batch form, with a stop between batches."""

import datetime

import pytest

from labelloom.operators import history
from labelloom.streaming import metrics
from labelloom.streaming.checks import read_stream

SCHEMA = "experiment_id long, ts timestamp, event_id long, value double, event_type string"


@pytest.mark.parametrize("mode", ["min", "max"])
def test_state_survives_a_restart(spark, tmp_path, mode):
    start = datetime.datetime(2024, 1, 1)
    # ties arrive in later batches with earlier and later times
    values = [(1, 5, 2.0), (1, 9, 1.0), (2, 1, None), (3, 1, 7.0), (1, 2, 2.0), (1, 1, 1.0), (2, 7, -3.0), (3, 4, 7.0), (4, 1, 0.5), (1, 30, 1.0), (2, 8, float("nan")), (3, 0, 7.0), (5, 1, None), (2, 2, 9.0)]
    rows = [(e, start + datetime.timedelta(minutes=m), i, v, "x") for i, (e, m, v) in enumerate(values)]
    batches = [rows[:5], rows[5:9], rows[9:]]
    metrics.use_state_store(spark)
    seen = {}

    def keep(frame, _):
        for r in frame.collect():
            seen[r.experiment_id] = (r.value, r.ts, r.event_id)

    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = read_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], SCHEMA).schema, 1)
        query = metrics.best_metric(stream, mode).writeStream.outputMode("update").foreachBatch(keep)
        # each run stops after its files and the next one starts from the checkpoint
        query.option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()
        assert k or seen[1][0] == (1.0 if mode == "min" else 2.0)
    clean = spark.createDataFrame([r for r in rows if r[3] == r[3]], SCHEMA)
    expected = {r.experiment_id: (r.value, r.ts, r.event_id) for r in history.best_metric(clean, mode).collect()}
    assert seen == expected
