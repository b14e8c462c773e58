"""The job stream ends in the states that the batch replay gives."""

from datetime import datetime

from test_operators import ENDS, EVENTS

from foliospark.streaming import jobs

SCHEMA = "job_key string, event string, at timestamp_ntz, event_id int"


def test_stream_matches_replay(spark, tmp_path):
    rows = [(k, e, datetime(2024, 1, 1, 0, i), i) for i, (k, e) in enumerate(EVENTS)]
    for part in (rows[:7], rows[7:]):  # two micro-batches: state outlives the first
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events"))
    query = (jobs.job_stream(events).writeStream.format("memory").queryName("job_states").outputMode("update")
             .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
    query.awaitTermination(120)
    assert query.exception() is None
    seen: dict = {}
    for r in spark.table("job_states").collect():
        seen.setdefault(r["job_key"], []).append((r["state"], r["attempt"]))
    assert {k: v[-1] for k, v in seen.items()} == ENDS
