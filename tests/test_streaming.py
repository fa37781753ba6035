"""Streams against batch queries, restarts included."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tempora.operators import measurements as M
from tempora.operators import processors as P
from tempora.plans.policy import Query
from tempora.plans.timeline import Field, Timeline
from tempora.streaming import signals

DIR = "/root/testdata/sf0.001"


def build(events):
    t = Timeline.of(events, "user_id", "ts", ["event_id"], {"k": Field("string", source="event_type"), "v": Field("double", source="value")}, True, ["event_id"])
    _, session = P.session_ids(t["k"].clock(), "12h")
    q = Query(t, reset=session).metric("m", M.duration_true(t["k"] == "view").scoped(session), interval="i").metric("s", session)
    q.metric("live", P.liveness(t["k"].clock(), F.col("k") == "view", "6h", lambda e: e["k"] == "view"))
    return q.metric("latch", P.level_latch(t["k"] == "view", t["v"], "6h", "double"))


@pytest.mark.parametrize("restarts", [0, 2])
def test_stream_equals_batch(spark, tmp_path, restarts):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", signals.STORE)
    src = spark.read.parquet(f"{DIR}/events.parquet").select("user_id", "event_id", "ts", "event_type", "value")
    far = src.select("user_id", F.lit(-1).cast("long").alias("event_id"), F.lit("2031-01-01").cast("timestamp_ntz").alias("ts"), "event_type", "value").limit(1)
    middle = src.where("event_id < 500"), src.where("event_id >= 500")
    folder, out, mark = (str(tmp_path / n) for n in ("in", "out", "cp"))
    parts = [middle[0].where("event_id % 2 = 1").unionByName(middle[0].where("event_id % 2 = 0")), middle[1], far]
    for i, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(folder)
        if i < 2 and i >= restarts:
            continue
        stream = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(folder)
        rows = signals.stream(build(stream), "user_id", None, {"event_id": "event_id"})
        q = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).outputMode("append").start()
        q.processAllAvailable()
        q.stop()
    got = sorted(map(tuple, spark.read.parquet(out).where("event_id >= 0").collect()))
    want = sorted(map(tuple, build(src).run("user_id", None, {"event_id": "event_id"}).collect()))
    # the entity of the event far ahead has one more liveness question open in the batch
    assert got == want and len(got) == 1000
