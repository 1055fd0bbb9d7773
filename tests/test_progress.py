"""Counts of observed runs and of streams."""

import time

import pytest
from pyspark.sql import functions as F

from sextant.plans.progress import Listener, Watch


def test_observed_run(spark):
    told = []

    def broken(*_):
        raise RuntimeError

    watch = Watch(broken, lambda *x: told.append(x))
    first = watch.stage("read", spark.range(1000))
    out = watch.stage("kept", first.where("id % 3 = 0"))
    assert watch.run(out.collect)[0].id == 0 and watch.ms > 0
    assert watch.counts == {"read": 1000, "kept": 334} and [x[:2] for x in told] == [("read", 1000), ("kept", 334)]
    with pytest.raises(ValueError):
        watch.stage("read", first)


def test_listener(spark, tmp_path):
    told, listener = [], None
    listener = Listener(lambda *x: told.append(x))
    spark.streams.addListener(listener)
    try:
        for i in range(3):
            spark.range(i * 10, i * 10 + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        s = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        s = s.observe("all", F.count(F.lit(1)).alias("rows"), F.count_if(F.col("id") % 2 == 0).alias("even"))
        q = s.writeStream.format("noop").queryName("watched").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        for _ in range(100):
            if listener.seen.get("watched") and listener.seen["watched"].ended:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    seen = listener.seen["watched"]
    assert (seen.batches, seen.rows, seen.observed, seen.failure) == (3, 30, {"all.rows": 30, "all.even": 15}, None)
    assert sum(x[1] for x in told if x[0] == "watched") == 30
