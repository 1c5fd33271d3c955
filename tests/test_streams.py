"""Streams with state: repeated, late and missing pieces, and restarts."""

from __future__ import annotations

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from voxlake.streaming import ingest, tracking

START = dt.datetime(2024, 1, 1)
ARRIVAL = "volume string, slice int, layer int, total int, at timestamp"
MESSAGE = "transaction string, kind string, instances array<string>, failed array<string>, reasons array<int>, at timestamp"


class Feed:
    """A folder of JSON files that a stream reads one at a time, and a table that it appends to; each run takes what is new."""

    def __init__(self, spark, tmp_path, kind, make):
        self.spark, self.kind, self.make = spark, kind, make
        self.source, self.sink, self.checkpoint = (str(tmp_path / n) for n in ("source", "sink", "checkpoint"))
        (tmp_path / "source").mkdir()
        self.n = 0
        tracking.with_state_store(spark)

    def add(self, *rows):
        names = [c.split()[0] for c in self.kind.split(", ")]
        with open(f"{self.source}/{self.n:03d}.json", "w") as f:
            for *values, minute in rows:
                f.write(json.dumps(dict(zip(names, [*values, (START + dt.timedelta(minutes=minute)).isoformat()], strict=True))) + "\n")
        os.utime(f"{self.source}/{self.n:03d}.json", (1_700_000_000 + self.n, 1_700_000_000 + self.n))
        self.n += 1

    def run(self):
        stream = self.spark.readStream.schema(self.kind).option("maxFilesPerTrigger", 1).json(self.source)
        query = self.make(stream.withWatermark("at", "1 minute")).writeStream.format("parquet").option("path", self.sink).option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
        return self.spark.read.parquet(self.sink).collect()


def test_volumes(spark, tmp_path):
    feed = Feed(spark, tmp_path, ARRIVAL, lambda s: tracking.volume_progress(s, 600))
    feed.add(("v", 0, 1, 3, 0), ("v", 2, 1, 3, 1), ("v", 2, 1, 3, 1), ("w", 0, 5, 2, 1))
    feed.add(("v", 2, 3, 3, 2), ("v", 2, 2, 3, 3))
    first = {(r.volume, r.event, r.slice, r.layer, r.received) for r in feed.run()}
    assert first == {("v", "slice", 0, 1, 1), ("v", "slice", 2, 1, 2), ("w", "slice", 0, 5, 1), ("v", "refined", 2, 3, 2)}
    # After a restart the state is there: a repeated slice says nothing, the missing one completes.
    feed.add(("v", 0, 1, 3, 3), ("v", 1, 1, 3, 3))
    second = {(r.volume, r.event, r.slice, r.layer, r.received) for r in feed.run()} - first
    assert second == {("v", "slice", 1, 1, 3), ("v", "complete", None, None, 3)}
    # Time goes on: the volume that lacks a slice expires, the complete one is forgotten without a word.
    feed.add(("x", 0, 1, 1, 60))
    feed.add(("x", 0, 1, 1, 61))
    rows = feed.run()
    third = {(r.volume, r.event, r.received, r.total, r.fraction) for r in rows} - {(r.volume, r.event, r.received, r.total, r.fraction) for r in rows if (r.volume, r.event, r.slice, r.layer, r.received) in first | second}
    assert third == {("x", "slice", 1, 1, 1.0), ("x", "complete", 1, 1, 1.0), ("w", "expired", 1, 2, 0.5)}


def test_commitments(spark, tmp_path):
    feed = Feed(spark, tmp_path, MESSAGE, lambda s: tracking.commitments(s, 600))
    feed.add(("t1", "request", ["a", "b", "c"], None, None, 0), ("t2", "report", ["x"], ["y"], [272], 0), ("t3", "request", ["q", "r"], None, None, 0))
    assert feed.run() == []
    feed.add(("t1", "report", ["a"], ["b"], [110], 1), ("t2", "request", ["x", "y", "y"], None, None, 1))
    feed.add(("t1", "report", ["a", "b", "c"], [], [], 2))
    settled = {(r.transaction, r.instance, r.status, r.reason) for r in feed.run()}
    assert settled == {("t1", "a", "committed", None), ("t1", "b", "failed", 110), ("t1", "c", "missing", None), ("t2", "x", "committed", None), ("t2", "y", "failed", 272)}
    feed.add(("t9", "request", ["z"], None, None, 90))
    feed.add(("t9", "request", ["z"], None, None, 91))
    assert {(r.transaction, r.instance, r.status, r.reason) for r in feed.run()} - settled == {("t3", "q", "expired", None), ("t3", "r", "expired", None)}


def test_layers_and_stored_references(spark, tmp_path):
    rows = [("a", 1, "one"), ("a", 3, "three"), ("a", 2, "two"), ("b", 1, "x")]
    spark.createDataFrame(rows, "volume string, layer int, payload string").write.json(str(tmp_path / "layers"))
    stream = spark.readStream.schema("volume string, layer int, payload string").json(str(tmp_path / "layers"))
    query = ingest.latest_layers(stream).writeStream.format("memory").queryName("layers").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(map(tuple, spark.table("layers").collect())) == [("a", 3, "three"), ("b", 1, "x")]
    stored = spark.createDataFrame([("a",), ("a",)], "volume string")
    query = ingest.committed(stream, stored, ["volume"]).writeStream.format("memory").queryName("stored").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert {(r.volume, r.committed) for r in spark.table("stored").collect()} == {("a", True), ("b", False)} and spark.table("stored").count() == 4


def test_breaker_on_a_stream(spark, tmp_path):
    calls = [("k", float(t), ok) for t, ok in ((0, False), (1, False), (2, False), (3, True), (40, False), (41, True))]
    spark.createDataFrame(calls, "key string, at double, ok boolean").coalesce(1).write.json(str(tmp_path / "calls"))
    stream = spark.readStream.schema("key string, at double, ok boolean").json(str(tmp_path / "calls"))
    query = ingest.circuit_breaker(stream, 3, 30.0).writeStream.format("memory").queryName("breaker").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [(r.at, r.allowed, r.state) for r in spark.table("breaker").orderBy("at").collect()] == [(0, True, "closed"), (1, True, "closed"), (2, True, "open"), (3, False, "open"), (40, True, "open"), (41, False, "open")]


def test_progress_listener(spark, tmp_path):
    spark.range(7).write.parquet(str(tmp_path / "rows"))
    seen = tracking.Progress()
    spark.streams.addListener(seen)
    try:
        query = spark.readStream.schema("id bigint").parquet(str(tmp_path / "rows")).groupBy().agg(F.count("*").alias("n")).writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
        query.awaitTermination(60)
        for _ in range(100):
            if query.id in seen.ended:
                break
            spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    finally:
        spark.streams.removeListener(seen)
    assert sum(n for _, n in seen.batches[query.id]) == 7


def test_keys_share_a_bucket(spark, tmp_path):
    """Keys of one bucket keep their own states and times, and the store has as many rows of values as buckets."""
    feed = Feed(spark, tmp_path, ARRIVAL, lambda s: tracking.volume_progress(s, 600, 1))
    feed.add(*((f"v{i}", 0, 1, 2, 0) for i in range(20)), (None, 0, 1, 2, 0))
    feed.add(("late", 0, 1, 2, 5), ("v0", 1, 1, 2, 5))
    feed.add(("x", 0, 1, 1, 13))
    feed.add(("x", 0, 1, 1, 14))
    ended = {(r.volume, r.event) for r in feed.run() if r.event != "slice"}
    assert ended == {*((f"v{i}", "expired") for i in range(1, 20)), (None, "expired"), ("v0", "complete"), ("x", "complete")}
    feed.add(("late", 1, 1, 2, 14), ("x", 0, 1, 1, 60))
    feed.add(("x", 0, 2, 1, 61))
    assert {(r.volume, r.event) for r in feed.run() if r.event not in ("slice", "expired")} == {("v0", "complete"), ("x", "complete"), ("late", "complete"), ("x", "refined")}
