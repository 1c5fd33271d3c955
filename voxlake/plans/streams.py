"""Streams over the driver's tables, run until they have read all, with their state in the state store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rounds import shared_folder
from ..streaming import tracking
from .registry import query
from .tables import table

#: Seconds after which a key is forgotten: longer than the tables' time.
_PATIENCE = 20 * 365 * 86_400.0
#: Rows of a bucket of keys.
_BUCKET = 10_000


def _buckets(rows: DataFrame) -> int:
    """As many buckets of keys as the rows need: their states stay of one size as tables grow."""
    return max(64, rows.count() // _BUCKET)


def _streamed(spark: SparkSession, rows: DataFrame, make) -> DataFrame:
    """What ``make`` appends for ``rows``, read as a stream in several batches."""
    tracking.with_state_store(spark)
    source, sink, checkpoint = (shared_folder(spark, f"stream-{n}") for n in ("source", "sink", "checkpoint"))
    files = max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows.repartition(files).write.parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files // 2).parquet(source).withWatermark("at", "1 minute")
    run = make(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(sink)


@query("""WITH s AS (SELECT user_id, event_id % 4 AS slice, max(event_id % 3) AS layer FROM events GROUP BY ALL)
SELECT CAST(user_id AS VARCHAR) AS volume, count(*) AS slices, sum(layer)::BIGINT AS layers, count(*) = 4 AS complete FROM s GROUP BY user_id""")
def volume_events(spark: SparkSession, d: str) -> DataFrame:
    """Events as layers of the four slices of users' volumes: how many slices came, their highest layers, and whether all were there."""
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("volume"), (F.col("event_id") % 4).cast("int").alias("slice"), (F.col("event_id") % 3).cast("int").alias("layer"), F.lit(4).alias("total"), F.lit("2024-01-01").cast("timestamp").alias("at"))
    found = _streamed(spark, e, lambda s: tracking.volume_progress(s, _PATIENCE, _buckets(e)))
    highest = found.where("slice is not null").groupBy("volume", "slice").agg(F.max("layer").alias("layer"))
    complete = found.groupBy("volume").agg(F.coalesce(F.bool_or(F.col("event") == "complete"), F.lit(False)).alias("complete"))
    return highest.groupBy("volume").agg(F.count("*").alias("slices"), F.sum("layer").alias("layers")).join(complete, "volume")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS transaction, 'i' || i AS instance, CASE i WHEN 0 THEN 'committed' WHEN 1 THEN 'failed' ELSE 'missing' END AS status, CASE i WHEN 1 THEN CAST(1 + o_custkey % 300 AS INTEGER) END AS reason FROM orders, range(3) t(i) WHERE o_orderkey % 4 <> 0""")
def commitment_events(spark: SparkSession, d: str) -> DataFrame:
    """Orders as commitment requests for three instances; reports, which every fourth lacks, name one as stored and one as failed."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("transaction"), "o_orderkey", "o_custkey", F.lit("2024-01-01").cast("timestamp").alias("at"))
    names = lambda *n: F.array(*map(F.lit, n)).alias("instances")
    requests = o.select("transaction", F.lit("request").alias("kind"), names("i0", "i1", "i2"), F.array().cast("array<string>").alias("failed"), F.array().cast("array<int>").alias("reasons"), "at")
    reports = o.where("o_orderkey % 4 <> 0").select("transaction", F.lit("report").alias("kind"), names("i0"), F.array(F.lit("i1")).alias("failed"), F.array((1 + F.col("o_custkey") % 300).cast("int")).alias("reasons"), "at")
    return _streamed(spark, requests.unionByName(reports), lambda s: tracking.commitments(s, _PATIENCE, _buckets(o)))
