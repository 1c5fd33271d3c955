"""The driver's tables under the names of imaging concepts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, *key: str) -> DataFrame:
    """``rows`` dealt by a key over as many tasks as shuffles have: a table in one file of few row groups is else read, and all that follows is done, by as few tasks."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)


def instances(spark: SparkSession, d: str) -> DataFrame:
    """Line items as instances of the studies that orders are, of the patients that customers are."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("patient_name"), F.col("c_mktsegment").alias("institution"))
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
    i = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_linenumber", "l_returnflag", "l_quantity", "l_extendedprice")
    return i.join(o, i.l_orderkey == o.o_orderkey).join(c, "o_custkey").select(
        "patient_name", F.col("o_custkey").cast("string").alias("patient_id"), "institution", F.col("o_orderkey").cast("string").alias("study_uid"), F.date_format("o_orderdate", "yyyyMMdd").alias("study_date"), F.col("o_orderpriority").alias("study_description"),
        F.concat_ws(".", "l_orderkey", "l_suppkey").alias("series_uid"), F.concat_ws(".", "l_orderkey", "l_suppkey", "l_partkey", "l_linenumber", "l_extendedprice").alias("sop_uid"), F.col("l_returnflag").alias("modality"),
        F.col("l_linenumber").alias("instance_number"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("projection"),
    )


#: ``instances`` in SQL.
INSTANCES = """inst AS (
  SELECT c_name AS patient_name, CAST(o_custkey AS VARCHAR) AS patient_id, c_mktsegment AS institution, CAST(o_orderkey AS VARCHAR) AS study_uid, strftime(o_orderdate, '%Y%m%d') AS study_date, o_orderpriority AS study_description,
    concat_ws('.', l_orderkey, l_suppkey) AS series_uid, concat_ws('.', l_orderkey, l_suppkey, l_partkey, l_linenumber, l_extendedprice) AS sop_uid, l_returnflag AS modality, l_linenumber AS instance_number, l_quantity AS quantity, l_extendedprice AS projection
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""


def pixels(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as 8 x 8 pictures: a row per pixel, 12 bits."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("place", "x"))
    return e.select("image_id", "place", F.floor((F.col("x").cast("double") + 1.0) * 2048.0).cast("int").alias("value"))


#: ``pixels`` in SQL.
PIXELS = """px AS (
  SELECT vec_id AS image_id, CAST(place - 1 AS INT) AS place, CAST(floor((CAST(x AS DOUBLE) + 1.0) * 2048.0) AS INT) AS value
  FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS place FROM embeddings))"""


def frames(spark: SparkSession, d: str) -> DataFrame:
    """The same pictures as one array each."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), F.transform("embedding", lambda x: F.floor((x.cast("double") + 1.0) * 2048.0).cast("int")).alias("pixels"))
