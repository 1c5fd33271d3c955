"""Element tables and de-identification over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import anonymize, links
from .registry import query
from .tables import table


def _elements(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    e = lambda path, tag, vr, value: F.struct(F.lit(path).alias("path"), F.lit(tag).alias("tag"), F.lit(vr).alias("vr"), F.array(value).alias("values"))
    rows = F.array(
        e("00020010", 0x00020010, "UI", F.lit("1.2")), e("00080060", 0x00080060, "CS", F.col("c_mktsegment")), e("00100010", 0x00100010, "PN", F.col("c_name")), e("00100030", 0x00100030, "DA", F.lit("19700101")),
        e("00110001", 0x00110001, "LO", F.lit("private")), e("00280010", 0x00280010, "US", F.lit("4")), e("00400275", 0x00400275, "SQ", F.lit(None).cast("string")), e("00400275[0]/00100020", 0x00100020, "LO", F.col("c_custkey").cast("string")),
        e("00081010", 0x00081010, "SQ", F.lit(None).cast("string")), e("00081010[0]/00080060", 0x00080060, "CS", F.lit("CT")),
    )
    return c.select(F.col("c_custkey").cast("string").alias("file_path"), F.explode(rows).alias("e")).select("file_path", "e.*")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS file_path, path, disposition, CASE path WHEN '00080060' THEN c_mktsegment WHEN '00100010' THEN 'ANONYMIZED' WHEN '00280010' THEN '4' WHEN '00400275[0]/00100020' THEN 'ANON' WHEN '00400275' THEN '' END AS value
FROM customer, (VALUES ('00080060', 'kept'), ('00100010', 'changed'), ('00100030', 'removed'), ('00110001', 'removed'), ('00280010', 'kept'), ('00400275', 'kept'), ('00400275[0]/00100020', 'changed'), ('00081010', 'removed')) v(path, disposition)""")
def anonymized(spark: SparkSession, d: str) -> DataFrame:
    a = anonymize.apply_policy(_elements(spark, d), anonymize.policy_table(spark))
    return a.select("file_path", "path", "disposition", F.array_join("values", "\\").alias("value"))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS file_path, CAST(c_custkey % 256 AS INT) AS low, 'ACME ' || (c_custkey % 3) AS creator, CASE WHEN c_custkey % 256 < 4 THEN 'entry ' || (c_custkey % 256) END AS name FROM customer WHERE c_custkey % 3 < 2""")
def private_tags(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").withColumn("file_path", F.col("c_custkey").cast("string"))
    elements = c.select("file_path", (F.lit(0x00111000) + F.col("c_custkey") % 256).cast("int").alias("tag"))
    creators = c.where("c_custkey % 3 < 2").select("file_path", F.lit(0x00110010).alias("tag"), F.concat(F.lit("ACME "), (F.col("c_custkey") % 3).cast("string")).alias("value"))
    dictionary = spark.range(8).select(F.concat(F.lit("acme "), (F.col("id") % 2).cast("string"), F.lit(" ")).alias("creator"), F.floor(F.col("id") / 2).cast("int").alias("low_byte"), F.lit("LO").alias("vr"), F.concat(F.lit("entry "), F.floor(F.col("id") / 2).cast("string")).alias("name"))
    with_creator = links.with_private_creator(elements, creators, "file_path")
    return links.private_entries(with_creator, dictionary).select("file_path", F.col("tag").bitwiseAND(F.lit(0xFF)).alias("low"), "creator", "name")
