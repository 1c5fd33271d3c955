"""Answers of imaging web services, recorded from the driver's tables and asked for again; batches put into a store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import elements
from ..operators.rounds import shared_folder, small_batches
from ..operators.running import with_running_sums
from ..sources import store, web
from .registry import query
from .tables import table

#: Studies of a recorded page, and partitions that ask for pages.
_PAGE, _PARTITIONS = 500, 8


def _pushing(spark: SparkSession) -> None:
    """Spark hands filters to data sources in Python only where it is told to."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def _json(**found: tuple[str, Column]) -> Column:
    """A data set in JSON; empty arrays are left out with their elements."""
    return F.to_json(F.struct(*(F.when(F.size(value) > 0, F.struct(F.lit(vr).alias("vr"), value.alias("Value"))).alias(tag.removeprefix("t")) for tag, (vr, value) in found.items())))


def _recorded(spark: SparkSession, responses: DataFrame) -> web.RecordedTransport:
    folder = shared_folder(spark, "web")
    with small_batches(spark):
        web.record(responses, folder).write.format("noop").mode("overwrite").save()
    return web.RecordedTransport(folder)


_STUDY_SQL = "SELECT '1.2.' || o_orderkey AS study_uid, CAST(o_custkey AS VARCHAR) AS patient_id, 'C^' || o_custkey AS patient_name, strftime(o_orderdate, '%Y%m%d') AS study_date, o_orderpriority AS description, o_orderkey % 5 AS series FROM orders"


def _study_pages(spark: SparkSession, d: str) -> DataFrame:
    """Answers to a search for all studies, page by page; empty ones follow the last."""
    o = table(spark, d, "orders")
    patient = F.col("o_custkey").cast("string")
    study = _json(
        t0020000D=("UI", F.array(F.concat(F.lit("1.2."), F.col("o_orderkey").cast("string")))), t00100020=("LO", F.array(patient)), t00100010=("PN", F.array(F.struct(F.concat(F.lit("C^"), patient).alias("Alphabetic")))),
        t00080020=("DA", F.array(F.date_format("o_orderdate", "yyyyMMdd"))), t00081030=("LO", F.array("o_orderpriority")), t00080061=("CS", F.array(F.lit("CT"), F.lit("MR"))), t00201206=("IS", F.array(F.col("o_orderkey") % 5)),
    )
    placed = with_running_sums(o.select("o_orderkey", study.alias("json"), F.lit(1).cast("bigint").alias("one")), [], ["o_orderkey"], {"n": "one"}).withColumn("page", F.floor(F.col("n") / _PAGE))
    pages = placed.groupBy("page").agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "json"))), lambda x: x["json"]), ","), F.lit("]")).alias("body"))
    after = placed.agg(F.coalesce(F.max("page"), F.lit(-1)).alias("last")).select(F.explode(F.sequence(F.col("last") + 1, F.col("last") + _PARTITIONS)).alias("page"), F.lit("").alias("body"))
    request = F.concat(F.lit(f"studies?limit={_PAGE}&offset="), (F.col("page") * _PAGE).cast("string"))
    return pages.unionByName(after).select(request.alias("request"), F.lit(web.JSON).alias("content_type"), F.encode("body", "UTF-8").alias("body"))


@query(f"SELECT study_uid, patient_id, patient_name, study_date, description, series, 'CT,MR' AS modalities FROM ({_STUDY_SQL})")
def web_studies(spark: SparkSession, d: str) -> DataFrame:
    """A search for all studies through the data source."""
    _pushing(spark)
    spark.dataSource.register(web.study_source("recorded_studies", _recorded(spark, _study_pages(spark, d))))
    found = spark.read.format("recorded_studies").option("page", _PAGE).option("partitions", _PARTITIONS).load()
    return found.select("study_uid", "patient_id", "patient_name", "study_date", "description", "series", F.array_join("modalities", ",").alias("modalities"))


@query("SELECT '1.3.' || s_suppkey AS study_uid, 200 AS status, tag, CASE tag WHEN 1048592 THEN s_name WHEN 2097165 THEN '1.3.' || s_suppkey ELSE CAST(CAST(i AS VARCHAR) AS VARCHAR) END AS value, i AS instance FROM supplier, range(3) t(i), (VALUES (1048592), (2097165), (2097171)) v(tag) WHERE s_suppkey % 7 <> 3 UNION ALL SELECT '1.3.' || s_suppkey, 404, NULL, NULL, NULL FROM supplier WHERE s_suppkey % 7 = 3")
def web_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Metadata of each supplier's study, three instances each; of some the service knows nothing."""
    s = table(spark, d, "supplier").withColumn("uid", F.concat(F.lit("1.3."), F.col("s_suppkey").cast("string")))
    instance = lambda i: _json(t0020000D=("UI", F.array("uid")), t00100010=("PN", F.array(F.struct(F.col("s_name").alias("Alphabetic")))), t00200013=("IS", F.array(F.lit(i))))
    known = s.where("s_suppkey % 7 <> 3").select(web.metadata_request(F.col("uid")).alias("request"), F.lit(web.JSON).alias("content_type"), F.encode(F.concat(F.lit("["), F.concat_ws(",", *map(instance, range(3))), F.lit("]")), "UTF-8").alias("body"))
    asked = s.select(F.col("uid").alias("study_uid"), web.metadata_request(F.col("uid")).alias("request"))
    told = web.answers(asked, _recorded(spark, known), web.JSON)
    listed = told.select("study_uid", "status", F.posexplode_outer(F.from_json(F.decode("body", "UTF-8"), "array<string>")).alias("instance", "json"))
    rows = elements.json_elements(listed.select(F.struct("study_uid", "instance").alias("file_path"), "json").where("json is not null"))
    good = rows.select(F.col("file_path.study_uid").alias("study_uid"), F.lit(200).alias("status"), "tag", F.get("values", 0).alias("value"), F.col("file_path.instance").cast("bigint").alias("instance"))
    return good.unionByName(told.where("status <> 200").select("study_uid", "status", *(F.lit(None).cast(k).alias(c) for c, k in (("tag", "int"), ("value", "string"), ("instance", "bigint")))))


@query("""SELECT '1.3.' || s_suppkey AS study_uid, i AS part, CASE i WHEN 0 THEN 'application/octet-stream' ELSE 'text/plain' END AS part_type, CASE i WHEN 0 THEN sha256('\\xC3\\xA9'::BLOB || encode(s_name)) ELSE sha256('--x' || chr(13) || chr(10) || s_suppkey) END AS digest FROM supplier, range(2) t(i)
UNION ALL SELECT '1.3.' || s_suppkey, 2, 'application/dicom', sha256('file ' || s_suppkey) FROM supplier""")
def web_bulk(spark: SparkSession, d: str) -> DataFrame:
    """Bulk data in two parts, and an object in the older way, of each supplier's study."""
    s = table(spark, d, "supplier").select(F.concat(F.lit("1.3."), F.col("s_suppkey").cast("string")).alias("uid"), "s_name", F.col("s_suppkey").cast("string").alias("key"))
    body = F.concat(F.lit(b"--b.1\r\nContent-Type: application/octet-stream\r\n\r\n\xc3\xa9"), F.encode("s_name", "UTF-8"), F.lit(b"\r\n--b.1\r\ncontent-type: text/plain\r\nContent-ID: 1\r\n\r\n--x\r\n"), F.encode("key", "UTF-8"), F.lit(b"\r\n--b.1--\r\n"))
    bulk = F.concat(F.lit("bulk/"), F.col("uid"))
    single = web.object_request(F.col("uid"), F.lit("1.4"), F.concat(F.lit("1.5."), F.col("key")))
    responses = s.select(bulk.alias("request"), F.lit('multipart/related; type="application/octet-stream"; boundary="b.1"').alias("content_type"), body.alias("body")).unionByName(
        s.select(single.alias("request"), F.lit("application/dicom").alias("content_type"), F.encode(F.concat(F.lit("file "), "key"), "UTF-8").alias("body"))
    )
    transport = _recorded(spark, responses)
    found = web.parts(web.answers(s.select(F.col("uid").alias("study_uid"), bulk.alias("request"), F.lit(0).alias("first")), transport, web.MULTIPART))
    alone = web.parts(web.answers(s.select(F.col("uid").alias("study_uid"), single.alias("request"), F.lit(2).alias("first")), transport, web.FILE))
    return found.unionByName(alone).select("study_uid", (F.col("part") + F.col("first")).cast("bigint").alias("part"), "part_type", F.sha2("content", 256).alias("digest"))


@query("""WITH i AS (SELECT 'c' || c_custkey AS sop_uid, 1 AS b, 'first ' || c_name AS content FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT 'c' || c_custkey, 2, 'second ' || c_mktsegment FROM customer WHERE c_custkey % 2 = 0)
SELECT sop_uid, sha256(max_by(content, b)) AS digest, CAST(2 AS BIGINT) AS batches, (SELECT count(*) FROM i) AS stored, (SELECT count(*) FROM customer WHERE c_custkey % 5 = 0) AS failed FROM i GROUP BY sop_uid""")
def store_batches(spark: SparkSession, d: str) -> DataFrame:
    """Two batches put into a store, the first of them twice: the later one of an instance stays, rows without an identifier are not stored."""
    folder = shared_folder(spark, "store")
    spark.dataSource.register(store.store_target("instance_store", folder))
    c = table(spark, d, "customer")
    row = lambda uid, text: [F.lit("1.2").alias("study_uid"), F.lit("1.3").alias("series_uid"), uid.alias("sop_uid"), F.lit("1.4").alias("sop_class"), F.encode(text, "UTF-8").alias("content")]
    uid = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    first = c.where("c_custkey % 3 <> 0").select(*row(uid, F.concat(F.lit("first "), "c_name"))).unionByName(c.where("c_custkey % 5 = 0").select(*row(F.lit(None).cast("string"), F.lit("x"))))
    second = c.where("c_custkey % 2 = 0").select(*row(uid, F.concat(F.lit("second "), "c_mktsegment")))
    for name, batch in (("a", first), ("b", second), ("a", first)):
        batch.write.format("instance_store").option("batch", name).mode("append").save()
    told = store.batches(spark, folder).agg(F.count("*").alias("batches"), F.sum("stored").alias("stored"), F.sum("failed").alias("failed"))
    return store.instances(spark, folder).select("sop_uid", F.sha2("content", 256).alias("digest")).crossJoin(F.broadcast(told))
