"""What tools, work lists and screens show, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import statistics, views
from ..sources import part10
from .files import _files
from .registry import query
from .tables import PIXELS, frames, instances, pixels, spread, table


@query("""WITH p AS (SELECT *, lpad(CAST(p_partkey AS VARCHAR), 8, '0') || '.dcm' AS file_path, p_partkey % 50 > 3 AS whole FROM part WHERE p_partkey % 50 > 2), v AS (
  SELECT file_path, unnest(['PatientName', 'PatientID', 'Modality', 'Rows', 'Columns', 'SamplesPerPixel', 'StudyInstanceUID', 'SeriesInstanceUID']) AS name,
    unnest([p_name, '(redacted)', p_brand, CASE WHEN whole THEN CAST(p_size AS VARCHAR) ELSE '0' END, CASE WHEN whole THEN CAST(p_size + 1 AS VARCHAR) ELSE '0' END, '1', CASE WHEN whole THEN '1.2.' || p_partkey END, CASE WHEN whole THEN '1.3.' || p_partkey % 7 END]) AS value FROM p)
SELECT * FROM v WHERE value IS NOT NULL""")
def inspected_files(spark: SparkSession, d: str) -> DataFrame:
    return views.inspected(part10.instance_rows(part10.elements(_files(spark, d))), everything=True)


def _rows(df: DataFrame, **values: Column) -> DataFrame:
    """Element rows (file_path, path, values, numbers) of the paths that are not null; in names ``__`` stands for ``[0]/`` and ``_n`` for an item."""
    listed = F.array(*(F.struct(F.lit(name[1:].replace("_1_", "[1]/").replace("__", "[0]/")).alias("path"), F.array(v.cast("string")).alias("values"), F.array(v.try_cast("double")).alias("numbers")) for name, v in values.items()))
    return df.select("file_path", F.inline(F.filter(listed, lambda e: e["values"][0].isNotNull())))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS file_path, c_name AS patient_name, CASE WHEN c_custkey % 2 = 0 THEN 'P' || c_custkey END AS patient_id, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN 'OT' ELSE 'MR' END AS modality, CASE WHEN c_custkey % 3 <> 0 THEN 'S' || c_custkey END AS step_id,
  CASE WHEN c_custkey % 3 <> 0 THEN 'S' || c_custkey WHEN c_custkey % 2 = 0 THEN 'P' || c_custkey ELSE 'worklist-item' END AS stable, concat_ws(' - ', c_name, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN 'OT' ELSE 'MR' END, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment ELSE 'whole' END) AS line FROM customer""")
def worklist_rows(spark: SparkSession, d: str) -> DataFrame:
    """Work-list entries out of element rows: some without a step, some whose step has no modality."""
    c = spread(table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), "c_custkey").withColumn("file_path", F.col("c_custkey").cast("string"))
    k = F.col("c_custkey")
    step = lambda v: F.when(k % 3 != 0, v)
    rows = _rows(
        c, t00100010=F.col("c_name"), t00100020=F.when(k % 2 == 0, F.concat(F.lit("P"), k.cast("string"))).otherwise(F.lit("  ")), t00080060=F.when(k % 3 != 0, F.lit("OT")), t00321060=F.lit("whole"), t00400100__00080060=F.when((k % 3 != 0) & (k % 5 != 0), "MR"),
        t00400100__00400009=step(F.concat(F.lit("S"), k.cast("string"))), t00400100__00400007=step(F.col("c_mktsegment")), t00400100_1_00400009=step(F.lit("second")),
    )
    return views.worklist_items(rows).select("file_path", "patient_name", "patient_id", "modality", "step_id", "stable", "line")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS file_path, CASE WHEN o_orderkey % 11 <> 0 THEN '1.' || o_orderkey END AS transaction, CASE WHEN o_orderkey % 11 = 0 OR o_orderkey % 4 = 3 THEN 'malformed' WHEN o_orderkey % 4 = 0 THEN 'committed' WHEN o_orderkey % 4 = 1 THEN 'failed' ELSE 'partial' END AS status,
  CASE o_orderkey % 4 WHEN 0 THEN 'a:false:' WHEN 1 THEN 'b:true:272' WHEN 2 THEN 'a:false:,b:true:272' ELSE '' END AS refs FROM orders""")
def commitment_report_rows(spark: SparkSession, d: str) -> DataFrame:
    """Commitment reports out of element rows: committed, failed, partial, and malformed ones."""
    k = F.col("o_orderkey")
    kind = lambda *n: F.when((k % 4).isin(*n), F.lit("1.2.840"))
    rows = _rows(
        table(spark, d, "orders").withColumn("file_path", k.cast("string")), t00081195=F.when(k % 11 != 0, F.concat(F.lit("1."), k.cast("string"))), t00080005=F.lit("ISO_IR 192"), t00081199__00081150=kind(0, 2), t00081199__00081155=F.when((k % 4).isin(0, 2, 3), "a"),
        t00081198__00081150=kind(1, 2), t00081198__00081155=F.when((k % 4).isin(1, 2), "b"), t00081198__00081197=F.when((k % 4).isin(1, 2), 272),
    )
    found = views.commitment_reports(rows)
    told = F.transform("references", lambda r: F.concat_ws(":", r["sop_uid"], r["failed"].cast("string"), F.coalesce(r["reason"].cast("string"), F.lit(""))))
    return found.select("file_path", "transaction", "status", F.coalesce(F.array_join(told, ","), F.lit("")).alias("refs"))


@query("""SELECT o_orderkey, 'pending' AS listed FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 5 < 3 UNION ALL SELECT o_orderkey, 'failed' FROM orders WHERE o_orderkey % 3 = 1""")
def queue_views(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    q = table(spark, d, "orders").select(k, F.get(F.array(*map(F.lit, ("pending", "failed", "sent"))), (k % 3).cast("int")).alias("state"), (k % 5).alias("attempts"), F.lit(3).alias("max_attempts"))
    return views.pending(q).select(k, F.lit("pending").alias("listed")).unionByName(views.failed(q).select(k, F.lit("failed").alias("listed")))


@query("SELECT c_name AS patient_name, CAST(o_custkey AS VARCHAR) AS patient_id, CAST(o_orderkey AS VARCHAR) AS study_uid, 'UNKNOWN' AS modality FROM orders JOIN customer ON c_custkey = o_custkey JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON l_orderkey = o_orderkey")
def patient_list(spark: SparkSession, d: str) -> DataFrame:
    """A row for each patient and study, by name."""
    rows = views.patient_rows(instances(spark, d).withColumn("modality", F.concat(F.lit("Z"), "modality"))).distinct()
    return views.by_name(rows)


@query("SELECT sop_uid FROM (SELECT concat_ws('.', l_orderkey, l_suppkey, l_partkey, l_linenumber, l_extendedprice) AS sop_uid, l_orderkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey) WHERE l_orderkey = 7")
def study_instances(spark: SparkSession, d: str) -> DataFrame:
    return views.instances_of(instances(spark, d), "7").select("sop_uid")


@query(f"""WITH {PIXELS}, lim AS (SELECT image_id, CAST(min(value) AS DOUBLE) AS low, CAST(max(value) AS DOUBLE) AS high, count(*) AS n FROM px GROUP BY image_id),
h AS (SELECT image_id, low, high, n, CAST(CASE WHEN high > low THEN floor((value - low) / (high - low) * 255) ELSE 0 END AS INT) AS bin, count(*) AS pixels FROM px JOIN lim USING (image_id) GROUP BY ALL),
r AS (SELECT *, sum(pixels) OVER (PARTITION BY image_id ORDER BY bin ROWS UNBOUNDED PRECEDING) AS reached FROM h), b AS (SELECT image_id, low, high, min(CASE WHEN reached >= floor(n * 0.01) THEN bin END) AS b1, min(CASE WHEN reached >= floor(n * 0.99) THEN bin END) AS b99 FROM r GROUP BY ALL),
a AS (SELECT image_id, ((low + (b1 + 0.5) * (high - low) / 256) + (low + (b99 + 0.5) * (high - low) / 256)) / 2 AS c, greatest((b99 - b1) * (high - low) / 256, 1.0) AS w, image_id % 4 AS mode, image_id % 3 AS k FROM b),
g AS (SELECT image_id, sum((place + 1) * CASE WHEN image_id % 2 = 0 THEN 255 - value // 16 ELSE value // 16 END) AS x FROM (SELECT image_id, t.p AS place, value FROM range(16) t(p) JOIN px ON px.place = (t.p // 4) * 2 * 8 + (t.p % 4) * 2) GROUP BY image_id)
SELECT image_id, round(CASE WHEN mode = 1 THEN -600 WHEN mode = 2 THEN 7 WHEN mode = 3 AND k > 0 THEN 40 ELSE c END, 6)::DOUBLE AS center, round(CASE WHEN mode = 1 THEN 1500 WHEN mode = 2 THEN 9 WHEN mode = 3 AND k > 0 THEN 400 ELSE w END, 6)::DOUBLE AS width,
  CASE WHEN k = 0 THEN '80.0:2000.0:second:1' ELSE '40.0:400.0::0,80.0:2000.0:second:1' END AS windows, CASE image_id % 4 WHEN 0 THEN '0,1;2' WHEN 1 THEN '0,1,2' WHEN 2 THEN '0;1;2' END AS fragments, CAST(x AS BIGINT) AS thumbnail FROM a JOIN g USING (image_id)""")
def screen_values(spark: SparkSession, d: str) -> DataFrame:
    """The window of a screen's mode, the windows that a header offers, the fragments of frames, and small pictures of bytes."""
    n = F.col("image_id")
    auto = statistics.auto_window(pixels(spark, d)).select("image_id", F.struct("center", "width").alias("auto"))
    rows = frames(spark, d).join(auto, "image_id")
    window = lambda c, w: F.struct(F.lit(float(c)).alias("center"), (F.lit(float(w)) if not isinstance(w, Column) else w).alias("width"))
    mode = F.get(F.array(*map(F.lit, ("automatic", "preset", "custom", "file"))), (n % 4).cast("int"))
    shown = views.resolved_window(mode, F.lit("LUNG"), window(7, 9), window(40, F.when(n % 3 > 0, 400.0).otherwise(0.0)), F.col("auto"))
    offered = views.display_windows(F.array(F.lit(40.0), F.lit(80.0), F.lit(1.0)), F.array(F.when(n % 3 > 0, 400.0).otherwise(0.0), F.lit(2000.0)), F.array(F.lit(" "), F.lit("second")), window(1, 1))
    told = F.transform(offered, lambda w: F.concat_ws(":", w["center"].cast("string"), w["width"].cast("string"), F.coalesce(w["explanation"], F.lit("")), w["place"].cast("string")))
    table_ = F.when(n % 4 == 0, F.array(F.lit(0), F.lit(26))).otherwise(F.array().cast("array<int>"))
    places = views.fragment_places(table_, F.array(F.lit(4), F.lit(6), F.lit(10)), F.get(F.array(*map(F.lit, (2, 1, 3, 7))), (n % 4).cast("int")))
    small = views.thumbnail_bytes(F.transform("pixels", lambda v: F.floor(v / 16).cast("int")), F.lit(8), 4, 4, F.lit(8), n % 2 == 0)
    mark = F.aggregate(F.transform(small, lambda v, i: (v * (i + 1)).cast("bigint")), F.lit(0).cast("bigint"), lambda a, v: a + v)
    return rows.select("image_id", F.round(shown["center"], 6).alias("center"), F.round(shown["width"], 6).alias("width"), F.array_join(told, ",").alias("windows"), F.array_join(F.transform(places, lambda p: F.array_join(p.cast("array<string>"), ",")), ";").alias("fragments"), mark.alias("thumbnail"))
