"""Searches, groups, orders and joins of studies, series and instances over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import catalog, links, search, slices
from .registry import query
from .tables import INSTANCES, instances, table

_TIES = ["patient_id", "instance_number", "quantity", "projection", "modality"]


@query(f"""WITH {INSTANCES}, f AS (SELECT *, row_number() OVER (PARTITION BY study_uid ORDER BY sop_uid, {", ".join(_TIES)}) AS r FROM inst)
SELECT study_uid, patient_name, patient_id, study_date, modality FROM f WHERE r = 1 AND contains(lower(patient_name), '#0000') AND modality = 'R' ORDER BY sop_uid, {", ".join(_TIES)} LIMIT 50 OFFSET 5""")
def study_search(spark: SparkSession, d: str) -> DataFrame:
    found = search.search_studies(instances(spark, d), offset=5, limit=50, tie=_TIES, patient_name="#0000", modality="R")
    return search.study_summary(found)


@query(f"WITH {INSTANCES} SELECT study_uid, count(*) AS instances, min(modality) AS first_modality FROM inst WHERE study_date = '19960102' OR study_description = '1-URGENT' GROUP BY study_uid")
def study_filter_exact(spark: SparkSession, d: str) -> DataFrame:
    i = instances(spark, d)
    wanted = search.study_filter(i.columns, study_date="19960102") | search.study_filter(i.columns, study_description="1-URGENT")
    return i.where(wanted).groupBy("study_uid").agg(F.count("*").alias("instances"), F.min("modality").alias("first_modality"))


@query("SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '00011') OR contains(lower(CAST(c_custkey AS VARCHAR)), '00011') OR contains(lower(c_mktsegment), '00011')")
def patient_search(spark: SparkSession, d: str) -> DataFrame:
    return search.search_patients(table(spark, d, "customer"), "00011", ("c_name", "c_custkey", "c_mktsegment")).select("c_custkey", "c_name")


@query("SELECT event_id, user_id FROM events WHERE event_type = 'click' AND user_id = 7")
def worklist_match(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("user_id", F.col("user_id").cast("string"))
    return search.worklist(e, event_type="click", user_id="7", props=None).select("event_id", F.col("user_id").cast("bigint").alias("user_id"))


@query(f"WITH {INSTANCES} SELECT study_uid, count(*) AS files, count(DISTINCT series_uid) AS series FROM inst GROUP BY study_uid")
def group_studies(spark: SparkSession, d: str) -> DataFrame:
    return catalog.group_studies(instances(spark, d))


@query("SELECT CASE WHEN upper(event_type) IN ('CT','MR','DX','CR','US','MG','RF','XC','SC','PT','NM') THEN upper(event_type) ELSE 'UNKNOWN' END AS modality, count(*) AS n FROM (SELECT CASE event_id % 4 WHEN 0 THEN 'ct' WHEN 1 THEN 'MR' WHEN 2 THEN 'pt' ELSE event_type END AS event_type FROM events) GROUP BY 1")
def group_by_modality(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    kind = F.when(F.col("event_id") % 4 == 0, "ct").when(F.col("event_id") % 4 == 1, "MR").when(F.col("event_id") % 4 == 2, "pt").otherwise(F.col("event_type"))
    return catalog.group_by_modality(e.select(kind.alias("modality")))


@query("SELECT coalesce(strftime(CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderdate END, '%b %-d, %Y'), 'Unknown Date') AS day, count(*) AS n FROM orders GROUP BY 1")
def group_by_date(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return catalog.group_by_date(o, F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderdate")))


@query("SELECT o_orderkey, o_orderdate FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderdate END AS o_orderdate FROM orders) ORDER BY o_orderdate DESC NULLS LAST, o_orderkey")
def newest_first(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate")).alias("o_orderdate"))
    return search.by_date_newest(o, "o_orderdate", "o_orderkey")


@query(f"WITH {INSTANCES} SELECT patient_name, study_date, study_uid, series_uid, instance_number, sop_uid FROM inst ORDER BY patient_name, study_date, study_uid, series_uid, lpad(CAST(instance_number AS VARCHAR), 8, '0'), sop_uid")
def catalog_order(spark: SparkSession, d: str) -> DataFrame:
    rows = instances(spark, d).withColumn("file_path", F.col("sop_uid"))
    return rows.orderBy(*catalog.catalog_order()).select("patient_name", "study_date", "study_uid", "series_uid", "instance_number", "sop_uid")


@query("SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderdate DESC NULLS LAST, o_orderkey) AS position FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderdate END AS o_orderdate FROM orders)")
def newest_first_whole(spark: SparkSession, d: str) -> DataFrame:
    """All orders with their places in the order of ``newest_first``."""
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate")).alias("o_orderdate"))
    return search.numbered(search.by_date_newest(o, "o_orderdate", "o_orderkey"))


@query(f"WITH {INSTANCES} SELECT patient_name, study_date, study_uid, series_uid, instance_number, sop_uid, row_number() OVER (ORDER BY patient_name, study_date, study_uid, series_uid, lpad(CAST(instance_number AS VARCHAR), 8, '0'), sop_uid) AS position FROM inst")
def catalog_order_whole(spark: SparkSession, d: str) -> DataFrame:
    """All instances with their places in ``catalog_order``."""
    rows = instances(spark, d).withColumn("file_path", F.col("sop_uid"))
    return search.numbered(rows.orderBy(*catalog.catalog_order()).select("patient_name", "study_date", "study_uid", "series_uid", "instance_number", "sop_uid"))


@query(f"""WITH {INSTANCES} SELECT sop_uid AS file_path, CASE WHEN patient_id LIKE '%3' THEN 'Unknown Patient' ELSE patient_name END AS patient_name, patient_id, study_uid, series_uid, CASE WHEN modality = 'N' THEN 'OT' ELSE modality END AS modality,
  CASE WHEN study_date < '1995' THEN 'Unknown Date' ELSE study_date END AS study_date, instance_number, 'Unknown Location' AS institution FROM inst WHERE study_uid NOT LIKE '%4'""")
def study_rows(spark: SparkSession, d: str) -> DataFrame:
    i = instances(spark, d)
    files = i.select(
        F.col("sop_uid").alias("file_path"), F.when(~F.col("patient_id").endswith("3"), F.col("patient_name")).alias("patient_name"), "patient_id", F.lit("").alias("patient_sex"), F.lit(None).cast("string").alias("patient_age"),
        F.when(~F.col("study_uid").endswith("4"), F.col("study_uid")).alias("study_uid"), F.when(F.col("study_date") >= "1995", F.col("study_date")).alias("study_date"), "study_description", "series_uid",
        F.when(F.col("modality") != "N", F.col("modality")).otherwise("").alias("modality"), F.col("instance_number").cast("string").alias("instance_number"), F.lit("").alias("body_part"), F.lit("").alias("institution"), F.lit(1).alias("file_size"),
    )
    return catalog.study_metadata(files).select("file_path", "patient_name", "patient_id", "study_uid", "series_uid", "modality", "study_date", "instance_number", "institution")


@query(f"""WITH {INSTANCES} SELECT sop_uid AS file_path, patient_name, CASE WHEN series_uid LIKE '%7' THEN 'file-series-' || sop_uid ELSE series_uid END AS series_uid, CASE WHEN modality = 'N' THEN 'OT' ELSE modality END AS modality,
  instance_number > 2 AND modality <> 'A' AS has_pixels, CASE WHEN modality = 'A' THEN 'SEG' END AS kind FROM inst""")
def catalog_rows(spark: SparkSession, d: str) -> DataFrame:
    i = instances(spark, d)
    sop_class = F.when(F.col("modality") == "A", "1.2.840.10008.5.1.4.1.1.66.4").otherwise("1.2.840.10008.5.1.4.1.1.2")
    files = i.select(
        F.col("sop_uid").alias("file_path"), "patient_name", "patient_id", "study_date", "study_description", F.lit("").alias("series_description"), "study_uid", F.when(~F.col("series_uid").endswith("7"), F.col("series_uid")).alias("series_uid"), "sop_uid",
        F.when(F.col("modality") != "N", F.col("modality")).otherwise(" ").alias("modality"), sop_class.alias("sop_class_uid"), "instance_number", F.lit(1).alias("file_size"), F.when(F.col("instance_number") > 2, 4).otherwise(0).alias("columns"), F.lit(4).alias("rows"),
    )
    return catalog.catalog_row(files).select("file_path", "patient_name", "series_uid", "modality", "has_pixels", catalog.object_kind(F.col("sop_class_uid")).alias("kind"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS file_path, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN c_name END, o_orderstatus) AS patient_name, o_orderpriority AS study_description FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def catalog_merge(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    c = table(spark, d, "customer")
    directory = o.select(F.col("o_orderkey").cast("string").alias("file_path"), F.col("o_orderstatus").alias("patient_name"), F.col("o_orderpriority").alias("study_description"))
    files = o.where("o_orderkey % 2 = 0").join(c, o.o_custkey == c.c_custkey).select(F.col("o_orderkey").cast("string").alias("file_path"), F.col("c_name").alias("patient_name"), F.lit("").alias("study_description"))
    return catalog.merged(directory, files, ["patient_name", "study_description"])


@query("SELECT o_custkey, o_orderstatus, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS r FROM orders) WHERE r = 1")
def patient_identity(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_orderkey")
    return catalog.one_per_patient(o, "o_custkey", "o_orderstatus", ["o_orderkey"])


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def store_upsert(spark: SparkSession, d: str) -> DataFrame:
    return search.latest(table(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("""SELECT p_partkey, concat_ws(' • ', CASE WHEN p_size % 3 = 0 THEN p_brand ELSE p_type END, upper(substr(p_type, 1, 2)), CASE WHEN p_size > 0 THEN p_size || CASE WHEN p_size = 1 THEN ' image' ELSE ' images' END END) AS line FROM part""")
def study_lines(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select("p_partkey", catalog.study_line(F.when(F.col("p_size") % 3 == 0, F.col("p_brand")), F.col("p_type"), F.upper(F.substring("p_type", 1, 2)), F.col("p_size")).alias("line"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS INT) AS slice_index FROM lineitem")
def slice_order(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "lineitem").withColumn("file_name", F.concat_ws("-", F.lpad(F.col("l_partkey").cast("string"), 9, "0"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0"), F.lpad(F.col("l_quantity").cast("int").cast("string"), 4, "0")))
    return slices.ordered(w, "l_orderkey", "l_extendedprice", "l_linenumber", "file_name").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.col("slice_index").cast("int").alias("slice_index"))


_DELTAS = "d AS (SELECT l_orderkey, abs(l_extendedprice - lag(l_extendedprice) OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice)) AS delta FROM lineitem)"


@query(f"""WITH {_DELTAS}, m AS (SELECT l_orderkey, delta, median(delta) OVER (PARTITION BY l_orderkey) AS med FROM d WHERE delta > 0),
s AS (SELECT l_orderkey, round(first(med), 6) AS spacing, round(max(abs(delta - med)), 6) AS max_deviation, max(abs(delta - med)) > greatest(0.05, first(med) * 0.02) AS variable FROM m GROUP BY l_orderkey)
SELECT k.l_orderkey, spacing, max_deviation, variable FROM (SELECT DISTINCT l_orderkey FROM lineitem) k LEFT JOIN s ON s.l_orderkey = k.l_orderkey""")
def slice_spacing(spark: SparkSession, d: str) -> DataFrame:
    s = slices.spacing(table(spark, d, "lineitem").select("l_orderkey", "l_extendedprice"), "l_orderkey", "l_extendedprice")
    return s.select("l_orderkey", F.round("spacing", 6).alias("spacing"), F.round("max_deviation", 6).alias("max_deviation"), "variable")


@query(f"WITH {_DELTAS} SELECT l_orderkey, coalesce(bool_or(delta <= 500.0), false) AS duplicated FROM d GROUP BY l_orderkey")
def slice_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return slices.duplicates(table(spark, d, "lineitem"), "l_orderkey", "l_extendedprice", 500.0)


@query("SELECT l_orderkey, array_to_string([x FOR x IN [CASE WHEN count(DISTINCT l_returnflag) > 1 THEN 'l_returnflag' END, CASE WHEN count(DISTINCT l_linestatus) > 1 THEN 'l_linestatus' END] IF x IS NOT NULL], ',') AS inconsistent FROM lineitem GROUP BY l_orderkey")
def slice_consistency(spark: SparkSession, d: str) -> DataFrame:
    c = slices.consistent(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_orderkey")
    return c.select("l_orderkey", F.array_join("inconsistent", ",").alias("inconsistent"))


@query("SELECT l_orderkey, CAST(split_part(w, '|', 3) AS DOUBLE) AS center, CAST(split_part(w, '|', 4) AS DOUBLE) AS width FROM (SELECT l_orderkey, min(lpad(CAST(l_linenumber AS VARCHAR), 3, '0') || '|' || lpad(CAST(l_partkey AS VARCHAR), 9, '0') || '|' || CAST(l_quantity AS VARCHAR) || '|' || CAST(l_tax AS VARCHAR)) AS w FROM (SELECT *, CASE WHEN l_linenumber > 1 THEN l_quantity END AS center FROM lineitem) WHERE center IS NOT NULL AND l_tax IS NOT NULL GROUP BY l_orderkey)")
def first_window(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "lineitem").withColumns({"center": F.when(F.col("l_linenumber") > 1, F.col("l_quantity")), "k1": F.lpad(F.col("l_linenumber").cast("string"), 3, "0"), "k2": F.lpad(F.col("l_partkey").cast("string"), 9, "0"), "k3": F.col("l_quantity").cast("string"), "k4": F.col("l_tax").cast("string")})
    return slices.first_window(s, "l_orderkey", ("k1", "k2", "k3", "k4"), "center", "l_tax")


@query("SELECT event_id, coalesce(lag(event_id) OVER w, event_id) AS previous, coalesce(lead(event_id) OVER w, event_id) AS next FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def slice_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return slices.neighbours(table(spark, d, "events"), "user_id", "event_id", "ts", "event_id").select("event_id", "previous", "next")


@query("SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_type, value, event_id) - 1 AS INT) AS spatial, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS temporal FROM events")
def frame_orders(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("image_id"), F.col("event_type").alias("stack_id"), F.col("value").alias("projection"), F.lit(None).cast("int").alias("in_stack"), F.col("event_id").alias("frame"), F.col("ts").alias("temporal_index"), F.lit(0).alias("acquisition_number"))
    s = slices.spatial_order(e).withColumnRenamed("place", "spatial")
    return slices.temporal_order(s).select("event_id", F.col("spatial").cast("int").alias("spatial"), F.col("place").cast("int").alias("temporal"))


@query("""WITH r AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'PATIENT' WHEN 1 THEN 'STUDY' WHEN 2 THEN 'SERIES' ELSE 'IMAGE' END AS type, role || turn AS key FROM conversations)
SELECT conv_id, turn, last_value(CASE WHEN type = 'PATIENT' THEN key END IGNORE NULLS) OVER w AS patient,
  CASE WHEN max(CASE WHEN type = 'STUDY' THEN turn END) OVER w > coalesce(max(CASE WHEN type = 'PATIENT' THEN turn END) OVER w, -1) THEN last_value(CASE WHEN type = 'STUDY' THEN key END IGNORE NULLS) OVER w END AS study,
  CASE WHEN max(CASE WHEN type = 'SERIES' THEN turn END) OVER w > coalesce(max(CASE WHEN type IN ('PATIENT', 'STUDY') THEN turn END) OVER w, -1) THEN last_value(CASE WHEN type = 'SERIES' THEN key END IGNORE NULLS) OVER w END AS series
FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) QUALIFY type = 'IMAGE'""")
def flat_directory(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    kind = F.element_at(F.array(*map(F.lit, ("PATIENT", "STUDY", "SERIES", "IMAGE"))), (F.col("turn") % 4 + 1).cast("int"))
    r = c.select("conv_id", "turn", kind.alias("type"), F.concat("role", F.col("turn").cast("string")).alias("key"))
    return slices.flat_hierarchy(r, "conv_id", "turn").select("conv_id", "turn", "patient", "study", "series")


@query("""WITH RECURSIVE t AS (SELECT conv_id, turn, 0 AS depth FROM conversations c WHERE turn = (SELECT min(turn) FROM conversations m WHERE m.conv_id = c.conv_id)
UNION ALL SELECT c.conv_id, c.turn, t.depth + 1 FROM t JOIN conversations c ON c.conv_id = t.conv_id AND c.turn = t.turn + 1) SELECT conv_id, turn, depth FROM t""")
def content_tree(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    items = c.select(F.col("conv_id").alias("doc"), F.col("turn").alias("id"), F.lag("turn").over(w).alias("parent"), F.lit(0).alias("ord"))
    items = items.where("parent is null or parent = id - 1")
    return links.content_tree(spark, items).select(F.col("doc").alias("conv_id"), F.col("id").alias("turn"), "depth")


@query("""SELECT conv_id, turn, CAST(turn AS INT) AS depth FROM conversations c WHERE turn = 0 OR (SELECT count(*) FROM conversations m WHERE m.conv_id = c.conv_id AND m.turn < c.turn) = c.turn""")
def linked_directory(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    r = c.select(F.col("conv_id").alias("directory"), (F.col("turn") + 1).alias("offset"), F.lit(0).cast("bigint").alias("next"), (F.col("turn") + 2).alias("lower"), (F.col("turn") == 0).alias("root"))
    return links.linked_records(spark, r).select(F.col("directory").alias("conv_id"), (F.col("offset") - 1).alias("turn"), F.col("depth").cast("int").alias("depth"))


@query("SELECT doc_id, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS committed FROM documents")
def commitment(spark: SparkSession, d: str) -> DataFrame:
    return links.commitment(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").where("quality = 1"), ["doc_id"])


@query("""SELECT source, CASE WHEN bool_and(ok) THEN 'committed' WHEN bool_or(ok) THEN 'partial' ELSE 'failed' END AS status FROM (SELECT source, doc_id IN (SELECT doc_id FROM labels) AS ok FROM documents) GROUP BY source""")
def commitment_status(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("source", "doc_id")
    return links.commitment_status(docs, links.commitment(docs, table(spark, d, "labels"), ["doc_id"]), "source")


@query("""WITH m AS (SELECT p_partkey, unnest([0, 1, 2]) AS ord FROM part), q AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(floor(l_quantity) AS BIGINT) AS stored, p_size FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, stored, CAST(CASE WHEN stored BETWEEN 0 AND 10 THEN stored * 1.5 + 1 WHEN stored BETWEEN 5 AND p_size THEN stored * 2.5 + 2 WHEN stored BETWEEN 40 AND 50 THEN stored * 3.5 + 3 END AS DOUBLE) AS physical FROM q""")
def value_maps(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("image_id"), F.posexplode(F.array(
        F.struct(F.lit("a").alias("label"), F.lit(0).alias("first"), F.lit(10).alias("last"), F.lit(1.5).alias("slope"), F.lit(1.0).alias("intercept")),
        F.struct(F.lit("b").alias("label"), F.lit(5).alias("first"), F.col("p_size").cast("int").alias("last"), F.lit(2.5).alias("slope"), F.lit(2.0).alias("intercept")),
        F.struct(F.lit("c").alias("label"), F.lit(40).alias("first"), F.lit(50).alias("last"), F.lit(3.5).alias("slope"), F.lit(3.0).alias("intercept")),
    )).alias("ord", "m")).select("image_id", "ord", "m.*")
    q = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("image_id"), "l_suppkey", F.floor("l_quantity").alias("stored"))
    return links.value_map_for(q, p).select("l_orderkey", "l_linenumber", F.col("image_id").alias("l_partkey"), "l_suppkey", "stored", "physical")


@query("SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def structure_set(spark: SparkSession, d: str) -> DataFrame:
    rois = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("roi_number"))
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    contours = n.select(F.col("n_nationkey").alias("roi_number"), "n_name")
    observations = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").alias("roi_number"), "r_name")
    return links.structures(rois, contours, observations).select("s_suppkey", "n_name", "r_name")


@query("SELECT doc_id FROM labels UNION ALL SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def key_references(spark: SparkSession, d: str) -> DataFrame:
    return links.key_references(table(spark, d, "labels"), table(spark, d, "documents"), ["doc_id"])


@query("SELECT doc_id FROM labels UNION ALL SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def key_references_whole(spark: SparkSession, d: str) -> DataFrame:
    """References of all documents; ``key_references`` is the same since it has lost its filter."""
    return key_references(spark, d)


@query("SELECT s_suppkey, n_nationkey, CAST(list_sum([CASE WHEN i % 2 = 0 THEN s_suppkey ELSE 0 END FOR i IN range(9)]) AS BIGINT) AS total FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def label_maps(spark: SparkSession, d: str) -> DataFrame:
    segments = table(spark, d, "supplier").select(F.col("s_suppkey").alias("segment_number"), "s_nationkey")
    f = table(spark, d, "nation").join(segments, F.col("n_nationkey") == F.col("s_nationkey")).select("segment_number", "n_nationkey", F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: (i + 1) % 2).alias("mask"))
    l = links.labelled_frames(segments.drop("s_nationkey"), f)  # noqa: E741
    return l.select(F.col("segment_number").alias("s_suppkey"), "n_nationkey", F.aggregate("labels", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


@query("""SELECT c_custkey, upper(regexp_extract(c_name, '([A-Za-z]+)', 1)) AS family, regexp_extract(c_name, '([0-9]+)', 1) AS given, '(' || upper(lpad(to_hex(16 + c_nationkey), 4, '0')) || ',' || upper(lpad(to_hex(c_custkey % 65536), 4, '0')) || ')' AS tag,
  c_nationkey % 2 = 1 AS private, replace(replace(c_mktsegment || ' & <x>', '&', '&amp;'), '<x>', '&lt;x&gt;') AS xml FROM customer""")
def name_functions(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    name = tx.person_name(F.concat(F.regexp_replace("c_name", "#.*$", ""), F.lit("^"), F.regexp_extract("c_name", "([0-9]+)", 1), F.lit("^^ ^=")))
    tag = (F.col("c_nationkey") + 16) * 65536 + F.col("c_custkey") % 65536
    return c.select("c_custkey", F.upper(name["alphabetic"]["family"]).alias("family"), name["alphabetic"]["given"].alias("given"), tx.tag_text(tag).alias("tag"), tx.is_private(tag).alias("private"), tx.xml_escaped(F.concat("c_mktsegment", F.lit(" & <x>"))).alias("xml"))


@query("""SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, CAST(day(o_orderdate) AS INT) AS d, CAST(o_orderkey % 24 AS INT) AS h, CAST(o_orderkey % 60 AS INT) AS mi, CASE WHEN o_orderkey % 2 = 0 THEN 90 ELSE -330 END AS zone,
  CAST(o_orderkey % 1000 AS INT) AS age, substr('DWMY', CAST(o_orderkey % 4 + 1 AS INT), 1) AS unit, CAST((o_orderkey % 24) * 3600 + (o_orderkey % 60) * 60 AS DOUBLE) AS seconds, strftime(o_orderdate, '%-d %b %Y') AS shown FROM orders""")
def time_functions(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    day, time = F.date_format("o_orderdate", "yyyyMMdd"), F.concat(two(F.col("o_orderkey") % 24), two(F.col("o_orderkey") % 60))
    whole = tx.datetime_parts(F.concat(day, time, F.when(F.col("o_orderkey") % 2 == 0, "+0130").otherwise("-0530")))
    age = tx.age_parts(F.concat(F.lpad((F.col("o_orderkey") % 1000).cast("string"), 3, "0"), F.substr(F.lit("DWMY"), (F.col("o_orderkey") % 4 + 1).cast("int"), F.lit(1))))
    return o.select("o_orderkey", whole["date"]["year"].alias("y"), whole["date"]["month"].alias("m"), whole["date"]["day"].alias("d"), whole["time"]["hour"].alias("h"), whole["time"]["minute"].alias("mi"), whole["offset_minutes"].alias("zone"), age["value"].alias("age"), age["unit"].alias("unit"), tx.seconds_of_day(time).alias("seconds"), tx.display_date(day).alias("shown"))


@query("""WITH u AS (SELECT '1.2.840.' || o_orderkey AS uid FROM orders), c AS (SELECT uid, [CAST(ascii(x) AS UHUGEINT) FOR x IN string_split(uid, '')] AS codes FROM u)
SELECT uid, '2.25.' || list_reduce(list_prepend(CAST('14695981039346656037' AS UHUGEINT), codes), lambda h, c: (xor(h, c) * CAST('1099511628211' AS UHUGEINT)) % CAST('18446744073709551616' AS UHUGEINT)) || '.' || list_reduce(list_prepend(CAST('11400714819323198485' AS UHUGEINT), codes), lambda h, c: (h * CAST(31 AS UHUGEINT) + c) % CAST('18446744073709551616' AS UHUGEINT)) AS remapped FROM c""")
def uid_remap(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.concat(F.lit("1.2.840."), F.col("o_orderkey").cast("string")).alias("uid"))
    return o.select("uid", tx.deterministic_uid(F.col("uid")).alias("remapped"))
