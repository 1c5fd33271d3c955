"""Rules for single values, character sets, undefined lengths, folders and landing streams over the driver's tables."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import elements, numeric, text
from ..operators import search
from ..operators.rounds import shared_folder
from ..sources import frames as fr
from ..sources import part10, writing
from ..streaming import ingest
from .registry import query
from .tables import table


@query("""WITH p AS (SELECT *, p_partkey % 7 AS k, sha256(CAST(p_partkey AS VARCHAR)) AS h FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'key ' || p_partkey ELSE p_brand END AS stable, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE p_brand || ' - ' || p_type END AS line, '2.25.' || CAST(('0x' || substr(h, 1, 12))::BIGINT AS VARCHAR) || lpad(CAST(('0x' || substr(h, 13, 12))::BIGINT AS VARCHAR), 15, '0') AS uid,
  40 - 0.5 - (greatest(k, 1) - 1) / 2.0::DOUBLE AS low, 40 - 0.5 + (greatest(k, 1) - 1) / 2.0::DOUBLE AS high, CASE WHEN k > 3 THEN 10.0 WHEN p_partkey % 2 = 0 THEN (p_size + 5) / 2.0 ELSE 50.0 END::DOUBLE AS center, CASE WHEN k > 3 THEN k WHEN p_partkey % 2 = 0 THEN greatest(5 - p_size, 1) ELSE 350 END::DOUBLE AS width,
  CASE WHEN k > 4 THEN 1 WHEN k > 2 THEN 80 WHEN k > 0 THEN 40 END::DOUBLE AS chosen, [10, 20, 30][greatest(least(p_size - 2, 2), 0) + 1] AS looked_up, 'a b ' || p_brand AS shown FROM p""")
def value_rules(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers and lines of worklists, new identifiers, window bounds, recommended and chosen windows, table values, text for display."""
    p = table(spark, d, "part")
    key, k = F.col("p_partkey"), (F.col("p_partkey") % 7).cast("double")
    blank = F.when(key % 3 == 0, F.lit("  ")).otherwise(F.col("p_brand"))
    bounds = numeric.window_bounds(F.lit(40.0), k)
    size = F.col("p_size").cast("double")
    recommended = numeric.recommended_window(F.lit(10.0), F.when(k > 3, k).otherwise(0.0), F.when(key % 2 == 0, "mr").otherwise("CT"), size, F.lit(5.0))
    # Of a list the second pair counts, if it is valid; else the first that is.
    chosen = numeric.chosen_window(F.when(k > 4, 1.0), F.lit(3.0), F.array(F.lit(40.0), F.lit(80.0)), F.array(F.when(k > 0, 400.0).otherwise(-1.0), F.when(k > 2, 2000.0).otherwise(0.0)))
    return p.select(
        "p_partkey", text.first_filled(F.when(key % 3 == 0, F.lit(None).cast("string")).otherwise(blank), F.concat(F.lit("key "), key.cast("string"))).alias("stable"), text.joined(" - ", F.col("p_brand"), F.when(key % 3 == 0, " ").otherwise(F.col("p_type"))).alias("line"), elements.new_uid(key.cast("string")).alias("uid"),
        bounds["low"].alias("low"), bounds["high"].alias("high"), recommended["center"].alias("center"), recommended["width"].alias("width"), chosen["c"].alias("chosen"), numeric.lut_value(F.col("p_size"), F.lit(2), F.array(F.lit(10), F.lit(20), F.lit(30))).alias("looked_up"),
        text.sanitized(F.concat(F.lit("a\x00\x07b "), F.lit("\x1b"), F.col("p_brand"), F.lit("\r\n"))).alias("shown"),
    )


_SETS = ("ISO_IR 100", "ISO_IR 144", "ISO_IR 192", "GB18030", "ISO_IR 126", "ISO_IR 100")
_WORDS = ("Müller", "Иван", "中é", "中文", "Ωμέγα", "中")


@query(f"""SELECT c_custkey, c_name || [{", ".join(f"'{w}'" for w in _WORDS)}][c_custkey % 6 + 1] AS name, CASE WHEN c_custkey % 6 = 5 THEN 'ISO_IR 192' ELSE [{", ".join(f"'{s}'" for s in _SETS)}][c_custkey % 6 + 1] END AS charset FROM customer""")
def charset_files(spark: SparkSession, d: str) -> DataFrame:
    """Names written in the character sets that files name, or in Unicode where they do not fit, and read again."""
    c = table(spark, d, "customer")
    pick = lambda words: F.get(F.array(*map(F.lit, words)), (F.col("c_custkey") % 6).cast("int"))
    element = lambda path, vr, value: F.struct(F.lit(path).alias("path"), F.lit(vr).alias("vr"), F.array(value).alias("values"))
    rows = c.select(F.col("c_custkey").cast("string").alias("file_path"), F.inline(F.array(element("00080005", "CS", pick(_SETS)), element("00100010", "PN", F.concat("c_name", pick(_WORDS))))))
    again = part10.elements(writing.files(rows), strict=True)
    return again.select(F.col("file_path").cast("bigint").alias("c_custkey"), part10.text_of(0x00100010).alias("name"), part10.text_of(0x00080005).alias("charset"))


def _undefined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files whose sequences and items end with marks: two items, the first of which holds a sequence of its own; every fourth one lacks an end."""
    open_, close, end = b"\xfe\xff\x00\xe0\xff\xff\xff\xff", b"\xfe\xff\x0d\xe0\0\0\0\0", b"\xfe\xff\xdd\xe0\0\0\0\0"

    def sequence(tag: int, *items: bytes) -> bytes:
        return struct.pack("<HH", tag >> 16, tag & 0xFFFF) + b"SQ\0\0\xff\xff\xff\xff" + b"".join(open_ + item + close for item in items) + end

    for batch in batches:
        out = []
        for key in batch["key"].to_pylist():
            uid = lambda v: part10._encode([(0x00081155, "UI", v)], True, "<")
            body = sequence(0x00081115, sequence(0x00081140, uid(f"1.{key}"), b"") + uid("9.9"), uid("8.8"))
            out.append(part10.write([]) + (body[:-8] if key % 4 == 3 else body) + part10._encode([(0x00100020, "LO", str(key))], True, "<") * (key % 4 != 3))
        yield pa.RecordBatch.from_arrays([pa.array([str(k) for k in batch["key"].to_pylist()]), pa.array(out, pa.binary())], ["file_path", "content"])


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS file, path, CASE path WHEN '00081115[0]/00081140[0]/00081155' THEN '1.' || s_suppkey WHEN '00100020' THEN CAST(s_suppkey AS VARCHAR) ELSE value END AS value, length, FALSE AS broken FROM supplier,
  (VALUES ('00081115', NULL, -1), ('00081115[0]/00081140', NULL, -1), ('00081115[0]/00081140[0]/00081155', NULL, NULL), ('00081115[0]/00081155', '9.9', NULL), ('00081115[1]/00081155', '8.8', NULL), ('00100020', NULL, NULL)) v(path, value, length) WHERE s_suppkey % 4 <> 3
UNION ALL SELECT CAST(s_suppkey AS VARCHAR), NULL, NULL, NULL, TRUE FROM supplier WHERE s_suppkey % 4 = 3""")
def undefined_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Sequences and items without lengths, nested, with an empty item; files that end before their marks are errors."""
    parsed = part10.elements(table(spark, d, "supplier").select(F.col("s_suppkey").alias("key")).mapInArrow(_undefined, "file_path string, content binary"))
    good = part10.element_rows(parsed).where("path not like '0002%'").select(F.col("file_path").alias("file"), "path", F.get("values", 0).alias("value"), F.when(F.col("length") < 0, F.col("length")).cast("int").alias("length"), F.lit(False).alias("broken"))
    return good.unionByName(parsed.where("error is not null").select(F.col("file_path").alias("file"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("int").alias("length"), F.lit(True).alias("broken")))


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = batch["key"].to_pylist()
        names = [f"{k % 5}/{'.' if k % 7 == 0 else ''}f{k}{('', '.dcm', '.DCM', '.txt')[k % 4]}" for k in keys]
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([part10.write([(0x00100020, "LO", str(k))]) for k in keys], pa.binary())], ["file_path", "content"])


def _folder(spark: SparkSession, d: str) -> str:
    """A folder of files: with the extension, with another, with none, and hidden ones."""
    folder = shared_folder(spark, "files")
    part10.write_files(table(spark, d, "supplier").select(F.col("s_suppkey").alias("key")).mapInArrow(_named, "file_path string, content binary"), folder).write.format("noop").mode("overwrite").save()
    return folder


_FOUND = "SELECT 'f' || s_suppkey || ['', '.dcm', '.DCM', '.txt'][s_suppkey % 4 + 1] AS name, CAST(s_suppkey AS VARCHAR) AS patient_id FROM supplier WHERE s_suppkey % 7 <> 0"


@query(f"{_FOUND} AND s_suppkey % 4 <> 3")
def scanned_files(spark: SparkSession, d: str) -> DataFrame:
    """A folder and those below it: files with the extension or none, hidden ones left out."""
    found = part10.scan(spark, _folder(spark, d))
    return found.select(F.element_at(F.split("file_path", "/"), -1).alias("name"), part10.text_of(0x00100020).alias("patient_id"))


@query("SELECT 'f' || s_suppkey || ['', '.dcm', '.DCM', '.txt'][s_suppkey % 4 + 1] AS name, CAST(s_suppkey AS VARCHAR) AS patient_id, 2 AS n FROM supplier WHERE s_suppkey % 7 <> 0")
def landed_files(spark: SparkSession, d: str) -> DataFrame:
    """Files that land in a folder, parsed as they come and appended to a table, from which a second run finds nothing new; with how many elements of group 2 each has."""
    folder, out, checkpoint = _folder(spark, d), shared_folder(spark, "landed"), shared_folder(spark, "landing")
    # Each batch costs the same, however few files it has: some 25 batches of more files where there are more than 1000.
    most = max(40, -(-table(spark, d, "supplier").count() // 25))
    for _ in range(2):
        ingest.write_batches(ingest.landing(spark, folder, most), out, checkpoint).awaitTermination()
    rows = spark.read.parquet(out)
    two = F.size(F.filter("elements", lambda e: F.floor(e["tag"] / 65536) == 2)) - 1
    return rows.select(F.element_at(F.split("file_path", "/"), -1).alias("name"), part10.text_of(0x00100020).alias("patient_id"), two.alias("n"))


@query("SELECT page_id, i AS frame, CASE WHEN (i + 1) * 12 <= strlen(html) AND i >= 0 THEN sha256(encode(html)[i * 12 + 1 : i * 12 + 12]) END AS digest, 12 AS size FROM pages, (VALUES (-1), (0), (7), (1000000)) v(i)")
def frame_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Byte ranges of frames of 2 x 2 pixels of three samples; null outside the data."""
    size = fr.bytes_per_frame(F.lit(2), F.lit(2), F.lit(3), F.lit(8), F.lit("RGB"))
    p = table(spark, d, "pages").select("page_id", F.encode("html", "UTF-8").alias("data"), F.explode(F.array(*map(F.lit, (-1, 0, 7, 1_000_000)))).alias("frame"))
    return p.select("page_id", "frame", F.sha2(fr.frame_bytes(F.col("data"), F.col("frame"), size.cast("int")), 256).alias("digest"), size.cast("int").alias("size"))


def _implicit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files that name no representations, with elements that are not common: a text, a number, and a sequence with an item."""
    for batch in batches:
        rows = [[(0x00181030, "LO", f"scan {k}"), (0x00189073, "FD", [k + 0.25]), (0x00189346, "SQ", [[(0x00181031, "LO", f"in {k}")]])] for k in batch["key"].to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([str(k) for k in batch["key"].to_pylist()]), pa.array([part10.write(r, part10.IMPLICIT_LE) for r in rows], pa.binary())], ["file_path", "content"])


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS file, path, vr, CASE path WHEN '00181030' THEN 'scan ' || s_suppkey WHEN '00189346[0]/00181031' THEN 'in ' || s_suppkey END AS value, CASE path WHEN '00189073' THEN s_suppkey + 0.25::DOUBLE END AS number, name FROM supplier,
  (VALUES ('00181030', 'LO', 'ProtocolName'), ('00189073', 'FD', 'AcquisitionDuration'), ('00189346', 'SQ', 'CTDIPhantomTypeCodeSequence'), ('00189346[0]/00181031', 'LO', 'Inner')) v(path, vr, name)""")
def dictionary_files(spark: SparkSession, d: str) -> DataFrame:
    """Files without representations, read by a data dictionary out of a table, which also names their elements."""
    folder = shared_folder(spark, "dictionary")
    entries = [("(0018,1030)", "LO", "ProtocolName"), ("00189073", "FD or DS", "AcquisitionDuration"), ("(0018,9346)", "SQ", "CTDIPhantomTypeCodeSequence"), ("(0018,1031)", "LO", "Inner"), ("(60xx,3000)", "OB", "Repeating")]
    spark.createDataFrame(entries, "tag string, vr string, name string").write.option("header", "true").csv(folder)
    known = part10.dictionary_table(spark, folder)
    files = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key")).mapInArrow(_implicit, "file_path string, content binary")
    rows = part10.element_rows(part10.elements(files, strict=True, dictionary=known)).where("path not like '0002%'")
    named = rows.join(F.broadcast(known.select(F.col("tag").cast("int").alias("tag"), "name")), "tag", "left")
    return named.select(F.col("file_path").alias("file"), "path", "vr", F.when(F.col("vr") == "LO", F.get("values", 0)).alias("value"), F.get("numbers", 0).alias("number"), "name")


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 25 OFFSET 10")
def paged_orders(spark: SparkSession, d: str) -> DataFrame:
    """A page whose bounds are texts, as requests give them."""
    return search.page(table(spark, d, "orders"), ["o_orderdate", "o_orderkey"], "10", "25").select("o_orderkey", "o_custkey")
