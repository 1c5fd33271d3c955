"""Part 10 files that are written from the driver's tables and read again, and frames of pixels in several forms."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import anonymize, loader
from ..sources import frames as fr
from ..sources import part10, writing
from .registry import query
from .tables import PIXELS, frames, spread, table

_SYNTAXES = (part10.EXPLICIT_LE, part10.IMPLICIT_LE, part10.DEFLATED_LE, part10.EXPLICIT_BE)


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for key, name, brand, size in zip(*(batch[c].to_pylist() for c in ("key", "name", "brand", "size")), strict=True):
            rows = [(0x00100010, "PN", name), (0x00100020, "LO", str(key)), (0x00080060, "CS", brand), (0x0020000D, "UI", f"1.2.{key}"), (0x0020000E, "UI", f"1.3.{key % 7}"), (0x00280010, "US", [size]), (0x00280011, "US", [size + 1]), (0x00281050, "DS", f"{size}\\{key}"), (0x00081115, "SQ", [[(0x00081155, "UI", f"9.{key}")], [(0x00081155, "UI", "9.0")]])]
            content = part10.write(rows, _SYNTAXES[key % 4])
            # Some files are broken: too short, without the mark, empty, or without a study.
            content = {0: content[:100], 1: content[:128] + b"XXXX" + content[132:], 2: b""}.get(key % 50, content)
            out.append(part10.write(rows[:3], _SYNTAXES[key % 4]) if key % 50 == 3 else content)
        yield pa.RecordBatch.from_arrays([pa.array([f"{k:08d}.dcm" for k in batch["key"].to_pylist()]), pa.array(out, pa.binary())], ["file_path", "content"])


def _files(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))
    return spread(p, "key").mapInArrow(_written, "file_path string, content binary")


@query("""WITH a AS (SELECT *, lpad(CAST(p_partkey AS VARCHAR), 8, '0') || '.dcm' AS file_path FROM part WHERE p_partkey % 50 > 2), n AS (SELECT file_path, '00100010' AS path, 'PN' AS vr, p_name AS value, CAST(NULL AS DOUBLE) AS number FROM a UNION ALL SELECT file_path, '00080060', 'CS', p_brand, NULL FROM a), p AS (SELECT * FROM a WHERE p_partkey % 50 > 3)
SELECT * FROM n UNION ALL SELECT file_path, '00280010', 'US', CAST(p_size AS VARCHAR), CAST(p_size AS DOUBLE) FROM p
UNION ALL SELECT file_path, '00281050', 'DS', p_size || '|' || p_partkey, CAST(p_size AS DOUBLE) FROM p UNION ALL SELECT file_path, '00081115[0]/00081155', 'UI', '9.' || p_partkey, NULL FROM p UNION ALL SELECT file_path, '00081115[1]/00081155', 'UI', '9.0', NULL FROM p""")
def file_elements(spark: SparkSession, d: str) -> DataFrame:
    """Elements of files in four transfer syntaxes, items of sequences among them."""
    e = part10.element_rows(part10.elements(_files(spark, d))).where("path in ('00100010', '00080060', '00280010', '00281050') or path like '00081115[%'")
    return e.select("file_path", "path", "vr", F.array_join("values", "|").alias("value"), F.get("numbers", 0).alias("number"))


@query("""SELECT lpad(CAST(p_partkey AS VARCHAR), 8, '0') || '.dcm' AS file_path, CASE p_partkey % 4 WHEN 0 THEN '1.2.840.10008.1.2.1' WHEN 1 THEN '1.2.840.10008.1.2' WHEN 2 THEN '1.2.840.10008.1.2.1.99' ELSE '1.2.840.10008.1.2.2' END AS transfer_syntax, p_name AS patient_name, CAST(p_partkey AS VARCHAR) AS patient_id, p_brand AS modality, CASE WHEN p_partkey % 50 = 3 THEN '' ELSE '1.2.' || p_partkey END AS study_uid, CASE WHEN p_partkey % 50 <> 3 THEN p_size END AS rows, CASE WHEN p_partkey % 50 <> 3 THEN p_size + 1 END AS columns, CASE WHEN p_partkey % 50 <> 3 THEN p_size || ',' || p_partkey END AS centers FROM part WHERE p_partkey % 50 > 2""")
def file_instances(spark: SparkSession, d: str) -> DataFrame:
    i = part10.instance_rows(part10.elements(_files(spark, d)))
    return i.select("file_path", "transfer_syntax", "patient_name", "patient_id", "modality", "study_uid", F.col("rows").cast("bigint").alias("rows"), F.col("columns").cast("bigint").alias("columns"), F.when(F.col("centers").isNotNull(), F.array_join(F.transform("centers", lambda c: c.cast("bigint").cast("string")), ",")).alias("centers"))


@query("""SELECT lpad(CAST(p_partkey AS VARCHAR), 8, '0') || '.dcm' AS file_path, CASE p_partkey % 50 WHEN 0 THEN 'shorter than 132 bytes,unreadable,no study,no series' WHEN 1 THEN 'no DICM mark,unreadable,no study,no series' WHEN 2 THEN 'shorter than 132 bytes,unreadable,no study,no series' WHEN 3 THEN 'no study,no series' ELSE '' END AS service,
  p_partkey % 50 <> 2 AS decoder_valid, CASE p_partkey % 50 WHEN 0 THEN 'File smaller than 132 bytes; DICOM preamble may be missing' WHEN 1 THEN 'Missing DICM signature at offset 128 (preamble optional)' WHEN 2 THEN 'File is empty' ELSE '' END AS decoder, p_partkey % 50 > 3 AS valid, CASE WHEN p_partkey % 50 > 3 THEN p_size ELSE 0 END AS height FROM part""")
def file_validation(spark: SparkSession, d: str) -> DataFrame:
    """Both rule sets over whole, short, unmarked, empty and study-less files."""
    files = _files(spark, d)
    parsed = part10.elements(files)
    known = parsed.select("file_path", "error", *(part10.text_of(t).alias(n) for t, n in ((0x0020000D, "study"), (0x0020000E, "series"))), part10.number_of(0x00280010).cast("int").alias("rows"), part10.number_of(0x00280011).cast("int").alias("columns"))
    both = files.join(known, "file_path")
    wrong = F.when(F.col("error").isNotNull(), "unreadable")
    # A file of 100 bytes has no place for the mark: that it is short is all that is said of it.
    service = F.transform(part10.validation_issues(F.col("content"), wrong, F.col("study"), F.col("series")), lambda x: x)
    service = F.when(F.octet_length("content") < 132, F.filter(service, lambda x: x != "no DICM mark")).otherwise(service)
    decoder, status = loader.decoder_issues(F.col("content")), loader.decoder_status(F.col("error"), F.col("columns"), F.col("rows"), F.lit(False), F.lit(False))
    return both.select("file_path", F.array_join(service, ",").alias("service"), decoder["valid"].alias("decoder_valid"), F.array_join(decoder["issues"], ",").alias("decoder"), status["valid"].alias("valid"), status["height"].cast("bigint").alias("height"))


@query("""WITH p AS (SELECT *, lpad(CAST(p_partkey AS VARCHAR), 8, '0') || '.dcm' AS file_path FROM part WHERE p_partkey % 50 > 2)
SELECT file_path, path, CASE path WHEN '00100010' THEN 'ANONYMIZED' WHEN '00100020' THEN 'ANON' WHEN '00080060' THEN p_brand WHEN '00280010' THEN CAST(p_size AS VARCHAR) ELSE p_size || '|' || p_partkey END AS value FROM p, (VALUES ('00100010'), ('00100020'), ('00080060'), ('00280010'), ('00281050')) v(path) WHERE p_partkey % 50 > 3 OR path < '0020'""")
def anonymized_files(spark: SparkSession, d: str) -> DataFrame:
    """Files in four syntaxes without their identities, written anew and read again."""
    rows = part10.element_rows(part10.elements(_files(spark, d)))
    left = anonymize.rewritten(anonymize.apply_policy(rows, anonymize.policy_table(spark)))
    again = part10.element_rows(part10.elements(writing.files(left)))
    return again.where("path in ('00100010', '00100020', '00080060', '00280010', '00281050')").select("file_path", "path", F.array_join("values", "|").alias("value"))


def _images(spark: SparkSession, d: str, syntax: str, encode) -> DataFrame:
    """Two frames of 8 x 4 pixels of 16 bits from each embedding, encoded by a function of the 64 values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch["pixels"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch["image_id"].cast(pa.string()), pa.array([encode(v) for v in values], pa.binary())], ["file_path", "pixel_data"])

    rows = frames(spark, d).mapInArrow(run, "file_path string, pixel_data binary")
    return rows.select("*", F.lit(syntax).alias("transfer_syntax"), F.lit(8).alias("rows"), F.lit(4).alias("columns"), F.lit(2).alias("frames"), F.lit(1).alias("samples_per_pixel"), F.lit(16).alias("bits_allocated"), F.lit(0).alias("pixel_representation"), F.lit("MONOCHROME2").alias("photometric"))


def _item(raw: bytes) -> bytes:
    raw += b"\0" * (len(raw) % 2)
    return b"\xfe\xff\x00\xe0" + struct.pack("<I", len(raw)) + raw


def _native(values: np.ndarray) -> bytes:
    return values.astype("<u2").tobytes()


def _run_length(values: np.ndarray) -> bytes:
    """Encapsulated frames of two byte planes each, in literal runs of 16 and repeated ones where a plane is even."""
    parts = []
    for frame in values.reshape(2, 32).astype(np.uint16):
        planes = []
        for plane in ((frame >> 8).astype(np.uint8), (frame & 255).astype(np.uint8)):
            even = (plane == plane[0]).all()
            raw = bytes([257 - 32, int(plane[0])]) if even else b"".join(bytes([15]) + plane[i : i + 16].tobytes() for i in (0, 16))
            planes.append(raw + b"\0" * (len(raw) % 2))
        head = struct.pack("<16I", 2, 64, 64 + len(planes[0]), *([0] * 13))
        parts.append(_item(head + b"".join(planes)))
    return _item(b"") + b"".join(parts) + b"\xfe\xff\xdd\xe0\0\0\0\0"


_FRAMES = f"WITH {PIXELS} SELECT CAST(image_id AS VARCHAR) AS file_path, CAST(place // 32 AS INT) AS frame, CAST(place % 32 AS INT) AS place, value FROM px"


def _decoded(images: DataFrame) -> DataFrame:
    return fr.decoded_frames(images).select("file_path", "frame", F.posexplode("pixels").alias("place", "value"))


@query(_FRAMES)
def native_pixels(spark: SparkSession, d: str) -> DataFrame:
    return _decoded(_images(spark, d, part10.EXPLICIT_LE, _native))


@query(_FRAMES)
def run_length_pixels(spark: SparkSession, d: str) -> DataFrame:
    return _decoded(_images(spark, d, "1.2.840.10008.1.2.5", _run_length))


@query(f"WITH {PIXELS}, h AS (SELECT image_id, place // 32 AS frame, string_agg(printf('%02X%02X', value % 256, value // 256), '' ORDER BY place) AS bytes FROM px GROUP BY ALL) SELECT CAST(image_id AS VARCHAR) AS file_path, CAST(frame AS INT) AS frame, bytes FROM h")
def frame_slices(spark: SparkSession, d: str) -> DataFrame:
    f = fr.native_frames(_images(spark, d, part10.EXPLICIT_LE, _native))
    return f.select("file_path", "frame", F.hex("bytes").alias("bytes"))


@query("SELECT DISTINCT CAST(vec_id AS VARCHAR) AS file_path, 0 AS frame, 'unsupported: JPEG 2000 needs a codec library' AS error FROM embeddings")
def unsupported_pixels(spark: SparkSession, d: str) -> DataFrame:
    return fr.decoded_frames(_images(spark, d, "1.2.840.10008.1.2.4.90", _native)).where("pixels is null").select("file_path", "frame", "error")


@query(f"WITH {PIXELS} SELECT image_id, CAST(place % 3 AS INT) AS channel, CAST(place // 3 AS INT) AS sample, value FROM px")
def waveform_channels(spark: SparkSession, d: str) -> DataFrame:
    c = frames(spark, d).select("image_id", F.posexplode(fr.deinterleave(F.col("pixels"), F.lit(3))).alias("channel", "v"))
    return c.select("image_id", "channel", F.posexplode("v").alias("sample", "value"))


@query("SELECT o_orderkey, text FROM (SELECT o_orderkey, lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS text FROM orders) ORDER BY text")
def scan_order(spark: SparkSession, d: str) -> DataFrame:
    """Files by their path."""
    return table(spark, d, "orders").select("o_orderkey", F.lpad(text.trimmed(F.col("o_orderkey").cast("string")), 8, "0").alias("text")).orderBy("text")
