"""Archives, directory files and pictures that are written from the driver's tables and read again."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import links
from ..sources import media, part10
from .registry import query
from .tables import PIXELS, frames, spread, table


def _archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for key, name in zip(batch["key"].to_pylist(), batch["name"].to_pylist(), strict=True):
            held = io.BytesIO()
            with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
                for member in ("IMG/a.dcm", "IMG/", "__MACOSX/a", "../out.dcm", "/root.dcm", "x\\..\\y"):
                    z.writestr(member, name)
            out.append(b"no archive" if key % 10 == 0 else held.getvalue())
        yield pa.RecordBatch.from_arrays([pa.array([f"{k}.zip" for k in batch["key"].to_pylist()]), pa.array(out, pa.binary())], ["file_path", "content"])


@query(r"""SELECT p_partkey || '.zip' AS archive, member, disposition, CASE WHEN disposition = 'extract' THEN p_name END AS content, FALSE AS broken FROM part, (VALUES ('IMG/a.dcm', 'extract'), ('IMG/', 'skip'), ('__MACOSX/a', 'skip'), ('../out.dcm', 'reject'), ('/root.dcm', 'reject'), ('x\..\y', 'reject')) v(member, disposition) WHERE p_partkey % 10 <> 0
UNION ALL SELECT p_partkey || '.zip', NULL, NULL, NULL, TRUE FROM part WHERE p_partkey % 10 = 0""")
def archive_members(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"))
    files = spread(files, "key").mapInArrow(_archives, "file_path string, content binary")
    return media.zip_members(files).select("archive", "member", "disposition", F.col("content").cast("string").alias("content"), F.col("error").isNotNull().alias("broken"))


def _directory(key: int, name: str) -> bytes:
    """A directory file of one patient with two images, which come before the records that lead to them."""

    def records(at: list[int]) -> list[list[tuple[int, str, object]]]:
        def record(following: int, lower: int, kind: str, *more: tuple[int, str, object]) -> list[tuple[int, str, object]]:
            return [(0x00041400, "UL", [following]), (0x00041410, "US", [0xFFFF]), (0x00041420, "UL", [lower]), (0x00041430, "CS", kind), *more]

        return [
            record(0, 0, "IMAGE", (0x00041500, "CS", f"IMG\\B{key}")), record(at[0], 0, "IMAGE", (0x00041500, "CS", f"IMG\\A{key}")), record(0, at[3], "PATIENT", (0x00100020, "LO", str(key)), (0x00100010, "PN", name)),
            record(0, at[4], "STUDY", (0x0020000D, "UI", f"1.2.{key}")), record(0, at[1], "SERIES", (0x0020000E, "UI", f"1.3.{key}")), record(0, 0, "IMAGE", (0x00041500, "CS", "LOST")),
        ]

    def whole(root: int, at: list[int]) -> list[tuple[int, str, object]]:
        return [(0x00041200, "UL", [root]), (0x00041220, "SQ", records(at))]

    sizes = [len(part10.write([(0x00041220, "SQ", [r])])) - len(part10.write([(0x00041220, "SQ", [])])) for r in records([0] * 6)]
    start = len(part10.write(whole(0, [0] * 6))) - sum(sizes)
    at = [start + sum(sizes[:i]) for i in range(6)]
    return part10.write(whole(at[2], at))


def _directories(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = batch["key"].to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([f"{k}/DICOMDIR" for k in keys]), pa.array([_directory(k, n) for k, n in zip(keys, batch["name"].to_pylist(), strict=True)], pa.binary())], ["file_path", "content"])


@query("""SELECT s_suppkey || '/DICOMDIR' AS directory, place, type, depth, CASE place WHEN 0 THEN 'IMG/B' || s_suppkey WHEN 1 THEN 'IMG/A' || s_suppkey END AS file_id, CASE WHEN place = 2 THEN s_name END AS patient_name, parent FROM supplier,
  (VALUES (0, 'IMAGE', 3, 4), (1, 'IMAGE', 3, 4), (2, 'PATIENT', 0, NULL), (3, 'STUDY', 1, 2), (4, 'SERIES', 2, 3)) v(place, type, depth, parent)""")
def directory_files(spark: SparkSession, d: str) -> DataFrame:
    """Records that links from the root reach, with their depth and the place of their parent; a record that nothing leads to is none of them."""
    files = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    files = spread(files, "key").mapInArrow(_directories, "file_path string, content binary")
    records = media.directory_records(part10.element_rows(part10.elements(files)))
    reached = links.linked_records(spark, records).join(records, ["directory", "offset"])
    parents = records.select("directory", F.col("offset").alias("parent"), F.col("place").alias("parent_place"))
    return reached.join(parents, ["directory", "parent"], "left").select("directory", "place", "type", "depth", F.when(F.col("file_id") != "", F.col("file_id")).alias("file_id"), "patient_name", F.col("parent_place").alias("parent"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'directory' WHEN 1 THEN 'zip' WHEN 2 THEN 'file' ELSE CASE WHEN p_partkey % 3 = 0 THEN 'directory' ELSE 'file' END END AS source,
  CASE p_partkey % 4 WHEN 0 THEN CASE WHEN p_partkey % 5 = 0 THEN 'dicom-directory' ELSE 'directory' END WHEN 1 THEN 'zip' WHEN 2 THEN 'file' ELSE CASE WHEN p_partkey % 3 <> 0 OR p_partkey % 5 = 0 THEN 'dicom-directory' ELSE 'directory' END END AS medium FROM part""")
def media_kinds(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    path = F.concat(F.lit("/m/"), F.col("p_partkey").cast("string"), F.get(F.array(*map(F.lit, ("/", ".ZIP", ".dcm", "/DicomDir"))), (F.col("p_partkey") % 4).cast("int")))
    folder, has = F.expr("p_partkey % 4 = 3 and p_partkey % 3 = 0"), F.expr("p_partkey % 5 = 0")
    return p.select("p_partkey", media.source_kind(path, folder).alias("source"), media.media_kind(path, folder, has).alias("medium"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pixels of the pictures that ``media.pictures`` writes."""
    for batch in batches:
        out = []
        for data in batch["content"].to_pylist():
            if data[:2] == b"II":
                out.append(np.frombuffer(data, "<u2", offset=int(np.frombuffer(data, "<u4", 1, 10 + 12 * 5 + 8)[0])).tolist())
            else:
                size, columns = int.from_bytes(data[33:37]), int.from_bytes(data[16:20])
                out.append(np.frombuffer(zlib.decompress(data[41 : 41 + size]), np.uint8).reshape(-1, columns + 1)[:, 1:].ravel().tolist())
        yield pa.RecordBatch.from_arrays([batch["file_path"], pa.array(out, pa.list_(pa.int32()))], ["file_path", "pixels"])


@query(f"""WITH {PIXELS}, p AS (SELECT image_id, string_agg(CAST(CAST(floor(value / 16.0) AS INT) AS VARCHAR), ',' ORDER BY place) AS shown, string_agg(CAST(value AS VARCHAR), ',' ORDER BY place) AS stored FROM px GROUP BY image_id)
SELECT image_id || '_frame0001.png' AS file_path, shown AS pixels FROM p UNION ALL SELECT image_id || '_frame0001.tiff', stored FROM p""")
def exported_frames(spark: SparkSession, d: str) -> DataFrame:
    """Display values as PNG and native ones as TIFF, read again."""
    f = frames(spark, d).select(F.col("image_id").cast("string").alias("base"), F.lit(0).alias("frame"), F.lit(1).alias("frames"), F.lit(8).alias("columns"), F.lit(1).alias("samples"), "pixels")
    shown = f.withColumn("pixels", F.transform("pixels", lambda v: F.floor(v / 16).cast("int")))
    files = media.pictures(shown, "png").unionByName(media.pictures(f, "tiff"))
    return files.mapInArrow(_read, "file_path string, pixels array<int>").select("file_path", F.array_join(F.col("pixels").cast("array<string>"), ",").alias("pixels"))
