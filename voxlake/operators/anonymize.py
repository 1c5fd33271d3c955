"""Rule-based de-identification of element tables, with an audit of what was done."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import deterministic_uid, is_private

#: The default policy as (tag, action, replacement).
DEFAULT_POLICY = (
    (0x00100010, "replace", "ANONYMIZED"),
    (0x00100020, "replace", "ANON"),
    (0x00100030, "remove", None),
    (0x00101001, "remove", None),
    (0x00101040, "remove", None),
    (0x00102154, "remove", None),
    (0x00080050, "replace", ""),
    (0x00200010, "replace", ""),
    (0x00081010, "remove", None),
    (0x00181000, "remove", None),
    (0x00401001, "remove", None),
    (0x00080090, "remove", None),
    (0x00080080, "remove", None),
    (0x0020000D, "remapUID", None),
    (0x0020000E, "remapUID", None),
    (0x00080018, "remapUID", None),
    (0x00200052, "remapUID", None),
    (0x00081155, "remapUID", None),
)
#: Tags that no policy changes, as they say how the pixels are to be read.
STRUCTURAL = (0x00080016, 0x00280002, 0x00280004, 0x00280006, 0x00280008, 0x00280010, 0x00280011, 0x00280100, 0x00280101, 0x00280102, 0x00280103, 0x7FE00010)

_POLICY = "tag int, action string, replacement string"


def _signed(tag: int) -> int:
    return tag - 2**32 if tag >= 2**31 else tag


def policy_table(spark, policy=DEFAULT_POLICY) -> DataFrame:
    return spark.createDataFrame([(_signed(t), a, r) for t, a, r in policy], _POLICY)


def apply_policy(elements: DataFrame, policy: DataFrame, root: str = "2.25", remove_private: bool = True) -> DataFrame:
    """Element rows (file_path, path, tag, vr, values array<string>) with ``disposition``, ``note`` and the new ``values``.

    Rows of group 2 and group lengths are left out silently. A removed element takes its nested elements along; below a sequence that
    is kept the policy applies again. The policy is one row per tag, which is small enough to be sent to all executors.
    """
    group = F.shiftrightunsigned("tag", 16)
    rows = elements.where((group != 2) & (F.col("tag").bitwiseAND(F.lit(0xFFFF)) != 0))
    rows = rows.join(F.broadcast(policy), "tag", "left")
    sequence = F.col("vr") == "SQ"
    action = F.coalesce("action", F.lit("keep"))
    private = is_private(F.col("tag")) & F.lit(remove_private)
    structural = F.col("tag").isin([_signed(t) for t in STRUCTURAL]) & (action != "keep")
    disposition = (
        F.when(private, "removed").when(structural, "blocked").when(action == "remove", "removed").when((action == "replace") & sequence, "unsupported").when(action == "replace", "changed")
        .when((action == "remapUID") & (F.coalesce(F.size("values"), F.lit(0)) <= 0), "unsupported").when(action == "remapUID", "remapped").otherwise("kept")
    )
    replaced = F.when(F.col("replacement") == "", F.array().cast("array<string>")).otherwise(F.array("replacement"))
    new = F.when(disposition == "changed", replaced).when(disposition == "remapped", F.transform("values", lambda u: deterministic_uid(u, root))).when(disposition == "removed", F.lit(None)).otherwise(F.col("values"))
    out = rows.withColumns({"disposition": disposition, "new_values": new})
    out = out.drop("action", "replacement", "values").withColumnRenamed("new_values", "values")
    # A file's elements meet once; of its removed ones only those count that hold some of the others.
    names = [c for c in out.columns if c != "file_path"]
    files = out.groupBy("file_path").agg(F.collect_list(F.struct(*names)).alias("all"), F.collect_set(F.when(F.col("disposition") == "removed", F.concat("path", F.lit("[")))).alias("gone"))
    around = F.array_distinct(F.flatten(F.transform("all", lambda e: _parents(e["path"]))))
    files = files.withColumn("gone", F.array_intersect("gone", around))
    left = F.when(F.size("gone") == 0, F.col("all")).otherwise(F.filter("all", lambda e: ~F.arrays_overlap(_parents(e["path"]), F.col("gone"))))
    return files.select("file_path", F.inline(left)).select(*out.columns)


def _parents(path: Column) -> Column:
    """The paths of the sequences around an element, each up to its opening bracket."""
    steps = F.split(path, r"\[")
    upto = F.transform(steps, lambda _, i: F.when(i > 0, F.concat(F.array_join(F.slice(steps, F.lit(1), i), "["), F.lit("["))))
    return F.filter(upto, lambda p: p.isNotNull())


def audit(applied: DataFrame) -> DataFrame:
    """What was done to which element; kept ones are not listed."""
    return applied.where("disposition <> 'kept'").select("file_path", "path", "tag", "disposition")


def rewritten(applied: DataFrame) -> DataFrame:
    """The elements that are left, with their new values."""
    return applied.where("disposition <> 'removed'").drop("disposition")
