"""Small views of element rows, instances and queues: what tools, work lists and screens show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric, text

#: Elements of work-list entries, of the entry and of its scheduled step.
WORKLIST = {
    "patient_name": "00100010", "patient_id": "00100020", "accession": "00080050", "procedure_id": "00401001", "procedure": "00321060",
    "station": "00400001", "start_date": "00400002", "start_time": "00400003", "step": "00400007", "step_id": "00400009",
}
STEP, MODALITY = "00400100[0]/", "00080060"
#: A report's transaction, its stored and failed references, and their elements.
TRANSACTION, STORED, FAILED, REASON, CLASS, INSTANCE = "00081195", "00081199", "00081198", "00081197", "00081150", "00081155"
#: Fixed value: the name whose value an inspection does not show.
REDACTED = "PatientID"


def inspected(instances: DataFrame, everything: bool = False) -> DataFrame:
    """(file_path, name, value): what an inspection shows of each file, blank values left out; with ``everything`` also that there is an identifier.

    ``instances`` as ``part10.instance_rows`` gives them, one row a file.
    """
    c = F.col
    number = lambda form, value: F.format_string(form, value.cast("double"))
    first = lambda name: F.get(name, 0)
    window = first("widths") > 0
    scaled = (c("slope") != 1) | (c("intercept") != 0)
    shown = {
        "PatientName": c("patient_name"), "PatientSex": c("patient_sex"), "PatientAge": c("patient_age"), "Modality": c("modality"), "StudyDate": c("study_date"), "StudyDescription": c("study_description"), "StudyInstanceUID": c("study_uid"),
        "SeriesDescription": c("series_description"), "SeriesInstanceUID": c("series_uid"), "Rows": F.coalesce(c("rows"), F.lit(0)).cast("string"), "Columns": F.coalesce(c("columns"), F.lit(0)).cast("string"), "BitsAllocated": c("bits_allocated").cast("string"),
        "SamplesPerPixel": c("samples_per_pixel").cast("string"), "PhotometricInterpretation": c("photometric"), "WindowCenter": F.when(window, number("%.1f", first("centers"))), "WindowWidth": F.when(window, number("%.1f", first("widths"))),
        "RescaleIntercept": F.when(scaled, number("%.2f", c("intercept"))), "RescaleSlope": F.when(scaled, number("%.2f", c("slope"))),
        "PixelSpacing": F.when((F.get("pixel_spacing", 1) > 0) & (first("pixel_spacing") > 0), F.format_string("%.4f × %.4f mm", F.get("pixel_spacing", 1), first("pixel_spacing"))),
    }
    if everything:
        shown[REDACTED] = F.when(text.blank_to_null(c("patient_id")).isNotNull(), "(redacted)")
    listed = F.array(*(F.struct(F.lit(name).alias("name"), text.blank_to_null(v).alias("value")) for name, v in shown.items()))
    return instances.select("file_path", F.inline(F.filter(listed, lambda e: e["value"].isNotNull())))


def worklist_items(rows: DataFrame) -> DataFrame:
    """Element rows of work-list entries to one row each, with ``stable`` and ``line``; the modality of the scheduled step counts before the entry's own.

    The first scheduled step of an entry is meant; columns of the step are null where there is none.
    """
    value = lambda path: F.max(F.when(F.col("path") == path, text.blank_to_null(F.get("values", 0))))
    own = {name: value(tag if name in ("patient_name", "patient_id", "accession", "procedure_id", "procedure") else STEP + tag) for name, tag in WORKLIST.items()}
    found = rows.groupBy("file_path").agg(*(c.alias(name) for name, c in own.items()), F.coalesce(value(STEP + MODALITY), value(MODALITY)).alias("modality"))
    stable = text.first_filled(*(F.col(n) for n in ("step_id", "accession", "procedure_id", "patient_id")), F.lit("worklist-item"))
    return found.withColumns({"stable": stable, "line": text.joined(" - ", F.col("patient_name"), F.col("modality"), F.col("start_date"), F.coalesce("step", "procedure"))})


def commitment_reports(rows: DataFrame) -> DataFrame:
    """Element rows of commitment reports to (file_path, transaction, status, references): committed, failed or partial; each reference with class, instance, whether it is stored, and the reason if not.

    Reports without a transaction, or without a reference that has class and instance, are malformed: their status is so.
    """
    item = F.regexp_extract("path", rf"^({STORED}|{FAILED})\[(\d+)\]/", 0)
    below = F.substring_index("path", "/", -1)
    one = lambda tag: F.max(F.when(F.col("below") == tag, F.get("values", 0)))
    inside = rows.withColumns({"item": item, "below": below}).where("item <> ''").groupBy("file_path", "item").agg(one(CLASS).alias("sop_class"), one(INSTANCE).alias("sop_uid"), F.max(F.when(F.col("below") == REASON, F.get("numbers", 0))).cast("int").alias("reason"))
    stored = F.col("item").startswith(STORED)
    named = inside.where("sop_class is not null and sop_uid is not null").select("file_path", F.struct((~stored).alias("failed"), F.regexp_extract("item", r"\[(\d+)\]", 1).cast("int").alias("n"), "sop_class", "sop_uid", F.when(~stored, F.col("reason")).alias("reason")).alias("r"))
    listed = named.groupBy("file_path").agg(F.array_sort(F.collect_list("r")).alias("references"), F.count_if("r.failed").alias("failed"), F.count("*").alias("n"))
    top = rows.groupBy("file_path").agg(F.max(F.when(F.col("path") == TRANSACTION, text.blank_to_null(F.get("values", 0)))).alias("transaction"))
    status = F.when(F.col("transaction").isNull() | F.col("n").isNull(), "malformed").when(F.col("failed") == 0, "committed").when(F.col("failed") == F.col("n"), "failed").otherwise("partial")
    return top.join(listed, "file_path", "left").select("file_path", "transaction", status.alias("status"), "references")


def pending(entries: DataFrame) -> DataFrame:
    """Entries of a queue that are still to be tried."""
    return entries.where("state = 'pending' and attempts < max_attempts")


def failed(entries: DataFrame) -> DataFrame:
    return entries.where("state = 'failed'")


def patient_rows(instances: DataFrame) -> DataFrame:
    """Name, identifier, study and known modality of each instance's patient."""
    return instances.select("patient_name", "patient_id", "study_uid", text.modality_of(F.col("modality")).alias("modality"))


def by_name(patients: DataFrame) -> DataFrame:
    """Patients in the order of the bytes of their names; equal names by identifier and study."""
    return patients.orderBy("patient_name", "patient_id", "study_uid")


def instances_of(instances: DataFrame, study: str) -> DataFrame:
    """A study's instances in the order of their identifiers."""
    return instances.where(F.col("study_uid") == study).orderBy("sop_uid")


def resolved_window(mode: Column, preset: Column, custom: Column, from_file: Column, automatic: Column) -> Column:
    """The window (center, width) of a mode: ``automatic``, ``preset`` by its name, ``custom``, or ``file``, which falls back to the automatic one where its width is not positive."""
    return F.when(mode == "preset", F.struct(numeric.preset_named(preset)["center"].alias("center"), numeric.preset_named(preset)["width"].alias("width"))).when(mode == "custom", custom).when((mode == "file") & (from_file["width"] > 0), from_file).otherwise(automatic)


def display_windows(centers: Column, widths: Column, explanations: Column, chosen: Column) -> Column:
    """The windows (center, width, explanation, place) that a header offers, invalid ones left out; where none is left the ``chosen`` one."""
    pairs = F.least(F.size(centers), F.size(widths))
    offered = F.transform(F.slice(F.arrays_zip(centers.alias("c"), widths.alias("w")), F.lit(1), F.greatest(pairs, F.lit(0))), lambda p, i: F.struct(p["c"].alias("center"), p["w"].alias("width"), text.blank_to_null(F.get(explanations, i)).alias("explanation"), i.alias("place")))
    valid = F.filter(offered, lambda p: p["center"].isNotNull() & (p["width"] > 0))
    alone = F.array(F.struct(chosen["center"].alias("center"), chosen["width"].alias("width"), F.lit(None).cast("string").alias("explanation"), F.lit(0).alias("place")))
    return F.when(F.size(valid) > 0, valid).when(chosen["width"] > 0, alone).otherwise(F.slice(alone, 1, 0))


def fragment_places(table: Column, lengths: Column, frames: Column) -> Column:
    """The fragments of each frame by their numbers: by the table of offsets, else all for the one frame, else one for each; null where none of these fits.

    ``lengths`` are those of the fragments; an offset counts the eight bytes before each.
    """
    count = F.size(lengths)
    starts = F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda k: F.aggregate(F.slice(lengths, F.lit(1), k), F.lit(0).cast("bigint"), lambda a, v: a + v + 8))
    all_ = F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0)))
    by_table = F.transform(table, lambda a, i: F.filter(all_, lambda k: (F.get(starts, k) >= a) & F.coalesce(F.get(starts, k) < F.get(table, i + 1), F.lit(True))))
    return F.when(count == 0, None).when(F.size(table) > 0, F.when(F.size(table) == frames, by_table)).when(frames == 1, F.array(all_)).when(count == frames, F.transform(all_, lambda k: F.array(k)))


def thumbnail_bytes(pixels: Column, columns: Column, width: int, height: int, rows: Column, inverted: Column) -> Column:
    """Nearest bytes of a smaller picture; turned over for MONOCHROME1."""
    return F.transform(numeric.thumbnail(pixels, columns, width, height, rows), lambda p: F.when(inverted, 255 - p).otherwise(p))
