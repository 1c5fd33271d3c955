"""Whole objects out of tables: directory files, reports, waveforms, presentation states and documents.

Each builder makes lists of elements (file_path, before, names, values as bytes), of which ``nesting`` makes files; directory files are laid out record by record. What a table does not have, null
columns, is left out of the file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import encoding
from ..operators.objects import CONTENT
from ..operators.rounds import settled
from ..operators.running import with_running_sums
from . import nesting
from .frames import interleaved
from .media import RECORDS

#: Storage classes of what is built.
DIRECTORY, PRESENTATION, ENCAPSULATED_PDF = "1.2.840.10008.1.3.10", "1.2.840.10008.5.1.4.1.1.11.1", "1.2.840.10008.5.1.4.1.1.104.1"
WAVEFORM = {"12-lead ECG": "1.2.840.10008.5.1.4.1.1.9.1.1", "general ECG": "1.2.840.10008.5.1.4.1.1.9.1.2", "hemodynamic": "1.2.840.10008.5.1.4.1.1.9.2.1"}
#: What samples are called, their bits and their range.
SAMPLES = {"SB": (8, -128, 127), "UB": (8, 0, 255), "SS": (16, -32768, 32767), "US": (16, 0, 65535)}

#: Records of a piece of a directory file.
PIECE = 1000

#: (tag, representation, column) of an element.
Field = tuple[str, str, Column]


def _value(vr: str, value: Column) -> Column:
    if vr in encoding.WIDTH:
        return encoding.numbers(value, vr)
    return value if vr in ("OB", "OW") else encoding.texts(value)


def element_lists(rows: DataFrame, fields: list[Field], before: Column | None = None) -> DataFrame:
    """The fields of each row as (file_path, before, names, values): values are null where there is none, names tell each value's tag and representation.

    Numbers are left as texts, which ``nesting.whole_files`` makes bytes of; their form follows a second colon of the name. A field of bytes that
    is given as numbers names their form after a slash (``OW/US``).
    """
    names, values = [], []
    for tag, vr, c in fields:
        vr, _, form = vr.partition("/")
        form = form or (vr if vr in encoding.WIDTH else "")
        names.append(f"{tag}:{vr}:{form}")
        numbers = c.cast("array<float>" if form == "FL" else "array<bigint>") if form else None
        values.append(_value(vr, c) if numbers is None else F.encode(F.array_join(numbers.cast("array<string>"), " "), "UTF-8"))
    return rows.select("file_path", (F.lit("") if before is None else before).alias("before"), F.lit(" ".join(names)).alias("names"), F.array(*values).alias("values"))


def _common(c) -> list[Field]:
    """What every object begins with; texts are in Unicode."""
    return [
        ("00080005", "CS", F.lit("ISO_IR 192")), ("00080016", "UI", c("sop_class")), ("00080018", "UI", c("sop_uid")), ("0020000D", "UI", c("study_uid")), ("0020000E", "UI", c("series_uid")),
        ("00080060", "CS", c("modality")), ("00100010", "PN", c("patient_name")), ("00100020", "LO", c("patient_id")),
    ]


def _optional(df: DataFrame):
    """Columns by name, null where the table has none."""
    return lambda name, kind="string": F.col(name) if name in df.columns else F.lit(None).cast(kind)


def _code(path: str, code: Column) -> list[Field]:
    """A code of (code, scheme, meaning) as a sequence of one."""
    return [(f"{path}[0]/00080100", "SH", code["code"]), (f"{path}[0]/00080102", "SH", code["scheme"]), (f"{path}[0]/00080104", "LO", code["meaning"])]


def objects(documents: DataFrame, rows: DataFrame) -> DataFrame:
    """(file_path, content) of element rows or lists; ``documents`` name each file's class and instance, and so which files there are."""
    return nesting.whole_files(rows, documents)


# Directory files


#: The elements of a record's links, whose values are four bytes each.
_NEXT, _LOWER = b"\x04\0\0\x14UL\x04\0", b"\x04\0\x20\x14UL\x04\0"
#: What stands between the links: the record is in use.
_IN_USE = b"\x04\0\x10\x14US\x02\0\xff\xff"
#: Bytes of a record's links and of what stands between, and of these with the head of its item.
_LINKS = len(_NEXT) + 4 + len(_IN_USE) + len(_LOWER) + 4
_FIXED = nesting.ITEM + _LINKS


def _body(kind: str, fields: list[tuple[str, str, Column]]) -> Column:
    """The elements of a record behind its links, those without a value left out."""
    parts = (encoding.element(tag, vr, encoding.texts(c)) for tag, vr, c in [("00041430", "CS", F.lit(kind)), *fields])
    return F.concat(*(F.coalesce(part, F.lit(b"")) for part in parts))


def _placed(images: DataFrame) -> DataFrame:
    """A row per image, with the records that begin at it: image, series, study, patient, as bytes behind their links, null where another image begins them.

    Patients, studies and series are ordered by their first places; p is the patient's where it begins. ``end`` and ``m`` are the bytes and records of the patient
    up to the row's, ``end_e``, ``end_s``, ``end_p`` and ``m_p`` those up to the end of the series, the study and the patient. All are windows within a patient, whose
    images are shuffled once and sorted twice.
    """
    tasks = int(images.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Patients before files, as rows are mostly told apart by the first bytes of what they are sorted by.
    of = lambda *keys: Window.partitionBy("who", "file_path", *keys)
    rows = images.withColumns({"who": F.coalesce(F.concat(F.lit("="), "patient_id"), F.lit("")), "place": F.col("place").cast("bigint")}).repartition(tasks, "who", "file_path")
    order = ["s", "study_uid", "e", "series_uid", "place"]
    run = of().orderBy(*order)
    other = lambda c: ~F.lag(c).over(run).eqNullSafe(F.col(c))
    # Each kind's bytes are made between two windows: in one step, their code would be longer than what Java compiles.
    rows = rows.withColumn("image", _body("IMAGE", [("00041500", "CS", F.array_join("file_id", "\\")), ("00041510", "UI", F.col("sop_class")), ("00041511", "UI", F.col("sop_uid")), ("00041512", "UI", F.col("transfer_syntax")), ("00200013", "IS", F.col("instance_number").cast("string"))]))
    rows = rows.withColumn("e", F.min("place").over(of("study_uid", "series_uid")))
    rows = rows.withColumn("series", _body("SERIES", [("00080060", "CS", F.col("modality")), ("0020000E", "UI", F.col("series_uid")), ("00200011", "IS", F.col("series_number").cast("string"))]))
    rows = rows.withColumn("s", F.min("place").over(of("study_uid")))
    rows = rows.withColumn("study", _body("STUDY", [("00080020", "DA", F.col("study_date")), ("0020000D", "UI", F.col("study_uid")), ("00200010", "SH", F.col("study_id"))]))
    rows = rows.withColumns({"new_p": F.row_number().over(run) == 1, "new_s": other("study_uid"), "new_e": other("series_uid")})
    study = F.col("new_p") | F.col("new_s")
    rows = rows.select(
        "file_path", "who", *order, F.when(F.col("new_p"), F.col("s")).alias("p"), "image", F.when(study | F.col("new_e"), F.col("series")).alias("series"), F.when(study, F.col("study")).alias("study"),
        F.when(F.col("new_p"), _body("PATIENT", [("00100010", "PN", F.col("patient_name")), ("00100020", "LO", F.col("patient_id"))])).alias("patient"),
    )
    none, begun = F.lit(0).cast("bigint"), ("image", "series", "study", "patient")
    so_far = run.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"end": F.sum(sum((F.coalesce(F.octet_length(c) + _FIXED, F.lit(0)) for c in begun), none)).over(so_far), "m": F.sum(sum((F.col(c).isNotNull().cast("bigint") for c in begun), none)).over(so_far)})
    for name, n in (("end_e", 4), ("end_s", 2)):
        rows = rows.withColumn(name, F.max("end").over(of(*order[:n])))
    return rows.withColumns({"end_p": F.max("end").over(of()), "m_p": F.max("m").over(of())}).drop(*order)


def directory_files(images: DataFrame, sets: DataFrame) -> DataFrame:
    """(file_path, content): the files of ``directory_pieces``, each in one value, which a task has to hold."""
    return nesting.joined_pieces(directory_pieces(images, sets))


def directory_pieces(images: DataFrame, sets: DataFrame, records_each: int = PIECE) -> DataFrame:
    """Directory files whose records name the byte offsets of their next sibling and first child, in pieces of ``records_each`` records: file_path,
    offset (of the piece in its file), item (number of its first record, null for the piece that begins the file), content. ``part10.piece_elements`` reads them.

    ``images``: file_path (of the directory), place (its order there, whole numbers from 0), patient_id, patient_name, study_uid, study_id, study_date,
    series_uid, modality, series_number, file_id (array), sop_class, sop_uid, transfer_syntax, instance_number. ``sets``: file_path, file_set_id,
    sop_uid. Patients, studies and series stand where their first image does. How long a record is does not depend on its links, so
    sums of the sizes within each patient, and of the patients' sizes before, give the offsets that are put in.
    """
    rows = settled(_placed(images))
    patients = rows.where("patient is not null").select("file_path", "p", "who", F.col("end_p").alias("bytes"), F.col("m_p").alias("records"))
    # Of the records before a patient's, the sums are over one row for each patient.
    based = settled(with_running_sums(patients, ["file_path"], ["p", "who"], {"before": "bytes", "first": "records"}))
    totals = based.groupBy("file_path").agg(F.sum("bytes").alias("total"), F.max("before").alias("last"))
    front = sets.join(totals, "file_path", "left").withColumns({"head": nesting.meta(F.lit(DIRECTORY), F.col("sop_uid")), "name": F.coalesce(encoding.element("00041130", "CS", encoding.texts(F.col("file_set_id"))), F.lit(b""))})
    outside = lambda first, last: F.concat("head", "name", encoding.element("00041200", "UL", encoding.number(first, 4)), encoding.element("00041202", "UL", encoding.number(last, 4)), encoding.element("00041212", "US", F.lit(b"\0\0")))
    none = F.lit(0).cast("bigint")
    front = front.withColumn("start", F.octet_length(outside(none, none)).cast("bigint") + nesting.SEQUENCE)
    at = lambda c: F.when(F.col("total").isNotNull(), c).otherwise(none)
    # What is outside of the records stands before them.
    sequence = encoding.head(F.lit(RECORDS), F.lit("SQ"), F.coalesce("total", none))
    begins = front.select("file_path", none.alias("piece"), F.lit(-1).cast("bigint").alias("n"), none.alias("offset"), F.concat(outside(at(F.col("start")), at(F.col("start") + F.col("last"))), sequence).alias("bytes"))
    bases = based.join(front.select("file_path", "start", "total"), "file_path").select("file_path", "who", (F.col("start") + F.col("before")).alias("start"), "first", (F.col("before") + F.col("bytes") < F.col("total")).alias("more"))
    placed = rows.join(bases, ["who", "file_path"])
    sizes = {c: F.octet_length(c) + _FIXED for c in ("image", "series", "study", "patient")}

    def record(kind: str, back: int, behind: list[str], end: str, more: Column) -> Column:
        """The record of a kind, which ``back`` others and those of ``behind`` follow up to the row's end; its next sibling, if there are ``more``, begins at ``end``."""
        offset = F.col("start") + F.col("end") - sum((sizes[c] for c in behind), sizes[kind])
        lower = none if kind == "image" else offset + sizes[kind]
        one = F.struct((F.col("first") + F.col("m") - back - 1).alias("n"), offset.alias("offset"), F.when(more, F.col("start") + F.col(end)).otherwise(none).alias("next"), lower.alias("lower"), F.col(kind).alias("body"))
        return F.when(F.col(kind).isNotNull(), one)

    # A record's first child, which all but images have, follows it.
    each = F.array(
        record("image", 0, [], "end", F.col("end") < F.col("end_e")), record("series", 1, ["image"], "end_e", F.col("end_e") < F.col("end_s")),
        record("study", 2, ["image", "series"], "end_s", F.col("end_s") < F.col("end_p")), record("patient", 3, ["image", "series", "study"], "end_p", F.col("more")),
    )
    records = placed.select("file_path", F.inline(F.array_compact(each)))
    item = F.concat(encoding.item_head(F.octet_length("body") + _LINKS), F.lit(_NEXT), encoding.number(F.col("next"), 4), F.lit(_IN_USE + _LOWER), encoding.number(F.col("lower"), 4), "body")
    records = records.select("file_path", F.floor(F.col("n") / records_each).alias("piece"), "n", "offset", item.alias("bytes"))
    return nesting.pieces(records.unionByName(begins)).select("file_path", "offset", F.when(F.col("offset") > 0, F.col("piece") * records_each).alias("item"), "content")


# Reports


def report_elements(documents: DataFrame, items: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """Element lists of structured reports.

    ``documents``: file_path, sop_class, sop_uid, study_uid, series_uid, and where they are known modality (else SR), label, description, completion,
    verification, template. ``items`` as ``objects.item_issues`` takes them, a code with its ``meaning``: the item ``root`` is the document
    itself, ``root/0`` its first child, and the numbers of an item's children run from 0 without gaps. ``evidence``: file_path, study_uid, series_uid, sop_class, sop_uid.
    """
    c = _optional(documents)
    out = element_lists(documents, [
        *[(tag, vr, F.coalesce(value, F.lit("SR")) if tag == "00080060" else value) for tag, vr, value in _common(c)],
        ("00700080", "CS", c("label")), ("00700081", "LO", c("description")), ("0040A491", "CS", c("completion")), ("0040A493", "CS", c("verification")),
        ("0040A504[0]/00080105", "CS", F.when(c("template").isNotNull(), "DCMR")), ("0040A504[0]/0040DB00", "CS", c("template")),
    ])
    before = F.regexp_replace(F.regexp_replace("path", "^root/?", ""), r"(\d+)(/|$)", rf"{CONTENT}[$1]/")
    measured = F.when(F.col("value_type") == "NUM", F.col("number"))
    units = F.when(measured.isNotNull(), F.col("units"))
    fields: list[Field] = [
        ("0040A010", "CS", F.col("relationship")), ("0040A040", "CS", F.col("value_type")), *_code("0040A043", F.col("concept")), ("0040A160", "UT", F.col("text")), *_code("0040A168", F.col("code")),
        ("0040A300[0]/0040A30A", "DS", encoding.decimal(measured)), *[(f"0040A300[0]/{tag}", vr, value) for tag, vr, value in _code("004008EA", units)],
        ("0040A120", "DT", F.col("date_time")), ("0040A121", "DA", F.col("date")), ("0040A122", "TM", F.col("time")), ("0040A123", "PN", F.col("person_name")), ("0040A124", "UI", F.col("uid")),
        ("00700023", "CS", F.col("graphic_type")), ("00700022", "FL", F.when(F.size("graphic_data") > 0, F.col("graphic_data"))),
    ]
    out = out.unionByName(element_lists(items, fields, before))
    named = items.select("file_path", before.alias("before"), F.posexplode("references").alias("k", "r"))
    out = out.unionByName(element_lists(named, [("00081150", "UI", F.col("r.sop_class")), ("00081155", "UI", F.col("r.sop_uid"))], F.concat("before", F.lit("00081199["), F.col("k").cast("string"), F.lit("]/"))))
    if evidence is None:
        return out
    # Studies and series in the order of their identifiers, instances in the order of theirs.
    number = lambda keys, order, rank: rank.over(Window.partitionBy(*keys).orderBy(*order)) - 1
    e = evidence.withColumns({"a": number(["file_path"], ["study_uid"], F.dense_rank()), "b": number(["file_path", "study_uid"], ["series_uid"], F.dense_rank()), "c": number(["file_path", "study_uid", "series_uid"], ["sop_uid"], F.row_number())})
    text = lambda column: F.col(column).cast("string")
    study = F.concat(F.lit("0040A375["), text("a"), F.lit("]/"))
    series = F.concat(study, F.lit("00081115["), text("b"), F.lit("]/"))
    out = out.unionByName(element_lists(e.dropDuplicates(["file_path", "a"]), [("0020000D", "UI", F.col("study_uid"))], study))
    out = out.unionByName(element_lists(e.dropDuplicates(["file_path", "a", "b"]), [("0020000E", "UI", F.col("series_uid"))], series))
    return out.unionByName(element_lists(e, [("00081150", "UI", F.col("sop_class")), ("00081155", "UI", F.col("sop_uid"))], F.concat(series, F.lit("00081199["), text("c"), F.lit("]/"))))


# Waveforms


def waveform_issues(groups: DataFrame, channels: DataFrame) -> DataFrame:
    """(file_path, issue) of waveforms that can't be built: the first rule that the first group breaks."""
    limits = F.create_map(*(x for name, (_, low, high) in SAMPLES.items() for x in (F.lit(name), F.struct(F.lit(low).alias("low"), F.lit(high).alias("high")))))
    own = channels.groupBy("file_path", "group").agg(F.min(F.size("samples")).alias("least"), F.max(F.size("samples")).alias("most"), F.min(F.array_min("samples")).alias("low"), F.max(F.array_max("samples")).alias("high"))
    joined = groups.join(own, ["file_path", "group"], "left").withColumn("limit", limits[F.col("interpretation")])
    good = F.coalesce((F.col("frequency") > 0) & ~F.isnan("frequency") & (F.col("frequency") < float("inf")), F.lit(False))
    issue = F.when(~good, "sampling frequency").when(F.col("least").isNull(), "no channels").when(F.col("least") != F.col("most"), "numbers of samples differ").when(F.col("limit").isNull() | (F.col("low") < F.col("limit.low")) | (F.col("high") > F.col("limit.high")), "sample out of range")
    return joined.withColumn("issue", issue).where("issue is not null").groupBy("file_path").agg(F.min_by("issue", "group").alias("issue"))


def waveform_elements(documents: DataFrame, groups: DataFrame, channels: DataFrame) -> DataFrame:
    """Element lists of waveforms; files that ``waveform_issues`` names are left out.

    ``documents`` as for reports, with content_date and content_time. ``groups``: file_path, group (numbers from 0), frequency, originality, interpretation (SB, UB, SS, US),
    label. ``channels``: file_path, group, channel (from 0), samples, label, source (code), sensitivity, units (code), baseline, correction.
    Samples are interleaved, channel by channel at each instant.
    """
    bad = waveform_issues(groups, channels).select("file_path")
    documents, groups, channels = (df.join(bad, "file_path", "left_anti") for df in (documents, groups, channels))
    c = _optional(documents)
    out = element_lists(documents, [*_common(c), ("00080023", "DA", c("content_date")), ("00080033", "TM", c("content_time"))])
    group = F.concat(F.lit("54000100["), F.col("group").cast("string"), F.lit("]/"))
    gathered = channels.groupBy("file_path", "group").agg(F.transform(F.array_sort(F.collect_list(F.struct("channel", "samples"))), lambda x: x["samples"]).alias("all"))
    g = groups.join(gathered, ["file_path", "group"])
    byte = F.col("interpretation").isin("SB", "UB")
    data = interleaved(F.col("all"))
    out = out.unionByName(element_lists(g, [
        ("003A0004", "CS", F.coalesce("originality", F.lit("ORIGINAL"))), ("003A0005", "US", F.array(F.size("all"))), ("003A0010", "UL", F.array(F.size(F.col("all")[0]))), ("003A001A", "DS", encoding.decimal(F.col("frequency"))), ("003A0020", "SH", F.col("label")),
        ("54001004", "US", F.array(F.when(byte, 8).otherwise(16))), ("54001006", "CS", F.col("interpretation")),
        ("54001010", "OB/UB", F.when(byte, data)), ("54001010", "OW/US", F.when(~byte, data)),
    ], group))
    kinds = channels.join(groups.select("file_path", "group", "interpretation"), ["file_path", "group"])
    return out.unionByName(element_lists(kinds, [
        ("003A0202", "IS", (F.col("channel") + 1).cast("string")), ("003A0203", "SH", F.col("label")), *_code("003A0208", F.col("source")), ("003A0210", "DS", encoding.decimal(F.col("sensitivity"))), *_code("003A0211", F.col("units")),
        ("003A0212", "DS", encoding.decimal(F.col("correction"))), ("003A0213", "DS", encoding.decimal(F.col("baseline"))), ("003A021A", "US", F.array(F.when(F.col("interpretation").isin("SB", "UB"), 8).otherwise(16))),
    ], F.concat(group, F.lit("003A0200["), F.col("channel").cast("string"), F.lit("]/"))))


# Presentation states and documents


def presentation_elements(documents: DataFrame, images: DataFrame, graphics: DataFrame) -> DataFrame:
    """Element lists of presentation states.

    ``documents`` as for reports, with label, created_date, created_time, rotation, flipped, center, width. ``images`` that they refer to: file_path, series_uid, sop_class,
    sop_uid. ``graphics``: file_path, annotation (numbers from 0), layer, place (its order in the annotation, from 0), units, kind, points
    (numbers), filled. Layers are numbered from 1 in the order in which annotations first name them.
    """
    c = _optional(documents)
    window = lambda name: F.when(c("center", "double").isNotNull() & c("width", "double").isNotNull(), encoding.decimal(c(name, "double")))
    out = element_lists(documents, [
        *_common(c), ("00700080", "CS", c("label")), ("00700082", "DA", c("created_date")), ("00700083", "TM", c("created_time")), ("00700041", "CS", F.when(F.coalesce(c("flipped", "boolean"), F.lit(False)), "Y").otherwise("N")),
        ("00700042", "US", F.array(F.coalesce(c("rotation", "int"), F.lit(0)))), ("20500020", "CS", F.lit("IDENTITY")), ("00283110[0]/00281050", "DS", window("center")), ("00283110[0]/00281051", "DS", window("width")),
    ])
    i = images.withColumns({"a": F.dense_rank().over(Window.partitionBy("file_path").orderBy("series_uid")) - 1, "b": F.row_number().over(Window.partitionBy("file_path", "series_uid").orderBy("sop_uid")) - 1})
    series = F.concat(F.lit("00081115["), F.col("a").cast("string"), F.lit("]/"))
    out = out.unionByName(element_lists(i.dropDuplicates(["file_path", "a"]), [("0020000E", "UI", F.col("series_uid"))], series))
    out = out.unionByName(element_lists(i, [("00081150", "UI", F.col("sop_class")), ("00081155", "UI", F.col("sop_uid"))], F.concat(series, F.lit("00081140["), F.col("b").cast("string"), F.lit("]/"))))
    layers = graphics.groupBy("file_path", "layer").agg(F.min("annotation").alias("first")).withColumn("order", F.row_number().over(Window.partitionBy("file_path").orderBy("first", "layer")))
    out = out.unionByName(element_lists(layers, [("00700002", "CS", F.col("layer")), ("00700062", "IS", F.col("order").cast("string"))], F.concat(F.lit("00700060["), (F.col("order") - 1).cast("string"), F.lit("]/"))))
    annotation = F.concat(F.lit("00700001["), F.col("annotation").cast("string"), F.lit("]/"))
    out = out.unionByName(element_lists(graphics.groupBy("file_path", "annotation").agg(F.min_by("layer", "place").alias("layer")), [("00700002", "CS", F.col("layer"))], annotation))
    return out.unionByName(element_lists(graphics, [
        ("00700005", "CS", F.coalesce("units", F.lit("PIXEL"))), ("00700020", "US", F.array(F.lit(2))), ("00700021", "US", F.array(F.floor(F.size("points") / 2))), ("00700022", "FL", F.col("points")), ("00700023", "CS", F.col("kind")),
        ("00700024", "CS", F.when(F.col("filled"), "Y").when(~F.col("filled"), "N")),
    ], F.concat(annotation, F.lit("00700009["), F.col("place").cast("string"), F.lit("]/"))))


def document_elements(documents: DataFrame) -> DataFrame:
    """Element lists of encapsulated documents: those of reports, with ``data`` (bytes), and title, mime_type, concept (code), content_date, content_time; empty ones are left out."""
    c = _optional(documents)
    return element_lists(documents.where(F.octet_length("data") > 0), [
        *[(tag, vr, F.lit("DOC") if tag == "00080060" else value) for tag, vr, value in _common(c)], ("00080023", "DA", c("content_date")), ("00080033", "TM", c("content_time")), ("00420010", "ST", c("title")),
        *(_code("0040A043", F.col("concept")) if "concept" in documents.columns else []), ("00420012", "LO", F.coalesce(c("mime_type"), F.lit("application/pdf"))), ("00420015", "UL", F.array(F.octet_length("data"))), ("00420011", "OB", F.col("data")),
    ])
