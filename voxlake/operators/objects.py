"""Whole objects out of element rows: plans, segmentations, functional groups, reports, captures, and what an object's pixels can be used for.

Items of nested sequences become rows by one aggregation over their files; nothing is parsed again.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Classes of segmentations, dose grids and parametric maps.
SEGMENTATION, DOSE, PARAMETRIC_MAP = "1.2.840.10008.5.1.4.1.1.66.4", "1.2.840.10008.5.1.4.1.1.481.2", "1.2.840.10008.5.1.4.1.1.30"
#: Families of pixel objects with their role and status.
FAMILIES = (
    ("classic-image", "image-display-input", "classic-pipelines"),
    ("segmentation", "overlay-or-segmentation", "typed-payload"),
    ("rt-dose", "dose-grid", "typed-payload"),
    ("parametric-map", "volume-input", "typed-payload"),
    ("float-pixel-data", "out-of-scope", "unsupported"),
    ("double-float-pixel-data", "out-of-scope", "unsupported"),
)

#: Classes of enhanced and comprehensive reports and key objects, with the templates they take.
ENHANCED_REPORT, COMPREHENSIVE_REPORT, KEY_OBJECTS = "1.2.840.10008.5.1.4.1.1.88.22", "1.2.840.10008.5.1.4.1.1.88.33", "1.2.840.10008.5.1.4.1.1.88.59"
MEASUREMENT_TEMPLATE, ROOT_CODE, ROOT_SCHEME = "1500", "126000", "DCM"
#: What reports may hold.
VALUE_TYPES = ("CONTAINER", "TEXT", "CODE", "NUM", "IMAGE", "SCOORD", "UIDREF", "DATETIME", "DATE", "TIME", "PNAME")
CONTEXT_TYPES = ("TEXT", "CODE", "UIDREF", "DATETIME", "DATE", "TIME", "PNAME")
RELATIONSHIPS = ("CONTAINS", "HAS OBS CONTEXT", "HAS CONCEPT MOD", "INFERRED FROM", "SELECTED FROM")
SCHEMES, UNIT_SCHEMES = ("DCM", "SCT", "SRT", "UCUM", "99LOCAL"), ("UCUM",)

#: Elements of beams and control points, by their path below the item.
BEAM = {
    "number": ("300A00C0", "int"), "name": ("300A00C2", "text"), "description": ("300A00C3", "text"), "type": ("300A00C4", "text"), "radiation_type": ("300A00C6", "text"), "machine": ("300A00B2", "text"),
    "dosimeter_unit": ("300A00B3", "text"), "source_axis_distance": ("300A00B4", "number"), "declared_points": ("300A0110", "int"),
}
CONTROL_POINT = {
    "point": ("300A0112", "int"), "energy": ("300A0114", "number"), "gantry_angle": ("300A011E", "number"), "device_angle": ("300A0120", "number"), "support_angle": ("300A0122", "number"), "table_angle": ("300A0125", "number"),
    "isocenter": ("300A012C", "numbers"), "meterset_weight": ("300A0134", "number"),
}
#: Elements of segments.
SEGMENT = {
    "number": ("00620004", "int"), "label": ("00620005", "text"), "description": ("00620006", "text"), "algorithm_type": ("00620008", "text"), "algorithm_name": ("00620009", "text"),
    "category": ("00620003[0]/00080104", "text"), "property_type": ("0062000F[0]/00080104", "text"), "tracking_id": ("00620020", "text"), "tracking_uid": ("00620021", "text"), "color": ("0062000D", "numbers"),
}
#: Functional groups of frames and their elements.
GROUPS = {
    "frame_content": {"dimension_index": ("00209111[0]/00209157", "numbers"), "stack_id": ("00209111[0]/00209056", "text"), "in_stack": ("00209111[0]/00209057", "int"), "temporal": ("00209111[0]/00209128", "int"), "acquisition": ("00209111[0]/00209156", "int")},
    "pixel_measures": {"spacing": ("00289110[0]/00280030", "numbers"), "thickness": ("00289110[0]/00180050", "number"), "between": ("00289110[0]/00180088", "number")},
    "plane_position": {"position": ("00209113[0]/00200032", "numbers")},
    "plane_orientation": {"orientation": ("00209116[0]/00200037", "numbers")},
    "derivation": {"source_uid": ("00089124[0]/00082112[0]/00081155", "text")},
    "transformation": {"intercept": ("00289145[0]/00281052", "number"), "slope": ("00289145[0]/00281053", "number")},
}
#: Sequences of beams, control points, segments, shared and per-frame groups.
BEAMS, POINTS, SEGMENTS, SHARED, PER_FRAME = 0x300A00B0, 0x300A0111, 0x00620002, 0x52009229, 0x52009230
#: The least number of components of a group's vectors.
COMPONENTS = {"spacing": 2, "position": 3, "orientation": 6}

#: The sequence of content items, and their elements.
CONTENT = "0040A730"
ITEM = {
    "relationship": ("0040A010", "text"), "value_type": ("0040A040", "text"), "concept_code": ("0040A043[0]/00080100", "text"), "concept_scheme": ("0040A043[0]/00080102", "text"), "text": ("0040A160", "text"),
    "code_code": ("0040A168[0]/00080100", "text"), "code_scheme": ("0040A168[0]/00080102", "text"), "measured": ("0040A300[0]/0040A30A", "number"), "number": ("0040A30A", "number"),
    "units_code": ("0040A300[0]/004008EA[0]/00080100", "text"), "units_scheme": ("0040A300[0]/004008EA[0]/00080102", "text"), "graphic_type": ("00700023", "text"), "graphic_data": ("00700022", "numbers"), "uid": ("0040A124", "text"),
    "date_time": ("0040A120", "text"), "date": ("0040A121", "text"), "time": ("0040A122", "text"), "person_name": ("0040A123", "text"),
}


def item_rows(rows: DataFrame, sequences: tuple[int, ...], fields: dict[str, tuple[str, str]]) -> DataFrame:
    """One row per item of the nested ``sequences``: ``file_path``, ``place`` (the item's numbers, outermost first) and the ``fields``.

    ``rows`` are element rows. Fields are paths below the item, read as ``text`` (blank: null), ``number``, ``int`` or ``numbers``. Values
    are combined before the one shuffle; items without elements have no row.
    """
    start = "/".join(rf"{s:08X}\[(\d+)\]" for s in sequences) + "/"
    below = F.regexp_replace("path", f"^{start}", "")
    place = F.array(*(F.regexp_extract("path", f"^{start}", i + 1).cast("int") for i in range(len(sequences))))
    inside = rows.where(F.col("path").startswith(f"{sequences[0]:08X}[") & F.col("path").rlike(f"^{start}")).withColumns({"place": place, "below": below})
    read = {
        "text": F.when(F.get("values", 0).rlike(r"[^\s\x00]"), F.get("values", 0)), "number": F.get("numbers", 0), "int": F.get("numbers", 0).cast("int"), "numbers": F.when(F.size("numbers") > 0, F.col("numbers")),
    }
    wanted = inside.where(F.col("below").isin([path for path, _ in fields.values()]))
    return wanted.groupBy("file_path", "place").agg(*(F.max(F.when(F.col("below") == path, read[kind])).alias(name) for name, (path, kind) in fields.items()))


def beams(rows: DataFrame) -> DataFrame:
    """Beams of treatment plans, one row each with its place; items without a number are none."""
    found = item_rows(rows, (BEAMS,), BEAM).where("number is not null")
    return found.withColumn("place", F.get("place", 0))


def control_points(rows: DataFrame) -> DataFrame:
    """Control points with the place and number of their beam; items without an index, and those of items that are no beams, are none. An isocenter has three components or is null."""
    points = item_rows(rows, (BEAMS, POINTS), CONTROL_POINT).where("point is not null")
    points = points.withColumns({"beam_place": F.get("place", 0), "place": F.get("place", 1), "isocenter": F.when(F.size("isocenter") >= 3, F.slice("isocenter", 1, 3))})
    return points.join(beams(rows).select("file_path", F.col("place").alias("beam_place"), F.col("number").alias("beam")), ["file_path", "beam_place"])


def segments(rows: DataFrame) -> DataFrame:
    """Segments of segmentations: items with a number and a label that is not blank."""
    return item_rows(rows, (SEGMENTS,), SEGMENT).where("number is not null and label is not null").withColumn("place", F.get("place", 0))


def segment_frames(headers: DataFrame, rows: DataFrame) -> DataFrame:
    """``headers`` (file_path, frames) to (file_path, frame, segment): the one its frame names, else the file's only one.

    A file without segments, or with a frame that has none, is no segmentation: it has no rows. At least one frame is counted.
    """
    known = segments(rows).groupBy("file_path").agg(F.count("*").alias("n"), F.min("number").alias("only"))
    frames = headers.join(known, "file_path").select("file_path", "n", "only", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.coalesce("frames", F.lit(1))) - 1)).alias("frame"))
    named = item_rows(rows, (PER_FRAME,), {"named": ("0062000A[0]/0062000B", "int")}).select("file_path", F.get("place", 0).alias("frame"), "named")
    numbered = frames.join(named, ["file_path", "frame"], "left").select("file_path", "frame", F.coalesce("named", F.when(F.col("n") == 1, F.col("only"))).alias("segment"))
    broken = numbered.where("segment is null").select("file_path").distinct()
    return numbered.join(broken, "file_path", "left_anti")


def _groups(items: DataFrame) -> DataFrame:
    """Items with each group as one struct, null where nothing of it is there."""

    def value(name: str) -> Column:
        return F.when(F.size(name) >= COMPONENTS[name], F.slice(name, 1, COMPONENTS[name])) if name in COMPONENTS else F.col(name)

    made = {}
    for group, fields in GROUPS.items():
        whole = [value(n) for n in fields]
        if group == "transformation":
            parts = [F.coalesce(whole[0], F.lit(0.0)), F.coalesce(whole[1], F.lit(1.0))]
        else:
            parts = whole
        made[group] = F.when(reduce(or_, (w.isNotNull() for w in whole)), F.struct(*(p.alias(n) for p, n in zip(parts, fields, strict=True))))
    return items.select("file_path", "place", *(c.alias(g) for g, c in made.items()))


def functional_groups(headers: DataFrame, rows: DataFrame) -> DataFrame:
    """``headers`` (file_path, frames) to a row per frame with six groups: the frame's own, else the shared one, else null.

    Files with neither kind of groups have no rows. Shared groups are one row per file and meet the frames by file.
    """
    fields = {name: spec for group in GROUPS.values() for name, spec in group.items()}
    own = _groups(item_rows(rows, (PER_FRAME,), fields)).withColumn("frame", F.get("place", 0)).drop("place")
    shared = _groups(item_rows(rows, (SHARED,), fields)).where(F.get("place", 0) == 0).select("file_path", *(F.col(g).alias(f"shared_{g}") for g in GROUPS))
    some = rows.where(" or ".join(f"path like '{s:08X}[%'" for s in (SHARED, PER_FRAME))).select("file_path").distinct()
    frames = headers.join(some, "file_path", "left_semi").select("file_path", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.coalesce("frames", F.lit(1))) - 1)).alias("frame"))
    return frames.join(own, ["file_path", "frame"], "left").join(shared, "file_path", "left").select("file_path", "frame", *(F.coalesce(g, f"shared_{g}").alias(g) for g in GROUPS))


def frame_sources(rows: DataFrame) -> DataFrame:
    """All source images that frames were derived from: ``file_path, frame, derivation, source, sop_class, sop_uid``, one row each."""
    fields = {"sop_class": ("00081150", "text"), "sop_uid": ("00081155", "text")}
    found = item_rows(rows, (PER_FRAME, 0x00089124, 0x00082112), fields)
    return found.select("file_path", *(F.get("place", i).alias(n) for i, n in enumerate(("frame", "derivation", "source"))), "sop_class", "sop_uid")


def pixel_element(has_float: Column, has_double: Column, has_integer: Column) -> Column:
    """Which pixel element an object has."""
    there = lambda c: F.coalesce(c, F.lit(False))
    return F.when(there(has_float), "float").when(there(has_double), "double").when(there(has_integer), "integer").otherwise("none")


def object_family(sop_class: Column, element: Column) -> Column:
    """(family, role, status): by the class of segmentations, dose grids and maps, else by the pixel element."""
    c = F.trim(F.coalesce(sop_class, F.lit("")))
    place = F.when(c == SEGMENTATION, 1).when(c == DOSE, 2).when(c == PARAMETRIC_MAP, 3).when(element == "float", 4).when(element == "double", 5).otherwise(0)
    rows = F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(row, ("family", "role", "status"), strict=True))) for row in FAMILIES))
    return F.get(rows, place)


def payload_problem(family: Column, element: Column, has_segments: Column, has_dose: Column, dose_scaling: Column, offsets: Column, frames: Column, has_map: Column) -> Column:
    """Why no typed payload can be made of an object; null where one can."""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    dose = F.when(no(has_dose), "no dose grid").when(no(F.trim(dose_scaling) != ""), "no dose grid scaling").when(no((F.coalesce(offsets, F.lit(0)) > 0) | (frames == 1)), "no grid frame offsets")
    return (
        F.when((family == "segmentation") & no(has_segments), "no segments").when(family == "rt-dose", dose).when((family == "parametric-map") & no(has_map), "no real world values")
        .when((family == "classic-image") & (element != "integer"), "no pixel data").when(family.isin("float-pixel-data", "double-float-pixel-data"), "no consumer of float pixels")
    )


def capture_issues(values: dict[str, Column], clinical: Column) -> Column:
    """What a clinical export of a secondary capture lacks: the names, in their order, of missing or blank ``values``; nothing for other exports."""
    missing = F.array_compact(F.array(*(F.when(~F.coalesce(c.cast("string").rlike(r"[^\s\x00]"), F.lit(False)), name) for name, c in values.items())))
    return F.when(F.coalesce(clinical, F.lit(False)), missing).otherwise(F.array().cast("array<string>"))


def content_items(rows: DataFrame) -> DataFrame:
    """Element rows of reports to their content items, in the columns that ``item_issues`` takes; one row per item, with ``path`` from ``root``.

    The items of a file are told apart by their place in the tree, at any depth, by one aggregation. Items without a value type that hold
    something are containers; items with nothing are left out.
    """
    inside = rows.withColumn("item", F.regexp_extract("path", rf"^((?:{CONTENT}\[\d+\]/)*)", 1)).withColumn("below", F.substring("path", F.length("item") + 1, F.length("path")))
    reference = r"^00081199\[(\d+)\]/(0008115[05])$"
    wanted = inside.where(F.col("below").isin([tag for tag, _ in ITEM.values()]) | F.col("below").rlike(reference) | (F.col("below") == CONTENT))
    text = F.when(~_blank(F.get("values", 0)), F.get("values", 0))
    read = {"text": text, "number": F.get("numbers", 0), "numbers": F.col("numbers")}
    named = F.struct(F.regexp_extract("below", reference, 1).cast("int").alias("n"), F.regexp_extract("below", reference, 2).alias("tag"), text.alias("value"))
    fields = [F.max(F.when(F.col("below") == tag, read[kind])).alias(name) for name, (tag, kind) in ITEM.items()]
    found = wanted.groupBy("file_path", "item").agg(*fields, F.array_sort(F.collect_list(F.when(F.col("below").rlike(reference), named))).alias("named"), F.max(F.col("below") == CONTENT).alias("has_children"))

    def of(place: Column, tag: str) -> Column:
        return F.get(F.filter("named", lambda r: (r["n"] == place) & (r["tag"] == tag)), 0)["value"]

    def code(name: str) -> Column:
        there = F.col(f"{name}_code").isNotNull() | F.col(f"{name}_scheme").isNotNull()
        return F.when(there, F.struct(F.col(f"{name}_code").alias("code"), F.col(f"{name}_scheme").alias("scheme"))).alias(name)

    something = reduce(or_, (F.col(c).isNotNull() for c in ("value_type", "relationship", "text", "concept_code", "measured", "units_code"))) | (F.size("named") > 0) | F.col("has_children")
    references = F.transform(F.array_distinct(F.transform("named", lambda r: r["n"])), lambda n: F.struct(of(n, "00081150").alias("sop_class"), of(n, "00081155").alias("sop_uid")))
    place = F.concat(F.lit("root"), F.regexp_replace("item", rf"{CONTENT}\[(\d+)\]/", "/$1"))
    return found.where(something).select(
        "file_path", place.alias("path"), "relationship", F.coalesce("value_type", F.lit("CONTAINER")).alias("value_type"), code("concept"), "text", code("code"), F.coalesce("measured", "number").alias("number"), code("units"),
        references.alias("references"), "graphic_type", F.col("graphic_data"), "uid", "date_time", "date", "time", "person_name",
    )


def _blank(c: Column) -> Column:
    return ~F.coalesce(c.rlike(r"[^\s\x00]"), F.lit(False))


def _issue(when: Column, path: Column, issue: str, detail: Column | None = None) -> Column:
    said = F.lit(None).cast("string") if detail is None else detail
    return F.when(F.coalesce(when, F.lit(False)), F.struct(path.alias("path"), F.lit(issue).alias("issue"), said.alias("detail")))


def _concept(c: Column, path: Column, at: Column) -> list[Column]:
    """Issues of a code: missing, or of an unknown scheme."""
    missing = c.isNull() | _blank(c["code"]) | _blank(c["scheme"])
    return [_issue(at & missing, path, "missing concept name"), _issue(at & ~missing & ~c["scheme"].isin(list(SCHEMES)), path, "unsupported coding scheme", c["scheme"])]


def _reference_issues(references: Column, path) -> Column:
    """An issue for each reference without class or instance."""
    bad = F.transform(references, lambda r, i: F.when(_blank(r["sop_class"]) | _blank(r["sop_uid"]), F.struct(path(i).alias("path"), F.lit("missing referenced object").alias("issue"), F.lit(None).cast("string").alias("detail"))))
    return F.coalesce(F.filter(bad, lambda x: x.isNotNull()), F.array().cast("array<struct<path:string,issue:string,detail:string>>"))


def item_issues(items: DataFrame) -> DataFrame:
    """Rules for single content items, which stay where they are: ``file_path, path, issue, detail``.

    ``items`` have ``path`` (``root``, ``root/0``, ...), ``relationship``, ``value_type``, codes ``concept``, ``code`` and ``units`` (structs of
    ``code`` and ``scheme``), ``text``, ``number``, ``references`` (structs of ``sop_class`` and ``sop_uid``), ``graphic_type``, ``graphic_data``,
    ``uid``, ``date_time``, ``date``, ``time`` and ``person_name``; any may be null.
    """
    c = F.col
    path, kind, relation = c("path"), c("value_type"), c("relationship")
    yes, inner = F.lit(True), c("path") != "root"
    by_reference = relation.startswith("R-")
    values = {"TEXT": "text", "UIDREF": "uid", "DATETIME": "date_time", "DATE": "date", "TIME": "time", "PNAME": "person_name"}
    n = F.when(c("graphic_data").isNull(), 0).otherwise(F.size("graphic_data"))
    drawn = F.when(c("graphic_type") == "POINT", n == 2).when(c("graphic_type").isin("MULTIPOINT", "POLYLINE"), (n >= 4) & (n % 2 == 0)).when(c("graphic_type") == "CIRCLE", n == 4).when(c("graphic_type") == "ELLIPSE", n == 8).otherwise(F.lit(False))
    single = [
        _issue(~F.coalesce(kind.isin(list(VALUE_TYPES)), F.lit(False)), path, "unsupported value type", kind),
        _issue(inner & relation.isNull(), path, "missing relationship"),
        _issue(inner & by_reference, path, "unsupported relationship by reference", relation),
        _issue(inner & ~by_reference & ~relation.isin(list(RELATIONSHIPS)), path, "unsupported relationship", relation),
        _issue(inner & (relation == "HAS OBS CONTEXT") & ~F.coalesce(kind.isin(list(CONTEXT_TYPES)), F.lit(False)), path, "unsupported value type", kind),
        *_concept(c("concept"), F.concat(path, F.lit(".conceptName")), yes),
        *(_issue((kind == k) & _blank(c(v)), path, "missing value", kind) for k, v in values.items()),
        _issue((kind == "CODE") & c("code").isNull(), path, "missing value", kind),
        *_concept(c("code"), F.concat(path, F.lit(".codeValue")), (kind == "CODE") & c("code").isNotNull()),
        _issue((kind == "NUM") & c("number").isNull(), path, "missing number"),
        _issue((kind == "NUM") & c("units").isNull(), path, "missing units"),
        *_concept(c("units"), F.concat(path, F.lit(".measurementUnits")), (kind == "NUM") & c("units").isNotNull()),
        _issue((kind == "NUM") & c("units").isNotNull() & ~F.coalesce(c("units.scheme").isin(list(UNIT_SCHEMES)), F.lit(False)), path, "unsupported unit scheme", c("units.scheme")),
        _issue((kind == "IMAGE") & ~F.coalesce(F.size("references") > 0, F.lit(False)), path, "missing referenced object"),
        _issue((kind == "SCOORD") & ~drawn, path, "invalid graphic data", F.concat_ws(" ", "graphic_type", n.cast("string"))),
    ]
    listed = F.when(kind == "IMAGE", _reference_issues(c("references"), lambda i: F.concat(path, F.lit(".referencedSOP["), i.cast("string"), F.lit("]")))).otherwise(F.array().cast("array<struct<path:string,issue:string,detail:string>>"))
    return items.select("file_path", F.explode(F.concat(F.array_compact(F.array(*single)), listed)).alias("e")).select("file_path", "e.*")


def document_issues(documents: DataFrame) -> DataFrame:
    """Rules for whole reports: ``file_path, path, issue, detail``.

    ``documents`` have ``sop_class``, ``template``, the root's ``value_type`` and ``concept``, ``evidence`` (an array of references) and ``n_key_references``.
    """
    c, nowhere = F.col, F.lit(None).cast("string")
    known = F.coalesce(c("sop_class").isin(ENHANCED_REPORT, COMPREHENSIVE_REPORT, KEY_OBJECTS), F.lit(False))
    measured = c("sop_class").isin(ENHANCED_REPORT, COMPREHENSIVE_REPORT)
    template = F.when(measured, F.coalesce(c("template") == MEASUREMENT_TEMPLATE, F.lit(False))).otherwise(F.coalesce(c("template"), F.lit("")) == "")
    rooted = (c("concept.code") == ROOT_CODE) & (c("concept.scheme") == ROOT_SCHEME)
    single = [
        _issue(~known, nowhere, "unsupported class", c("sop_class")),
        _issue(known & ~template, nowhere, "unsupported template", c("template")),
        _issue(known & ~F.coalesce(c("value_type") == "CONTAINER", F.lit(False)), F.lit("root"), "unsupported root value type", c("value_type")),
        _issue(known & measured & c("concept").isNull(), F.lit("root"), "missing concept name"),
        _issue(known & measured & c("concept").isNotNull() & ~F.coalesce(rooted, F.lit(False)), F.lit("root"), "unsupported root concept", F.concat_ws("/", "concept.scheme", "concept.code")),
        _issue((c("sop_class") == KEY_OBJECTS) & (F.coalesce(c("n_key_references"), F.lit(0)) == 0), nowhere, "missing evidence"),
    ]
    listed = _reference_issues(c("evidence"), lambda i: F.concat(F.lit("evidence["), i.cast("string"), F.lit("]")))
    return documents.select("file_path", F.explode(F.concat(F.array_compact(F.array(*single)), listed)).alias("e")).select("file_path", "e.*")


def vendor_tags(data: bytes) -> list[dict[str, object]] | None:
    """Tags of one vendor header with or without its mark; None where it is cut short or a count is out of its bounds."""
    at, tags = 8 if data[:4] == b"SV10" else 0, []
    try:
        count, _ = struct.unpack_from("<II", data, at)
        at += 8
        if not 0 < count < 1024:
            return None
        for _ in range(count):
            name, vm, vr, _, items, _ = struct.unpack_from("<64sI4sIII", data, at)
            at += 84
            if items >= 1024:
                return None
            values = []
            for _ in range(items):
                size = struct.unpack_from("<IIII", data, at)[0]
                at += 16
                if at + (size + 3) // 4 * 4 > len(data):
                    return None
                values.append(_plain(data[at : at + size]))
                at += (size + 3) // 4 * 4
            tags.append({"name": _plain(name), "vr": _plain(vr), "vm": vm, "values": [v for v in values if v]})
    except struct.error:
        return None
    return tags


def _plain(raw: bytes) -> str:
    """Text up to the first zero byte, trimmed."""
    return raw.split(b"\0")[0].decode(errors="replace").strip()


def vendor_headers(elements: DataFrame, name: str = "binary") -> DataFrame:
    """``elements`` (file_path, path, and a binary column) with ``tags`` read from it, one row for each element that is a vendor header."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("name", pa.string()), ("vr", pa.string()), ("vm", pa.int64()), ("values", pa.list_(pa.string()))]))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["file_path"], batch["path"], pa.array([vendor_tags(b or b"") for b in batch[name].to_pylist()], kind)], ["file_path", "path", "tags"])

    found = elements.select("file_path", "path", name).mapInArrow(run, "file_path string, path string, tags array<struct<name:string,vr:string,vm:bigint,values:array<string>>>")
    return found.where("tags is not null")
