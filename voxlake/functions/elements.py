"""Data sets as maps and arrays of elements: edits, orders, unions, JSON and XML texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import xml_escaped


def with_tag(tags: Column, tag: int, values: Column) -> Column:
    """A map of tag to values with one tag set."""
    return F.map_concat(without_tag(tags, tag), F.create_map(F.lit(tag), values))


def without_tag(tags: Column, tag: int) -> Column:
    return F.map_filter(tags, lambda k, _: k != tag)


def in_tag_order(tags: Column) -> Column:
    """The map's (key, value) pairs by tag."""
    return F.array_sort(F.map_entries(tags))


def all_tags(parsed: Column, lazy: Column) -> Column:
    """Tags of two maps, each once, in order."""
    return F.array_sort(F.array_union(F.map_keys(parsed), F.map_keys(lazy)))


def multiplicity(values: Column, raw: Column) -> Column:
    """Number of values; bytes count as one, nothing as none."""
    return F.when(values.isNotNull(), F.size(values)).when(F.octet_length(raw) > 0, 1).otherwise(0)


def new_uid(seed: Column) -> Column:
    """``2.25.`` and the decimal form of 96 bits of a hash of the seed: the same again when a task is retried."""
    part = lambda at: F.conv(F.substring(F.sha2(seed.cast("binary"), 256), at, 12), 16, 10)
    return F.concat(F.lit("2.25."), part(1), F.lpad(part(13), 15, "0"))


def resolved(frame: Column, shared: Column, groups: tuple[str, ...]) -> Column:
    """Functional groups of a frame, the shared ones where it has none."""
    return F.struct(*(F.coalesce(frame[g], shared[g]).alias(g) for g in groups))


def same_object(left: Column, right: Column) -> Column:
    """References to one object: equal class, instance and frame numbers."""
    return left["sop_class"].eqNullSafe(right["sop_class"]) & left["sop_uid"].eqNullSafe(right["sop_uid"]) & left["frames"].eqNullSafe(right["frames"])


def unique_references(references: Column) -> Column:
    """References without repetitions, in the order of their first."""
    return F.array_distinct(references)


def matching_items(items: Column, wanted) -> Column:
    """Flattened content items for which the caller's function of an item is true."""
    return F.filter(items, wanted)


def is_cad_finding(*texts: Column) -> Column:
    """Any of the names holds CAD or FINDING, in any case."""
    return F.upper(F.concat_ws(" ", *texts)).rlike("CAD|FINDING")


def _quoted(value: Column) -> Column:
    """A JSON string; slashes are escaped too."""
    inner = F.to_json(F.array(value))
    return F.replace(F.substring(inner, F.lit(2), F.length(inner) - 2), F.lit("/"), F.lit("\\/"))


#: Representations whose values are numbers in JSON.
NUMBERS = ("US", "UL", "SS", "SL", "FL", "FD", "OF", "OD", "AT")


def _member(items: Column) -> Column:
    """One element as a member of a JSON object, with the keys in order; ``items`` is the text of a sequence's items."""
    quoted = F.transform("values", lambda v: F.when(F.col("vr") == "PN", F.concat(F.lit('{"Alphabetic":'), _quoted(v), F.lit("}"))).when(F.col("vr").isin(list(NUMBERS)), v).otherwise(_quoted(v)))
    value = (
        F.when(F.col("vr") == "SQ", F.concat(F.lit('"Value":'), F.coalesce(items, F.lit("[]")), F.lit(",")))
        .when(F.size("values") > 0, F.concat(F.lit('"Value":['), F.array_join(quoted, ","), F.lit("],")))
        .when(F.octet_length("binary") > 0, F.concat(F.lit('"InlineBinary":'), _quoted(F.base64("binary")), F.lit(","))).otherwise("")
    )
    return F.concat(F.lit('"'), F.format_string("%08X", F.col("tag")), F.lit('":{'), value, F.lit('"vr":"'), F.col("vr"), F.lit('"}'))


def json_documents(rows: DataFrame, file: str = "file_path", most_depth: int = 8) -> DataFrame:
    """Element rows (path, parent, depth, tag, vr, values, binary) to one JSON text per file, without pixels, tags in order.

    Sequences are put together level by level from the innermost; elements below ``most_depth`` levels are refused.
    """
    plain = rows.where((F.col("tag") != 0x7FE00010) | (F.col("depth") > 0))
    plain = plain.withColumn("depth", F.when(F.col("depth") > most_depth, F.raise_error(F.lit("sequences are nested too deeply")).cast("int")).otherwise(F.col("depth")))
    text = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tag", "member"))), lambda m: m["member"]), ","), F.lit("}"))
    lower = None
    for depth in range(most_depth, -1, -1):
        level = plain.where(F.col("depth") == depth)
        if lower is None:
            level = level.withColumn("items", F.lit(None).cast("string"))
        else:
            sequences = lower.withColumn("path", F.regexp_replace("parent", r"\[\d+\]$", "")).withColumn("n", F.regexp_extract("parent", r"\[(\d+)\]$", 1).cast("int"))
            listed = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "object"))), lambda i: i["object"]), ","), F.lit("]"))
            level = level.join(sequences.groupBy(file, "path").agg(listed.alias("items")), [file, "path"], "left")
        members = level.select(file, "parent", "tag", _member(F.col("items")).alias("member"))
        lower = members.groupBy(*([file] if depth == 0 else [file, "parent"])).agg(text.alias("object"))
    return lower.withColumnRenamed("object", "json")


def json_elements(documents: DataFrame, file: str = "file_path", json: str = "json") -> DataFrame:
    """JSON texts to one row (tag, vr, values, binary) per top-level element, by tag; items of sequences stay JSON texts."""
    kind = "map<string,struct<vr:string,Value:array<string>,InlineBinary:string,BulkDataURI:string>>"
    rows = documents.select(file, F.explode(F.from_json(json, kind)).alias("tag", "e"))
    text = lambda v: F.when(F.col("e.vr") == "PN", F.coalesce(F.get_json_object(v, "$.Alphabetic"), F.get_json_object(v, "$.Ideographic"), F.get_json_object(v, "$.Phonetic"), v)).otherwise(v)
    values = F.when(F.col("e.InlineBinary").isNotNull(), None).when(F.col("e.BulkDataURI").isNotNull(), F.array("e.BulkDataURI")).otherwise(F.transform("e.Value", text))
    return rows.select(file, F.conv("tag", 16, 10).cast("int").alias("tag"), F.col("e.vr").alias("vr"), values.alias("values"), F.try_to_binary("e.InlineBinary", F.lit("base64")).alias("binary"))


def xml_documents(rows: DataFrame, file: str = "file_path") -> DataFrame:
    """Top-level elements, without pixels, as one XML text per file."""
    values = F.array_join(F.transform("values", lambda v, i: F.concat(F.lit('<Value number="'), (i + 1).cast("string"), F.lit('">'), xml_escaped(v), F.lit("</Value>"))), "")
    element = F.concat(F.lit('<DicomAttribute tag="'), F.format_string("%08X", F.col("tag")), F.lit('" vr="'), F.col("vr"), F.lit('">'), F.coalesce(values, F.lit("")), F.lit("</DicomAttribute>"))
    top = rows.where((F.col("depth") == 0) & (F.col("tag") != 0x7FE00010)).select(file, F.struct("tag", element.alias("text")).alias("e"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["text"]), "")
    return top.groupBy(file).agg(F.concat(F.lit("<NativeDicomModel>"), listed, F.lit("</NativeDicomModel>")).alias("xml"))
