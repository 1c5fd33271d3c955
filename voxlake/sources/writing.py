"""Element rows back to Part 10 files, one file at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import part10

#: Representations that the character set applies to, and the one that every text fits.
BY_CHARSET, CHARSET, UNICODE = ("LO", "LT", "PN", "SH", "ST", "UC", "UT"), 0x00080005, "ISO_IR 192"


def encode_text(texts: list[str], charset: str) -> tuple[list[bytes], str]:
    """Texts in the named character set, or all of them in Unicode where one does not fit, and the set that was taken."""
    codec = part10.CHARSETS.get(charset.strip(), "utf-8")
    try:
        return [t.encode(codec) for t in texts], charset
    except UnicodeEncodeError:
        return [t.encode() for t in texts], UNICODE


def _value(vr: str, values: list[str], binary: bytes | None) -> object:
    if vr in part10._NUMBERS:
        whole = part10._NUMBERS[vr] not in "fd"
        return [int(float(v)) if whole else float(v) for v in values]
    return binary or b"" if binary is not None or vr.startswith("O") or vr == "UN" else "\\".join(values)


def _nested(elements: list[dict]) -> list[tuple[int, str, object]]:
    """(tag, representation, value) lists, one for each item, by the elements' paths."""
    root: dict[int, list] = {}
    for e in elements:
        node, *steps = root, *e["path"].split("/")
        for step in steps[:-1]:
            items = node.setdefault(int(step[:8], 16), ["SQ", {}])[1]
            node = items.setdefault(int(step[9:-1]), {})
        tag = int(steps[-1], 16)
        if e["vr"] == "SQ":
            node.setdefault(tag, ["SQ", {}])
        else:
            node[tag] = [e["vr"], _value(e["vr"], e["values"] or [], e["binary"])]

    def listed(node: dict[int, list]) -> list[tuple[int, str, object]]:
        return [(tag, vr, [listed(v.get(i, {})) for i in range(max(v, default=-1) + 1)] if vr == "SQ" else v) for tag, (vr, v) in node.items()]

    return listed(root)


def _file(elements: list[dict], syntax: str) -> bytes:
    """A file; texts are written in the file's character set, or in Unicode, which the file then names."""
    own = next((e for e in elements if e["path"] == f"{CHARSET:08X}"), None)
    texts = [e for e in elements if e["vr"] in BY_CHARSET and e["binary"] is None]
    encoded, charset = encode_text(["\\".join(e["values"] or []) for e in texts], (own["values"] or [""])[-1] if own else "")
    for e, raw in zip(texts, encoded, strict=True):
        e["binary"] = raw
    if charset == UNICODE:
        # The sets of items would hide the file's.
        elements = [e for e in elements if not e["path"].endswith(f"{CHARSET:08X}")] + [{"path": f"{CHARSET:08X}", "vr": "CS", "values": [UNICODE], "binary": None}]
    return part10.write(_nested(elements), syntax)


def files(rows: DataFrame, syntax: str = part10.EXPLICIT_LE) -> DataFrame:
    """Element rows (file_path, path, vr, values, and binary where there is one) to ``file_path, content, error``, a row per file.

    The elements of a file meet in one group, which is no larger than the file. Group 2 and group lengths are written anew; items that
    lack between others are written empty. Pixels that were not read, encapsulated ones, and numbers that are none, give an error instead
    of a file.
    """
    binary = F.col("binary") if "binary" in rows.columns else F.lit(None).cast("binary")
    length = F.col("length") if "length" in rows.columns else F.lit(None).cast("bigint")
    own = rows.where(~F.col("path").startswith("0002") & ~F.col("path").rlike("0000$"))
    lost = F.when((F.col("path") == f"{part10.PIXEL_DATA:08X}") & (F.coalesce(length, F.lit(0)) < 0), "encapsulated pixels").when((F.col("path") == f"{part10.PIXEL_DATA:08X}") & binary.isNull(), "pixels were not read")
    grouped = own.groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("path", "vr", "values", binary.alias("binary")))).alias("elements"), F.max(lost).alias("lost"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.binary(), pa.string()))], ["file_path", "content", "error"])

        held, size = [], 0
        for batch in batches:
            for path, elements, error in zip(batch["file_path"], batch["elements"], batch["lost"].to_pylist(), strict=True):
                content = None
                if error is None:
                    try:
                        content = _file(elements.as_py(), syntax)
                    except (ValueError, OverflowError, part10.struct.error) as e:
                        error = str(e)
                held.append((path.as_py(), content, error))
                size += len(content or b"")
                if size >= part10.BATCH_BYTES or len(held) >= part10.BATCH_ELEMENTS:
                    yield made(held)
                    held, size = [], 0
        if held:
            yield made(held)

    return grouped.mapInArrow(run, "file_path string, content binary, error string")
