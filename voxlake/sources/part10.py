"""Part 10 image files as rows: headers, long element tables, frames.

Only bytes are parsed in Python, a file at a time inside Arrow batches; everything after that is DataFrame work on the element table.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import remote

#: Value representations with 32-bit lengths.
LONG_VR = ("OB", "OD", "OF", "OL", "OV", "OW", "SQ", "SV", "UC", "UN", "UR", "UT", "UV")
#: Transfer syntaxes of uncompressed data, and the deflated one.
IMPLICIT_LE, EXPLICIT_LE, DEFLATED_LE, EXPLICIT_BE = "1.2.840.10008.1.2", "1.2.840.10008.1.2.1", "1.2.840.10008.1.2.1.99", "1.2.840.10008.1.2.2"
#: Representations of common elements, for files that do not name them.
DICTIONARY = {
    0x00080005: "CS", 0x00080016: "UI", 0x00080018: "UI", 0x00080020: "DA", 0x00080030: "TM", 0x00080050: "SH", 0x00080060: "CS", 0x00080061: "CS", 0x00080080: "LO", 0x00080090: "PN", 0x00081030: "LO", 0x0008103E: "LO",
    0x00081110: "SQ", 0x00081115: "SQ", 0x00081140: "SQ", 0x00081150: "UI", 0x00081155: "UI", 0x00100010: "PN", 0x00100020: "LO", 0x00100030: "DA", 0x00100040: "CS", 0x00101010: "AS", 0x00101030: "DS", 0x00180015: "CS", 0x00180050: "DS",
    0x00180088: "DS", 0x0020000D: "UI", 0x0020000E: "UI", 0x00200010: "SH", 0x00200011: "IS", 0x00200013: "IS", 0x00200032: "DS", 0x00200037: "DS", 0x00200052: "UI", 0x00280002: "US", 0x00280004: "CS", 0x00280006: "US", 0x00280008: "IS",
    0x00280010: "US", 0x00280011: "US", 0x00280030: "DS", 0x00280100: "US", 0x00280101: "US", 0x00280102: "US", 0x00280103: "US", 0x00281050: "DS", 0x00281051: "DS", 0x00281052: "DS", 0x00281053: "DS", 0x00400275: "SQ", 0x0040A043: "SQ",
    0x0040A040: "CS", 0x0040A160: "UT", 0x0040A168: "SQ", 0x0040A300: "SQ", 0x0040A30A: "DS", 0x0040A730: "SQ", 0x00041220: "SQ", 0x00041400: "UL", 0x00041420: "UL", 0x00041430: "CS", 0x00041500: "CS", 0x7FE00010: "OW",
    # Directory records, codes and references.
    0x00041130: "CS", 0x00041200: "UL", 0x00041202: "UL", 0x00041212: "US", 0x00041410: "US", 0x00041510: "UI", 0x00041511: "UI", 0x00041512: "UI", 0x00080100: "SH", 0x00080102: "SH", 0x00080104: "LO", 0x00081160: "IS", 0x00082112: "SQ", 0x00089124: "SQ",
    # Content items.
    0x00081199: "SQ", 0x004008EA: "SQ", 0x0040A010: "CS", 0x0040A120: "DT", 0x0040A121: "DA", 0x0040A122: "TM", 0x0040A123: "PN", 0x0040A124: "UI", 0x00700022: "FL", 0x00700023: "CS",
    # Functional groups.
    0x00209056: "SH", 0x00209057: "UL", 0x00209111: "SQ", 0x00209113: "SQ", 0x00209116: "SQ", 0x00209128: "UL", 0x00209156: "US", 0x00209157: "UL", 0x00289110: "SQ", 0x00289145: "SQ", 0x52009229: "SQ", 0x52009230: "SQ",
    # Segments.
    0x00620001: "CS", 0x00620002: "SQ", 0x00620003: "SQ", 0x00620004: "US", 0x00620005: "LO", 0x00620006: "ST", 0x00620008: "CS", 0x00620009: "LO", 0x0062000A: "SQ", 0x0062000B: "US", 0x0062000D: "US", 0x0062000E: "US", 0x0062000F: "SQ", 0x00620010: "CS", 0x00620020: "UT", 0x00620021: "UI",
    # Dose, structures and plans.
    0x3004000C: "DS", 0x3004000E: "DS", 0x30060020: "SQ", 0x30060022: "IS", 0x30060026: "LO", 0x3006002A: "IS", 0x30060039: "SQ", 0x30060040: "SQ", 0x30060042: "CS", 0x30060046: "IS", 0x30060050: "DS", 0x30060080: "SQ", 0x30060084: "IS", 0x30060085: "SH", 0x300600A4: "CS",
    0x300A0002: "SH", 0x300A0003: "LO", 0x300A0004: "ST", 0x300A000C: "CS", 0x300A00B0: "SQ", 0x300A00B2: "SH", 0x300A00B3: "CS", 0x300A00B4: "DS", 0x300A00C0: "IS", 0x300A00C2: "LO", 0x300A00C3: "ST", 0x300A00C4: "CS", 0x300A00C6: "CS", 0x300A0110: "IS", 0x300A0111: "SQ", 0x300A0112: "IS",
    0x300A0114: "DS", 0x300A011E: "DS", 0x300A0120: "DS", 0x300A0122: "DS", 0x300A0125: "DS", 0x300A012C: "DS", 0x300A0134: "DS",
}
#: Character sets by their defined terms.
CHARSETS = {"": "ascii", "ISO_IR 6": "ascii", "ISO_IR 100": "latin-1", "ISO_IR 101": "iso8859-2", "ISO_IR 109": "iso8859-3", "ISO_IR 110": "iso8859-4", "ISO_IR 144": "iso8859-5", "ISO_IR 127": "iso8859-6", "ISO_IR 126": "iso8859-7", "ISO_IR 138": "iso8859-8", "ISO_IR 148": "iso8859-9", "ISO_IR 13": "shift_jis", "ISO_IR 166": "tis-620", "ISO_IR 192": "utf-8", "GB18030": "gb18030", "GBK": "gbk"}
PIXEL_DATA, UNDEFINED = 0x7FE00010, 0xFFFFFFFF
#: Elements of the top level, nested ones not counted, after which reading stops; rows or columns at most.
MOST_ELEMENTS, MOST_SIDE = 10_000, 65_536
#: Entries of a data dictionary.
MOST_TAGS = 100_000
#: Elements, and bytes of files, after which a batch of parsed files is passed on.
BATCH_ELEMENTS, BATCH_BYTES = 10_000, 4_000_000

_ELEMENT = "path string, parent string, depth int, tag int, vr string, `values` array<string>, numbers array<double>, `binary` binary, `offset` bigint, length bigint"
SCHEMA = f"file_path string, file_size bigint, transfer_syntax string, error string, elements array<struct<{_ELEMENT}>>"

_FIELDS = {
    "path": pa.string(), "parent": pa.string(), "depth": pa.int32(), "tag": pa.int32(), "vr": pa.string(), "values": pa.list_(pa.string()), "numbers": pa.list_(pa.float64()), "binary": pa.binary(), "offset": pa.int64(), "length": pa.int64(),
}

_TEXT = frozenset(("AE", "AS", "CS", "DA", "DS", "DT", "IS", "LO", "LT", "PN", "SH", "ST", "TM", "UC", "UI", "UR", "UT"))
_WHOLE = frozenset(("LT", "ST", "UT", "UR"))
_NUMBERS = {"US": "H", "SS": "h", "UL": "I", "SL": "i", "FL": "f", "FD": "d", "AT": "H", "OF": "f", "OD": "d"}


class Malformed(ValueError):
    """What keeps a file from being read."""


def decode_text(raw: bytes, charset: str) -> str:
    """By the named character set, else as UTF-8, else as Latin-1; cut at NUL."""
    for name in (CHARSETS.get(charset.strip(), "utf-8"), "utf-8", "latin-1"):
        try:
            return raw.split(b"\0")[0].decode(name)
        except UnicodeDecodeError:
            continue
    return ""


class _Reader:
    def __init__(self, data: bytes, explicit: bool, big: bool, with_pixels: bool, dictionary: dict[int, str] = DICTIONARY):
        self.dictionary = dictionary
        self.data, self.explicit, self.order, self.with_pixels = data, explicit, ">" if big else "<", with_pixels
        self.charset, self.rows, self.top = "", [], 0

    def header(self, at: int, explicit: bool) -> tuple[int, str, int, int]:
        """Tag, representation, length and the place of the value."""
        if at + 8 > len(self.data):
            raise Malformed(f"an element at {at} has no header")
        group, element = struct.unpack_from(self.order + "HH", self.data, at)
        tag = group << 16 | element
        if group == 0xFFFE or not explicit:
            return tag, "" if group == 0xFFFE else self.dictionary.get(tag, "UN"), struct.unpack_from(self.order + "I", self.data, at + 4)[0], at + 8
        vr = self.data[at + 4 : at + 6].decode("latin-1")
        if vr in LONG_VR:
            if at + 12 > len(self.data):
                raise Malformed(f"an element at {at} has no length")
            return tag, vr, struct.unpack_from(self.order + "I", self.data, at + 8)[0], at + 12
        return tag, vr, struct.unpack_from(self.order + "H", self.data, at + 6)[0], at + 8

    def dataset(self, at: int, end: int, parent: str, depth: int, explicit: bool, to_item_end: bool = False) -> int:
        if depth > 32:
            raise Malformed("sequences are nested too deeply")
        while at < end:
            tag, vr, length, start = self.header(at, explicit)
            if tag == 0xFFFEE00D and to_item_end:
                return start
            if tag >> 16 == 0xFFFE:
                raise Malformed(f"an item mark at {at} stands outside a sequence")
            if depth == 0:
                self.top += 1
                if self.top > MOST_ELEMENTS:
                    return end
            path = f"{parent}{tag:08X}"
            row = {"path": path, "parent": parent.rstrip("/") or None, "depth": depth, "tag": tag - 2**32 if tag >= 2**31 else tag, "vr": vr, "offset": start, "length": length if length != UNDEFINED else -1}
            self.rows.append(row)
            if tag == PIXEL_DATA and depth == 0:
                if self.with_pixels:
                    row["binary"] = self.data[start : end if length == UNDEFINED else start + length]
                return end
            if vr == "SQ" or length == UNDEFINED:
                at = self.sequence(start, end if length == UNDEFINED else min(end, start + length), path, depth, explicit and vr != "UN", length == UNDEFINED)
                continue
            stop = min(start + length, end)
            self.value(row, self.data[start:stop], vr, tag)
            at = stop
        if to_item_end:
            raise Malformed("an item has no end")
        return at

    def sequence(self, at: int, end: int, path: str, depth: int, explicit: bool, marked: bool, n: int = 0) -> int:
        while at < end:
            tag, _, length, start = self.header(at, explicit)
            if tag == 0xFFFEE0DD:
                return start
            if tag != 0xFFFEE000:
                raise Malformed(f"{path} holds something else than items at {at}")
            inside = f"{path}[{n}]/"
            if length == UNDEFINED:
                at = self.dataset(start, end, inside, depth + 1, explicit, True)
            else:
                if start + length > end:
                    raise Malformed(f"item {n} of {path} is longer than its sequence")
                at = self.dataset(start, start + length, inside, depth + 1, explicit)
            n += 1
        if marked:
            raise Malformed(f"{path} has no end")
        return at

    def value(self, row: dict, raw: bytes, vr: str, tag: int) -> None:
        if vr in _TEXT:
            text = decode_text(raw, self.charset if vr in ("LO", "LT", "PN", "SH", "ST", "UC", "UT") else "")
            row["values"] = [text.strip(" \0")] if vr in _WHOLE else [v.strip(" \0") for v in text.split("\\")]
            if tag == 0x00080005:
                self.charset = row["values"][-1]
            if vr in ("DS", "IS"):
                row["numbers"] = [_number(v) for v in row["values"]]
        elif vr in _NUMBERS:
            form = _NUMBERS[vr]
            count = len(raw) // struct.calcsize(form)
            row["numbers"] = [float(v) for v in struct.unpack_from(f"{self.order}{count}{form}", raw)]
            row["values"] = [f"{v:g}" if form in "fd" else str(int(v)) for v in row["numbers"]]
        else:
            row["binary"] = raw


def _number(value: str) -> float | None:
    try:
        return float(value)
    except ValueError:
        return None


def parse(data: bytes, with_pixels: bool = False, dictionary: dict[int, str] = DICTIONARY) -> tuple[str, list[dict]]:
    """Transfer syntax and element rows of a file: group 2 explicit, then the data set as its syntax says; pixels last and only on request."""
    if len(data) < 132 or data[128:132] != b"DICM":
        raise Malformed("no DICM mark at 128")
    meta = _Reader(data, True, False, False)
    at = 132
    while at + 8 <= len(data) and data[at : at + 2] == b"\x02\0":
        tag, vr, length, start = meta.header(at, True)
        row = {"path": f"{tag:08X}", "parent": None, "depth": 0, "tag": tag, "vr": vr, "offset": start, "length": length}
        meta.value(row, data[start : start + length], vr, tag)
        meta.rows.append(row)
        at = start + length
    syntax = next((r["values"][0] for r in meta.rows if r["tag"] == 0x00020010), IMPLICIT_LE)
    if syntax == DEFLATED_LE:
        data, at = zlib.decompressobj(-15).decompress(data[at:]), 0
    body = _Reader(data, syntax != IMPLICIT_LE, syntax == EXPLICIT_BE, with_pixels, dictionary)
    body.dataset(at, len(data), "", 0, body.explicit)
    sides = {r["tag"]: r["numbers"][0] for r in body.rows if r["tag"] in (0x00280010, 0x00280011) and r["depth"] == 0 and r.get("numbers")}
    if any(not 0 < v <= MOST_SIDE for v in sides.values()):
        raise Malformed("rows or columns are out of range")
    return syntax, meta.rows + body.rows


def parse_items(data: bytes, path: str, item: int, offset: int) -> list[dict]:
    """Element rows of whole items of the top-level sequence ``path`` of an explicit file, least byte first, which begin at ``offset`` with the item of number ``item``."""
    body = _Reader(data, True, False, False)
    body.sequence(0, len(data), path, 0, True, False, item)
    for row in body.rows:
        row["offset"] += offset
    return body.rows


def dictionary_table(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A data dictionary (tag, vr, name) out of a text file with a head and the columns tag, vr and name.

    Tags are eight hexadecimal digits, also as ``(0010,0020)`` or ``0010,0020`` in quotes; lines whose tags are none, as those of repeating groups, are
    left out, and of several representations the first counts.
    """
    rows = spark.read.option("header", "true").option("sep", sep).csv(path)
    digits = F.upper(F.regexp_replace("tag", "[^0-9A-Fa-fxX]", ""))
    return rows.where(digits.rlike("^[0-9A-F]{8}$")).select(F.conv(digits, 16, 10).cast("bigint").alias("tag"), F.substring(F.trim("vr"), 1, 2).alias("vr"), F.trim("name").alias("name"))


def _known(dictionary: DataFrame | None) -> dict[int, str]:
    """Representations by tag; a dictionary has at most ``MOST_TAGS`` entries, which every task gets."""
    if dictionary is None:
        return DICTIONARY
    rows = dictionary.select("tag", "vr").where("tag is not null and vr is not null").limit(MOST_TAGS + 1).collect()
    if len(rows) > MOST_TAGS:
        raise ValueError(f"a dictionary of more than {MOST_TAGS} entries")
    return DICTIONARY | {int(r.tag) & 0xFFFFFFFF: r.vr for r in rows}


def _parsed(heads: list[tuple], rows: list[dict]) -> pa.RecordBatch:
    """A batch of files: (path, size, syntax, error, number of elements) each, and the elements of all, one after the other."""
    columns = [pa.array([r.get(f) for r in rows], t) for f, t in _FIELDS.items()]
    ends = pa.array([0, *accumulate(h[4] for h in heads)], pa.int32())
    listed = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(columns, list(_FIELDS)))
    kinds = (pa.string(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([*(pa.array([h[i] for h in heads], t) for i, t in enumerate(kinds)), listed], ["file_path", "file_size", "transfer_syntax", "error", "elements"])


def elements(files: DataFrame, with_pixels: bool = False, strict: bool = False, dictionary: DataFrame | None = None) -> DataFrame:
    """Rows (file_path, content) to one row per file: transfer syntax, elements, and an error where it could not be read (raised if ``strict``).

    ``dictionary`` (tag, vr), as ``dictionary_table`` reads it, tells the representations of files that do not name them, beyond those of common elements.
    """
    known = _known(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, held, size = [], [], 0
        for batch in batches:
            for path, content in zip(batch["file_path"], batch["content"], strict=True):
                data, syntax, rows, error = content.as_py() or b"", None, [], None
                try:
                    syntax, rows = parse(data, with_pixels, known)
                except (Malformed, struct.error, zlib.error) as e:
                    if strict:
                        raise
                    error = str(e)
                heads.append((path.as_py(), len(data), syntax, error, len(rows)))
                held += rows
                size += len(data)
                if len(held) >= BATCH_ELEMENTS or size >= BATCH_BYTES or len(heads) >= BATCH_ELEMENTS:
                    yield _parsed(heads, held)
                    heads, held, size = [], [], 0
        if heads:
            yield _parsed(heads, held)

    return files.select("file_path", "content").mapInArrow(run, SCHEMA)


def piece_elements(pieces: DataFrame, sequence: str) -> DataFrame:
    """Files in pieces (file_path, offset, item, content), as ``building.directory_pieces`` gives them, to one row for each piece, as ``elements`` has them for files.

    The first piece of a file, with item null, ends after an item of ``sequence`` or with the file; the others hold items of it alone, of which ``item`` is the first one's
    number. The files are explicit, least byte first, and name no character set. What is malformed is raised.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, held, size = [], [], 0
        for batch in batches:
            for path, offset, item, content in zip(batch["file_path"].to_pylist(), batch["offset"].to_pylist(), batch["item"].to_pylist(), batch["content"], strict=True):
                data, syntax = content.as_py(), EXPLICIT_LE
                if item is None:
                    syntax, rows = parse(data)
                else:
                    rows = parse_items(data, sequence, item, offset)
                heads.append((path, len(data), syntax, None, len(rows)))
                held += rows
                size += len(data)
                if len(held) >= BATCH_ELEMENTS or size >= BATCH_BYTES:
                    yield _parsed(heads, held)
                    heads, held, size = [], [], 0
        if heads:
            yield _parsed(heads, held)

    return pieces.select("file_path", "offset", "item", "content").mapInArrow(run, SCHEMA)


def scan(spark: SparkSession, path: str, with_pixels: bool = False) -> DataFrame:
    """All files with the extension ``dcm`` or none below a folder, hidden ones left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    wanted = ~name.startswith(".") & (name.rlike(r"(?i)\.dcm$") | ~name.contains("."))
    return elements(files.where(wanted).select(F.col("path").alias("file_path"), "content"), with_pixels)


def element_rows(parsed: DataFrame) -> DataFrame:
    """One row per element."""
    return parsed.where("error is null").select("file_path", F.explode("elements").alias("e")).select("file_path", "e.*")


def text_of(tag: int, parsed: str = "elements") -> Column:
    """First value of a top-level element, empty where it is missing."""
    hit = F.filter(parsed, lambda e: (e["tag"] == tag) & (e["depth"] == 0))
    return F.coalesce(F.get(F.get(hit, F.size(hit) - 1)["values"], 0), F.lit(""))


def number_of(tag: int, place: int = 0, parsed: str = "elements") -> Column:
    """A number of a top-level element; null where it is missing or none."""
    hit = F.filter(parsed, lambda e: (e["tag"] == tag) & (e["depth"] == 0))
    return F.get(F.get(hit, F.size(hit) - 1)["numbers"], place)


def numbers_of(tag: int, parsed: str = "elements") -> Column:
    hit = F.filter(parsed, lambda e: (e["tag"] == tag) & (e["depth"] == 0))
    return F.get(hit, F.size(hit) - 1)["numbers"]


def instance_rows(parsed: DataFrame) -> DataFrame:
    """The flat columns of searches, catalogues and series, one row per readable file."""
    return parsed.where("error is null").select(
        "file_path", "file_size", "transfer_syntax", text_of(0x00100010).alias("patient_name"), text_of(0x00100020).alias("patient_id"), text_of(0x00100040).alias("patient_sex"), text_of(0x00101010).alias("patient_age"),
        text_of(0x0020000D).alias("study_uid"), text_of(0x00080020).alias("study_date"), text_of(0x00081030).alias("study_description"), text_of(0x0020000E).alias("series_uid"), text_of(0x0008103E).alias("series_description"),
        text_of(0x00080060).alias("modality"), text_of(0x00080016).alias("sop_class_uid"), text_of(0x00080018).alias("sop_uid"), number_of(0x00200013).cast("int").alias("instance_number"), text_of(0x00180015).alias("body_part"),
        text_of(0x00080080).alias("institution"), number_of(0x00280010).cast("int").alias("rows"), number_of(0x00280011).cast("int").alias("columns"), F.coalesce(number_of(0x00280008), F.lit(1.0)).cast("int").alias("frames"),
        number_of(0x00280100).cast("int").alias("bits_allocated"), number_of(0x00280101).cast("int").alias("bits_stored"), number_of(0x00280102).cast("int").alias("high_bit"), number_of(0x00280103).cast("int").alias("pixel_representation"),
        F.coalesce(number_of(0x00280002), F.lit(1.0)).cast("int").alias("samples_per_pixel"), text_of(0x00280004).alias("photometric"), F.coalesce(number_of(0x00281053), F.lit(1.0)).alias("slope"), F.coalesce(number_of(0x00281052), F.lit(0.0)).alias("intercept"),
        numbers_of(0x00281050).alias("centers"), numbers_of(0x00281051).alias("widths"), numbers_of(0x00200032).alias("position"), numbers_of(0x00200037).alias("orientation"), numbers_of(0x00280030).alias("pixel_spacing"),
    )


def validation_issues(content: Column, parsed_error: Column, study: Column, series: Column) -> Column:
    """What a strict scanner objects to; an empty array means a valid file."""
    checks = F.array(
        F.when(content.isNull() | (F.octet_length(content) < 132), "shorter than 132 bytes"), F.when(F.substring(content, 129, 4) != F.lit(b"DICM"), "no DICM mark"), F.when(parsed_error.isNotNull(), parsed_error),
        F.when(F.coalesce(study, F.lit("")) == "", "no study"), F.when(F.coalesce(series, F.lit("")) == "", "no series"),
    )
    return F.array_compact(checks)


def write(rows: list[tuple[int, str, object]], syntax: str = EXPLICIT_LE) -> bytes:
    """A Part 10 file of (tag, representation, value); a value is text, numbers, bytes, or a list of such lists for a sequence."""
    explicit, order = syntax != IMPLICIT_LE, ">" if syntax == EXPLICIT_BE else "<"
    meta = _encode([(0x00020001, "OB", b"\0\1"), (0x00020010, "UI", syntax)], True, "<")
    body = _encode(sorted(rows, key=lambda r: r[0]), explicit, order)
    if syntax == DEFLATED_LE:
        deflate = zlib.compressobj(wbits=-15)
        body = deflate.compress(body) + deflate.flush()
    return b"\0" * 128 + b"DICM" + _encode([(0x00020000, "UL", [len(meta)])], True, "<") + meta + body


def _encode(rows: list[tuple[int, str, object]], explicit: bool, order: str) -> bytes:
    out = []
    for tag, vr, value in rows:
        if vr == "SQ":
            raw = b"".join(struct.pack(order + "HHI", 0xFFFE, 0xE000, len(item)) + item for item in (_encode(sorted(v, key=lambda r: r[0]), explicit, order) for v in value))
        elif isinstance(value, bytes):
            raw = value
        elif isinstance(value, str):
            raw = value.encode()
        else:
            raw = struct.pack(f"{order}{len(value)}{_NUMBERS[vr]}", *value)
        raw += (b"\0" if vr in ("UI", "OB", "UN") else b" ") * (len(raw) % 2)
        head = struct.pack(order + "HH", tag >> 16, tag & 0xFFFF)
        if not explicit:
            head += struct.pack(order + "I", len(raw))
        elif vr in LONG_VR:
            head += vr.encode() + struct.pack(order + "HI", 0, len(raw))
        else:
            head += vr.encode() + struct.pack(order + "H", len(raw))
        out.append(head + raw)
    return b"".join(out)


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """(file_path, content) rows as (file_path, bytes) of what was written below a folder that every task reaches; a retry writes the same files again."""
    folder = remote.addressed(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents = batch["content"].to_pylist()
            for path, content in zip(batch["file_path"].to_pylist(), contents, strict=True):
                remote.write(f"{folder}/{path.lstrip('/')}", content)
            yield pa.RecordBatch.from_arrays([batch["file_path"], pa.array([len(c) for c in contents], pa.int64())], ["file_path", "bytes"])

    return rows.select("file_path", "content").mapInArrow(run, "file_path string, bytes bigint")
