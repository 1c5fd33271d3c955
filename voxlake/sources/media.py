"""Media: where series come from, archives, directory files, and frames written as pictures."""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quantity import frame_file_name
from ..functions.text import zip_entry_disposition
from ..operators.rounds import settled, small_batches
from . import part10

#: The sequence of directory records, and their elements.
RECORDS, FIRST_ROOT = "00041220", "00041200"
RECORD = {
    "next": ("00041400", "number"), "in_use": ("00041410", "number"), "lower": ("00041420", "number"), "type": ("00041430", "text"), "file_id": ("00041500", "parts"), "sop_class": ("00041510", "text"), "sop_uid": ("00041511", "text"),
    "patient_id": ("00100020", "text"), "patient_name": ("00100010", "text"), "study_uid": ("0020000D", "text"), "series_uid": ("0020000E", "text"), "modality": ("00080060", "text"), "instance_number": ("00200013", "text"),
}
#: What an item begins with, and representations as the numbers that their letters are.
ITEM = b"\xfe\xff\0\xe0"
UL, US = (int.from_bytes(vr, "little") for vr in (b"UL", b"US"))
TEXT, LONG = (np.isin(np.arange(1 << 16), [int.from_bytes(vr.encode(), "little") for vr in names]) for names in (part10._TEXT - set(part10.LONG_VR) - part10._WHOLE, part10.LONG_VR))
#: Bytes before the value of an item's first element: its head and the item's.
HEADS = 16
#: Bytes and entries after which a batch of archives' entries is passed on.
MEMBER_BYTES, MEMBER_ROWS = 4_000_000, 10_000


def source_kind(path: Column, is_folder: Column) -> Column:
    """``directory``, ``zip`` or ``file``: where a series is read from."""
    return F.when(F.coalesce(is_folder, F.lit(False)) | path.endswith("/"), "directory").when(F.lower(path).endswith(".zip"), "zip").otherwise("file")


def media_kind(path: Column, is_folder: Column, has_directory_file: Column) -> Column:
    """How a medium is catalogued: by its directory file where it is one or has one at its top, else as ``directory``, ``zip`` or ``file``."""
    kind = source_kind(path, is_folder)
    named = F.lower(F.element_at(F.split(path, "/"), -1)) == "dicomdir"
    return F.when(((kind == "directory") & F.coalesce(has_directory_file, F.lit(False))) | ((kind == "file") & named), "dicom-directory").otherwise(kind)


def zip_members(archives: DataFrame) -> DataFrame:
    """``archives`` (file_path, content) to ``archive, member, disposition, content, error``: one row for each entry, in batches of a bounded size.

    Entries are extracted, skipped (folders, hidden metadata) or rejected (paths that leave the archive), the latter two without
    content; what is no archive, or an entry that is broken, has a row with the error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.binary(), pa.string()))], ["archive", "member", "content", "error"])

        def members(path: str, data: bytes) -> Iterator[tuple]:
            try:
                with zipfile.ZipFile(io.BytesIO(data)) as archive:
                    for entry in archive.infolist():
                        try:
                            yield path, entry.filename, archive.read(entry), None
                        except (zipfile.BadZipFile, NotImplementedError, RuntimeError, zlib.error) as e:
                            yield path, entry.filename, None, str(e)
            except zipfile.BadZipFile as e:
                yield path, None, None, str(e)

        held, size = [], 0
        for batch in batches:
            for path, data in zip(batch["file_path"], batch["content"], strict=True):
                for row in members(path.as_py(), data.as_py() or b""):
                    held.append(row)
                    size += len(row[2] or b"")
                    if size >= MEMBER_BYTES or len(held) >= MEMBER_ROWS:
                        yield made(held)
                        held, size = [], 0
        if held:
            yield made(held)

    found = archives.select("file_path", "content").mapInArrow(run, "archive string, member string, content binary, error string")
    disposition = F.when(F.col("member").isNotNull(), zip_entry_disposition(F.col("member")))
    return found.select("archive", "member", disposition.alias("disposition"), F.when(disposition == "extract", F.col("content")).alias("content"), "error")


def directory_records(rows: DataFrame) -> DataFrame:
    """Element rows of directory files to their records: ``directory, place, offset, root``, the links and what they name.

    ``offset`` is where the record's item begins in its file, which is what links mean; ``root`` marks the first record of the root. A file id is
    a path. The result is the input of ``links.linked_records``; where the links lead nowhere, ``slices.flat_directory`` takes the order of the places.
    """
    own = rows.where(F.col("path").startswith(f"{RECORDS}[")).withColumns({"place": F.regexp_extract("path", rf"^{RECORDS}\[(\d+)\]/[0-9A-F]{{8}}$", 1), "below": F.substring_index("path", "/", -1)}).where("place <> ''")
    read = {"text": F.get("values", 0), "number": F.get("numbers", 0).cast("bigint"), "parts": F.array_join("values", "/")}
    records = own.groupBy(F.col("file_path").alias("directory"), F.col("place").cast("int").alias("place")).agg((F.min("offset") - HEADS).alias("offset"), *(F.max(F.when(F.col("below") == tag, read[kind])).alias(name) for name, (tag, kind) in RECORD.items()))
    roots = rows.where(F.col("path") == FIRST_ROOT).groupBy(F.col("file_path").alias("directory")).agg(F.max(read["number"]).alias("first"))
    return records.join(roots, "directory", "left").withColumn("root", F.coalesce(F.col("offset") == F.col("first"), F.lit(False))).drop("first")


def _values(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray, kind: str) -> pa.Array:
    """Values of ``sizes`` bytes, below 0 where there is none, as ``directory_records`` has them."""
    there = sizes >= 0
    if kind == "number":
        number = np.zeros(len(starts), np.int64)
        for i in range(4):
            number[there] |= np.where(i < sizes[there], buf[np.minimum(starts[there] + i, len(buf) - 1)], 0).astype(np.int64) << 8 * i
        return pa.array(number, mask=~there)
    sizes = np.maximum(sizes, 0)
    # Filled to an even length.
    sizes = sizes - ((sizes > 0) & (buf[np.maximum(starts + sizes - 1, 0)] == 0))
    ends = np.concatenate(([0], np.cumsum(sizes)))
    flat = buf[np.arange(ends[-1]) + np.repeat(starts - ends[:-1], sizes)]
    held = pa.Array.from_buffers(pa.binary(), len(starts), [pa.py_buffer(np.packbits(there, bitorder="little")), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(flat)])
    if not ((flat == 0) | (flat > 127)).any():
        texts = pc.utf8_trim(held.cast(pa.string()), " ") if (flat == 32).any() else held.cast(pa.string())
        if not (flat == 92).any():
            return texts
        if kind == "parts" and not pc.any(pc.match_substring_regex(texts, r" \\|\\ ")).as_py():
            return pc.replace_substring(texts, "\\", "/")
    listed = [None if v is None else [x.strip(" \0") for x in part10.decode_text(v, "").split("\\")] for v in held.to_pylist()]
    return pa.array([None if v is None else "/".join(v) if kind == "parts" else v[0] for v in listed], pa.string())


def _plain_records(data: bytes, offset: int, item: int, names: list[str]) -> pa.RecordBatch | None:
    """Records of whole items, all of a piece at once, element by element; null where one is written in a way that only ``part10`` reads: without lengths,
    with sequences or long values, twice, or cut."""
    starts, at = [], 0
    while at < len(data):
        if data[at : at + 4] != ITEM or at + 8 > len(data):
            return None
        starts.append(at)
        at += 8 + int.from_bytes(data[at + 4 : at + 8], "little")
    if at != len(data) or not starts:
        return None
    buf, begin = np.frombuffer(data, np.uint8), np.array(starts)
    row, cur, end = np.arange(len(begin)), begin + 8, np.append(begin[1:], len(data))
    if (cur == end).any():
        return None
    tags = np.array([int(RECORD[n][0], 16) for n in names])
    order = np.argsort(tags)
    ordered = tags[order]
    places, sizes = np.zeros((len(names), len(row)), np.int64), np.full((len(names), len(row)), -1)
    numbers = np.array([RECORD[n][1] == "number" for n in names])
    steps = np.arange(8)
    while len(row):
        if (cur + 8 > end).any():
            return None
        head = buf[cur[:, None] + steps].view("<u2")
        vr, start, size = head[:, 2], cur + 8, head[:, 3].astype(np.int64)
        cur = start + size
        if LONG[vr].any() or (head[:, 0] == 0xFFFE).any() or (cur > end).any():
            return None
        tag = head[:, 0].astype(np.int64) << 16 | head[:, 1]
        slot = order[np.minimum(np.searchsorted(ordered, tag), len(tags) - 1)]
        hit = np.flatnonzero(tags[slot] == tag)
        slot, to, vr = slot[hit], row[hit], vr[hit]
        whole = ((vr == UL) & (size[hit] == 4)) | ((vr == US) & (size[hit] == 2))
        if not np.where(numbers[slot], whole, TEXT[vr]).all() or (sizes[slot, to] >= 0).any():
            return None
        places[slot, to], sizes[slot, to] = start[hit], size[hit]
        live = cur < end
        if not live.all():
            row, cur, end = row[live], cur[live], end[live]
    columns = [_values(buf, places[k], sizes[k], RECORD[n][1]) for k, n in enumerate(names)]
    return pa.RecordBatch.from_arrays([pa.array(np.arange(item, item + len(begin)), pa.int32()), pa.array(begin + offset), *columns], ["place", "offset", *names])


def _any_records(rows: list[dict], names: list[str]) -> pa.RecordBatch:
    """Records of element rows, as ``directory_records`` has them."""
    found: dict[int, dict] = {}
    tags = {RECORD[n][0]: n for n in names}
    for r in rows:
        place = re.fullmatch(rf"{RECORDS}\[(\d+)\]/([0-9A-F]{{8}})", r["path"])
        if place:
            record = found.setdefault(int(place[1]), {"offset": r["offset"] - HEADS})
            record["offset"] = min(record["offset"], r["offset"] - HEADS)
            if place[2] in tags:
                name = tags[place[2]]
                values, numbers = r.get("values") or [], r.get("numbers") or []
                kind = RECORD[name][1]
                value = "/".join(values) if kind == "parts" and r.get("values") is not None else values[0] if kind == "text" and values else int(numbers[0]) if kind == "number" and numbers and numbers[0] is not None else None
                if value is not None:
                    record[name] = max(record.get(name, value), value)
    kinds = {n: pa.int64() if RECORD[n][1] == "number" else pa.string() for n in names}
    columns = [pa.array([r.get(n) for r in found.values()], t) for n, t in {"offset": pa.int64(), **kinds}.items()]
    return pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), *columns], ["place", "offset", *names])


def piece_records(pieces: DataFrame, names: tuple[str, ...] = tuple(RECORD)) -> DataFrame:
    """Directory files in pieces, as ``building.directory_pieces`` gives them and ``part10.piece_elements`` reads them, to what ``directory_records`` gives of their elements,
    without a row for each element. ``names``: the columns of ``RECORD`` that are wanted."""
    names = list(names)
    kinds = ", ".join(f"{n} {'bigint' if RECORD[n][1] == 'number' else 'string'}" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, offset, item, content in zip(batch["file_path"].to_pylist(), batch["offset"].to_pylist(), batch["item"].to_pylist(), batch["content"], strict=True):
                data, first = content.as_py(), None
                if item is None:
                    rows = part10.parse(data)[1]
                    found = _any_records(rows, names)
                    first = max((int(r["numbers"][0]) for r in rows if r["path"] == FIRST_ROOT and r.get("numbers")), default=None)
                else:
                    found = _plain_records(data, offset, item, names)
                    if found is None:
                        found = _any_records(part10.parse_items(data, RECORDS, item, offset), names)
                n = found.num_rows
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(path, pa.string()), n), *found.columns, pa.repeat(pa.scalar(first, pa.int64()), n)], ["directory", *found.schema.names, "first"])

    with small_batches(pieces.sparkSession):
        records = settled(pieces.select("file_path", "offset", "item", "content").mapInArrow(run, f"directory string, place int, offset bigint, {kinds}, first bigint"))
    roots = records.groupBy("directory").agg(F.max("first").alias("first"))
    return records.drop("first").join(roots, "directory", "left").withColumn("root", F.coalesce(F.col("offset") == F.col("first"), F.lit(False))).drop("first")


def png(pixels: np.ndarray, columns: int, samples: int = 1) -> bytes:
    """A PNG picture of 8-bit grey (1 sample) or colour (3 samples) values."""
    lines = pixels.astype(np.uint8).reshape(-1, columns * samples)
    raw = np.concatenate((np.zeros((len(lines), 1), np.uint8), lines), 1).tobytes()

    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    head = struct.pack(">IIBBBBB", columns, len(lines), 8, {1: 0, 3: 2}[samples], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def tiff16(pixels: np.ndarray, columns: int) -> bytes:
    """An uncompressed TIFF picture of 16-bit grey values; negative ones make it signed."""
    signed = len(pixels) and pixels.min() < 0
    data = pixels.astype("<i2" if signed else "<u2").tobytes()
    lines = len(pixels) // columns
    entries = [(256, 4, columns), (257, 4, lines), (258, 3, 16), (259, 3, 1), (262, 3, 1), (273, 4, 0), (277, 3, 1), (278, 4, lines), (279, 4, len(data)), (339, 3, 2 if signed else 1)]
    start = 8 + 2 + 12 * len(entries) + 4
    table = b"".join(struct.pack("<HHII", tag, kind, 1, start if tag == 273 else value) for tag, kind, value in entries)
    return b"II*\0" + struct.pack("<IH", 8, len(entries)) + table + struct.pack("<I", 0) + data


def pictures(frames: DataFrame, kind: str = "png") -> DataFrame:
    """``frames`` (base, frame, frames, columns, samples, pixels) to ``file_path, content``: a file for each frame, for ``part10.write_files``.

    ``png`` takes display values of 8 bits, ``tiff`` native grey values of 16. Frames whose size does not fit their columns have a null content.
    """
    if kind not in ("png", "tiff"):
        raise ValueError(f"no picture format: {kind}")

    def one(values: pa.Scalar, columns: int, samples: int) -> bytes | None:
        if not values.is_valid or not columns or samples not in ((1, 3) if kind == "png" else (1,)):
            return None
        pixels = values.values.to_numpy(zero_copy_only=False)
        if not len(pixels) or len(pixels) % (columns * samples):
            return None
        return png(pixels, columns, samples) if kind == "png" else tiff16(pixels, columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content = [one(*row) for row in zip(batch["pixels"], batch["columns"].to_pylist(), batch["samples"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["file_path"], pa.array(content, pa.binary())], ["file_path", "content"])

    named = frames.select(frame_file_name(F.col("base"), F.col("frame"), F.col("frames"), kind).alias("file_path"), F.col("columns").cast("int").alias("columns"), F.col("samples").cast("int").alias("samples"), F.col("pixels").cast("array<int>").alias("pixels"))
    return named.mapInArrow(run, "file_path string, content binary")
