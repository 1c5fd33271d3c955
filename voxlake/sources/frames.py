"""Pixels of frames: descriptors, slices of native data, run-length decoding, bit planes and waveforms.

Sizes and places are column arithmetic; only bytes are turned into numbers by numpy, in Arrow batches, a frame per row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Transfer syntaxes with the route that pixels take; others are native.
ROUTES = {
    "1.2.840.10008.1.2.5": "rle",
    "1.2.840.10008.1.2.4.57": "jpeg-lossless",
    "1.2.840.10008.1.2.4.70": "jpeg-lossless",
    "1.2.840.10008.1.2.4.50": "unsupported: baseline JPEG needs an image library",
    "1.2.840.10008.1.2.4.51": "unsupported: 12-bit JPEG is not decoded yet",
    "1.2.840.10008.1.2.4.80": "unsupported: JPEG-LS needs a codec library",
    "1.2.840.10008.1.2.4.81": "unsupported: JPEG-LS needs a codec library",
    "1.2.840.10008.1.2.4.90": "unsupported: JPEG 2000 needs a codec library",
    "1.2.840.10008.1.2.4.91": "unsupported: JPEG 2000 needs a codec library",
    "1.2.840.10008.1.2.4.201": "unsupported: high-throughput JPEG 2000 needs a codec library",
    "1.2.840.10008.1.2.4.202": "unsupported: high-throughput JPEG 2000 needs a codec library",
    "1.2.840.10008.1.2.4.203": "unsupported: high-throughput JPEG 2000 needs a codec library",
}


def route(syntax: Column) -> Column:
    routes = F.create_map(*[F.lit(x) for pair in ROUTES.items() for x in pair])
    return F.coalesce(F.try_element_at(routes, syntax), F.lit("native"))


def bytes_per_frame(rows: Column, columns: Column, samples: Column, bits_allocated: Column, photometric: Column) -> Column:
    """YBR_FULL_422 packs two pixels into four samples."""
    plain = rows * columns * samples
    packed = F.ceil(columns / 2).cast("bigint") * 4 * rows
    return F.when(photometric == "YBR_FULL_422", packed).otherwise(plain) * F.ceil(bits_allocated / 8).cast("bigint")


def frame_bytes(data: Column, frame: Column, size: Column) -> Column:
    """The bytes of one frame of native data; null outside."""
    return F.when((frame >= 0) & ((frame + 1) * size <= F.octet_length(data)), F.substring(data, frame * size + 1, size))


def native_frames(images: DataFrame, data: str = "pixel_data") -> DataFrame:
    """One row (image columns without the data, frame, bytes) per frame of native data."""
    size = bytes_per_frame(F.col("rows"), F.col("columns"), F.col("samples_per_pixel"), F.col("bits_allocated"), F.col("photometric"))
    rest = [c for c in images.columns if c != data]
    numbered = images.withColumn("__size", size).select(*rest, "__size", data, F.explode(F.sequence(F.lit(0), F.col("frames") - 1)).alias("frame"))
    return numbered.select(*rest, "frame", F.expr(f"substring({data}, cast(frame * __size + 1 as int), cast(__size as int))").alias("bytes"))


def unpack(raw: bytes, bits_allocated: int, signed: bool, big: bool = False) -> np.ndarray:
    kind = {8: "i1" if signed else "u1", 16: "i2" if signed else "u2", 32: "i4" if signed else "u4"}[bits_allocated]
    return np.frombuffer(raw[: len(raw) // (bits_allocated // 8) * (bits_allocated // 8)], (">" if big else "<") + kind)


def rle_segment(raw: bytes) -> bytes:
    """PackBits: n < 128 copies n + 1 bytes, n > 128 repeats the next 257 - n times, 128 does nothing."""
    out, at = bytearray(), 0
    while at < len(raw):
        n = raw[at]
        if n < 128:
            out += raw[at + 1 : at + 2 + n]
            at += n + 2
        elif n > 128:
            out += raw[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


def rle_frame(raw: bytes, rows: int, columns: int, samples: int, bits_allocated: int) -> np.ndarray:
    """A frame of run-length segments, a segment per byte plane, the most significant first; samples stay next to each other."""
    count = int.from_bytes(raw[:4], "little")
    planes = bits_allocated // 8 * samples
    if len(raw) < 64 or count != planes:
        raise ValueError(f"{count} segments instead of {planes}")
    starts = [int.from_bytes(raw[4 + 4 * i : 8 + 4 * i], "little") for i in range(count)] + [len(raw)]
    size = rows * columns
    parts = []
    for i in range(count):
        if not 64 <= starts[i] <= starts[i + 1] <= len(raw):
            raise ValueError("segments are out of order")
        part = rle_segment(raw[starts[i] : starts[i + 1]])[:size]
        if len(part) < size:
            raise ValueError(f"segment {i} holds {len(part)} of {size} bytes")
        parts.append(np.frombuffer(part, np.uint8).astype(np.int64))
    depth = bits_allocated // 8
    whole = [sum(parts[s * depth + b] << (8 * (depth - 1 - b)) for b in range(depth)) for s in range(samples)]
    return np.stack(whole, 1).ravel()


def fragments(raw: bytes) -> tuple[list[int], list[bytes]]:
    """Offset table and fragments of encapsulated pixel data."""
    at, items = 0, []
    while at + 8 <= len(raw):
        mark, length = raw[at : at + 4], int.from_bytes(raw[at + 4 : at + 8], "little")
        if mark == b"\xfe\xff\xdd\xe0":
            break
        if mark != b"\xfe\xff\x00\xe0" or at + 8 + length > len(raw):
            raise ValueError(f"no item at {at}")
        items.append(raw[at + 8 : at + 8 + length])
        at += 8 + length
    if not items:
        raise ValueError("no offset table")
    return np.frombuffer(items[0][: len(items[0]) // 4 * 4], "<u4").tolist(), items[1:]


def frames_of_fragments(table: list[int], parts: list[bytes], frames: int) -> list[bytes]:
    """By the offset table, else all fragments of the one frame, else a fragment per frame."""
    if table:
        if len(table) != frames:
            raise ValueError(f"{len(table)} offsets for {frames} frames")
        places = np.concatenate(([0], np.cumsum([len(p) + 8 for p in parts])))
        ends = [*table[1:], int(places[-1])]
        return [b"".join(p for p, at in zip(parts, places, strict=False) if a <= at < b) for a, b in zip(table, ends, strict=True)]
    if frames == 1:
        return [b"".join(parts)]
    if len(parts) == frames:
        return parts
    raise ValueError(f"{len(parts)} fragments for {frames} frames, and no offset table")


def bit_frames(raw: bytes, pixels: int, frames: int) -> np.ndarray:
    """Masks (frames, pixels) of packed bits, the lowest bit of each byte first, frames without a gap."""
    bits = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")
    if len(bits) < pixels * frames:
        raise ValueError(f"{len(bits)} bits for {frames} frames of {pixels}")
    return bits[: pixels * frames].reshape(frames, pixels)


def pack_bits(masks: np.ndarray) -> bytes:
    raw = np.packbits(np.asarray(masks, np.uint8).ravel(), bitorder="little").tobytes()
    return raw + b"\0" * (len(raw) % 2)


def deinterleave(samples: Column, channels: Column) -> Column:
    """Sample-major values to an array per channel."""
    return F.transform(F.sequence(F.lit(0), channels - 1), lambda c: F.filter(samples, lambda _, i: i % channels == c))


def interleaved(channels: Column) -> Column:
    """An array of equally long arrays to one array, instant by instant."""
    count = F.size(F.get(channels, 0))
    instants = F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: F.transform(channels, lambda c: F.get(c, i)))
    return F.when(count > 0, F.flatten(instants)).otherwise(F.slice(F.get(channels, 0), 1, 0))


def _pixels_of(r: dict) -> list[list[int]]:
    raw, frames = r["pixel_data"], r["frames"]
    size = (r["rows"], r["columns"], r["samples_per_pixel"], r["bits_allocated"])
    kind = ROUTES.get(r["transfer_syntax"], "native")
    if kind.startswith("unsupported"):
        raise ValueError(kind)
    if kind == "jpeg-lossless":
        raise ValueError("unsupported: lossless JPEG is not decoded yet")
    if kind == "rle":
        out = [rle_frame(f, *size) for f in frames_of_fragments(*fragments(raw), frames)]
        if r["pixel_representation"]:
            top = 1 << (size[3] - 1)
            out = [np.where(x >= top, x - 2 * top, x) for x in out]
        return [x.tolist() for x in out]
    values = unpack(raw, size[3], bool(r["pixel_representation"]), r["transfer_syntax"] == "1.2.840.10008.1.2.2")
    count = size[0] * size[1] * size[2]
    if len(values) < count * frames:
        raise ValueError(f"{len(values)} samples for {frames} frames of {count}")
    return [values[i * count : (i + 1) * count].tolist() for i in range(frames)]


def decoded_frames(images: DataFrame, decode: Callable[[dict], list[list[int]]] = _pixels_of) -> DataFrame:
    """(file_path, frame, pixels array<int>, error) of images with ``pixel_data`` and the flat columns of ``instance_rows``.

    An image that cannot be decoded is one row with its error. ``decode`` can be another function from a row to its frames.
    """
    needed = ["file_path", "pixel_data", "transfer_syntax", "rows", "columns", "frames", "samples_per_pixel", "bits_allocated", "pixel_representation"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                try:
                    frames, error = decode(r), None
                except (ValueError, KeyError, TypeError) as e:
                    frames, error = [None], str(e)
                n = len(frames)
                yield pa.RecordBatch.from_arrays([pa.array([r["file_path"]] * n, pa.string()), pa.array(range(n), pa.int32()), pa.array(frames, pa.list_(pa.int32())), pa.array([error] * n, pa.string())], ["file_path", "frame", "pixels", "error"])

    return images.select(*needed).mapInArrow(run, "file_path string, frame int, pixels array<int>, error string")


def denoised(pixels: np.ndarray, strength: float) -> np.ndarray:
    """3 x 3 Gaussian over 16 with repeated edges, blended in by the strength; up to 0.1 nothing happens."""
    if strength <= 0.1:
        return pixels
    p = np.pad(pixels.astype(float), 1, mode="edge")
    h, w = pixels.shape
    kernel = np.outer([1, 2, 1], [1, 2, 1]) / 16.0
    smooth = sum(kernel[i, j] * p[i : i + h, j : j + w] for i in range(3) for j in range(3))
    return pixels * (1 - min(strength, 1.0)) + smooth * min(strength, 1.0)
