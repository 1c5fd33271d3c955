"""Removal of long repeated substrings, found by suffix arrays that two-stage sorting builds.

Where two equal strings of ``length`` bytes start, both hold the same least-hashed anchor at the same place. So the windows of
all texts are dealt by the hash of their anchor: a piece holds the windows of one anchor that follow each other, and equal
windows meet in one block. Pieces of anchors that occur once cannot hold a repeat and never leave their document. In a block only suffixes
smaller than their successors are sorted directly; scans over the buckets of first bytes induce the order of the others; the common
prefixes of neighbours tell the repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, mix64, ranges, small_arrow_batches, text_or_empty, value_bytes

#: Bytes of a repeat, and of an anchor within it.
LENGTH, ANCHOR = 200, 64
#: Bytes of text that a mapper hashes at once, and of pieces in a block.
CHUNK, BLOCK_BYTES = 1 << 20, 2 << 20
#: Pieces of one key that a block takes. The windows of a more frequent key are dealt again, by longer common strings.
CROWD = 8192
#: Parts in which copies of one piece, and rows of a hot key, are counted.
SALTS = 64
#: Hot keys, which are dealt by salt: at most so many (some 100 kB), as frequent in one text of SAMPLE as a crowded key would be. Which
#: keys they are changes the speed alone; a key that is not among so many holds a small share of the rows.
HOT, SAMPLE = 10_000, 16

_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_STEP), -1, 2**64))

_PIECES = "key bigint, id binary, start int, low int, high int, piece binary"


def _hashes(data: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all strings of k bytes, by sums of bytes times powers."""
    n = len(data)
    powers = np.full(n, _STEP, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers, dtype=np.uint64)))
    back = np.full(n - k + 1, _BACK, np.uint64)
    back[0] = 1
    return mix64((sums[k:] - sums[: n - k + 1]) * np.cumprod(back, dtype=np.uint64))


def _least(v: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values that follow each other."""
    size = 1
    while 2 * size <= width:
        v = np.minimum(v[: len(v) - size], v[size:])
        size *= 2
    return v if size == width else np.minimum(v[: len(v) - (width - size)], v[width - size :])


def anchors_of(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, k: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """For each piece of the texts: text, hash of its anchor, the anchor's place, and the least and greatest distance from a window's start to it."""
    sizes = np.diff(ends)
    if len(data) < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64, np.int64))
    h = _hashes(data, k)
    bits = np.uint64(max(1, int(len(data)).bit_length()))
    places = np.arange(len(h), dtype=np.uint64)
    least = _least((h >> bits << bits) | places, length - k + 1)
    at = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    count = np.maximum(0, sizes - length + 1)
    owner = np.repeat(np.arange(len(sizes)), count)
    start = ranges(ends[:-1], count)
    at = at[start]
    if not len(start):
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64, np.int64))
    first = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (owner[1:] != owner[:-1]))))
    last = np.append(first[1:], len(start)) - 1
    text = owner[first]
    return text, h[at[first]], at[first] - ends[text], at[first] - start[last], at[first] - start[first]


def suffix_order(t: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The places ``wanted`` (boolean) of ``t`` in the order of their suffixes, as far as ``depth`` symbols tell.

    ``t``: bytes plus 1, and 0 as end mark of each piece, the last symbol included; past a suffix's first symbol a NUL byte and an end mark
    tie. A suffix is small if it is smaller than its
    successor. Small suffixes are sorted directly; the others are induced, in a scan over the buckets of first symbols: when a
    bucket's order is known, its predecessors are appended to their own buckets in that order.
    """
    n = len(t)
    step = np.sign(np.diff(t.astype(np.int32), append=np.int32(257)))
    where = np.where(step != 0, np.arange(n), n)
    upcoming = np.minimum.accumulate(where[::-1])[::-1]
    small = step[np.minimum(upcoming, n - 1)] > 0
    # A suffix that is not small needs its successors up to the first small one.
    near = np.where(small, np.arange(n), n)
    near = np.minimum.accumulate(near[::-1])[::-1]
    need = wanted.copy()
    large = np.flatnonzero(wanted & ~small)
    need[ranges(large, np.minimum(near[large], n - 1) - large + 1)] = True
    seeds = np.flatnonzero(need & small)
    raw = np.concatenate((np.maximum(t, 1) - 1, np.zeros(depth, t.dtype))).astype(np.uint8)
    rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, depth)[seeds])
    by_text = np.argsort(rows.view(f"S{depth}").ravel(), kind="stable")
    seeds = seeds[by_text]
    seeds = seeds[np.argsort(t[seeds], kind="stable")]
    bounds = np.searchsorted(t[seeds], np.arange(258))
    pending: list[list[np.ndarray]] = [[] for _ in range(257)]
    out = []
    induced = need & ~small
    for c in range(257):
        wave = np.concatenate(pending[c]) if pending[c] else np.zeros(0, np.int64)
        parts = []
        while len(wave):
            parts.append(wave)
            back = wave[wave > 0] - 1
            wave = back[induced[back] & (t[back] == c)]
        parts.append(seeds[bounds[c] : bounds[c + 1]])
        bucket = np.concatenate(parts)
        if not len(bucket):
            continue
        out.append(bucket)
        back = bucket[bucket > 0] - 1
        back = back[induced[back]]
        back = back[t[back] > c]
        symbols = t[back]
        back = back[np.argsort(symbols, kind="stable")]
        found, at = np.unique(np.sort(symbols), return_index=True)
        for s, piece in zip(found.tolist(), np.split(back, at[1:]) if len(found) else [], strict=True):
            pending[s].append(piece)
    order = np.concatenate(out) if out else np.zeros(0, np.int64)
    return order[wanted[order]]


def common_prefixes(raw: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix, up to ``depth``, of each place in ``order`` and the one before it; 0 for the first."""
    rows = np.lib.stride_tricks.sliding_window_view(raw, depth)
    out = np.zeros(len(order), np.int64)
    for low in range(1, len(order), 65536):
        a, b = rows[order[low - 1 : low + 65535][: len(order[low : low + 65536])]], rows[order[low : low + 65536]]
        other = a != b
        out[low : low + len(b)] = np.where(other.any(1), other.argmax(1), depth)
    return out


def repeats_in(pieces: list[bytes], copies: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Windows (piece, place) of distinct pieces that start elsewhere too: in another piece, at another place, or in a piece's copies."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    raw = np.frombuffer(b"\0".join(pieces) + b"\0" * (length + 1), np.uint8)
    n = int(sizes.sum()) + len(pieces)
    t = raw[:n].astype(np.uint16) + 1
    t[starts + sizes] = 0
    counts = sizes - length + 1
    places = ranges(starts, counts)
    wanted = np.zeros(n, bool)
    wanted[places] = True
    order = suffix_order(t, wanted, length)
    shared = common_prefixes(raw, order, length) >= length
    again = np.zeros(n, bool)
    again[order[shared]] = True
    again[order[:-1][shared[1:]]] = True
    owner = np.repeat(np.arange(len(pieces)), counts)
    hit = again[places] | (copies[owner] > 1)
    return owner[hit], (places - starts[owner])[hit]


def _runs(owner: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places that follow each other, sorted by owner, as (owner, first, last)."""
    if not len(owner):
        return owner, place, place
    new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (place[1:] != place[:-1] + 1)))
    first = np.flatnonzero(new)
    return owner[first], place[first], place[np.append(first[1:], len(owner)) - 1]


def _anchor_rows(length: int, k: int):
    """(id, text) to a row per piece: the hash of its anchor, and the anchor's place with the distances of windows to it in one number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = value_bytes(batch["text"])
            ids = batch["id"]
            at = 0
            while at < len(ids):
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + CHUNK, "right")) - 1)
                text, key, anchor, low, high = anchors_of(data[ends[at] : ends[to]], ends[at : to + 1] - ends[at], length, k)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), ids.slice(at, to - at).take(pa.array(text)), pa.array((anchor << 32) + (low << 16) + high)], ["key", "id", "place"])
                at = to

    return run


def _piece_batch(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], ["key", "id", "start", "low", "high", "piece"])


def _cut_pieces(length: int):
    """(text, id, rows) to the pieces themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, text, rows in zip(*(batch[c].to_pylist() for c in ("id", "text", "rows")), strict=True):
                raw = text.encode()
                for r in rows:
                    anchor, low, high = r["place"] >> 32, (r["place"] >> 16) & 0xFFFF, r["place"] & 0xFFFF
                    out.append((r["key"], i, anchor - high, low, high, raw[anchor - high : anchor - low + length]))
                if len(out) > 20_000:
                    yield _piece_batch(out)
                    out = []
            yield _piece_batch(out)

    return run


def _halve(length: int, low: int, high: int):
    """Deals windows whose anchors stand ``low`` to ``high`` bytes after their starts by half of these distances: the new key is the string that all windows of a half have in common."""
    middle = (low + high) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, i, start, least, most, piece in zip(*(batch[c].to_pylist() for c in ("key", "id", "start", "low", "high", "piece")), strict=True):
                for lo, hi in ((low, middle), (middle + 1, high)):
                    a, b = max(lo, least), min(hi, most)
                    if a <= b:
                        common = piece[most - lo : most + length - hi]
                        new = xxhash.xxh3_64_intdigest(common, (key ^ (lo << 20) ^ hi) % 2**64)
                        out.append((new - 2**64 if new >= 2**63 else new, i, start + most - b, a, b, piece[most - b : most - a + length]))
            yield _piece_batch(out)

    return run


def _blocks(length: int):
    """Rows (key, id, start, piece) sorted by key to runs of repeated windows (id, first, last). A block ends where a key does."""

    def solve(held: dict[bytes, list[tuple[bytes, int]]]) -> pa.RecordBatch:
        pieces = list(held)
        owner, first, last = _runs(*repeats_in(pieces, np.array([len(held[p]) for p in pieces]), length))
        ids: list[bytes] = []
        firsts: list[int] = []
        lasts: list[int] = []
        for o, f, e in zip(owner.tolist(), first.tolist(), last.tolist(), strict=True):
            for i, start in held[pieces[o]]:
                ids.append(i)
                firsts.append(start + f)
                lasts.append(start + e)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(firsts, pa.int32()), pa.array(lasts, pa.int32())], ["id", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[tuple[bytes, int]]] = {}
        size, before = 0, None
        for batch in batches:
            for key, i, start, piece in zip(*(batch[c].to_pylist() for c in ("key", "id", "start", "piece")), strict=True):
                if key != before and size > BLOCK_BYTES:
                    yield solve(held)
                    held, size = {}, 0
                before = key
                places = held.get(piece)
                if places is None:
                    held[piece] = [(i, start)]
                    size += len(piece)
                else:
                    places.append((i, start))
        if held:
            yield solve(held)

    return run


def _settle(pieces: DataFrame, crowd: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Runs of pieces that have copies; one of each piece of keys with several, if they fit a block; the same of larger keys.

    Copies are first counted in ``SALTS`` parts of a piece's rows, and one row of each part goes on, so that no task meets all rows of a
    passage that very many texts share.
    """
    part, piece = Window.partitionBy("key", "p0", "p1", "salt"), Window.partitionBy("key", "p0", "p1")
    named = pieces.withColumns({"p0": F.xxhash64("piece"), "p1": F.xxhash64(F.lit(1), "piece"), "salt": F.pmod(F.xxhash64("id", "start"), F.lit(SALTS))})
    counted = checkpointed(named.withColumns({"c": F.count("*").over(part), "r": F.row_number().over(part.orderBy("id", "start"))}))
    reps = counted.where("r = 1").withColumns({"c": F.sum("c").over(piece), "r": F.row_number().over(piece.orderBy("id", "start"))})
    reps = checkpointed(reps.withColumn("n", F.count_if(F.col("r") == 1).over(Window.partitionBy("key"))))
    copied = counted.where("r > 1").select("id", "start", "low", "high").unionByName(reps.where("c > 1").select("id", "start", "low", "high"))
    copied = copied.select("id", F.col("start").alias("first"), (F.col("start") + F.col("high") - F.col("low")).alias("last"))
    one = reps.where("r = 1 and n > 1").drop("p0", "p1", "salt", "c", "r")
    return copied, one.where(F.col("n") <= crowd).drop("n"), one.where(F.col("n") > crowd).drop("n")


def _read(texts: DataFrame, needed: DataFrame) -> DataFrame:
    """Texts of the rows ``needed`` (id, own, ...). Each use deals the texts in the same way, so Spark shuffles them once."""
    other = needed.withColumnsRenamed({"id": "id2", "own": "own2"})
    return texts.join(other, (F.col("id") == F.col("id2")) & F.col("own").eqNullSafe(F.col("own2"))).drop("id2", "own2")


def repeated_runs(texts: DataFrame, classes: DataFrame, length: int = LENGTH, k: int = ANCHOR, crowd: int = CROWD) -> DataFrame:
    """Runs (id, first, last) of places in texts (id, own, text) where a string starts that starts elsewhere too. Copies of a text share an id and count once; ``classes`` names, for each id, the ``own`` whose text is read."""
    key = Window.partitionBy("key", "salt")
    ordered = key.orderBy("id", "place")
    anchored = lambda some: some.select("id", "text").mapInArrow(_anchor_rows(length, k), "key bigint, id binary, place bigint")
    seen = anchored(texts.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(SAMPLE)) == 0)).groupBy("key").count()
    hot = seen.where(F.col("count") > max(1, crowd // SAMPLE)).orderBy(F.desc("count"), "key").limit(HOT).select("key", F.lit(True).alias("hot"))
    anchors = anchored(texts).join(F.broadcast(hot), "key", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    anchors = anchors.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("id", "place"), F.lit(SALTS))).otherwise(0))
    new = ~(F.lag("id").over(ordered).eqNullSafe(F.col("id")) & F.lag("place").over(ordered).eqNullSafe(F.col("place")))
    rows = checkpointed(anchors.withColumn("new", new).withColumn("n", F.sum(F.col("new").cast("bigint")).over(key)).where("new and (hot or n > 1)").select("key", "id", "place", (F.col("hot") | (F.col("n") > crowd)).alias("crowded")))

    def cut(some: DataFrame) -> DataFrame:
        needed = some.groupBy("id").agg(F.collect_list(F.struct("key", "place")).alias("rows"))
        return _read(texts, needed.join(classes.select("id", "own"), "id")).mapInArrow(_cut_pieces(length), _PIECES)

    pieces = cut(rows.where(~F.col("crowded")))
    settled = []
    crowded = rows.where("crowded")
    if crowded.limit(1).count():
        queue = [(cut(crowded), 0, length - k)]
        while queue:
            part, low, high = queue.pop()
            copied, fit, large = _settle(part, crowd)
            settled.append(copied)
            pieces = pieces.unionByName(fit)
            if low < high and large.limit(1).count():  # with low = high a key has one piece: the window itself
                middle = (low + high) // 2
                halved = checkpointed(large.mapInArrow(_halve(length, low, high), _PIECES))
                queue += [(halved.where(F.col("low").between(a, b)), a, b) for a, b in ((low, middle), (middle + 1, high))]
    runs = pieces.select("key", "id", "start", "piece").repartition("key").sortWithinPartitions("key").mapInArrow(_blocks(length), "id binary, first int, last int")
    for s in settled:
        runs = runs.unionByName(s)
    return runs


def _cut(length: int):
    """(id, text, runs) to what is left of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, spans, digests, lefts = [], [], [], []
            for text, runs in zip(batch["text"].to_pylist(), batch["runs"].to_pylist(), strict=True):
                raw = text.encode()
                covered = sorted((r["first"], r["last"] + length) for r in runs or ())
                parts, end, gone, count = [], 0, 0, 0
                for first, last in covered:
                    if first > end or not count:
                        count += 1
                        parts.append(raw[end:first])
                        gone, end = gone + last - first, last
                    elif last > end:
                        gone, end = gone + last - end, last
                kept = b"".join([*parts, raw[end:]])
                removed.append(gone)
                spans.append(count)
                lefts.append(kept.decode("utf-8", "replace"))
                digests.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string()), pa.array(lefts, pa.string())], ["id", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    return run


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, k: int = ANCHOR, crowd: int = CROWD) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text``.

    Each byte that a string of ``length`` bytes covers which also starts anywhere else, in the same text or another, is removed, judged
    on the input. ``kept_text`` is the rest; a character of which some bytes are gone is replaced by U+FFFD there, not in the
    digest. Null texts count as empty; texts under ``length`` bytes are kept whole; of equal texts of ``length`` bytes or more
    nothing is left, so of repeated rows neither. Ids may be null or repeat: texts are told apart by 128 bits of their SHA-256.
    Other columns are not read; an empty table gives an empty result.
    """
    small_arrow_batches(docs.sparkSession)
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("own"), text.alias("text"), F.octet_length(text).cast("bigint").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("sha")).withColumn("id", F.unhex(F.substring("sha", 1, 32)))
    long = rows.where(F.col("n_bytes") >= length)
    classes = checkpointed(long.groupBy("id").agg(F.count("*").alias("copies"), F.min("own").alias("own")))
    texts = long.select("id", "own", "text")
    runs = repeated_runs(texts, classes, length, k, crowd).groupBy("id").agg(F.collect_set(F.struct("first", "last")).alias("runs"))
    single = classes.where("copies = 1").select("id", "own").join(runs, "id")
    cut = _read(texts, single).select("id", "text", "runs").mapInArrow(_cut(length), "id binary, n_removed bigint, n_spans bigint, kept_sha256 string, kept_text string")
    left = rows.join(classes.select("id", "copies"), "id", "left").join(cut, "id", "left")
    gone = F.coalesce("copies", F.lit(0)) > 1
    return left.select(
        F.col("own").alias("doc_id"), "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(gone, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(gone, "").otherwise(F.coalesce("kept_text", "text")).alias("kept_text"),
    )
