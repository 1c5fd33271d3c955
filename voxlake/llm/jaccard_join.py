"""Exact similarity join of word-shingle sets that uses relations between sets to skip work.

Index level: an inverted index over the shared tokens of set prefixes, each list ordered by set size and, if long, cut into blocks;
blocks whose sizes rule out a link are skipped as wholes. A pair is judged at the first token it shares: what follows there in the
smaller rest bounds the overlap. Pairs whose parity masks differ in more bits than linked sets may are dropped.

Answer level: sets that are highly similar to a set already answered (its leader) take over its answers. With the distance
d = 1 - Jaccard, which obeys the triangle inequality, a member Y of leader X and a member Z of leader W can only be linked if
d(X, W) <= (1 - t) + d(Y, X) + d(Z, W); so only leaders meet in the index, and members only where their leaders' distance leaves
room and the two groups are not one component already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, mix64, ranges, small_arrow_batches, text_or_empty
from .components import SALTS, connected_components

#: Sets, and tokens of them, that one leader group compares at once; larger groups are dealt into several, which share some sets as pivots.
GROUP, TOKENS, PIVOTS = 256, 1 << 20, 48
#: Entries of a block of an index list.
BLOCK = 64
#: Earlier shared tokens that an entry of an index list carries.
BEFORE = 16
#: Bits of a shingle's hash that choose its counter. Rare shingles come first in the index order. A task's counters take 16 MB, the steps of all sums 4 MB.
COUNTER_BITS = 22
#: Counters of a row on their way to the driver.
SEGMENT = 1 << 14
#: Ids by which texts are picked before they are shuffled: so many are broadcast at most.
MOST_IDS = 1_000_000


class _Words(dict):
    """Hashes of words, computed at their first use."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 30_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Words()


def shingle_set(text: str | None, n_words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles: lower-cased A-Z, words of ``[^\\x20\\x09-\\x0D]+``."""
    split = (text or "").encode().lower().split()
    words = np.fromiter(map(_WORDS.__getitem__, split), np.uint64, len(split))
    if not len(words):
        return words
    n = min(n_words, len(words))
    rows = len(words) - n + 1
    out = np.full(rows, n, np.uint64)
    for i in range(n):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + words[i : i + rows])
    return np.unique(out)


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum()) if len(y) else 0


def least_overlap(a: int, b: int, percent: int) -> int:
    """The smallest i with 100 i >= percent (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_size(size: int, percent: int) -> int:
    """Of two linked sets the first |x| - (least overlap) + 1 tokens share one or more."""
    return size + (-percent * size // 100) + 1


def parity_mask(x: np.ndarray) -> tuple[int, int]:
    """128 parities: how many tokens hash to each place, modulo 2. Masks of two sets differ in at most as many bits as the sets do in tokens."""
    odd = np.bincount((x >> np.uint64(57)).astype(np.int64), minlength=128) & 1
    a, b = np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()
    return a, b


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def count_steps(counts: np.ndarray) -> np.ndarray:
    """Counts as one byte each, in steps that never go down: counts below 16 as they are, then eight steps for each power of two, up to 2^34."""
    power = np.frexp(np.maximum(counts, 16).astype(np.float64))[1].astype(np.int64) - 5
    return np.where(counts < 16, counts, np.minimum(8 + 8 * power + (counts >> power + 1), 255)).astype(np.uint8)


def token_counts(texts: DataFrame, n_words: int) -> np.ndarray:
    """How often shingles occur in all documents, by the leading bits of their hash, in ``count_steps``; summed by segments on the executors."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << COUNTER_BITS, np.uint32)
        for batch in batches:
            for text in batch["text"]:
                np.add.at(seen, (shingle_set(text.as_py(), n_words) >> np.uint64(64 - COUNTER_BITS)).astype(np.int64), 1)
        for k in range(len(seen) // SEGMENT):
            counts = seen[k * SEGMENT : (k + 1) * SEGMENT]
            if counts.any():
                # In the fewest bytes that hold them: their number tells how many.
                yield row(k, counts.astype(np.min_scalar_type(int(counts.max()))))

    def row(k: int, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([counts.tobytes()], pa.binary())], ["segment", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        for batch in batches:
            for k, counts in zip(batch["segment"].to_pylist(), batch["counts"], strict=True):
                if k != at:
                    if at is not None:
                        yield row(at, count_steps(total))
                    at, total = k, np.zeros(SEGMENT, np.int64)
                held = counts.as_py()
                total += np.frombuffer(held, f"<u{len(held) // SEGMENT}").astype(np.int64)
        if at is not None:
            yield row(at, count_steps(total))

    kinds = "segment int, counts binary"
    counted = texts.select("text").mapInArrow(count, kinds)
    found = counted.repartition("segment").sortWithinPartitions("segment").mapInArrow(add, kinds).toArrow()
    out = np.zeros(1 << COUNTER_BITS, np.uint8)
    for k, counts in zip(found["segment"].to_pylist(), found["counts"].to_pylist(), strict=True):
        out[k * SEGMENT : (k + 1) * SEGMENT] = np.frombuffer(counts, np.uint8)
    return out


def shingle_signatures(texts: DataFrame, n_words: int, percent: int, counts: np.ndarray) -> DataFrame:
    """(id, text) to (id, size, d0, d1, key, m0, m1, prefix): set size, digest of the set, its least hash, parity mask and prefix in index order.

    That order is one for all sets, so linked ones meet in it whatever ``counts`` are.
    """
    often = texts.sparkSession.sparkContext.broadcast(counts)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, d0, d1, keys, masks, prefixes = [], [], [], [], [], []
            for text in batch["text"]:
                x = shingle_set(text.as_py(), n_words)
                digest = xxhash.xxh3_128_digest(x.tobytes())
                sizes.append(len(x))
                d0.append(int.from_bytes(digest[:8], "little", signed=True))
                d1.append(int.from_bytes(digest[8:], "little", signed=True))
                keys.append(int(_signed(x)[0]) if len(x) else 0)
                masks.append(parity_mask(x))
                n = prefix_size(len(x), percent) if len(x) else 0
                x = x[np.argsort(often.value[(x >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)], kind="stable")]
                prefixes.append(_signed(np.ascontiguousarray(x[:n])))
            ends = np.concatenate(([0], np.cumsum([len(p) for p in prefixes]))).astype(np.int32)
            flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch["id"], pa.array(sizes, pa.int32()), pa.array(d0, pa.int64()), pa.array(d1, pa.int64()), pa.array(keys, pa.int64()), *(pa.array([m[i] for m in masks], pa.int64()) for i in (0, 1)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                ["id", "size", "d0", "d1", "key", "m0", "m1", "prefix"],
            )

    return texts.mapInArrow(sign, "id bigint, size int, d0 bigint, d1 bigint, key bigint, m0 bigint, m1 bigint, prefix array<bigint>")


def _attach(n_words: int, percent: int):
    """For one bounded group of sets, pivots first: each joins the first leader it is linked with, else becomes one; further leaders that it
    links to, each of another component so far, are listed beside."""

    def run(table: pa.Table) -> pa.Table:
        rows = zip(table["pivot"].to_pylist(), table["id"].to_pylist(), table["text"].to_pylist(), strict=True)
        sets = sorted(((not p, len(x := shingle_set(t, n_words)), i, x) for p, i, t in rows), key=lambda r: r[:3])
        leaders: list[tuple[np.ndarray, int]] = []
        root: list[int] = []
        out = []
        for _, size, i, x in sets:
            joined: list[int] = []
            radius = 0.0
            for k, (y, _) in enumerate(leaders):
                if 100 * min(len(y), size) < percent * max(len(y), size):
                    continue
                r = k
                while root[r] != r:
                    r = root[r]
                if joined and r == root[joined[0]]:
                    continue
                common = overlap(x, y)
                if common >= least_overlap(size, len(y), percent):
                    if not joined:
                        radius = 1 - common / (size + len(y) - common)
                        root[k] = r
                    else:
                        root[r] = root[joined[0]]
                    joined.append(k)
            if joined:
                out.append((i, leaders[joined[0]][1], radius, [leaders[k][1] for k in joined[1:]]))
            else:
                root.append(len(leaders))
                leaders.append((x, i))
                out.append((i, i, 0.0, []))
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64()))
        return pa.table([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=["id", "leader", "radius", "also"])

    return run


def find_leaders(sets: DataFrame, texts: DataFrame, n_words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(id, leader, radius) of sets that share their least hash with others, where radius bounds the distance to the leader; and all links found on the way.

    A group of any size is dealt into parts of about ``GROUP`` sets that share ``PIVOTS`` of them, which connects the parts; leaders meet again in the next round, as long as
    rounds still merge leaders. What a round leaves apart the index finds.
    """
    rest = checkpointed(_dealt(sets.select("id", "key", "size")))
    found, links, before = None, None, None
    while True:
        n = rest.count()
        if not n or before is not None and n > 0.7 * before:
            if found is None:
                found, links = rest.select("id", F.col("id").alias("leader"), F.lit(0.0).alias("radius")), rest.select(F.col("id").alias("a"), F.col("id").alias("b"))
            return found, links
        before = n
        place = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("id", F.lit(n)), "id"))
        chosen = rest.where("parts > 1").withColumn("place", place).where(F.col("place") <= PIVOTS).where("place <= pivots")
        pivots = chosen.select("id", "key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("pivot"))
        others = rest.join(chosen.select("id"), "id", "left_anti").select("id", "key", F.pmod(F.xxhash64("id", F.lit(n)), F.col("parts")).cast("int").alias("part"), F.lit(False).alias("pivot"))
        groups = others.unionByName(pivots).join(_picked(texts, rest.select("id")), "id").select("key", "part", "id", "pivot", "text").groupBy("key", "part")
        new = checkpointed(groups.applyInArrow(_attach(n_words, percent), "id bigint, leader bigint, radius double, also array<bigint>").distinct())
        pairs = new.where("id <> leader").select(F.col("id").alias("a"), F.col("leader").alias("b")).unionByName(new.select(F.col("id").alias("a"), F.explode("also").alias("b")))
        links = pairs if links is None else links.unionByName(pairs)
        if found is None:
            found = new.drop("also")
        else:
            further = new.select(F.col("id").alias("leader"), F.col("leader").alias("to"), F.col("radius").alias("more"))
            found = checkpointed(found.join(further, "leader", "left").select("id", F.coalesce("to", "leader").alias("leader"), (F.col("radius") + F.coalesce("more", F.lit(0.0))).alias("radius")))
        again = rest.where("parts > 1").join(new.where("id = leader").select("id"), "id", "left_semi")
        rest = checkpointed(_dealt(again.select("id", "key", "size")))


def _dealt(sets: DataFrame) -> DataFrame:
    """Sets (id, key, size) that share their key with others, with the number of parts of their group and of its pivots.

    A part has about ``GROUP`` sets and about ``TOKENS`` tokens, of which the pivots make up a fourth at most, but one at least.
    """
    whole = Window.partitionBy("key")
    # A key's sets are dealt by their ids: those of a frequent one never meet in one task.
    dealt = sets.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    groups = dealt.groupBy("key", "salt").agg(F.count("*").alias("n"), F.sum("size").alias("tokens")).withColumns({"n": F.sum("n").over(whole), "tokens": F.sum("tokens").over(whole)}).where("n > 1")
    parts = F.ceil(F.greatest(F.col("n") / GROUP, F.col("tokens") / TOKENS)).cast("int")
    pivots = F.greatest(F.lit(1), F.least(F.lit(PIVOTS), F.floor(F.lit(TOKENS // 4) * F.col("n") / F.col("tokens")))).cast("int")
    return dealt.join(groups.select("key", "salt", parts.alias("parts"), pivots.alias("pivots")), ["key", "salt"]).drop("salt")


def _pairs_of_lists(percent: int):
    """Streams index lists (rows sorted by token, then size) and emits pairs that sizes, positions and parity masks leave possible.

    A pair is emitted at the first token its sets share. Earlier shared tokens are looked for among the ``BEFORE`` last ones of either
    set; only where more precede may a pair be emitted again, and its bound on the overlap allows for them.
    """

    def possible(x: np.ndarray, before: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        _, _, parts, sizes, positions, places, m0, m1 = x
        fits = (parts[i] != parts[j]) & (100 * np.minimum(sizes[i], sizes[j]) >= percent * np.maximum(sizes[i], sizes[j]))
        i, j = i[fits], j[fits]
        both = sizes[i] + sizes[j]
        bound = np.minimum(sizes[i] - positions[i], sizes[j] - positions[j])
        earlier = np.minimum(places[i], places[j])
        unseen = np.minimum(earlier, np.maximum(places[i] - BEFORE, 0) + np.maximum(places[j] - BEFORE, 0))
        apart = sum(np.bitwise_count((m[i] ^ m[j]).view(np.uint64)).astype(np.int64) for m in (m0, m1))
        fits = ((100 + percent) * (bound + unseen) >= percent * both) & ((100 + percent) * (both - apart) >= 2 * percent * both)
        i, j, known = i[fits], j[fits], np.minimum(places, BEFORE)
        met = np.zeros(len(i), bool)
        if len(i):
            own, other = before[i], before[j]
            here = np.arange(BEFORE) < known[i][:, None]
            for c in range(int(known[j].max())):
                met |= ((own == other[:, c, None]) & here).any(1) & (c < known[j])
        return i[~met], j[~met]

    def of_list(x: np.ndarray, before: np.ndarray, start: int, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For a long list, block by block."""
        parts, sizes = x[2], x[3]
        low = start
        for at in range(start, end, BLOCK):
            to = min(at + BLOCK, end)
            while low < at and 100 * sizes[min(low + BLOCK, at) - 1] < percent * sizes[at]:  # the whole block is too small
                low += BLOCK
            for other in range(low, to, BLOCK):
                until = min(other + BLOCK, to)
                if parts[other:until].min() == parts[at:to].max() and parts[other:until].max() == parts[at:to].min():
                    continue  # all of one component: answered
                j, i = (c.ravel() for c in np.meshgrid(np.arange(at, to), np.arange(other, until)))
                yield possible(x, before, i[i < j], j[i < j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_before = None, None
        names = ["token", "who", "part", "size", "position", "place", "m0", "m1"]

        def emit(x: np.ndarray, before: np.ndarray) -> Iterator[pa.RecordBatch]:
            starts = np.flatnonzero(np.concatenate(([True], x[0, 1:] != x[0, :-1])))
            ends = np.append(starts[1:], x.shape[1])
            short = ends - starts <= BLOCK
            left = np.repeat(np.where(short, ends, starts), ends - starts) - np.arange(x.shape[1]) - 1
            left = np.maximum(left, 0)
            i = np.repeat(np.arange(x.shape[1]), left)
            found = [possible(x, before, i, ranges(np.arange(x.shape[1]) + 1, left))]
            for s, e in zip(starts[~short].tolist(), ends[~short].tolist(), strict=True):
                if (x[2, s:e] != x[2, s]).any():
                    found.extend(of_list(x, before, s, e))
            i, j = (np.concatenate(c) for c in zip(*found, strict=True))
            if len(i):
                pairs = np.unique(np.stack((np.minimum(x[1, i], x[1, j]), np.maximum(x[1, i], x[1, j]))), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in pairs], ["a", "b"])

        for batch in batches:
            x = np.stack([batch[n].to_numpy(zero_copy_only=False).astype(np.int64) for n in names])
            known = np.minimum(x[5], BEFORE)
            before = np.zeros((x.shape[1], BEFORE), np.int64)
            before[np.repeat(np.arange(x.shape[1]), known), ranges(np.zeros(x.shape[1], np.int64), known)] = batch["before"].flatten().to_numpy()
            if held is not None:
                x, before = np.concatenate((held, x), 1), np.concatenate((held_before, before))
            if not x.shape[1]:
                continue
            last = int(np.searchsorted(x[0], x[0, -1]))
            held, held_before = x[:, last:], before[last:]
            if last:
                yield from emit(x[:, :last], before[:last])
        if held is not None and held.shape[1]:
            yield from emit(held, held_before)

    return run


def shared_prefixes(sets: DataFrame) -> DataFrame:
    """(id, shared) with those (position, token) of each prefix, in index order, that sets of another part have in theirs too.

    Few tokens are: the others, which no pair can meet by, leave the index here as narrow rows.
    """
    whole = Window.partitionBy("token")
    rows = sets.select("id", "part", F.posexplode("prefix").alias("position", "token"))
    met = rows.withColumns({"low": F.min("part").over(whole), "high": F.max("part").over(whole)}).where("low < high")
    return met.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("position", "token"))).alias("shared"))


def index_pairs(sets: DataFrame, percent: int, by_leader: bool = True) -> DataFrame:
    """Distinct pairs (a, b), a < b, of leaders (or of ids) that an index list leaves possible."""
    shared = checkpointed(shared_prefixes(sets))
    tokens = F.col("shared.token")
    entries = F.transform("shared", lambda x, i: F.struct(x.token.alias("token"), x.position.alias("position"), i.alias("place"), F.slice(tokens, F.greatest(i - BEFORE, F.lit(0)) + 1, F.least(i, F.lit(BEFORE))).alias("before")))
    about = sets.select("id", F.col("leader" if by_leader else "id").alias("who"), "part", "size", "m0", "m1")
    lists = shared.select("id", entries.alias("entries")).join(about, "id").select("id", "who", "part", "size", "m0", "m1", F.inline("entries"))
    lists = lists.repartition("token").sortWithinPartitions("token", "size", "id")
    return lists.mapInArrow(_pairs_of_lists(percent), "a bigint, b bigint").distinct()


def _picked(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of distinct ``ids`` alone, where these are few, so that no others are shuffled; else all."""
    return texts.join(F.broadcast(ids), "id", "left_semi") if ids.limit(MOST_IDS + 1).count() <= MOST_IDS else texts


def verified(pairs: DataFrame, texts: DataFrame, n_words: int) -> DataFrame:
    """(a, b) with the exact size of their sets' intersection and union. Only a's set is held while its partners stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, x = None, np.zeros(0, np.uint64)
        for batch in batches:
            rows = []
            for a, b, text in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), batch["text"], strict=True):
                if b is None:
                    own, x = a, shingle_set(text.as_py(), n_words)
                elif a == own:
                    y = shingle_set(text.as_py(), n_words)
                    common = overlap(x, y)
                    rows.append((a, b, common, len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], ["a", "b", "common", "either"])

    pairs = checkpointed(pairs)
    texts = _picked(texts, checkpointed(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()))
    partners = pairs.join(texts.withColumnRenamed("id", "b"), "b").select("a", "b", "text")
    owners = texts.withColumnRenamed("id", "a").join(pairs.select("a").distinct(), "a", "left_semi").select("a", F.lit(None).cast("bigint").alias("b"), "text")
    rows = owners.unionByName(partners).repartition("a").sortWithinPartitions("a", F.asc_nulls_first("b"))
    return rows.mapInArrow(run, "a bigint, b bigint, common bigint, either bigint")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id``.

    A document's set holds its distinct ``n_words``-word shingles (fewer words: the whole sequence as one). Two documents link when
    100 * intersection >= percent * union, and ``component_id`` is the smallest id that links reach. Documents with null or empty
    text, or without words, have an empty set and link with nothing. Rows with a null id are dropped, as nothing can name them; rows
    that repeat an id count as one document with the smallest of their texts. Other columns are not read. Shingles are
    compared as 64-bit hashes.
    """
    small_arrow_batches(docs.sparkSession)
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), text_or_empty(text_col).alias("text"))
    # One text for each id, before anything reads them: what is signed is what is compared.
    texts = checkpointed(texts.groupBy("id").agg(F.min("text").alias("text"))) if _repeats(texts) else texts
    signed = checkpointed(shingle_signatures(texts, n_words, percent, token_counts(texts, n_words)))
    classes = signed.where("size > 0").groupBy("d0", "d1").agg(F.min("id").alias("rep"))
    member = signed.where("size > 0").select("id", "d0", "d1").join(classes, ["d0", "d1"]).select("id", "rep")
    distinct = signed.join(classes.select(F.col("rep").alias("id")), "id", "left_semi")
    led, tied = find_leaders(distinct, texts, n_words, percent)
    tied = checkpointed(connected_components(tied))
    sets = distinct.join(led, "id", "left").join(tied, "id", "left").select("id", F.coalesce("leader", "id").alias("leader"), F.coalesce("radius", F.lit(0.0)).alias("radius"), F.coalesce("component", "id").alias("part"), "size", "m0", "m1", "prefix")
    sets = checkpointed(sets)
    # The prefixes are in the sets now; what else is needed of the signatures is small, and their files can go.
    known = checkpointed(signed.select("id", "size").join(member, "id", "left"))
    del signed, classes, member, distinct, led
    met = checkpointed(verified(index_pairs(sets, percent), texts, n_words))
    linked = f"100 * common >= {percent} * either"
    links = tied.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(met.where(linked).select("a", "b"))
    parts = checkpointed(connected_components(links))
    # Leaders that are too far apart for a link, though not too far for their members.
    slack = checkpointed(sets.groupBy("leader").agg(F.max("radius").alias("r")).where("r > 0"))
    near = met.where(f"not ({linked})").withColumn("d", 1 - F.col("common") / F.col("either"))
    for side in ("a", "b"):
        near = near.join(slack.select(F.col("leader").alias(side), F.col("r").alias(f"r_{side}")), side, "left").join(parts.select(F.col("id").alias(side), F.col("component").alias(f"c_{side}")), side, "left")
    near = checkpointed(near.na.fill(0.0, ["r_a", "r_b"]).where(f"d <= {1 - percent / 100} + r_a + r_b + 1e-9 and not coalesce(c_a, a) <=> coalesce(c_b, b)").select("a", "b", "d", "r_a", "r_b"))
    if near.limit(1).count():
        need = near.select(F.col("a").alias("leader"), (F.col("d") - (1 - percent / 100) - F.col("r_b") - 1e-9).alias("need"))
        need = need.unionByName(near.select(F.col("b").alias("leader"), (F.col("d") - (1 - percent / 100) - F.col("r_a") - 1e-9).alias("need")))
        some = sets.join(need.groupBy("leader").agg(F.min("need").alias("need")), "leader").where("radius >= need").drop("need", "part")
        some = checkpointed(some.join(parts, "id", "left").select("id", "leader", "radius", F.coalesce("component", "id").alias("part"), "size", "m0", "m1", "prefix"))
        pairs = index_pairs(some, percent, by_leader=False)
        for side in ("a", "b"):
            pairs = pairs.join(some.select(F.col("id").alias(side), F.col("leader").alias(f"l_{side}"), F.col("radius").alias(f"s_{side}")), side)
        rooms = near.select(F.col("a").alias("x"), F.col("b").alias("y"), "d")
        pairs = pairs.withColumns({"x": F.least("l_a", "l_b"), "y": F.greatest("l_a", "l_b")}).join(rooms, ["x", "y"]).where(f"d <= {1 - percent / 100} + s_a + s_b + 1e-9").select("a", "b")
        more = checkpointed(verified(pairs, texts, n_words)).where(linked).select("a", "b")
        parts = checkpointed(connected_components(parts.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more)))
    reached = known.join(parts.withColumnRenamed("id", "rep"), "rep", "left")
    return reached.select(F.col("id").alias("doc_id"), F.col("size").cast("bigint").alias("n_shingles"), F.coalesce("component", "rep", "id").alias("component_id"))


def _repeats(texts: DataFrame) -> bool:
    return bool(texts.groupBy("id").count().where("count > 1").limit(1).count())
