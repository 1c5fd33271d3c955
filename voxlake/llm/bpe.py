"""Byte-level BPE encoding and decoding with a published table of ranks.

Spark's higher-order functions fold the ranked merges over the bytes of distinct words, with the ranks as a literal. Words that
are frequent in the corpus are folded once, the others once for each task that meets them, as long as it remembers them.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_arrow_batches, small_batches, text_or_empty, value_bytes

#: Frequent words whose ids every task holds: at most so many, of at most so many bytes, some 50 MB in a worker. They are counted on
#: one document in SAMPLE; which words they are changes the speed alone.
FREQUENT, LONGEST, SAMPLE = 250_000, 48, 8
#: Further words that a task remembers at once, so that each is folded once while it is remembered.
REMEMBERED = 100_000
#: Buckets of the literal rank map; a bucket's few entries are searched one by one.
BUCKETS = 16_381
#: Bits of an id, and the rank of pairs that are no piece.
ID_BITS, NO_RANK = 17, 2**31 - 1
#: Words of more bytes are merged with a heap: folding copies the pieces at each merge.
HUGE = 1024


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: the last lambda of an empty fold holds it, without a copy."""
    return F.aggregate(F.array(), value, lambda kept, _: kept, use)


class RankMap:
    """Ranks as a literal column: an array of buckets, each a map from pairs of ids to the rank of the joined piece, which is its id."""

    def __init__(self, ranks: dict[bytes, int], buckets: int = BUCKETS):
        if max(ranks.values()) >> ID_BITS:
            raise ValueError("too many ranks")
        held: list[dict[str, int]] = [{} for _ in range(buckets)]
        for piece, rank in ranks.items():
            for cut in range(1, len(piece)):
                left, right = ranks.get(piece[:cut]), ranks.get(piece[cut:])
                if left is not None and right is not None:
                    pair = left << ID_BITS | right
                    held[pair % buckets][str(pair)] = rank
        self.literal = F.from_json(F.lit(json.dumps(held)), "array<map<string,int>>")
        self.buckets = buckets
        #: The id of each byte.
        self.bytes = [ranks[bytes([i])] for i in range(256)]
        #: Pieces that merges do not lead to; a word that is one is its id all the same.
        self.exceptions = {piece: rank for piece, rank in ranks.items() if len(piece) > 1 and merged(piece, ranks) != [rank]}

    def encode(self, words: Column) -> Column:
        """Ids of each word of an array."""
        first = F.from_json(F.lit(json.dumps(self.bytes)), "array<int>")
        latin = F.transform(words, lambda w: F.decode(F.encode(w, "UTF-8"), "ISO-8859-1"))
        ids = bound(first, lambda table: F.transform(latin, lambda w: F.transform(F.filter(F.split(w, ""), lambda c: F.length(c) > 0), lambda c: F.get(table, F.ascii(c)))))
        if not self.exceptions:
            return self.fold(ids)
        whole = F.create_map(*(F.lit(v) for piece, rank in self.exceptions.items() for v in (piece.decode("latin-1"), rank)))
        return F.zip_with(latin, self.fold(ids), lambda w, found: F.coalesce(F.when(F.try_element_at(whole, w).isNotNull(), F.array(F.try_element_at(whole, w))), found))

    def fold(self, words: Column) -> Column:
        """Ids of each word of an array, given as the ids of its bytes."""
        return bound(self.literal, lambda ranks: F.transform(words, lambda w: self._word(w, ranks)))

    def _word(self, word: Column, ranks: Column) -> Column:
        """A fold of the word's pieces, at first its bytes, over as many steps as there could be merges; each step joins the leftmost pair of the least rank.

        A piece is a number: the rank of its pair with the next piece, and below that, in ``ID_BITS`` bits, its id. A step looks up
        the two pairs that it makes.
        """
        none, low = F.lit(NO_RANK << ID_BITS), F.lit((1 << ID_BITS) - 1)

        def pair(left: Column, right: Column) -> Column:
            """The rank of a pair of ids above ``ID_BITS`` zeros."""
            found = lambda p: F.try_element_at(F.get(ranks, (p % self.buckets).cast("int")), p.cast("string")).cast("bigint")
            return bound(F.shiftleft(left, ID_BITS) + right, lambda p: F.coalesce(F.shiftleft(found(p), ID_BITS), none))

        def step(parts: Column, _: Column) -> Column:
            def joined(least: Column) -> Column:
                new = F.shiftright(least, ID_BITS)

                def at(place: Column) -> Column:
                    changed = lambda p, i: F.when(i == place, pair(new, F.get(parts, place + 2).bitwiseAND(low)) + new).when(i == place - 1, pair(p.bitwiseAND(low), new) + p.bitwiseAND(low)).otherwise(p)
                    return F.transform(F.filter(parts, lambda _, i: i != place + 1), changed)

                return F.when(least >= none, parts).otherwise(bound(least.bitwiseAND(low).cast("int"), at))

            # Rank and place in one number, so that the least is the leftmost pair of the least rank.
            return bound(F.array_min(F.transform(parts, lambda p, i: p - p.bitwiseAND(low) + i)), joined)

        ids = F.transform(word, lambda i: i.cast("bigint"))
        return bound(ids, lambda ids: F.aggregate(F.slice(ids, F.lit(2), F.size(ids)), F.transform(ids, lambda p, i: pair(p, F.get(ids, i + 1)) + p), step, lambda parts: F.transform(parts, lambda p: p.bitwiseAND(low).cast("int"))))


def merge_huge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word of very many bytes."""
    return [ranks[word]] if word in ranks else merged(word, ranks)


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges, from a heap of pairs."""
    pieces: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
    after, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
    heap = [(r, i, pieces[i], pieces[i + 1]) for i in range(len(word) - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)

    def pair(i: int, j: int) -> None:
        if i >= 0 and j < len(pieces) and (r := ranks.get(pieces[i] + pieces[j])) is not None:
            heapq.heappush(heap, (r, i, pieces[i], pieces[j]))

    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if pieces[i] != a or j >= len(pieces) or pieces[j] != b:
            continue
        pieces[i], pieces[j] = a + b, None
        after[i] = after[j]
        if after[i] < len(pieces):
            before[after[i]] = i
        pair(before[i], i)
        pair(i, after[i])
    return [ranks[p] for p in pieces if p is not None]


#: The letters, numbers and white space up to U+00FF, for the standard library's faster matcher.
LATIN = {r"\p{L}": "A-Za-zªµºÀ-ÖØ-öø-ÿ", r"\p{N}": "0-9²³¹¼½¾", r"\s": r"\t-\r \x85\xa0"}


def splitter(pattern: str):
    """A function from a text to its matches of ``pattern``. Texts without characters beyond U+00FF go to ``re``, with the classes spelled out."""
    whole = regex.compile(pattern).findall
    narrow = pattern.replace(r"\S", f"[^{LATIN[r'\s']}]")
    narrow = re.sub(r"\[(\^?)([^\]]*)\]", lambda m: f"[{m[1]}" + re.sub(r"\\(?:p\{[LN]\}|s)", lambda c: LATIN[c[0]], m[2]) + "]", narrow)
    narrow = re.sub(r"\\(?:p\{[LN]\}|s)", lambda c: f"[{LATIN[c[0]]}]", narrow)
    if "\\p" in narrow:  # a pattern with other classes
        return whole
    quick = re.compile(narrow).findall
    return lambda text: quick(text) if text.isascii() or max(text) <= "\xff" else whole(text)


@dataclass
class FrequentWords:
    """Words joined by NUL, their numbers of ids and all ids, and words whose id no merges lead to; ``table`` is made once by each worker that holds the broadcast."""

    words: str
    counts: bytes
    ids: bytes
    exceptions: dict[str, bytes]

    @cached_property
    def table(self) -> dict[str, bytes]:
        ends = (4 * np.cumsum(np.frombuffer(self.counts, np.uint8).astype(np.int64))).tolist()
        return {word: self.ids[a:b] for word, a, b in zip(self.words.split("\0"), [0, *ends], ends, strict=False)} | self.exceptions


def frequent_words(texts: DataFrame, ranks: RankMap, pattern: str) -> FrequentWords:
    """At most FREQUENT words of LONGEST bytes with their ids: a few megabytes."""
    some = texts.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(SAMPLE)) == 0)
    words = some.select(F.explode(F.regexp_extract_all("text", F.lit(f"(?U){pattern}"), F.lit(0))).alias("word"))
    top = words.groupBy("word").count().where((F.octet_length("word") <= LONGEST) & (F.col("count") > 1) & ~F.contains("word", F.lit("\0"))).orderBy(F.desc("count"), "word").limit(FREQUENT)
    rows = top.repartition(8).select("word", F.get(ranks.encode(F.array("word")), 0).alias("ids")).toArrow()
    ids = rows["ids"].combine_chunks()
    odd = {piece.decode(errors="ignore"): np.array([rank], "<u4").tobytes() for piece, rank in ranks.exceptions.items()}
    return FrequentWords("\0".join(rows["word"].to_pylist()), np.diff(ids.offsets.to_numpy()).astype(np.uint8).tobytes(), ids.flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes(), odd)


def _split_and_put_in(docs: DataFrame, path: str, pattern: str, id_col: str, text_col: str, columns: list[str], results: str, result) -> DataFrame:
    """The ``columns`` of each row and what ``result(ids, pieces)`` makes of its text's ids: the columns ``results``.

    The first function splits texts and looks words up; a word that is neither frequent nor remembered goes out with the row that
    meets it first, is folded there, and the second function, which reads the same rows in the same order, remembers its ids.
    """
    small_arrow_batches(docs.sparkSession)
    # The literal takes much of a small driver: what earlier queries left there goes first, on both sides of the gateway.
    gc.collect()
    docs.sparkSession.sparkContext._jvm.System.gc()
    ranked = read_ranks(path)
    table = RankMap(ranked)
    context = docs.sparkSession.sparkContext
    all_pieces = context.broadcast(_by_rank(ranked))
    common = context.broadcast(frequent_words(docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")), table, pattern))
    source = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(columns)), text_or_empty(text_col).alias("text"))
    passed = [f"c{i}" for i in range(len(columns))]
    kinds = "".join(f"c{i} {source.schema[f'c{i}'].dataType.simpleString()}, " for i in range(len(columns)))
    first = np.array(table.bytes, np.int32)
    fields = [f.split() for f in results.split(", ")]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, known = splitter(pattern), common.value.table
        seen: dict[str, int] = {}
        ranks: dict[bytes, int] = {}
        for batch in (part for b in batches for part in small_batches(b, "text")):
            runs, cuts, uses, firsts, counts, new = [], [], [], [], [0], []
            for text in batch["text"]:
                words = split(text.as_py())
                ids = list(map(known.get, words))
                if len(seen) > REMEMBERED:
                    seen = {}
                firsts.append(len(seen))
                run, cut, use, at, size = [], [], [], 0, 0
                for place in [i for i, found in enumerate(ids) if found is None]:
                    word = words[place]
                    if len(word) * 4 > HUGE and len(raw := word.encode()) > HUGE:
                        ranks = ranks or {p: r for r, p in enumerate(all_pieces.value.to_pylist()) if p is not None}
                        ids[place] = np.array(merge_huge(raw, ranks), "<u4").tobytes()
                        continue
                    if (known_as := seen.get(word)) is None:
                        known_as = seen[word] = len(seen)
                        new.append(word.encode())
                    run.append(b"".join(ids[at:place]))
                    at = place + 1
                    size += len(run[-1])
                    cut.append(size)
                    use.append(known_as)
                runs.append(b"".join([*run, *ids[at:]]))
                cuts.append(np.array(cut, "<i8").tobytes())
                uses.append(np.array(use, "<i4").tobytes())
                counts.append(len(new))
            letters = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(w) for w in new]))), pa.int32()), pa.array(first[np.frombuffer(b"".join(new), np.uint8)]))
            others = pa.ListArray.from_arrays(pa.array(counts, pa.int32()), letters)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in passed), pa.array(runs, pa.binary()), pa.array(cuts, pa.binary()), pa.array(uses, pa.binary()), pa.array(firsts, pa.int32()), others], [*passed, "run", "cuts", "uses", "first", "others"])

    def put_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = all_pieces.value
        inserts: list[bytes] = []
        for batch in (part for b in batches for part in small_batches(b, "run")):
            out = []
            for run, cuts, uses, first, folded in zip(*(batch[c] for c in ("run", "cuts", "uses", "first", "folded")), strict=True):
                run, cuts = run.as_py(), cuts.as_py()
                if first.as_py() != len(inserts):
                    if first.as_py():
                        raise RuntimeError("rows of a partition came in another order")
                    inserts = []
                inserts += [np.array(ids, "<u4").tobytes() for ids in folded.as_py()]
                if cuts:
                    at, parts = 0, []
                    for cut, use in zip(np.frombuffer(cuts, "<i8").tolist(), np.frombuffer(uses.as_py(), "<i4").tolist(), strict=True):
                        parts += (run[at:cut], inserts[use])
                        at = cut
                    run = b"".join([*parts, run[at:]])
                out.append(result(run, piece))
            columns = list(zip(*out, strict=True)) or [()] * len(fields)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in passed), *(pa.array(c, {"binary": pa.binary(), "bigint": pa.int64(), "string": pa.string()}[kind]) for c, (_, kind) in zip(columns, fields, strict=True))], [*passed, *(name for name, _ in fields)])

    looked = source.mapInArrow(look_up, f"{kinds}run binary, cuts binary, uses binary, first int, others array<array<int>>")
    folded = looked.select(*passed, "run", "cuts", "uses", "first", table.fold(F.col("others")).alias("folded"))
    return folded.mapInArrow(put_in, f"{kinds}{results}").select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(columns)), *(name for name, _ in fields))


def _by_rank(ranks: dict[bytes, int]) -> pa.Array:
    """Pieces at the places of their ranks."""
    pieces: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    return pa.array(pieces, pa.binary())


def _pieces(ids: bytes, by_rank: pa.Array) -> bytes:
    """The concatenated pieces of ids; an id that is none is refused."""
    if not ids:
        return b""
    taken = by_rank.take(pa.array(np.frombuffer(ids, "<u4")))
    if taken.null_count:
        raise ValueError("an id has no piece")
    return value_bytes(taken)[0].tobytes()


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``doc_id`` (or the columns ``keep``) and ``ids`` (binary, little-endian unsigned 32-bit) of every whole text; null counts as empty.

    Each match of ``pattern`` is encoded by itself, without special tokens.
    """
    return _split_and_put_in(docs, path, pattern, id_col, text_col, keep or [id_col], "ids binary", lambda ids, _: (ids,))


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with the column ``decoded`` (binary): the concatenated pieces of the ids; null ids count as none."""
    pieces = encoded.sparkSession.sparkContext.broadcast(_by_rank(read_ranks(path)))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in small_batches(b, ids_col)):
            out = [_pieces(ids.as_py() or b"", pieces.value) for ids in batch[ids_col]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "decoded"])

    return encoded.mapInArrow(join, f"{kinds}, decoded binary")


def bpe_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    Encodes as ``encode`` does and decodes the ids as ``decode`` does, in one pass. Null texts count as empty (no id, the digest of
    nothing); repeated rows come out alike; a null id stays null; very long texts are encoded whole; other columns are not read; an
    empty table gives an empty result.
    """

    def digests(ids: bytes, piece: pa.Array) -> tuple[int, str, str]:
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(_pieces(ids, piece)).hexdigest()

    out = _split_and_put_in(docs, path, pattern, id_col, text_col, [id_col], "n_tokens bigint, ids_sha256 string, decoded_sha256 string", digests)
    return out.withColumnRenamed(id_col, "doc_id")
