"""How the sources of a language differ in the terms that they use.

Counts of a source's terms are packed into one sparse vector for each chunk of a language's vocabulary. The sources of a language
are dealt into blocks, and each vector is sent to the tiles, block by block, that its block takes part in; a tile goes through its
chunks one after the other and adds up its part of the matrix of differences. A long vocabulary is cut into spans of chunks, whose
matrices are added.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, small_arrow_batches, text_or_empty

#: Terms of a chunk, chunks of a span, sources of a block.
CHUNK, SPAN, BLOCK = 4096, 64, 32
#: Terms that a task counts before it hands its counts on.
HELD = 300_000
#: Shares are whole numbers of a billionth, each count raised by PRIOR.
UNIT, PRIOR = 1_000_000_000, 5

#: Each byte of a term stays, A to Z lower-cased, every other one becomes a blank: ``[^\x00-\x40\x5B-\x60\x7B-\x7F]+`` over UTF-8.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_COUNTS = "lang string, source string, term string, n bigint, docs bigint"


#: Bytes of a text that are split at once.
PIECE = 4 << 20


def _terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, with empty ones among them, a piece of it at a time."""
    at = 0
    while at < len(text):
        to = min(at + PIECE, len(text))
        if to < len(text):
            to = text.rfind(b" ", at, to) + 1 or text.find(b" ", to) + 1 or len(text)
        yield text[at:to].split(b" ")
        at = to


def _count(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """How often, and in how many documents, each (lang, source) has each term: sums of a task, handed on whenever it holds too many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (times, docs) in held.items():
                terms = list(times)
                for at in range(0, len(terms), 10_000):
                    some = terms[at : at + 10_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(some)), pa.array([source] * len(some)), pa.array(some, pa.binary()).cast(pa.string()), *(pa.array([c[t] for t in some], pa.int64()) for c in (times, docs))],
                        ["lang", "source", "term", "n", "docs"],
                    )
            held.clear()

        size = 0
        for batch in batches:
            for lang, source, text in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), batch["text"].cast(pa.large_binary()), strict=True):
                times, docs = held.setdefault((lang, source), (Counter(), Counter()))
                before, own = len(times), set()
                for terms in _terms(text.as_py().translate(_LETTERS)):
                    times.update(terms)
                    own.update(terms)
                docs.update(own)
                for c in (times, docs):
                    c.pop(b"", None)
                size += len(times) - before + 1
                if size > most:
                    yield from out()
                    size = 0
        yield from out()

    return run


def term_counts(docs: DataFrame, least_docs: int, held: int = HELD) -> DataFrame:
    """(lang, source, term, n, n_lang, first) of the terms in at least ``least_docs`` documents of their language; one row of each (lang, term) is its ``first``."""
    counts = docs.mapInArrow(_count(held), _COUNTS).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    totals = counts.withColumns({"n_lang": F.sum("n").over(term), "docs": F.sum("docs").over(term), "first": F.row_number().over(term.orderBy("source")) == 1})
    return totals.where(F.col("docs") >= least_docs).drop("docs")


def groups(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """(lang, source, total, g, n_groups, v, total_lang): each occurring pair with its sum of counts, its number within the language, and the language's vocabulary and sum."""
    own = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum(F.col("first").cast("bigint")).alias("v"))
    lang = Window.partitionBy("lang")
    return docs.select("lang", "source").distinct().join(own, ["lang", "source"], "left").na.fill(0, ["total", "v"]).withColumns(
        {"g": F.row_number().over(lang.orderBy("source")) - 1, "n_groups": F.count("*").over(lang), "v": F.sum("v").over(lang), "total_lang": F.sum("total").over(lang)}
    )


def share(n: Column, total: Column, v: Column) -> Column:
    """1 + floor(UNIT (n + PRIOR) / (total + PRIOR v)), exactly."""
    whole = lambda c: c.cast("decimal(20,0)")
    return 1 + F.call_function("div", whole(n + PRIOR) * F.lit(UNIT).cast("decimal(10,0)"), whole(total + PRIOR * v))


def shares(n: np.ndarray, total: int, v: int) -> np.ndarray:
    """The same in whole numbers of 64 bits: a long division by three digits of a thousand."""
    whole, rest = total + PRIOR * v, n + PRIOR
    out = np.zeros_like(rest)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // whole
        rest %= whole
    return out + 1


def packed(counts: DataFrame, named: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(lang, source, g, total, v, n_groups, chunk, places, counts): a sparse vector of each source for each chunk where it has terms."""
    n_chunks = F.greatest(F.lit(1), F.ceil(F.col("v") / chunk))
    rows = counts.join(named, ["lang", "source"]).withColumn("chunk", F.pmod(F.xxhash64("term"), n_chunks).cast("int"))
    place = F.dense_rank().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1
    vectors = rows.withColumn("place", place).groupBy("lang", "chunk", "source", "g", "total", "v", "n_groups").agg(F.collect_list(F.struct("place", "n")).alias("terms"))
    return vectors.select("lang", "source", "g", "total", "v", "n_groups", "chunk", F.col("terms.place").alias("places"), F.col("terms.n").alias("counts"))


def _pair_sums(block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of a tile, sorted by span and chunk, to the sums of its pairs. The first rows of a span, of chunk -1, name the tile's groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, chunk, groups, vectors = None, None, {}, []
        sums, seen = None, 0

        def add() -> None:
            """The chunk that is complete joins the sums."""
            nonlocal seen
            if not vectors:
                return
            width = 1 + max(int(places.max()) for _, places, _ in vectors)
            dense = np.repeat(base[:, None], width, 1)
            for g, places, counts in vectors:
                dense[order[g], places] = shares(counts, *groups[g][1:3])
            for i, g in enumerate(left):
                sums[i] += np.abs(dense[order[g]] - dense[across]).sum(1)
            seen += width
            vectors.clear()

        def out() -> Iterator[pa.RecordBatch]:
            rows = [(tile[0], groups[a][0], groups[b][0], int(sums[i, j]), seen, groups[a][2], abs(int(base[order[a]]) - int(base[order[b]]))) for i, a in enumerate(left) for j, b in enumerate(right) if a < b]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["lang", "a", "b", "sum", "seen", "v", "rest"])

        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("lang", "i", "j", "span", "chunk", "g", "source", "total", "v")]
            for k, (*key, at, g, source, total, v) in enumerate(zip(*columns, strict=True)):
                if tuple(key) != tile:
                    if tile is not None:
                        add()
                        yield from out()
                    tile, chunk, sums, seen = tuple(key), -1, None, 0
                    groups.clear()
                if at == -1:
                    groups[g] = (source, total, v, int(shares(np.zeros(1, np.int64), total, v)[0]) if v else 0)
                    order = {x: i for i, x in enumerate(sorted(groups))}
                    base = np.array([groups[x][3] for x in sorted(groups)], np.int64)
                    left, right = ([x for x in sorted(groups) if x // block == tile[side]] for side in (1, 2))
                    across = [order[x] for x in right]
                    sums = np.zeros((len(left), len(right)), np.int64)
                    continue
                if at != chunk:
                    add()
                    chunk = at
                vectors.append((g, batch["places"][k].values.to_numpy(zero_copy_only=False), batch["counts"][k].values.to_numpy(zero_copy_only=False)))
        if tile is not None:
            add()
            yield from out()

    return run


def pair_values(vectors: DataFrame, named: DataFrame, chunk: int = CHUNK, span: int = SPAN, block: int = BLOCK) -> DataFrame:
    """(lang, source, item, value): the sum of differences of each two sources of a language, both ways."""
    kinds = {"places": "array<int>", "counts": "array<bigint>"}
    spans = F.ceil(F.greatest(F.lit(1), F.ceil(F.col("v") / chunk)) / span).cast("int")
    names = named.select("lang", "source", "g", "total", "v", "n_groups", F.lit(-1).alias("chunk"), *(F.lit(None).cast(k).alias(c) for c, k in kinds.items()), F.explode(F.sequence(F.lit(0), spans - 1)).alias("span"))
    rows = names.unionByName(vectors.withColumn("span", F.floor(F.col("chunk") / span).cast("int")))
    own = F.floor(F.col("g") / block).cast("int")
    tiles = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_groups") - 1) / block).cast("int")))).withColumns({"i": F.least(own, "other"), "j": F.greatest(own, "other")})
    key = ["lang", "i", "j", "span"]
    sums = tiles.select(*key, "chunk", "g", "source", "total", "v", *kinds).repartition(*key).sortWithinPartitions(*key, "chunk").mapInArrow(_pair_sums(block), "lang string, a string, b string, sum bigint, seen bigint, v bigint, rest bigint")
    # Terms that no vector of a tile has differ by what their groups give to a term that does not occur.
    whole = sums.groupBy("lang", "a", "b").agg((F.sum("sum") + (F.first("v") - F.sum("seen")) * F.first("rest")).alias("value"))
    return whole.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(whole.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))


def term_values(counts: DataFrame, named: DataFrame) -> DataFrame:
    """(lang, source, item, value): the terms that a source uses more than its language does, and by how much."""
    more = share(F.col("n"), F.col("total"), F.col("v")) - share(F.col("n_lang"), F.col("total_lang"), F.col("v"))
    return counts.where("n > 0").join(named, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), more.alias("value")).where("value > 0")


def source_divergence(docs: DataFrame, least_docs: int = 30, top: int = 50, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, source, part, item, value, rank``: of each (lang, source), its differences from the language's other sources and its ``top`` own terms.

    A term is a run of letters of A to Z, lower-cased, or of any characters beyond ASCII. A language keeps the V terms in at least
    ``least_docs`` of its documents; a group's share of a term is p = 1 + floor(10^9 (count + 5) / (N + 5 V)), with N its sum of
    counts of kept terms. Part ``pair`` has for each other source the sum of |p - q| over all kept terms, 0 where V is 0; part
    ``term`` has the terms with a count whose p is above the language's, and by how much. Ranks run from 1 by descending value, then
    by the item's bytes. Null text, language and source are empty ones; groups without terms are there; rows that repeat count each
    time; other columns are not read; a text may have any length; an empty table gives an empty result. Sums are exact up to 9 * 10^15 terms of a group.
    """
    small_arrow_batches(docs.sparkSession)
    docs = docs.select(text_or_empty(lang_col).alias("lang"), text_or_empty(source_col).alias("source"), text_or_empty(text_col).alias("text"))
    counts = checkpointed(term_counts(docs, least_docs))
    named = checkpointed(groups(docs, counts))
    pairs = pair_values(packed(counts, named), named)
    own = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(own).alias("rank"))
    return ranked(pairs, "pair").unionByName(ranked(term_values(counts, named), "term").where(F.col("rank") <= top))


DIVERGENCE_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), t AS (SELECT lang, source, r, translate(unnest(terms), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d
), c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM t GROUP BY ALL
), k AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(docs) >= 30
), g AS (SELECT DISTINCT lang, source FROM d
), x AS (
  SELECT k.lang, g.source, k.term, coalesce(c.n, 0) AS n, sum(coalesce(c.n, 0)) OVER (PARTITION BY k.lang, g.source) AS total, count(*) OVER (PARTITION BY k.lang, g.source) AS v
  FROM k JOIN g ON g.lang = k.lang LEFT JOIN c ON c.lang = k.lang AND c.source = g.source AND c.term = k.term
), p AS (SELECT lang, source, term, n, 1 + CAST((1000000000::HUGEINT * (n + 5)) // (total + 5 * v) AS BIGINT) AS p FROM x
), q AS (SELECT lang, term, 1 + CAST((1000000000::HUGEINT * (n + 5)) // (sum(n) OVER w + 5 * count(*) OVER w) AS BIGINT) AS q FROM k WINDOW w AS (PARTITION BY lang)
), s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, p - q AS value FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE n > 0 AND p > q
), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (FROM pairs UNION ALL FROM terms))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
"""
