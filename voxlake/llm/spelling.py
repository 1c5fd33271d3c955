"""Spelling variants: words one edit apart, found by bands of letter-parity masks.

A word's mask holds, for each letter, whether it stands there an odd number of times. One inserted, deleted or replaced letter flips
at most two bits, so of three bands of the mask one at least is the same for both words. Words join on an equal band; the key also
holds the length that the shorter word of a pair has (the length filter) and the half of the word before or after the edit, which is
the same for both, so that a bucket is small at any size of the vocabulary. What meets is verified by its edit distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, text_or_empty

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits of a mask: a letter a to z has its own, any other letter one of 36 more. Bit b belongs to band b modulo 3, which deals frequent letters out.
BITS, BANDS = 62, 3


def misspelled_words(docs: DataFrame, least: int, one_in: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word) for each run of letters whose word has ``least`` code points or more.

    Where ``one_in`` divides the checksum of ``<id>:<run>``, the run's code point at checksum modulo length is deleted.
    """
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text_or_empty(text_col), F.lit(rf"[A-Za-zÀ-ÿ]{{{least},}}"), F.lit(0))).alias("run"))
    low = runs.select("id", F.translate("run", UPPER, LOWER).alias("run")).select("run", F.crc32(F.encode(F.concat("id", F.lit(":"), "run"), "UTF-8")).alias("h"), F.char_length("run").alias("n"))
    at = (F.col("h") % F.col("n")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.col("n")))
    return low.where((F.col("h") % one_in != 0) | (F.col("n") > least)).select(F.when(F.col("h") % one_in == 0, shorter).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, least_n: int) -> DataFrame:
    """(word, n) of words that occur ``least_n`` times or more."""
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


def parity_mask(word: Column) -> Column:
    """One bit for each letter: whether it occurs an odd number of times."""
    letter = lambda c: F.when(F.ascii(c) < 123, F.ascii(c) - 97).otherwise(26 + F.ascii(c) % 36)
    letters = F.filter(F.split(word, ""), lambda c: c != "")
    return F.aggregate(letters, F.lit(0).cast("bigint"), lambda m, c: m.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), letter(c))))


def _band(mask: Column, k: int) -> Column:
    return mask.bitwiseAND(F.lit(sum(1 << b for b in range(k, BITS, BANDS))).cast("bigint"))


def _halves(word: Column, size: Column, shorter: Column) -> tuple[Column, Column]:
    """What stands before and after the middle of the shorter word of a pair: one of the two is not touched by the edit."""
    before = F.floor(shorter / 2).cast("int")
    return F.substring(word, F.lit(1), before), F.substring(word, size - (shorter - before) + 1, shorter)


def _keys(words: DataFrame, shorter: Column) -> DataFrame:
    """A row for each band and half, as one hash: what collides is told apart by the verification."""
    start, end = _halves(F.col("word"), F.char_length("word"), shorter)
    keys = [F.struct(F.xxhash64(F.lit(k), _band(F.col("mask"), k), shorter, F.lit(side), half).alias("key"), F.lit(2 * k + side).alias("place")) for k in range(BANDS) for side, half in ((0, start), (1, end))]
    return words.select("word", "n", "mask", F.inline(F.array(*keys)))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b): each pair of words of (word, n) exactly one edit apart, once; the longer or else the greater word is b."""
    words = words.select("word", "n", parity_mask(F.col("word")).alias("mask"))
    columns = ("word", "n", "mask", "place")
    a = _keys(words, F.char_length("word")).select("key", *(F.col(c).alias(f"{c}_a") for c in columns))
    b = _keys(words, F.char_length("word")).unionByName(_keys(words, F.char_length("word") - 1)).select("key", *(F.col(c).alias(f"{c}_b") for c in columns))
    size_a, size_b = F.char_length("word_a"), F.char_length("word_b")
    flips = F.col("mask_a").bitwiseXOR(F.col("mask_b"))
    later = (size_b > size_a) | (size_b == size_a) & (F.col("word_b") > F.col("word_a"))
    # A pair is taken at its first equal band and, where both halves are the same, at the first of them.
    start_a, start_b = (_halves(F.col(f"word_{x}"), F.lit(0), size_a)[0] for x in "ab")
    first = F.when(_band(flips, 0) == 0, 0).when(_band(flips, 1) == 0, 2).otherwise(4) + F.when(start_a == start_b, 0).otherwise(1)
    near = (F.bit_count(flips) <= 2) & (size_b - size_a).between(0, 1) & later & (F.col("place_a") == F.col("place_b")) & (F.col("place_a") == first) & (F.levenshtein("word_a", "word_b", 1) == 1)
    return a.join(b, "key").where(near).select(F.col("word_a").alias("a"), F.col("word_b").alias("b"), "n_a", "n_b")


def with_forms(words: DataFrame, times: int) -> DataFrame:
    """(word, n, n_near, form, form_n): a word's form is its near word of the largest n (ties: the smallest), if that is ``times`` its own n or more."""
    pairs = near_pairs(words)
    links = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("m")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("m")))
    best = links.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    enough = -F.col("best.m") >= times * F.col("n")
    return words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.m")).alias("form_n"))


def roots(words: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: forms followed to the last.

    Each step of a chain is more frequent by a factor, so chains are short; each round doubles the steps that are taken at once.
    """
    found = checkpointed(words.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        further = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = checkpointed(found.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        found = longer.select("word", "root")
        if not longer.where("moved").limit(1).count():
            return found


def spelling_variants(docs: DataFrame, least: int = 7, least_n: int = 2, one_in: int = 31, times: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word: ``word, n, n_near, form, form_n, root``.

    Words are the maximal runs of ``[A-Za-z\\u00C0-\\u00FF]`` of whole texts, lower-cased A to Z alone, less the letters that
    ``misspelled_words`` deletes; those of ``least`` code points or more that occur ``least_n`` times or more overall. ``n_near``
    counts the words exactly one inserted, deleted or replaced code point apart. Null and empty texts have no words; a null id counts
    as an empty one; rows that repeat count each time; a text may have any length; other columns are not read. Without words the
    result is empty.
    """
    words = checkpointed(vocabulary(misspelled_words(docs, least, one_in, id_col, text_col), least_n))
    formed = checkpointed(with_forms(words, times))
    return formed.join(roots(formed), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: The checksum folds the bytes of ``<id>:<run>`` by its polynomial; near words share what is left without one letter.
SPELLING_SQL = r"""
WITH RECURSIVE r AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), d AS (SELECT id, run, count(*) AS n, hex(encode(id || ':' || run)) AS x FROM r GROUP BY ALL
), c AS (
  SELECT run, n, xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)),
    lambda a, b: xor(a >> 8, list_reduce([(xor(a, b) & 255), 0, 0, 0, 0, 0, 0, 0, 0], lambda e, z: CASE WHEN e % 2 = 1 THEN xor(e >> 1, 3988292384) ELSE e >> 1 END)))) AS h
  FROM d
), w AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) + 2 AS BIGINT)) ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1
), v AS (SELECT word, n FROM w WHERE length(word) >= 7 AND n >= 2
), cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)
), near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN v b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN v b ON a.rest = b.word
), best AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, encode(other)) AS other, max(m) AS m FROM near GROUP BY word
), f AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * v.n THEN other END AS form, CASE WHEN m >= 10 * v.n THEN m END AS form_n FROM v LEFT JOIN best ON v.word = best.word
), chain AS (
  SELECT word, word AS at FROM f
  UNION ALL SELECT chain.word, f.form FROM chain JOIN f ON f.word = chain.at WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, chain.at AS root, f.n, f.n_near, f.form_n FROM f JOIN chain ON f.word = chain.word JOIN f last ON last.word = chain.at AND last.form IS NULL
"""
