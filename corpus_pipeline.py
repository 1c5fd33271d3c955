"""A training-corpus pipeline: each stage reads what its predecessor kept and wrote.

The languages that the first stage predicts replace ``lang`` where that is null; everything else in the columns of
``documents`` goes through unchanged.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.llm import bpe, exact_dedup, jaccard_join, language_id, mixing
from voxlake.llm.common import checkpointed, shared_folder, text_or_empty

#: The columns of ``documents``.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents whose language is less certain than this go; with four languages or fewer none is.
LEAST_SCORE = 0.25
#: Names of files, and rows of two numbers, that are broadcast at most: 20 MB, and 40 MB.
MOST_FILES, MOST_BROADCAST = 100_000, 1_000_000


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not ``und``; with more than four learned languages, those of ``LEAST_SCORE`` at least.

    Null and letterless texts go; ids may be null or repeated, and rows are judged one by one; an empty table stays empty; very long
    texts are read whole.
    """
    model = language_id.fit(docs)
    labelled = language_id.predict(docs, model, keep=COLUMNS)
    kept = labelled.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(COLUMNS)


def _with_row(docs: DataFrame) -> DataFrame:
    """The documents with a number ``row`` for each row that is the same whenever they are read: ids may be null or repeated.

    Rows of Parquet files are numbered by their file and their place in it. Rows of other sources, or of more files than the list of
    names may hold, are written with their number before anything is decided by it.
    """
    try:
        placed = docs.select(*COLUMNS, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
    except AnalysisException:
        return _written_with_row(docs)
    names = placed.select("file").distinct().limit(MOST_FILES + 1).collect()
    if len(names) > MOST_FILES:
        return _written_with_row(docs)
    numbers = docs.sparkSession.createDataFrame(list(enumerate(sorted(r.file for r in names))), "number bigint, file string")
    return placed.join(F.broadcast(numbers), "file").select(*COLUMNS, (F.shiftleft("number", 40) + F.col("place")).alias("row"))


def _written_with_row(docs: DataFrame) -> DataFrame:
    return checkpointed(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")))


def _one_of_each(rows: DataFrame, groups: DataFrame, first: Column) -> DataFrame:
    """The rows that come first in their group of (row, group): then by the smallest id, null last, then by row."""
    order = F.struct(first.alias("first"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    shared = checkpointed(groups.where("row <> group"))
    # Groups of one row are not looked at: their rows stay.
    members = shared.unionByName(shared.select(F.col("group").alias("row"), "group").distinct())
    named = checkpointed(rows.select("row", order.alias("order")).join(_sized(members), "row").select("row", "group", "order"))
    chosen = named.groupBy("group").agg(F.min("order").alias("order")).select(F.col("order.row").alias("row"))
    gone = checkpointed(named.select("row").join(chosen, "row", "left_anti"))
    return rows.join(_sized(gone), "row", "left_anti").select(COLUMNS)


def _sized(rows: DataFrame) -> DataFrame:
    """``rows``, broadcast where their count shows them to be small."""
    return F.broadcast(rows) if rows.count() <= MOST_BROADCAST else rows


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exactly one row of each group of equal texts: the longest original, then the smallest id.

    Decisions are made for rows, not for ids: rows with a null id stay or go like others and come last in the order, rows that repeat
    an id and its text are copies of each other, and different texts that share an id are different documents.
    """
    rows = _with_row(docs)
    groups = exact_dedup.exact_dedup(rows, id_col="row").select(F.col("doc_id").alias("row"), F.col("keep_id").alias("group"))
    return _one_of_each(rows, groups, -F.char_length(text_or_empty()))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exactly one row of each group that links of 0.8 or more on five-word shingles connect: the one with the smallest id.

    Rows are linked, not ids: null ids come last in the order, and each row of a repeated id is compared by its own text.
    """
    rows = _with_row(docs)
    groups = jaccard_join.jaccard_join(rows, id_col="row", n_words=5, percent=80).select(F.col("doc_id").alias("row"), F.col("component_id").alias("group"))
    return _one_of_each(rows, groups, F.lit(0))


def sample(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled by probabilities that meet the target marginals. Rows of one id and text are drawn alike; null columns count as a value of their own; an empty table stays empty."""
    return mixing.mix(docs, keep=COLUMNS).where("sampled").select(COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document that is left, and the digest of what they decode to: a row for each row, null texts as empty ones, null ids kept."""
    return bpe.bpe_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language_id", identify), ("exact_dedup", drop_copies), ("jaccard_join", drop_near_copies), ("mixing", sample), ("bpe", tokenize)]

#: The network and the byte-pair merges have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; between two of them the documents are written to the shared checkpoint folder as Parquet."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
