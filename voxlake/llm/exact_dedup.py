"""Exact deduplication by a tree merge of sorted digest runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, checkpointed, text_or_empty

#: Partitions that meet in one merge; a larger number means fewer rounds and wider merges.
FAN_IN = 8

_RUN = "digest binary, n_norm int, proof bigint, n_points int, best_id bigint, n bigint, slot int"


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digest of the text without white space, and what proves and orders it."""
    norm = F.translate(text_or_empty(text_col), ASCII_SPACE, "")
    return docs.select(F.col(id_col).cast("bigint").alias("best_id"), F.char_length(text_or_empty(text_col)).alias("n_points"), norm.alias("norm")).select(
        F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("digest"), F.char_length("norm").alias("n_norm"), F.xxhash64("norm").alias("proof"), "n_points", "best_id"
    )


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and preference: the first of each key stays, with the sum of ``n``. The last key waits for the next batch."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table]).combine_chunks()
        if not table.num_rows:
            continue
        digests = table["digest"].to_pylist()
        keys = list(zip(digests, table["n_norm"].to_pylist(), table["proof"].to_pylist(), strict=True))
        starts = np.array([0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1])])
        counts = np.add.reduceat(table["n"].to_numpy(), starts)
        place = table.schema.get_field_index("n")
        merged = table.take(pa.array(starts)).set_column(place, table.schema.field(place), pa.array(counts, pa.int64()))
        held = merged.slice(len(starts) - 1)
        if len(starts) > 1:
            yield from merged.slice(0, len(starts) - 1).to_batches()
    if held is not None:
        yield from held.combine_chunks().to_batches()


def _sorted_runs(df: DataFrame) -> DataFrame:
    """Each partition becomes one sorted run with a row per key: most code points first, then the smallest id."""
    return df.sortWithinPartitions("digest", "n_norm", "proof", F.desc("n_points"), F.asc_nulls_last("best_id")).mapInArrow(_merge, _RUN)


def tree_merge(signed: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """A row per distinct text: its key, the id that stays and the number of copies.

    There are ``fan_in ** r`` slots. Round j replaces digit j of a row's slot by digit j of its digest, so ``fan_in``
    partitions exchange parts of their runs and merge what they get; after r rounds equal digests have met, and each slot holds
    its share of them. A text that a third of the rows hold is one row per run before the first exchange, and at most
    ``fan_in`` rows in a merge.
    """
    slots, rounds = fan_in, 1
    while slots < signed.rdd.getNumPartitions():
        slots, rounds = slots * fan_in, rounds + 1
    target = F.conv(F.hex(F.substring("digest", 1, 6)), 16, 10).cast("bigint") % slots
    runs = _sorted_runs(signed.withColumns({"n": F.lit(1).cast("bigint"), "slot": F.spark_partition_id() % slots}))
    for j in range(rounds):
        unit = fan_in**j
        digit = F.floor(F.col("slot") / unit) % fan_in
        runs = runs.withColumn("slot", (F.col("slot") - digit * unit + F.floor(target / unit) % fan_in * unit).cast("int"))
        runs = _sorted_runs(runs.repartitionById(slots, F.col("slot")))
    return runs.drop("slot")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after deletion of every character of ``[\\x20\\x09-\\x0D]``. SHA-256 sorts and joins them;
    the normalised length and a second, independent hash go along in every merge and must agree as well. The row with the most
    code points in its original text stays, then the one with the smallest id. Null texts count as empty; empty texts are
    equal to each other. A null id sorts after all others. Rows that repeat an id and its text are all marked alike. Other
    columns, whatever their names, are not read. An empty table gives an empty result.
    """
    signed = checkpointed(signatures(docs, id_col, text_col))
    groups = tree_merge(signed, fan_in).withColumnsRenamed({"best_id": "keep_id", "n": "group_size"}).drop("n_points")
    joined = signed.join(groups, ["digest", "n_norm", "proof"])
    return joined.select(
        F.col("best_id").alias("doc_id"), "keep_id", "group_size", F.col("best_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )
