"""Small helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters of ``[\x20\x09-\x0D]``.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only on one machine, as in tests, an own one is set where that is unset."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="voxlake-"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, without its lineage.

    Shuffle files of earlier steps go first: Spark deletes them when the driver has collected the plans that made them, and a driver
    with little garbage would wait too long for that.
    """
    checkpoint_folder(df.sparkSession)
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors see."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def value_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary array without nulls, and the n + 1 offsets of its values."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[ends[0] : ends[-1]], ends - ends[0]


#: Rows of an Arrow batch. Spark's default of 10,000 whole documents takes tens to hundreds of megabytes on both sides of each task.
ARROW_ROWS = 500


#: Bytes of text that an Arrow function takes on at once, beyond a single longer text.
BATCH_BYTES = 4 << 20


#: Characters of a plan's description: with the ranks of a tokenizer as a literal each would take megabytes of the driver.
PLAN_TEXT = 100_000


def small_arrow_batches(spark: SparkSession) -> None:
    """Arrow batches of ``ARROW_ROWS`` rows or some ``BATCH_BYTES`` and short descriptions of plans for this session, unless it names other numbers than Spark's defaults."""
    for name, default, wanted in (("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000, ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20, BATCH_BYTES), ("spark.sql.maxPlanStringLength", 2_147_483_632, PLAN_TEXT)):
        if spark.conf.get(name).rstrip("b") == str(default):
            spark.conf.set(name, str(wanted))


def small_batches(batch: pa.RecordBatch, name: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` cut into slices whose values of the string or binary column ``name`` hold about ``most`` bytes; a longer value goes alone."""
    sizes = pc.fill_null(pc.binary_length(batch[name]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.concatenate(([0], np.cumsum(sizes)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all half-open ranges [start, start + length), one range after the other."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.asarray(starts, np.int64) - np.concatenate(([0], np.cumsum(lengths)[:-1]))
    return np.arange(total, dtype=np.int64) + np.repeat(shift, lengths)
