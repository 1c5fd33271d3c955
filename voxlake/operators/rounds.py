"""Tables that are built in rounds: each round's table is written to the session's checkpoint folder and cuts the plan."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only on one machine, as in tests, an own folder where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that all tasks share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="voxlake-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all tasks reach."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder, which cuts its plan."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def ways_to_roots(links: DataFrame, keys: list[str], folds: dict) -> DataFrame:
    """Rows (keys, id, up, ...) of a forest, up null at roots, to (keys, id, ...) folded over the way to each row's root.

    ``folds`` gives, for each further column, the value over a way of two parts from those of the near and the far part. Each round
    doubles the ways, so a chain of n rows takes log2(n) rounds. Rows that no root reaches, as in cycles, are left out.
    """
    rows = settled(links)
    open_before = None
    while True:
        still = rows.where("up is not null").count()
        if not still or still == open_before:
            return rows.where("up is null").drop("up")
        open_before = still
        far = rows.select(*keys, F.col("id").alias("up"), F.col("up").alias("__up"), *(F.col(c).alias(f"__{c}") for c in folds))
        joined = rows.where("up is not null").join(far, [*keys, "up"])
        ways = joined.select(*keys, "id", F.col("__up").alias("up"), *(f(F.col(c), F.col(f"__{c}")).alias(c) for c, f in folds.items()))
        rows = settled(rows.where("up is null").unionByName(ways))


#: Bytes after which a batch of rows of large values goes to an Arrow function.
BATCH_BYTES = 4 << 20


@contextmanager
def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> Iterator[None]:
    """Actions inside hand rows to Arrow functions in batches of about ``most`` bytes: by their number alone, all rows of a task may be one batch."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, before)
