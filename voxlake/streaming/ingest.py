"""Streams of instances: a landing folder, upserts, commitments, progressive volumes and circuit breakers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.part10 import elements


def landing(spark: SparkSession, path: str, most_files: int = 1000) -> DataFrame:
    """Files that arrive below a folder, parsed as they come."""
    kind = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(kind).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", most_files).load(path)
    return elements(files.select(F.col("path").alias("file_path"), "content"))


def write_batches(stream: DataFrame, path: str, checkpoint: str, partitions: tuple[str, ...] = ()):
    """Appends a stream to a Parquet table; each batch is written once, also after a restart."""
    out = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (out.partitionBy(*partitions) if partitions else out).trigger(availableNow=True).start()


def latest_layers(stream: DataFrame, volume: str = "volume", layer: str = "layer", payload: str = "payload") -> DataFrame:
    """The highest layer of each volume so far; later layers refine earlier ones."""
    return stream.groupBy(volume).agg(F.max(layer).alias(layer), F.max_by(payload, layer).alias(payload))


def committed(references: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """A stream of references with whether each is stored; ``stored`` is a table that is read again with each batch."""
    have = stored.select(*keys).distinct().withColumn("__have", F.lit(True))
    return references.join(have, keys, "left").withColumn("committed", F.coalesce("__have", F.lit(False))).drop("__have")


def retry_queue(entries: DataFrame, failed: DataFrame, key: str, most: int = 3) -> DataFrame:
    """A queue after a round: failures count an attempt, and at ``most`` their state is failed; what succeeded goes."""
    bad = failed.select(key).distinct().withColumn("__bad", F.lit(True))
    counted = entries.join(bad, key).drop("__bad").withColumn("attempts", F.col("attempts") + 1)
    return counted.withColumn("state", F.when(F.col("attempts") >= most, "failed").otherwise("pending"))


def reset_failed(entries: DataFrame, key: str, wanted: str) -> DataFrame:
    """The entry is pending again, with no attempt counted."""
    hit = (F.col(key) == wanted) & (F.col("state") == "failed")
    return entries.withColumns({"attempts": F.when(hit, 0).otherwise(F.col("attempts")), "state": F.when(hit, "pending").otherwise(F.col("state"))})


_BREAKER = "key string, at double, allowed boolean, state string, failures int"


def _step(events: list[tuple[float, bool]], failures: int, opened: float | None, limit: int, reset_s: float) -> tuple[list[tuple[float, bool, str, int]], int, float | None]:
    out = []
    for at, ok in events:
        half = opened is not None and at - opened >= reset_s
        if opened is not None and not half:
            out.append((at, False, "open", failures))
            continue
        if ok:
            failures, opened, state = 0, None, "closed"
        else:
            # The count is kept while half open: one more failure opens it again.
            failures += 1
            opened = at if failures >= limit else None
            state = "open" if opened is not None else "closed"
        out.append((at, True, state, failures))
    return out, failures, opened


def circuit_breaker(stream: DataFrame, limit: int = 3, reset_s: float = 30.0) -> DataFrame:
    """Calls (key string, at double seconds, ok boolean) with whether a breaker per key let them through.

    ``limit`` failures in a row open it; after ``reset_s`` seconds calls pass again, and the next failure opens it at once. Works on streams,
    with the state of each key in the state store.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failures, opened = state.get if state.exists else (0, None)
        calls = sorted((float(a), bool(o)) for f in frames for a, o in zip(f["at"], f["ok"], strict=True))
        rows, failures, opened = _step(calls, failures, None if opened is None or opened < 0 else opened, limit, reset_s)
        state.update((failures, -1.0 if opened is None else opened))
        yield pd.DataFrame([(key[0], *r) for r in rows], columns=["key", "at", "allowed", "state", "failures"])

    return stream.groupBy("key").applyInPandasWithState(update, _BREAKER, "failures int, opened double", "append", GroupStateTimeout.NoTimeout)
