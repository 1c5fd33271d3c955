"""A store of instances that batches are added to as wholes.

Each task writes what it has to files of its own and tells their names; publishing a batch is one move of the list of those files to the
batch's name. Readers see the files of published lists alone, so a lost or repeated task leaves nothing behind that counts, and a batch
that is sent again is not added again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from . import remote

#: Columns of the store; bytes of a task's file after which it begins another.
SCHEMA = "study_uid string, series_uid string, sop_uid string, sop_class string, content binary"
FILE_BYTES = 256 << 20


@dataclass
class Written(WriterCommitMessage):
    """Files of a task, and how many rows they hold; rows without an instance are not stored."""

    files: list[str]
    stored: int
    failed: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, folder: str, batch: str):
        self.folder, self.batch = folder, batch

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = pyarrow.fs.FileSystem.from_uri(self.folder)
        fs.create_dir(f"{root}/data", recursive=True)
        files: list[str] = []
        file, size, stored, failed = None, 0, 0, 0
        try:
            for batch in iterator:
                kept = batch.filter(pc.fill_null(pc.greater(pc.utf8_length(batch["sop_uid"]), 0), False))
                stored, failed = stored + kept.num_rows, failed + batch.num_rows - kept.num_rows
                if not kept.num_rows:
                    continue
                if file is None:
                    files.append(f"{uuid.uuid4().hex}.parquet")
                    file, size = pq.ParquetWriter(f"{root}/data/{files[-1]}", kept.schema, filesystem=fs), 0
                file.write_batch(kept)
                size += kept.nbytes
                if size >= FILE_BYTES:
                    file.close()
                    file = None
        finally:
            if file is not None:
                file.close()
        return Written(files, stored, failed)

    def commit(self, messages: list[Written | None]) -> None:
        """Publishes the batch, unless it is published: then what was written again goes."""
        done = [m for m in messages if m is not None]
        if is_published(self.folder, self.batch):
            return self.abort(messages)
        told = {"batch": self.batch, "order": len(remote.names(f"{self.folder}/published")), "files": [f for m in done for f in m.files], "stored": sum(m.stored for m in done), "failed": sum(m.failed for m in done)}
        remote.write(f"{self.folder}/published/{self.batch}.json", json.dumps(told).encode())

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            for f in m.files if m is not None else ():
                remote.delete(f"{self.folder}/data/{f}")


def is_published(folder: str, batch: str) -> bool:
    return remote.read(f"{remote.addressed(folder)}/published/{batch}.json") is not None


def store_target(name: str, folder: str) -> type[DataSource]:
    """A data source to write to, registered under ``name``: ``df.write.format(name).option("batch", ...).mode("append").save()``.

    ``df`` has the columns of ``SCHEMA``. A batch's name must be fit for a file.
    """
    folder = remote.addressed(folder)

    class StoreTarget(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
            if overwrite:
                raise ValueError("the store is only appended to")
            if not self.options.get("batch"):
                raise ValueError("a batch needs a name")
            return _Writer(folder, self.options["batch"])

    return StoreTarget


def batches(spark: SparkSession, folder: str) -> DataFrame:
    """(batch, order, files, stored, failed) of what is published."""
    kinds = "batch string, order bigint, files array<string>, stored bigint, failed bigint"
    folder = remote.addressed(folder)
    if not remote.names(f"{folder}/published"):
        return spark.createDataFrame([], kinds)
    return spark.read.schema(kinds).json(f"{folder}/published")


def instances(spark: SparkSession, folder: str) -> DataFrame:
    """The instances of published batches: of each identifier the one of the latest batch, within it of the greatest content digest.

    The names of published files go through the driver, as those of any table's do."""
    folder = remote.addressed(folder)
    listed = batches(spark, folder).select("batch", "order", F.explode("files").alias("file"))
    paths = [f"{folder}/data/{r.file}" for r in listed.select("file").collect()]
    if not paths:
        return spark.createDataFrame([], SCHEMA)
    rows = spark.read.schema(SCHEMA).parquet(*paths).withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    names = StructType.fromDDL(SCHEMA).fieldNames()
    # Only keys are compared; contents are looked up once for what stays.
    seen = rows.join(listed, "file")
    last = seen.groupBy("sop_uid").agg(F.max(F.struct("order", "batch", F.sha2("content", 256).alias("digest"))).alias("k"))
    kept = seen.withColumn("k", F.struct("order", "batch", F.sha2("content", 256).alias("digest"))).join(last, ["sop_uid", "k"]).dropDuplicates(["sop_uid"])
    return kept.select(names)
