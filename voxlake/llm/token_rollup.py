"""Token counts as rollups that signed deltas maintain.

A batch holds changes of documents' token counts: inserts, deletes and revisions. It becomes signed rows (an insert +, a delete -, a revision
both), which are summed by source, language and tokenizer version and committed under the batch's name. Totals are the sums
over all committed batches, so batches may arrive in any order, and a batch that is committed again changes nothing. Where two
writers commit a batch at once, both their folders may be in place for a while; every reader counts the first writer's alone.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_or_empty

KEYS = ["source", "lang", "tokenizer"]
MEASURES = ["docs", "tokens"]
MISSING = "(none)"

_COMMITTED = "source string, lang string, tokenizer string, docs bigint, tokens bigint, batch_id string, writer string"


def signed(changes: DataFrame) -> DataFrame:
    """Changes (op, source, lang, tokenizer, tokens, old_source, old_lang, old_tokenizer, old_tokens) to sums by key.

    ``op`` is insert, delete or revise; a delete names what goes in the ``old_`` columns, a revision both sides. Other operations are refused. Null keys count
    as ``(none)``, null counts as 0.
    """
    op = F.when(F.col("op").isin("insert", "delete", "revise"), F.col("op")).otherwise(F.raise_error(F.concat(F.lit("unknown operation: "), F.coalesce("op", F.lit("null")))))

    def side(prefix: str, sign: int) -> Column:
        return F.struct(*(F.coalesce(F.col(f"{prefix}{k}").cast("string"), F.lit(MISSING)).alias(k) for k in KEYS), F.lit(sign).cast("bigint").alias("docs"), (F.coalesce(F.col(f"{prefix}tokens"), F.lit(0)) * sign).cast("bigint").alias("tokens"))

    sides = F.when(op == "insert", F.array(side("", 1))).when(op == "delete", F.array(side("old_", -1))).otherwise(F.array(side("old_", -1), side("", 1)))
    return changes.select(F.explode(sides).alias("s")).select("s.*").groupBy(*KEYS).agg(*(F.sum(m).cast("bigint").alias(m) for m in MEASURES))


class TokenRollup:
    """A rollup table in a shared folder: one folder of summed deltas for each committed batch."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _files(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _writers(self, batch_id: str) -> list[str]:
        fs, where = self._files(f"{self.path}/batch_id={batch_id}")
        return sorted(f.getPath().getName().removeprefix("writer=") for f in fs.listStatus(where)) if fs.exists(where) else []

    def committed(self, batch_id: str) -> bool:
        return bool(self._writers(batch_id))

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Add a batch, unless it is there already; whether it was added.

        The sums are written aside and moved into the batch's folder by one rename, to a name that no other writer has. Of writers
        that do so at once the first by time and name counts, and the others take theirs away again. A writer that is lost before the
        rename leaves nothing that counts, one that is lost after it leaves what counts once.
        """
        if not batch_id or not all(c.isalnum() or c in "-_" for c in batch_id):
            raise ValueError("a batch id holds letters, digits, - and _")
        if self.committed(batch_id):
            return False
        writer = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
        aside = f"{self.path}/_aside/{batch_id}-{writer}"
        signed(changes).write.parquet(aside)
        return self._settle(batch_id, writer, aside)

    def _settle(self, batch_id: str, writer: str, aside: str) -> bool:
        fs, source = self._files(aside)
        _, batch = self._files(f"{self.path}/batch_id={batch_id}")
        _, target = self._files(f"{self.path}/batch_id={batch_id}/writer={writer}")
        fs.mkdirs(batch)
        if not fs.rename(source, target):
            raise OSError(f"{aside} can't be moved")
        if self._writers(batch_id)[0] == writer:
            return True
        fs.delete(target, True)
        return False

    def deltas(self) -> DataFrame:
        """The rows of all batches, of the first writer of each."""
        fs, where = self._files(self.path)
        if not fs.exists(where) or not any(s.getPath().getName().startswith("batch_id=") for s in fs.listStatus(where)):
            return self.spark.createDataFrame([], _COMMITTED)
        rows = self.spark.read.schema(_COMMITTED).parquet(self.path)
        return rows.join(rows.groupBy("batch_id").agg(F.min("writer").alias("writer")), ["batch_id", "writer"])

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens) of keys that are not zero."""
        sums = self.deltas().groupBy(*KEYS).agg(*(F.sum(m).cast("bigint").alias(m) for m in MEASURES))
        return sums.where("docs <> 0 or tokens <> 0")

    def check(self) -> None:
        """Refuses totals below zero: then a delete or revision has no insert."""
        if self.totals().where("docs < 0 or tokens < 0").limit(1).count():
            raise ValueError("a key has fewer than no documents or tokens")


def count_words(text_col: str = "text") -> Column:
    """Runs of characters other than ``[\\x20\\x09-\\x0D]``."""
    return F.regexp_count(text_or_empty(text_col), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def count_pieces(text_col: str = "text") -> Column:
    """Runs of letters, of digits, and single other signs."""
    return F.regexp_count(text_or_empty(text_col), F.lit(r"[A-Za-z]+|[0-9]+|[^\x20\x09-\x0DA-Za-z0-9]")).cast("bigint")


def inserts(docs: DataFrame, tokenizer: str, tokens: Column, source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """Changes that add documents."""
    return _changes(docs, "insert", new=(source_col, lang_col, tokenizer, tokens))


def deletes(docs: DataFrame, tokenizer: str, tokens: Column, source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """Changes that take documents out."""
    return _changes(docs, "delete", old=(source_col, lang_col, tokenizer, tokens))


def revisions(docs: DataFrame, old: tuple[str, Column], new: tuple[str, Column], source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """Changes of documents' counts from one (tokenizer, count) to another."""
    return _changes(docs, "revise", new=(source_col, lang_col, *new), old=(source_col, lang_col, *old))


def _changes(docs: DataFrame, op: str, new: tuple | None = None, old: tuple | None = None) -> DataFrame:
    columns = [F.lit(op).alias("op")]
    for prefix, side in (("", new), ("old_", old)):
        source, lang, tokenizer, tokens = side or (None, None, None, None)
        columns += [(F.col(source) if source else F.lit(None)).cast("string").alias(f"{prefix}source"), (F.col(lang) if lang else F.lit(None)).cast("string").alias(f"{prefix}lang"), F.lit(tokenizer).cast("string").alias(f"{prefix}tokenizer"), (tokens if tokens is not None else F.lit(None)).cast("bigint").alias(f"{prefix}tokens")]
    return docs.select(columns)
