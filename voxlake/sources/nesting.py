"""Element rows, with their values as bytes, to the bytes of nested data sets, in columns.

How long a sequence or item is follows from sums over what lies below it, at any depth, so that no level waits for another; where an
element begins is a running sum in the order of the file.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import encoding
from ..operators.rounds import BATCH_BYTES, settled
from ..operators.running import with_running_sums
from . import part10

#: Bytes of the head of an item and of a sequence; a file's preamble and mark.
ITEM, SEQUENCE, MARK = 8, 12, b"\0" * 128 + b"DICM"
#: Fixed value: uncompressed, explicit, least byte first.
EXPLICIT_LE = "1.2.840.10008.1.2.1"
#: Bytes of a number in values that are given as numbers.
FORMS = {"SB": 1, "UB": 1}
#: Files whose elements are taken out of a batch at once.
SLICE = 200


def place_key(path: Column) -> Column:
    """A path as a text whose order is the order in the file: item numbers are padded to ten digits."""
    return F.regexp_replace(F.regexp_replace(path, r"\[(\d+)\]", "[0000000000$1]"), r"\[0*(\d{10})\]", "[$1]")


def _above(path: Column, itself: bool) -> Column:
    """Sequences and items on the way to a path, outermost first; with itself, if it is one."""
    steps = F.split(path, "/")
    ways = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), "/"))
    both = F.flatten(F.transform(ways, lambda w: F.when(w.endswith("]"), F.array(F.regexp_replace(w, r"\[\d+\]$", ""), w)).otherwise(F.array(w))))
    return both if itself else F.filter(both, lambda w: w != path)


def nodes(rows: DataFrame, file: str = "file_path") -> DataFrame:
    """(file, path, key, bytes, size): each element with its value, and the heads of sequences and items with the lengths of what is below.

    ``rows``: file, path (``0040A730[2]/0040A160``), vr, value (bytes). Elements without a value, null, are left out; sequences and items
    that hold nothing have rows of their own, with vr ``SQ``, or null and a path that ends in ``]``. Other sequences and items need none.
    """
    rows = settled(rows)
    empty = F.coalesce(F.col("vr") == "SQ", F.col("path").endswith("]"))
    leaves = rows.where(~empty & F.col("value").isNotNull()).withColumn("value", encoding.padded(F.col("vr"), F.col("value")))
    leaves = leaves.select(file, "path", F.concat(encoding.head(F.substring_index("path", "/", -1), F.col("vr"), F.octet_length("value")), "value").alias("bytes"))
    held = leaves.select(file, F.explode(_above(F.col("path"), False)).alias("path"), F.octet_length("bytes").cast("bigint").alias("own"))
    held = held.unionByName(rows.where(empty).select(file, F.explode(_above(F.col("path"), True)).alias("path"), F.lit(0).cast("bigint").alias("own")))
    boxes = held.groupBy(file, "path").agg(F.sum("own").alias("own"))
    heads = boxes.select(file, F.explode(_above(F.col("path"), False)).alias("path"), F.when(F.col("path").endswith("]"), ITEM).otherwise(SEQUENCE).cast("bigint").alias("heads"))
    length = F.col("own") + F.coalesce("heads", F.lit(0))
    whole = boxes.join(heads.groupBy(file, "path").agg(F.sum("heads").alias("heads")), [file, "path"], "left")
    tag = F.substring_index("path", "/", -1)
    whole = whole.select(file, "path", F.when(F.col("path").endswith("]"), encoding.item_head(length)).otherwise(encoding.head(tag, F.lit("SQ"), length)).alias("bytes"))
    return leaves.unionByName(whole).select(file, "path", place_key(F.col("path")).alias("key"), "bytes", F.octet_length("bytes").cast("bigint").alias("size"))


def meta(sop_class: Column, sop_uid: Column) -> Column:
    """What stands before the data set: the mark, and the group that names the syntax and the instance."""
    element = encoding.element
    texts = (("00020002", sop_class), ("00020003", sop_uid), ("00020010", F.lit(EXPLICIT_LE)))
    group = F.concat(element("00020001", "OB", F.lit(b"\0\1")), *(element(tag, "UI", encoding.texts(F.coalesce(value, F.lit("")))) for tag, value in texts))
    return F.concat(F.lit(MARK), element("00020000", "UL", encoding.number(F.octet_length(group), 4)), group)


def with_offsets(tree: DataFrame, heads: DataFrame, file: str = "file_path") -> DataFrame:
    """``offset``: where in its file each node begins. ``heads``: (file, head), what stands before the data set."""
    before = heads.select(file, F.octet_length("head").cast("bigint").alias("__head"))
    return with_running_sums(settled(tree), [file], ["key"], {"offset": "size"}).join(before, file).withColumn("offset", F.col("offset") + F.col("__head")).drop("__head")


def files(tree: DataFrame, heads: DataFrame, file: str = "file_path") -> DataFrame:
    """(file, content): a file's nodes in order after its head. The nodes of a file meet in one task, which holds them three times over."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("key", "bytes"))), lambda n: n["bytes"])
    bodies = tree.groupBy(file).agg(encoding.joined(parts).alias("body"))
    return heads.join(bodies, file, "left").select(file, F.concat("head", F.coalesce("body", F.lit(b""))).alias("content"))


def pieces(rows: DataFrame, file: str = "file_path") -> DataFrame:
    """(file, piece, offset, content): the bytes of rows (file, piece, n, offset, bytes) one after the other in the order of n, which goes up from piece to piece of a
    file. Only a piece's rows meet in a task, and one piece is held at once."""
    # By a number of partitions, as few bytes may be much work.
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(file, "piece", "n", "offset", "bytes").repartition(tasks, file, "piece").sortWithinPartitions(file, "piece", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, parts, done, size = None, [], [], 0

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.binary()))], [file, "piece", "offset", "content"])

        last = (-1, -1)
        for batch in batches:
            if not batch.num_rows:
                continue
            piece, n = (batch[c].to_numpy() for c in ("piece", "n"))
            # Of two files that meet at pieces of one number, the second begins at a number that the first one's piece has or has behind it.
            new = (piece != np.concatenate(([last[0]], piece[:-1]))) | (n <= np.concatenate(([last[1]], n[:-1])))
            new[0] |= begun is None
            last = int(piece[-1]), int(n[-1])
            held = batch["bytes"].cast(pa.binary())
            ends, data = np.frombuffer(held.buffers()[1], np.int32)[held.offset : held.offset + len(held) + 1], memoryview(held.buffers()[2] or b"")
            starts = sorted({0, *np.flatnonzero(new).tolist()})
            for at, to in zip(starts, [*starts[1:], len(n)], strict=True):
                if new[at]:
                    if begun is not None:
                        done.append((*begun, b"".join(parts)))
                        size += len(done[-1][3])
                    begun, parts = (batch[file][at].as_py(), int(piece[at]), batch["offset"][at].as_py()), []
                parts.append(bytes(data[ends[at] : ends[to]]))
                if size >= BATCH_BYTES:
                    yield made()
                    done, size = [], 0
        if begun is not None:
            done.append((*begun, b"".join(parts)))
            yield made()

    return dealt.mapInArrow(run, f"{file} string, piece bigint, offset bigint, content binary")


def joined_pieces(rows: DataFrame, file: str = "file_path") -> DataFrame:
    """(file, content) of pieces; each file is one value."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("offset", "content"))), lambda n: n["content"])
    return rows.groupBy(file).agg(encoding.joined(parts).alias("content"))


def _nested(elements: list[tuple]) -> list[tuple[int, str, object]]:
    """(tag, representation, value) lists, one for each item, by the paths of elements (path, vr, value); those of an item in any order."""
    root: dict[int, list] = {}
    for path, representation, value in elements:
        node, steps = root, path.split("/")
        empty = representation == "SQ" or steps[-1].endswith("]")
        for step in steps if empty else steps[:-1]:
            items = node.setdefault(int(step[:8], 16), ["SQ", {}])[1]
            if step.endswith("]"):
                node = items.setdefault(int(step[9:-1]), {})
        if not empty:
            node[int(steps[-1], 16)] = [representation, value]

    def listed(node: dict[int, list]) -> list[tuple[int, str, object]]:
        return [(tag, vr, [listed(v[i]) for i in sorted(v)] if vr == "SQ" else v) for tag, (vr, v) in sorted(node.items())]

    return listed(root)


def _packed(value: bytes, form: str) -> bytes:
    """Numbers, given as texts with blanks between, as ``encoding.numbers`` writes them."""
    texts = value.decode().split()
    if form == "FL":
        # Zero below zero is written as zero.
        return struct.pack(f"<{len(texts)}f", *(float(t) or 0.0 for t in texts))
    if form == "AT":
        return b"".join(struct.pack("<HH", int(t) >> 16 & 0xFFFF, int(t) & 0xFFFF) for t in texts)
    width = FORMS.get(form) or encoding.WIDTH[form]
    return b"".join((int(t) & (1 << 8 * width) - 1).to_bytes(width, "little") for t in texts)


def _head(sop_class: str | None, sop_uid: str | None) -> bytes:
    """What ``meta`` gives."""
    group = part10._encode([(0x00020001, "OB", b"\0\1"), (0x00020002, "UI", sop_class or ""), (0x00020003, "UI", sop_uid or ""), (0x00020010, "UI", EXPLICIT_LE)], True, "<")
    return MARK + part10._encode([(0x00020000, "UL", [len(group)])], True, "<") + group


def whole_files(rows: DataFrame, documents: DataFrame, file: str = "file_path") -> DataFrame:
    """(file, content): the files that ``files(nodes(rows), heads)`` gives with heads by ``meta``, out of each file's elements at once, in one shuffle.

    ``documents``: file, sop_class, sop_uid.

    ``rows`` as for ``nodes``, or ``building``'s lists. For files whose elements fit a task; of larger
    ones ``nodes`` spreads the elements over tasks.
    """
    if "names" not in rows.columns:
        rows = rows.select(file, F.col("path").alias("before"), F.concat(F.lit(":"), F.coalesce("vr", F.lit("")), F.lit(":")).alias("names"), F.array("value").alias("values"))
    # By a number of partitions, as few bytes may be much work.
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    gathered = rows.repartition(tasks, file).groupBy(file).agg(F.collect_list(F.struct("before", "names", "values")).alias("elements"))
    grouped = documents.select(file, "sop_class", "sop_uid").repartition(tasks, file).join(gathered, file, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[list[str]]] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                held = part["elements"].flatten()
                lists = zip(*(held.field(c).to_pylist() for c in ("before", "names", "values")), strict=True)
                counts = [n or 0 for n in part["elements"].value_lengths().to_pylist()]
                contents = []
                for sop_class, sop_uid, count in zip(part["sop_class"].to_pylist(), part["sop_uid"].to_pylist(), counts, strict=True):
                    kept = []
                    for before, names, values in islice(lists, count):
                        if names not in known:
                            known[names] = [name.split(":") for name in names.split(" ")]
                        for (tag, vr, form), value in zip(known[names], values, strict=True):
                            if value is not None or vr == "SQ" or not vr:
                                kept.append((before + tag, vr, _packed(value, form) if form else value))
                    contents.append(_head(sop_class, sop_uid) + part10._encode(_nested(kept), True, "<"))
                yield pa.RecordBatch.from_arrays([part[file], pa.array(contents, pa.binary())], [file, "content"])

    return grouped.select(file, "sop_class", "sop_uid", "elements").mapInArrow(run, f"{file} string, content binary")
