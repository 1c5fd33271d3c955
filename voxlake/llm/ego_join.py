"""Embedding near-dedup by an epsilon grid order join.

Unit vectors with cosine c stand sqrt(2 - 2c) apart. They are turned to their principal axes, which keeps distances, sorted by the
cells of a grid of that width on the leading axes, and cut into intervals of the sequence. Two intervals whose boxes stand further
apart than that hold no link. What is left is joined recursively: intervals are halved, and halves that are provably
distant are skipped, down to small leaves, where the leading axes reject most pairs before the whole vectors are multiplied.
The axes steer what is skipped; whether a pair links is decided by the product of the unturned unit vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed
from .components import connected_components

#: Vectors that the principal axes are fitted on (the axes steer the speed alone), leading axes of the grid, axes of the boxes.
FIT, GRID, AXES = 4096, 4, 16
#: Vectors of an interval and of a leaf, and partners that one task holds an interval against.
INTERVAL, LEAF, PARTNERS = 4096, 128, 16


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column whose values have one length."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def unit_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, unit) of vectors that are not null, not zero and hold only finite numbers. Squares of components scaled by the largest neither overflow nor vanish."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    good = F.col(vector_col).isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull()).where(good).select(F.col(id_col).cast("bigint").alias("id"), v.alias("v"), F.array_max(F.transform(v, F.abs)).alias("most")).where("most > 0")
    scaled = rows.select("id", F.transform("v", lambda x: x / F.col("most")).alias("v"))
    scaled = scaled.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))
    return scaled.select("id", F.transform("v", lambda x: x / F.col("norm")).alias("unit"))


def principal_axes(units: DataFrame, n: int = FIT) -> np.ndarray:
    """The ``AXES`` leading orthonormal axes, one per column, in descending order of variance, of the ``n`` vectors with the smallest hashes of their ids; of the commonest length among them."""
    some = units.orderBy(F.xxhash64("id"), "id").limit(n).toArrow()["unit"].combine_chunks()
    if not len(some):
        return np.eye(1)
    sizes = np.diff(some.offsets.to_numpy())
    size = np.bincount(sizes).argmax()
    x = _matrix(some.filter(pa.array(sizes == size)))
    if len(x) < 2 or size < 2:
        return np.eye(size)[:, :AXES]
    return np.ascontiguousarray(np.linalg.eigh(np.cov(x.T))[1][:, ::-1][:, :AXES])


def leading(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Coordinates on the leading axes; vectors of another length than the axes keep their own first coordinates. Padded to ``AXES``."""
    lead = x @ axes if x.shape[1] == axes.shape[0] else x[:, :AXES]
    return np.pad(lead, ((0, 0), (0, AXES - lead.shape[1])))


def _cells(axes: np.ndarray, width: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch["unit"].offsets.to_numpy())
            for size in np.unique(sizes):
                some = batch.filter(pa.array(sizes == size))
                cell = np.floor(leading(_matrix(some["unit"]), axes)[:, :GRID] / width).astype(np.int32)
                yield pa.RecordBatch.from_arrays([some["id"], some["copies"], some["unit"], pa.array(np.full(len(cell), size), pa.int32()), pa.array(list(cell), pa.list_(pa.int32()))], ["id", "copies", "unit", "size", "cell"])

    return run


def _intervals(axes: np.ndarray):
    """Sorted rows to intervals of the sequence, of one length of vectors each: ids, copies and vectors packed, with the box around them on the leading axes."""

    def run(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def pack() -> pa.RecordBatch:
            ids, copies, x = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            lead = leading(x, axes)
            values = [int(ids.min()), x.shape[1], ids.tobytes(), copies.tobytes(), x.tobytes(), lead.min(0), lead.max(0)]
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64()))
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], ["part", "size", "ids", "copies", "rows", "low", "high"])

        for batch in iterator:
            sizes = batch["size"].to_numpy(zero_copy_only=False)
            at = 0
            while at < batch.num_rows:
                if held and held[-1][2].shape[1] != sizes[at]:
                    yield pack()
                room = INTERVAL - sum(len(h[0]) for h in held)
                piece = batch.slice(at, min(room, int((sizes[at:] == sizes[at]).sum())))
                held.append((piece["id"].to_numpy(zero_copy_only=False).astype(np.int64), piece["copies"].to_numpy(zero_copy_only=False).astype(np.int64), _matrix(piece["unit"])))
                at += piece.num_rows
                if piece.num_rows == room:
                    yield pack()
        if held:
            yield pack()

    return run


def join_intervals(x: np.ndarray, y: np.ndarray, same: bool, cosine: float, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of all pairs with that cosine or more; i < j where both are the same interval."""
    reach = 2 - 2 * cosine + 1e-9
    found: list[tuple[np.ndarray, np.ndarray]] = []
    lead, lead2 = leading(x, axes), leading(y, axes)

    def apart(a: np.ndarray, b: np.ndarray) -> bool:
        gap = np.maximum(0, np.maximum(a.min(0) - b.max(0), b.min(0) - a.max(0)))
        return float(gap @ gap) > reach

    def walk(a0: int, a1: int, b0: int, b1: int) -> None:
        if same and b1 <= a0:
            return
        a, b = lead[a0:a1], lead2[b0:b1]
        if not (same and a0 == b0) and apart(a, b):
            return
        if a1 - a0 > LEAF or b1 - b0 > LEAF:
            halves = lambda p, q: [(p, q)] if q - p <= LEAF else [(p, (p + q) // 2), ((p + q) // 2, q)]
            for p, q in halves(a0, a1):
                for r, s in halves(b0, b1):
                    walk(p, q, r, s)
            return
        i, j = np.nonzero((a**2).sum(1)[:, None] + (b**2).sum(1) - 2 * (a @ b.T) <= reach)
        if len(i):
            i, j = i + a0, j + b0
            hit = np.einsum("ij,ij->i", x[i], y[j]) >= cosine
            i, j = i[hit], j[hit]
            if same:
                i, j = i[i < j], j[i < j]
            found.append((i, j))

    walk(0, len(x), 0, len(y))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _spanning(i: np.ndarray, j: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """Links between ids that connect what all links of this pair of intervals connect: at most one for each id."""
    root: dict[int, int] = {}

    def find(n: int) -> int:
        while root.setdefault(n, n) != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    left, right = [], []
    for p, q in zip(a[i].tolist(), b[j].tolist(), strict=True):
        r, s = find(p), find(q)
        if r != s:
            root[max(r, s)] = min(r, s)
            left.append(p)
            right.append(q)
    return left, right


def _join(cosine: float, axes: np.ndarray):
    """Streams an interval and then its partners; for each pair gives the number of links of every id and links that span their components."""

    def matched(own: dict, other: dict) -> pa.RecordBatch | None:
        i, j = join_intervals(own["x"], other["x"], own is other, cosine, axes)
        if not len(i):
            return None
        a, b = own["ids"], other["ids"]
        who, place = np.unique(np.concatenate((a[i], b[j])), return_inverse=True)
        times = np.bincount(place, np.concatenate((other["copies"][j], own["copies"][i])), len(who)).astype(np.int64)
        left, right = _spanning(i, j, a, b)
        return pa.RecordBatch.from_arrays([pa.array([*who.tolist(), *left], pa.int64()), pa.array([*([None] * len(who)), *right], pa.int64()), pa.array([*times.tolist(), *([0] * len(left))], pa.int64())], ["a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict = {}
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch[c][k].as_py() for c in ("part", "other")}
                if row["other"] is None or row["other"] != row["part"]:
                    ids, copies, x = (np.frombuffer(batch[c][k].as_py(), kind) for c, kind in (("ids", np.int64), ("copies", np.int64), ("rows", np.float64)))
                    row |= {"ids": ids, "copies": copies, "x": x.reshape(len(ids), -1)}
                if row["other"] is None:
                    own = row
                    continue
                out = matched(own, own if row["other"] == own["part"] else row)
                if out is not None:
                    yield out

    return run


def near_intervals(parts: DataFrame, width: float, reach: float) -> DataFrame:
    """(part, other), part <= other, of intervals whose boxes stand no further apart than ``reach`` squared. They meet in the grid's cells on all its axes."""
    boxes = parts.select("part", "size", "low", "high", *(F.floor(F.get(side, k) / width).alias(f"{name}{k}") for k in range(GRID) for side, name in (("low", "from"), ("high", "to"))))
    for k in range(GRID):
        boxes = boxes.withColumn(f"cell{k}", F.explode(F.sequence(F.col(f"from{k}"), F.col(f"to{k}") + 1)))
    keys = ["size", *(f"cell{k}" for k in range(GRID))]
    right = boxes.select(*keys, F.col("part").alias("other"), F.col("low").alias("low2"), F.col("high").alias("high2"), *(F.col(f"from{k}").alias(f"from2{k}") for k in range(GRID)))
    apart = F.zip_with(F.zip_with("low2", "high", lambda p, q: p - q), F.zip_with("low", "high2", lambda p, q: p - q), lambda p, q: F.greatest(p, q, F.lit(0.0)))
    gap = F.aggregate(apart, F.lit(0.0), lambda s, x: s + x * x)
    first = " and ".join(f"cell{k} = greatest(from{k}, from2{k})" for k in range(GRID))
    return boxes.join(right, keys).where("part <= other").where(first).where(gap <= reach).select("part", "other")


def ego_join(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    Two vectors link when their cosine in double precision is ``cosine`` or more, whatever their other columns; ``component_id`` is the
    smallest id that links reach. Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, and
    vectors of different lengths do not link. Rows with a null id are dropped; rows that repeat an id count as one, the first by
    value. An empty table gives an empty result.

    Equal unit vectors are one member with a number of copies, so a vector that a third of the rows hold is compared once.
    """
    named = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v"))
    if named.groupBy("id").count().where("count > 1").limit(1).count():
        named = named.groupBy("id").agg(F.min("v").alias("v"))
    # Equal vectors are told by two 64-bit hashes; vectors that differ in the sign of a zero alone stay two members, and link.
    units = checkpointed(unit_vectors(named, "id", "v").withColumns({"d0": F.xxhash64(F.lit(0), "unit"), "d1": F.xxhash64(F.lit(1), "unit")}))
    classes = units.groupBy("d0", "d1").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    members = checkpointed(units.select("id", "d0", "d1").join(classes, ["d0", "d1"]).select("id", "rep", "copies"))
    distinct = checkpointed(units.select("id", "unit").join(members.where("id = rep").select("id", "copies"), "id").select("id", "copies", "unit"))
    axes = principal_axes(distinct)
    width, reach = float(np.sqrt(2 - 2 * cosine)), 2 - 2 * cosine + 1e-9
    cells = distinct.mapInArrow(_cells(axes, width), "id bigint, copies bigint, unit array<double>, size int, cell array<int>")
    sequence = cells.repartitionByRange("size", "cell", "id").sortWithinPartitions("size", "cell", "id")
    parts = checkpointed(sequence.mapInArrow(_intervals(axes), "part bigint, size int, ids binary, copies binary, rows binary, low array<double>, high array<double>"))
    # An interval goes to each of its groups of partners once, and to each interval that it is a partner of.
    near = checkpointed(near_intervals(parts, width, reach))
    groups = near.groupBy("part").agg(F.ceil(F.count("*") / PARTNERS).alias("groups"))
    dealt = near.join(groups, "part").withColumn("group", F.pmod(F.xxhash64("other"), F.col("groups")))
    packed = parts.select("part", "ids", "copies", "rows")
    owners = dealt.select("part", "group").distinct().join(packed, "part").select("part", "group", F.lit(None).cast("bigint").alias("other"), "ids", "copies", "rows")
    empty = [F.when(F.col("other") != F.col("owner"), F.col(c)).otherwise(F.lit(b"")).alias(c) for c in ("ids", "copies", "rows")]
    partners = dealt.select(F.col("part").alias("owner"), "group", "other").join(packed.withColumnRenamed("part", "other"), "other").select(F.col("owner").alias("part"), "group", "other", *empty)
    rows = owners.unionByName(partners).repartition("part", "group").sortWithinPartitions("part", "group", F.asc_nulls_first("other"))
    met = checkpointed(rows.mapInArrow(_join(cosine, axes), "a bigint, b bigint, n bigint"))
    counts = met.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    reached = connected_components(met.where("b is not null").select("a", "b")).withColumnRenamed("id", "rep")
    answers = members.join(counts, "rep", "left").join(reached, "rep", "left")
    answers = answers.select("id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = named.select("id").join(answers, "id", "left").select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
