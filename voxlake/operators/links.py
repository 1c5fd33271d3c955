"""Join-shaped operators: label maps, commitments, value maps, private elements, references and record trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rounds import settled, ways_to_roots


def labelled_frames(segments: DataFrame, frames: DataFrame) -> DataFrame:
    """Frames of each segment with the segment's number wherever a mask is set; segments without frames are left out."""
    return segments.join(frames, "segment_number").withColumn("labels", F.transform("mask", lambda m: F.when(m != 0, F.col("segment_number")).otherwise(0)))


def commitment(references: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Each reference with ``committed``: whether an instance of its class and identifier is stored."""
    have = stored.select(*keys).distinct().withColumn("__have", F.lit(True))
    return references.join(have, keys, "left").withColumn("committed", F.coalesce("__have", F.lit(False))).drop("__have")


def commitment_status(requests: DataFrame, evaluated: DataFrame, transaction: str) -> DataFrame:
    """committed, partial or failed per transaction; one without references is committed."""
    s = evaluated.groupBy(transaction).agg(F.bool_and("committed").alias("all"), F.bool_or("committed").alias("any"))
    status = F.when(F.coalesce("all", F.lit(True)), "committed").when(F.col("any"), "partial").otherwise("failed")
    return requests.select(transaction).distinct().join(s, transaction, "left").select(transaction, status.alias("status"))


def value_map_for(pixels: DataFrame, maps: DataFrame, image: str = "image_id", stored: str = "stored", label: str | None = None) -> DataFrame:
    """Each pixel with the map that holds for it: one with the wanted label first, else the first whose range contains the value; without one the values are null.

    Pixels are matched to an image's list of maps, which is short; so no pair of a pixel and a map is a row.
    """
    listed = maps.groupBy(image).agg(F.array_sort(F.collect_list(F.struct("ord", "label", "first", "last", "slope", "intercept"))).alias("maps"))
    hit = lambda m: F.col(stored).between(m["first"], m["last"])
    wanted = F.filter("maps", lambda m: hit(m) & (m["label"] == label)) if label else F.array()
    joined = pixels.join(listed, image, "left").withColumn("map", F.coalesce(F.get(wanted, 0), F.get(F.filter("maps", hit), 0)) if label else F.get(F.filter("maps", hit), 0)).drop("maps")
    return joined.withColumn("physical", F.col(stored) * F.col("map.slope") + F.col("map.intercept"))


def with_private_creator(elements: DataFrame, creators: DataFrame, dataset: str) -> DataFrame:
    """Private elements with the creator that reserved their block: same group, block = upper byte of the element number."""
    e = elements.withColumns({"group": F.shiftrightunsigned("tag", 16), "block": F.shiftrightunsigned(F.col("tag").bitwiseAND(F.lit(0xFFFF)), 8)})
    c = creators.select(dataset, F.shiftrightunsigned("tag", 16).alias("group"), F.col("tag").bitwiseAND(F.lit(0xFF)).alias("block"), F.col("value").alias("creator"))
    return e.join(c, [dataset, "group", "block"])


def private_entries(elements: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Private elements with their entry of a dictionary, by creator in any case and lower byte."""
    key = lambda c: F.upper(F.trim(c))
    d = dictionary.select(key("creator").alias("__creator"), F.col("low_byte").alias("__low"), "vr", "name")
    e = elements.withColumns({"__creator": key("creator"), "__low": F.col("tag").bitwiseAND(F.lit(0xFF))})
    return e.join(d, ["__creator", "__low"], "left").drop("__creator", "__low")


def structures(rois: DataFrame, contours: DataFrame, observations: DataFrame) -> DataFrame:
    """Regions with their contours and observations, by number; regions without either stay."""
    return rois.join(contours, "roi_number", "left").join(observations, "roi_number", "left")


def key_references(evidence: DataFrame, content: DataFrame, keys: list[str]) -> DataFrame:
    """Evidence references, and content references that are not among them."""
    return evidence.select(*keys).unionByName(content.select(*keys).distinct().join(evidence.select(*keys), keys, "left_anti"))


#: Offsets whose records' ways are followed together within a task, and records at most; rows that are broadcast at most.
NEAR, CHUNK, MOST_BROADCAST = 1 << 20, 1 << 16, 500_000


def _followed(t: pa.Table) -> pa.Table:
    """Rows (directory, id, up, depth, parent) with their ways folded up to the first record that is not among them, or their root; those of cycles are left out."""
    n = t.num_rows
    d = t[0].combine_chunks()
    new = np.ones(n, bool)
    new[1:] = ~pc.fill_null(pc.equal(d[1:], d[:-1]), False).to_numpy(zero_copy_only=False)
    has = {c: t[c].is_valid().to_numpy() for c in ("id", "up", "parent")}
    id_, up, parent, depth = (t[c].cast(pa.int64()).fill_null(0).to_numpy().copy() for c in ("id", "up", "parent", "depth"))
    codes = np.unique(np.concatenate((id_, up)), return_inverse=True)[1].reshape(2, n) + np.cumsum(new) * 2 * n
    own = np.where(has["id"], codes[0], -1)
    order = np.argsort(own)
    at = order[np.minimum(np.searchsorted(own, codes[1], sorter=order), n - 1)]
    to = np.where(has["up"] & (own[at] == codes[1]), at, -1)
    for _ in range(n.bit_length() + 1):
        m = np.flatnonzero(to >= 0)
        if not len(m):
            break
        far = to[m]
        depth[m] += depth[far]
        parent[m], has["parent"][m] = np.where(has["parent"][m], parent[m], parent[far]), has["parent"][m] | has["parent"][far]
        up[m], has["up"][m] = up[far], has["up"][far]
        to[m] = to[far]
    kept = to < 0
    return pa.table([d, t["id"], pa.array(up, mask=~has["up"]), pa.array(depth.astype(np.int32)), pa.array(parent, mask=~has["parent"])], names=t.column_names).filter(pa.array(kept))


def _near_ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= CHUNK:
            yield from _followed(pa.Table.from_batches(held)).to_batches()
            held, n = [], 0
    if held:
        yield from _followed(pa.Table.from_batches(held)).to_batches()


def linked_records(spark, records: DataFrame, directory: str = "directory", parent: str = "offset") -> DataFrame:
    """Records of offset-linked directories that their root reaches, with depth and their parent, by its whole number ``parent``.

    Records: (directory, offset, next, lower, root). A record's next is its sibling, its lower its first child. Of several records
    that point to one the first in the file counts. Chains may have any length; records of a cycle that no root reaches are left
    out; an empty table gives an empty result.

    Ways among records that lie together are followed within a task. Where they leave it they meet few records, as a file's records mostly
    stand in the order of the tree; the rounds are over those alone.
    """
    pointers = F.array(F.struct(F.col("next").cast("bigint").alias("id"), (F.col("offset") * 2).cast("bigint").alias("up")), F.struct(F.col("lower").cast("bigint").alias("id"), (F.col("offset") * 2 + 1).cast("bigint").alias("up")))
    points = records.select(directory, F.col(parent).cast("bigint").alias("parent"), F.inline(pointers)).where("id > 0")
    # The first in the file, and of one record's links the next.
    first = points.groupBy(directory, "id").agg(F.min("up").alias("p"), F.min_by("parent", "up").alias("parent"))
    own = records.select(directory, F.col("offset").cast("bigint").alias("id"), F.coalesce("root", F.lit(False)).alias("root")).groupBy(directory, "id").agg(F.max("root").alias("root"))
    above = own.join(first, [directory, "id"], "left").where("root or p is not null")
    down = ~F.col("root") & (F.col("p") % 2 == 1)
    start = above.select(directory, "id", F.when(~F.col("root"), F.shiftright("p", 1)).alias("up"), F.when(down, 1).otherwise(0).alias("depth"), F.when(down, F.col("parent")).alias("parent"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = start.repartition(tasks, directory, F.floor(F.col("id") / NEAR)).sortWithinPartitions(directory, "id")
    short = settled(dealt.mapInArrow(_near_ways, start.schema))
    still = short.where("up is not null")
    met = settled(still.select(directory, F.col("up").alias("id")).distinct())
    small = F.broadcast if met.count() <= MOST_BROADCAST else lambda rows: rows
    ways = ways_to_roots(short.join(small(met), [directory, "id"], "left_semi"), [directory], {"depth": lambda near, far: near + far, "parent": lambda near, far: F.coalesce(near, far)})
    far = ways.select(directory, F.col("id").alias("up"), F.col("depth").alias("above"), F.col("parent").alias("farther"))
    reached = still.join(small(far), [directory, "up"]).select(directory, "id", (F.col("depth") + F.col("above")).alias("depth"), F.coalesce("parent", "farther").alias("parent"))
    reached = short.where("up is null").drop("up").unionByName(reached)
    kind = lambda c: records.schema[c].dataType
    return reached.select(directory, F.col("id").cast(kind("offset")).alias("offset"), "depth", F.col("parent").cast(kind(parent)).alias("parent"))


def content_tree(spark, items: DataFrame, doc: str = "doc", order: str = "ord") -> DataFrame:
    """Content items in pre-order with depth and path; items that no root reaches are left out. Trees may be of any depth."""
    own = F.lpad(F.col(order).cast("string"), 6, "0")
    start = items.select(doc, "id", F.col("parent").alias("up"), "parent", F.when(F.col("parent").isNull(), 0).otherwise(1).alias("depth"), own.alias("path"))
    ways = ways_to_roots(start, [doc], {"depth": lambda near, far: near + far, "path": lambda near, far: F.concat(far, F.lit("."), near), "parent": lambda near, _: near})
    return ways.select(doc, "id", "parent", "depth", "path")


def measurements(items: DataFrame) -> DataFrame:
    """Numeric content items with the first coordinates and the different sources among their children."""
    children = items.where(F.col("parent").isNotNull()).groupBy("doc", F.col("parent").alias("id")).agg(
        F.min_by("text", F.when(F.col("value_type") == "SCOORD", F.col("ord"))).alias("coordinates"), F.array_sort(F.collect_set(F.when(F.col("value_type") == "IMAGE", F.col("text")))).alias("sources")
    )
    return items.where("value_type = 'NUM'").select("doc", "id", "code", "num", "unit").join(children, ["doc", "id"], "left")
