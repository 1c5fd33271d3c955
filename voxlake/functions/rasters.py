"""Neighbourhoods, drawing and packed masks on frames that stay arrays or bytes: no row for each pixel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decoding import bound


#: The weights of the smoothing along each side, and the strength up to which nothing is smoothed.
WEIGHTS, LEAST_STRENGTH = (1, 2, 1), 0.1


# Neighbourhoods


def _along(values: Column, columns: Column, rows: Column, across: bool) -> Column:
    """Weighted sums of each value and its two neighbours in its row, or in its column; edges are repeated."""
    left, middle, right = WEIGHTS

    def one(v: Column, i: Column) -> Column:
        place = i % columns if across else F.floor(i / columns).cast("int")
        last, step = (columns - 1, F.lit(1)) if across else (rows - 1, columns)
        before, after = F.when(place > 0, i - step).otherwise(i), F.when(place < last, i + step).otherwise(i)
        return left * F.get(values, before) + middle * v + right * F.get(values, after)

    return F.transform(values, one)


def smoothed(pixels: Column, columns: Column) -> Column:
    """The 3 x 3 smoothing (1 2 1) x (1 2 1) / 16 of bytes, in whole numbers: one pass along the rows, one along the columns."""
    rows = F.floor(F.size(pixels) / columns).cast("int")
    both = bound(_along(pixels, columns, rows, True), lambda sums: _along(sums, columns, rows, False))
    return F.transform(both, lambda v: F.floor(v / sum(WEIGHTS) ** 2).cast("int"))


def denoised(pixels: Column, columns: Column, strength: Column) -> Column:
    """Bytes blended with their smoothing; the strength is held between 0 and 1, and nothing happens up to ``LEAST_STRENGTH``.

    Null where the pixels do not fill rows.
    """
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), strength))
    blend = F.zip_with(pixels, smoothed(pixels, columns), lambda p, s: F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), p + share * (s - p)))).cast("int"))
    whole = (columns > 0) & (F.size(pixels) % columns == 0)
    return F.when(whole, F.when(share > LEAST_STRENGTH, blend).otherwise(pixels.cast("array<int>")))


# Drawing


def _point(v: Column, side: Column) -> Column:
    """A share of an image's side as a pixel."""
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) * F.greatest(side - 1, F.lit(0)) + 0.5).cast("int")


def line_points(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The pixels of a line as an array of (x, y): one for each step along its longer side, the other side rounded towards the end."""
    dx, dy = F.abs(x1 - x0), F.abs(y1 - y0)
    long, short = F.greatest(dx, dy), F.least(dx, dy)
    along = lambda j: F.when(long > 0, F.floor((2 * j * short + long) / (2 * F.greatest(long, F.lit(1))))).otherwise(0).cast("int")
    sign = lambda a, b: F.when(a < b, 1).otherwise(-1)
    step = lambda j: F.struct((x0 + sign(x0, x1) * F.when(dx >= dy, j).otherwise(along(j))).alias("x"), (y0 + sign(y0, y1) * F.when(dx >= dy, along(j)).otherwise(j)).alias("y"))
    return F.transform(F.sequence(F.lit(0), long), step)


def touched(overlays: DataFrame) -> DataFrame:
    """(image_id, layer, offset, times): how often the brush of each overlay meets each pixel.

    ``overlays``: image_id, layer (their order), kind (``line`` or ``rectangle``), x0, y0, x1, y1 as shares of the image's sides (of rectangles two corners), thickness,
    columns, rows. A rectangle is four lines; at corners, and where a brush overlaps itself, a pixel is met more than once.
    """
    x0, x1 = _point(F.col("x0"), F.col("columns")), _point(F.col("x1"), F.col("columns"))
    y0, y1 = _point(F.col("y0"), F.col("rows")), _point(F.col("y1"), F.col("rows"))
    line = F.array(F.struct(x0.alias("a"), y0.alias("b"), x1.alias("c"), y1.alias("d")))
    corners = ((x0, y0), (x1, y0), (x1, y1), (x0, y1))
    sides = F.array(*(F.struct(p[0].alias("a"), p[1].alias("b"), q[0].alias("c"), q[1].alias("d")) for p, q in zip(corners, (*corners[1:], corners[0]), strict=True)))
    drawn = overlays.select("image_id", "layer", "columns", "rows", F.greatest(F.lit(1), "thickness").alias("t"), F.explode(F.when(F.col("kind") == "rectangle", sides).otherwise(line)).alias("s"))
    points = drawn.select("image_id", "layer", "columns", "rows", "t", F.explode(line_points(F.col("s.a"), F.col("s.b"), F.col("s.c"), F.col("s.d"))).alias("p"))
    low = -F.floor(F.col("t") / 2).cast("int")
    reach = F.sequence(low, low + F.col("t") - 1)
    brush = points.withColumn("right", F.explode(reach)).withColumn("down", F.explode(reach)).withColumns({"x": F.col("p.x") + F.col("right"), "y": F.col("p.y") + F.col("down")})
    inside = brush.where("x >= 0 and x < columns and y >= 0 and y < rows")
    return inside.groupBy("image_id", "layer", (F.col("y") * F.col("columns") + F.col("x")).alias("offset")).agg(F.count("*").cast("int").alias("times"))


def blended(under: Column, over: Column, alpha: Column) -> Column:
    """A byte under another of an opacity from 0 to 255."""
    share = alpha / 255.0
    return F.when(alpha >= 255, over).when(alpha <= 0, under).otherwise(F.greatest(F.lit(0), F.least(F.lit(255), F.floor(under * (1.0 - share) + over * share + 0.5).cast("int"))))


def drawn(frames: DataFrame, overlays: DataFrame) -> DataFrame:
    """Grey frames (image_id, columns, pixels) with ``rgb``, three bytes a pixel, overlays blended in in the order of their layers.

    ``overlays`` as for ``touched``, with red, green, blue and alpha. Only pixels that an overlay meets are looked at one by one; an image's
    meet in one row, which is no larger than the image. Images without overlays are only made colour.
    """
    colours = overlays.select("image_id", "layer", "red", "green", "blue", "alpha")
    met = touched(overlays).join(colours, ["image_id", "layer"])
    layers = met.groupBy("image_id", "offset").agg(F.array_sort(F.collect_list(F.struct("layer", "times", "red", "green", "blue", "alpha"))).alias("layers"))
    spots = layers.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("offset", "layers"))).alias("spots"))

    def over(under: Column, layers: Column, colour: str) -> Column:
        return F.aggregate(layers, under, lambda v, l: F.aggregate(F.sequence(F.lit(1), l["times"]), v, lambda u, _: blended(u, l[colour], l["alpha"])))  # noqa: E741

    joined = frames.join(spots, "image_id", "left")
    pixels, grey = F.col("pixels"), lambda a: F.flatten(F.transform(a, lambda p: F.array(p, p, p)))
    # Runs of pixels between the spots, each before its spot; the last run follows.
    run = lambda s, i: F.slice(pixels, F.when(i > 0, F.get(F.col("spots"), i - 1)["offset"] + 2).otherwise(1), F.when(i > 0, s["offset"] - F.get(F.col("spots"), i - 1)["offset"] - 1).otherwise(s["offset"]))
    spot = lambda s: F.array(*(over(F.get(pixels, s["offset"]), s["layers"], c) for c in ("red", "green", "blue")))
    parts = F.transform("spots", lambda s, i: F.concat(grey(run(s, i)), spot(s)))
    last = F.element_at("spots", -1)["offset"] + 1
    rgb = F.concat(F.flatten(parts), grey(F.slice(pixels, last + 1, F.greatest(F.size(pixels) - last, F.lit(0)))))
    return joined.withColumn("rgb", F.when(F.col("spots").isNull(), grey(pixels)).otherwise(rgb)).drop("spots")


# Packed masks: bits of pixels, the lowest of each byte first, frames without a gap


def packed_bytes(bits: Column) -> Column:
    """An array of bits as bytes; what lacks to a whole byte is 0."""
    count = F.size(bits)
    byte = lambda k: sum((F.coalesce(F.get(bits, 8 * k + i), F.lit(0)) * (1 << i) for i in range(1, 8)), F.coalesce(F.get(bits, 8 * k), F.lit(0)))
    bytes_ = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((count - 1) / 8).cast("int"), F.lit(0))), lambda k: F.lpad(F.hex(byte(k)), 2, "0"))
    return F.when(count > 0, F.unhex(F.array_join(bytes_, ""))).otherwise(F.lit(b""))


def _byte(data: Column, k: Column) -> Column:
    return F.coalesce(F.conv(F.hex(F.substring(data, k + 1, F.lit(1))), 16, 10).cast("int"), F.lit(0))


def packed_frame(data: Column, frame: Column, size: Column) -> Column:
    """The mask of one frame, shifted to begin with a byte, bits beyond it 0; null where the data end before it."""
    first = frame * size
    at, shift = F.floor(first / 8).cast("int"), (first % 8).cast("int")
    count = F.ceil(size / 8).cast("int")

    def byte(k: Column) -> Column:
        both = _byte(data, at + k) + _byte(data, at + k + 1) * 256
        kept = F.floor(both / F.pow(F.lit(2.0), shift)).cast("int") % 256
        rest = size - 8 * k
        return F.when(rest < 8, kept % F.pow(F.lit(2.0), rest).cast("int")).otherwise(kept)

    whole = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda k: F.lpad(F.hex(byte(k)), 2, "0")), ""))
    return F.when((size > 0) & (F.octet_length(data) * 8 >= first + size), whole)


def mask_bits(mask: Column, size: Column) -> Column:
    """A mask's bits as an array."""
    return F.when(size > 0, F.transform(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0))), lambda i: F.floor(_byte(mask, F.floor(i / 8).cast("int")) / F.pow(F.lit(2.0), i % 8)).cast("int") % 2)).otherwise(F.array().cast("array<int>"))


def _words(mask: Column) -> Column:
    """A mask as whole numbers of 32 bits."""
    digits = F.rpad(F.hex(mask), (F.ceil(F.octet_length(mask) / 4) * 8).cast("int"), "0")
    places = F.sequence(F.lit(0), F.greatest(F.ceil(F.octet_length(mask) / 4).cast("int") - 1, F.lit(0)))
    return bound(digits, lambda d: F.transform(places, lambda k: F.conv(F.substring(d, 8 * k + 1, F.lit(8)), 16, 10).cast("bigint")))


def mask_count(mask: Column) -> Column:
    """How many pixels a mask holds."""
    return F.when(F.octet_length(mask) > 0, F.aggregate(_words(mask), F.lit(0), lambda a, w: a + F.bit_count(w))).otherwise(F.when(mask.isNotNull(), 0))


def mask_overlap(a: Column, b: Column) -> Column:
    """How many pixels two masks of one size share."""
    return F.when((F.octet_length(a) > 0) & (F.octet_length(a) == F.octet_length(b)), F.aggregate(F.zip_with(_words(a), _words(b), lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda s, n: s + n))


def masks_joined(masks: DataFrame, *keys: str, mask: str = "mask") -> DataFrame:
    """(keys, mask): of masks of one size the one that holds every pixel of any, combined before the shuffle word by word."""
    words = masks.select(*keys, F.octet_length(mask).alias("__n"), F.posexplode(_words(F.col(mask))).alias("__k", "__word"))
    whole = words.groupBy(*keys, "__n", "__k").agg(F.bit_or("__word").alias("__word")).groupBy(*keys, "__n").agg(F.array_sort(F.collect_list(F.struct("__k", "__word"))).alias("__w"))
    digits = F.array_join(F.transform("__w", lambda x: F.lpad(F.hex(x["__word"]), 8, "0")), "")
    return whole.select(*keys, F.unhex(F.substring(digits, F.lit(1), F.col("__n") * 2)).alias(mask))


def label_map(labels: list[Column], masks: list[Column], size: Column) -> Column:
    """A label for each pixel: that of the first mask that holds it, else 0."""
    all_bits = F.array(*(mask_bits(m, size) for m in masks))
    return bound(all_bits, lambda bits: F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.coalesce(*(F.when(F.get(F.get(bits, k), i) == 1, label) for k, label in enumerate(labels)), F.lit(0))))
