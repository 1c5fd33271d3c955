"""Pixel statistics over rows of (image, value): one row per pixel, any number of images at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 256
#: The distance from 1.0 to the next double.
EPSILON = 2.220446049250313e-16


def _limits(pixels: DataFrame, image: str, value: str) -> DataFrame:
    return pixels.groupBy(image).agg(F.min(value).cast("double").alias("low"), F.max(value).cast("double").alias("high"), F.count(value).alias("n"))


def histogram(pixels: DataFrame, image: str = "image_id", value: str = "value", bins: int = BINS) -> DataFrame:
    """(image, bin, pixels, low, high, n) of bins that are not empty. The last bin holds the greatest value alone; an even picture is in bin 0.

    A partial count per bin is all that is shuffled.
    """
    limits = _limits(pixels, image, value)
    joined = pixels.where(F.col(value).isNotNull()).join(limits, image)
    span = F.col("high") - F.col("low")
    place = F.when(span > 0, F.floor((F.col(value).cast("double") - F.col("low")) / F.when(span > 0, span) * (bins - 1))).otherwise(0)
    return joined.groupBy(image, "low", "high", "n", place.cast("int").alias("bin")).agg(F.count("*").alias("pixels"))


def statistics(pixels: DataFrame, image: str = "image_id", value: str = "value") -> DataFrame:
    """Range, mean, variance and deviation of the whole population, and the quality metrics from them."""
    v = F.col(value).cast("double")
    s = pixels.groupBy(image).agg(F.count(value).alias("n"), F.min(v).alias("min_value"), F.max(v).alias("max_value"), F.avg(v).alias("mean"), F.var_pop(v).alias("variance"), F.stddev_pop(v).alias("std_deviation"))
    ratio = F.col("max_value") / (F.col("min_value") + 1.0)
    return s.withColumns({
        "contrast": (F.col("max_value") - F.col("min_value")) / (F.col("max_value") + F.col("min_value") + EPSILON),
        "snr": F.col("mean") / (F.col("std_deviation") + EPSILON),
        "dynamic_range": F.when(ratio > 0, 20.0 * F.log10(F.when(ratio > 0, ratio))).otherwise(0.0),
    })


def auto_window(pixels: DataFrame, image: str = "image_id", value: str = "value", bins: int = BINS) -> DataFrame:
    """Centre and width from the first bins whose running counts reach 1 % and 99 % of the pixels (cut off); bin centres divide the range by the number of bins.

    With fewer than 100 pixels the first threshold is 0, which bin 0 reaches whether it is empty or not. The first hit after the
    least value counts, as a bin centre equal to the least value does not.
    """
    h = histogram(pixels, image, value, bins)
    running = F.sum("pixels").over(Window.partitionBy(image).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    h = h.withColumn("reached", running)
    # Bin 0 is never empty: it holds the least value.
    p = h.groupBy(image, "low", "high", "n").agg(
        F.min(F.when(F.col("reached") >= F.floor(F.col("n") * 0.01), F.col("bin"))).alias("b1"), F.min(F.when(F.col("reached") >= F.floor(F.col("n") * 0.99), F.col("bin"))).alias("b99")
    )
    step = (F.col("high") - F.col("low")) / bins
    low, high = F.col("low") + (F.col("b1") + 0.5) * step, F.col("low") + (F.col("b99") + 0.5) * step
    return p.select(image, ((low + high) / 2.0).alias("center"), F.greatest(high - low, F.lit(1.0)).alias("width"))


def percentile_window(pixels: DataFrame, lower: float = 0.01, upper: float = 0.99, image: str = "image_id", value: str = "value") -> DataFrame:
    """Centre and width of the values at places floor((n-1) lower) and ceil((n-1) upper) of the sorted pixels.

    Counts of equal values are summed first, so a row per different value is sorted, not one per pixel.
    """
    if not 0 <= lower < upper <= 1:
        raise ValueError("0 <= lower < upper <= 1")
    counts = pixels.where(F.col(value).isNotNull()).groupBy(image, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
    w = Window.partitionBy(image)
    counts = counts.withColumns({"last": F.sum("c").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)), "n": F.sum("c").over(w)})
    at = lambda place: (F.col("last") > place) & (F.col("last") - F.col("c") <= place)
    ends = counts.groupBy(image).agg(F.max(F.when(at(F.floor((F.col("n") - 1) * lower)), F.col("v"))).alias("low"), F.max(F.when(at(F.ceil((F.col("n") - 1) * upper)), F.col("v"))).alias("high"))
    return ends.select(image, ((F.col("low") + F.col("high")) / 2.0).alias("center"), F.greatest(F.col("high") - F.col("low"), F.lit(1.0)).alias("width"))


def equalized(pixels: DataFrame, image: str = "image_id", value: str = "value") -> DataFrame:
    """Pixels with ``grey``, 0 to 255 by their share of the cumulated histogram. The exact rounding of other tools is not known; order is kept."""
    counts = pixels.groupBy(image, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(image)
    counts = counts.withColumns({"r": F.sum("c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)), "n": F.sum("c").over(w), "c0": F.first("c").over(w.orderBy(value))})
    rest = F.col("n") - F.col("c0")
    grey = F.when(rest > 0, F.floor((F.col("r") - F.col("c0")) * 255.0 / F.when(rest > 0, rest) + 0.5)).otherwise(0).cast("int")
    return pixels.join(counts.select(image, value, grey.alias("grey")), [image, value])


def physical_range(maps: DataFrame, image: str = "image_id") -> DataFrame:
    """Least and greatest physical value over an image's linear maps."""
    a, b = (F.col(x) * F.col("slope") + F.col("intercept") for x in ("first", "last"))
    return maps.groupBy(image).agg(F.min(F.least(a, b)).alias("low"), F.max(F.greatest(a, b)).alias("high"))


def batch_summary(results: DataFrame, succeeded: Column) -> DataFrame:
    """Total, successes, failures and rate; 0 where there is nothing."""
    s = results.agg(F.count("*").alias("total"), F.count_if(succeeded).alias("succeeded"))
    return s.select("total", "succeeded", (F.col("total") - F.col("succeeded")).alias("failed"), F.coalesce(F.try_divide(F.col("succeeded"), F.col("total")), F.lit(0.0)).cast("double").alias("rate"))


def benchmark(times: DataFrame, name: str, ms: str) -> DataFrame:
    """Mean, median, deviation, 95th and 99th percentile and coefficient of variation."""
    v = F.col(ms)
    return times.groupBy(name).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.stddev_samp(v).alias("sd"), F.percentile(v, 0.95).alias("p95"), F.percentile(v, 0.99).alias("p99")).withColumn("cv", F.try_divide(F.col("sd"), F.col("mean")))
