"""Pixel statistics and value transforms over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric as nm
from ..operators import statistics as st
from .registry import query
from .tables import PIXELS, frames, pixels, table

_LIMITS = "lim AS (SELECT image_id, CAST(min(value) AS DOUBLE) AS low, CAST(max(value) AS DOUBLE) AS high, count(*) AS n FROM px GROUP BY image_id)"
_BINS = f"{_LIMITS}, h AS (SELECT image_id, low, high, n, CAST(CASE WHEN high > low THEN floor((value - low) / (high - low) * 255) ELSE 0 END AS INT) AS bin, count(*) AS pixels FROM px JOIN lim USING (image_id) GROUP BY ALL)"


@query(f"WITH {PIXELS}, {_BINS} SELECT image_id, bin, pixels FROM h")
def histogram(spark: SparkSession, d: str) -> DataFrame:
    return st.histogram(pixels(spark, d)).select("image_id", "bin", "pixels")


@query(f"""WITH {PIXELS} SELECT image_id, count(*) AS n, CAST(min(value) AS DOUBLE) AS min_value, CAST(max(value) AS DOUBLE) AS max_value, round(avg(value), 6) AS mean, round(var_pop(value) + 1e-7, 4) AS variance, round(stddev_pop(value), 6) AS std_deviation,
  round((max(value) - min(value)) / (max(value) + min(value) + 2.220446049250313e-16), 6) AS contrast, round(avg(value) / (stddev_pop(value) + 2.220446049250313e-16), 6) AS snr, round(20.0 * log10(max(value) / (min(value) + 1.0)), 6) AS dynamic_range FROM px GROUP BY image_id""")
def quality_metrics(spark: SparkSession, d: str) -> DataFrame:
    # The variance of 64 whole numbers can stand right between two roundings; both sides are shifted off these ties.
    s = st.statistics(pixels(spark, d)).withColumn("variance", F.col("variance") + 1e-7)
    return s.select("image_id", "n", "min_value", "max_value", *(F.round(c, 4 if c == "variance" else 6).alias(c) for c in ("mean", "variance", "std_deviation", "contrast", "snr", "dynamic_range")))


@query(f"""WITH {PIXELS}, {_BINS}, r AS (SELECT *, sum(pixels) OVER (PARTITION BY image_id ORDER BY bin ROWS UNBOUNDED PRECEDING) AS reached FROM h),
p AS (SELECT image_id, low, high, min(CASE WHEN reached >= floor(n * 0.01) THEN bin END) AS b1, min(CASE WHEN reached >= floor(n * 0.99) THEN bin END) AS b99 FROM r GROUP BY ALL)
SELECT image_id, round(((low + (b1 + 0.5) * (high - low) / 256) + (low + (b99 + 0.5) * (high - low) / 256)) / 2, 6) AS center, round(greatest((b99 - b1) * (high - low) / 256, 1.0), 6) AS width FROM p""")
def auto_window(spark: SparkSession, d: str) -> DataFrame:
    return st.auto_window(pixels(spark, d)).select("image_id", F.round("center", 6).alias("center"), F.round("width", 6).alias("width"))


@query("""WITH s AS (SELECT l_returnflag AS image_id, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem),
e AS (SELECT image_id, max(CASE WHEN i = floor((n - 1) * 0.01) THEN v END) AS low, max(CASE WHEN i = ceil((n - 1) * 0.99) THEN v END) AS high FROM s GROUP BY image_id)
SELECT image_id, round((low + high) / 2, 4) AS center, round(greatest(high - low, 1.0), 4) AS width FROM e""")
def percentile_window(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("image_id"), F.col("l_extendedprice").alias("value"))
    return st.percentile_window(p).select("image_id", F.round("center", 4).alias("center"), F.round("width", 4).alias("width"))


@query(f"""WITH {PIXELS}, c AS (SELECT image_id, value, count(*) AS c FROM px GROUP BY ALL), r AS (SELECT image_id, value, sum(c) OVER (PARTITION BY image_id ORDER BY value ROWS UNBOUNDED PRECEDING) AS r, sum(c) OVER (PARTITION BY image_id) AS n, first_value(c) OVER (PARTITION BY image_id ORDER BY value) AS c0 FROM c)
SELECT image_id, place, value, CAST(CASE WHEN n > c0 THEN floor((r - c0) * 255.0 / (n - c0) + 0.5) ELSE 0 END AS INT) AS grey FROM px JOIN r USING (image_id, value)""")
def equalization(spark: SparkSession, d: str) -> DataFrame:
    return st.equalized(pixels(spark, d)).select("image_id", "place", "value", "grey")


@query("SELECT count(*) AS total, count(*) FILTER (WHERE value > 50) AS succeeded, count(*) FILTER (WHERE value <= 50) AS failed, count(*) FILTER (WHERE value > 50) / CAST(count(*) AS DOUBLE) AS rate FROM events")
def batch_summary(spark: SparkSession, d: str) -> DataFrame:
    return st.batch_summary(table(spark, d, "events"), F.col("value") > 50)


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_samp(value), 6) AS sd, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(stddev_samp(value) / avg(value), 6) AS cv FROM events GROUP BY event_type")
def benchmark_statistics(spark: SparkSession, d: str) -> DataFrame:
    b = st.benchmark(table(spark, d, "events"), "event_type", "value")
    return b.select("event_type", "n", *(F.round(c, 6).alias(c) for c in ("mean", "median", "sd", "p95", "p99", "cv")))


@query("SELECT l_partkey AS image_id, round(min(least(l_quantity * (1 + l_tax) - 10, (l_quantity + 5) * (1 + l_tax) - 10)), 6) AS low, round(max(greatest(l_quantity * (1 + l_tax) - 10, (l_quantity + 5) * (1 + l_tax) - 10)), 6) AS high FROM lineitem GROUP BY l_partkey")
def physical_range(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "lineitem").select(F.col("l_partkey").alias("image_id"), F.col("l_quantity").alias("first"), (F.col("l_quantity") + 5).alias("last"), (1 + F.col("l_tax")).alias("slope"), F.lit(-10.0).alias("intercept"))
    return st.physical_range(m).select("image_id", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


_L = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, floor(l_quantity) AS q, l_tax AS t, l_extendedprice AS e FROM lineitem"
_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(*_KEYS, F.floor("l_quantity").cast("double").alias("q"), F.col("l_tax").alias("t"), F.col("l_extendedprice").alias("e"))


@query(f"""SELECT {", ".join(_KEYS)}, round((1 + t) * q - 1024, 6) AS hu, round((q + 1024) / (1 + t), 6) AS stored, round(greatest(least(sign(e / 3 - 9000) * floor(abs(e / 3 - 9000) + 0.5), 32767.0), -32768.0)) + 0.0 AS voxel, 65535 - CAST(q AS INT) AS inverted, CAST(q AS INT) + 32768 AS biased FROM ({_L})""")
def rescaling(spark: SparkSession, d: str) -> DataFrame:
    slope = 1 + F.col("t")
    return _lines(spark, d).select(*_KEYS, F.round(nm.rescale(F.col("q"), slope, F.lit(-1024.0)), 6).alias("hu"), F.round(nm.hu_to_stored(F.col("q"), slope, F.lit(-1024.0)), 6).alias("stored"), nm.modality_voxel(F.col("e") / 3 - 9000).cast("double").alias("voxel"), nm.monochrome1(F.col("q").cast("int")).alias("inverted"), nm.signed_bias(F.col("q").cast("int")).alias("biased"))


@query(f"""WITH {PIXELS} SELECT image_id, place, CAST(floor(greatest(least(CAST(value AS FLOAT) * (CAST(255 AS FLOAT) / (CAST(2248 AS FLOAT) - CAST(1848 AS FLOAT))) + (-CAST(1848 AS FLOAT)) * (CAST(255 AS FLOAT) / (CAST(2248 AS FLOAT) - CAST(1848 AS FLOAT))), 255.0), 0.0)) AS INT) AS grey,
  CAST(floor((1 - greatest(least((value - 1848.0) / 400.0, 1.0), 0.0)) * 255 + 0.5) AS INT) AS shown FROM px""")
def window_level(spark: SparkSession, d: str) -> DataFrame:
    c, w = F.lit(2048.0), F.lit(400.0)
    return pixels(spark, d).select("image_id", "place", nm.window_level(F.col("value"), c, w).alias("grey"), nm.display_value(F.col("value").cast("double"), c, w, F.lit(True)).alias("shown"))


_PRESETS = f"""SELECT {", ".join(_KEYS)}, CASE WHEN abs(-600 - c) <= 50 AND abs(1500 - w) <= 50 THEN 'Lung' WHEN abs(400 - c) <= 50 AND abs(1800 - w) <= 50 THEN 'Bone' WHEN abs(50 - c) <= 50 AND abs(350 - w) <= 50 THEN 'Soft Tissue' WHEN abs(40 - c) <= 50 AND abs(80 - w) <= 50 THEN 'Brain' WHEN abs(120 - c) <= 50 AND abs(200 - w) <= 50 THEN 'Liver'
  WHEN abs(0 - c) <= 50 AND abs(4096 - w) <= 50 THEN 'Custom' WHEN abs(50 - c) <= 50 AND abs(350 - w) <= 50 THEN 'Mediastinum' WHEN abs(60 - c) <= 50 AND abs(400 - w) <= 50 THEN 'Abdomen' WHEN abs(50 - c) <= 50 AND abs(250 - w) <= 50 THEN 'Spine' WHEN abs(40 - c) <= 50 AND abs(400 - w) <= 50 THEN 'Pelvis' WHEN abs(300 - c) <= 50 AND abs(600 - w) <= 50 THEN 'Angiography' WHEN abs(100 - c) <= 50 AND abs(500 - w) <= 50 THEN 'Pulmonary Embolism' WHEN abs(2000 - c) <= 50 AND abs(4000 - w) <= 50 THEN 'Mammography' WHEN abs(2500 - c) <= 50 AND abs(5000 - w) <= 50 THEN 'PET Scan' END AS preset FROM (SELECT *, q * 2 AS c, floor(e / 100) AS w FROM ({_L}))"""


@query(_PRESETS)
def preset_lookup(spark: SparkSession, d: str) -> DataFrame:
    r = _lines(spark, d).withColumns({"c": F.col("q") * 2, "w": F.floor(F.col("e") / 100).cast("double")})
    return r.select(*_KEYS, nm.preset_near(F.col("c"), F.col("w")).alias("preset"))


@query(_PRESETS)
def preset_lookup_whole(spark: SparkSession, d: str) -> DataFrame:
    """Every line with its preset, or null; ``preset_lookup`` is the same since it has lost its filter."""
    return preset_lookup(spark, d)


@query("""SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN CASE WHEN contains(lower(p_name), 'a') THEN 'Lung,Mediastinum,Bone,Soft Tissue' ELSE 'Soft Tissue,Bone,Lung,Brain' END WHEN p_size % 4 = 1 THEN 'Mammography' WHEN p_size % 4 = 2 THEN 'Brain,Soft Tissue' ELSE 'Custom' END AS presets FROM part""")
def preset_suggestions(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    kind = F.element_at(F.array(*map(F.lit, ("ct", "MG", "mr", "XX"))), (F.col("p_size") % 4 + 1).cast("int"))
    return p.select("p_partkey", F.array_join(nm.suggested_presets(kind, F.when(F.contains(F.lower("p_name"), F.lit("a")), "CHEST PA")), ",").alias("presets"))


@query(f"""SELECT {", ".join(_KEYS)}, round(CASE WHEN q <= 10 THEN q * 0.5 + 2 END, 6) AS rwv, CASE WHEN q BETWEEN 1 AND 3 THEN q * 10 END AS listed, round(CASE WHEN q BETWEEN 5 AND 20 THEN q * 2 + 1 END, 6) AS parametric, round(q * 0.25 * 2 + 1, 6) AS wave, round(q * 0.001, 6) AS dose FROM ({_L})""")
def physical_values(spark: SparkSession, d: str) -> DataFrame:
    q, none = F.col("q"), F.lit(None).cast("array<double>")
    tab = F.array(F.lit(10.0), F.lit(20.0), F.lit(30.0))
    return _lines(spark, d).select(
        *_KEYS, F.round(nm.real_world_value(q, F.lit(0), F.lit(10), F.lit(0.5), F.lit(2.0), none), 6).alias("rwv"), nm.real_world_value(q, F.lit(1), F.lit(3), F.lit(0.0), F.lit(0.0), tab).alias("listed"),
        F.round(nm.parametric_value(q, F.lit(20), F.lit(5), F.lit(2.0), F.lit(1.0)), 6).alias("parametric"), F.round(nm.waveform_value(q, F.lit(0.25), F.lit(2.0), F.lit(1.0)), 6).alias("wave"), F.round(nm.dose_value(q, F.lit(0.001)), 6).alias("dose"),
    )


@query("""WITH p AS (SELECT c_custkey, 40.0 + c_custkey % 60 AS kg, 1.5 + (c_custkey % 50) / 100.0 AS m, CASE WHEN c_custkey % 3 = 0 THEN 'M' WHEN c_custkey % 3 = 1 THEN 'F' ELSE 'O' END AS sex, 3.5e8 * pow(2.0, -((CASE WHEN c_custkey % 2 = 0 THEN 3600.0 ELSE 82800.0 END)) / 6586.2) AS dose FROM customer),
f AS (SELECT *, kg * 1000 AS bw, CASE sex WHEN 'M' THEN 1.10 * kg - 120 * pow(kg / (m * 100), 2) WHEN 'F' THEN 1.07 * kg - 148 * pow(kg / (m * 100), 2) END * 1000 AS lbm, 0.007184 * pow(kg, 0.425) * pow(m * 100, 0.725) * 10000 AS bsa, CASE sex WHEN 'M' THEN 48.0 + 1.06 * (m * 100 - 152) WHEN 'F' THEN 45.5 + 0.91 * (m * 100 - 152) END * 1000 AS ibw FROM p)
SELECT c_custkey, round(1000 * bw / dose, 6) AS suv_bw, round(1000 * CASE WHEN lbm > 0 THEN lbm END / dose, 6) AS suv_lbm, round(1000 * bsa / dose, 6) AS suv_bsa, round(1000 * CASE WHEN ibw > 0 THEN ibw END / dose, 6) AS suv_ibw FROM f""")
def uptake_values(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    kg, m = 40.0 + k % 60, 1.5 + (k % 50) / 100.0
    sex = F.when(k % 3 == 0, "M").when(k % 3 == 1, "F").otherwise("O")
    seconds = nm.decay_seconds(F.lit(7200.0), F.when(k % 2 == 0, 10800.0).otherwise(3600.0))
    dose = nm.decayed_dose(F.lit(3.5e8), F.lit(None).cast("double"), F.lit(6586.2), seconds)
    value = lambda kind: F.round(nm.uptake_value(kind, F.lit(1000.0), F.lit("BQML"), dose, nm.size_factor(kind, kg, m, sex)), 6).alias(f"suv_{kind}")
    return table(spark, d, "customer").select("c_custkey", *map(value, ("bw", "lbm", "bsa", "ibw")))


@query(f"""WITH {PIXELS} SELECT image_id, place, CAST(least(greatest(floor(y + 1.402 * (cr - 128) + 0.5), 0), 255) AS INT) AS r, CAST(least(greatest(floor(y - 0.344136 * (cb - 128) - 0.714136 * (cr - 128) + 0.5), 0), 255) AS INT) AS g, CAST(least(greatest(floor(y + 1.772 * (cb - 128) + 0.5), 0), 255) AS INT) AS b,
  CAST(floor((1 - least(value, 4095) / 4095.0::DOUBLE) * 255 + 0.5) AS INT) AS byte FROM (SELECT image_id, place, value, value % 256 AS y, (value // 3) % 256 AS cb, (value // 7) % 256 AS cr FROM px)""")
def color_values(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    part = lambda n: (F.floor(v / n) % 256).cast("double")
    rgb = nm.ybr_to_rgb((v % 256).cast("double"), part(3), part(7))
    return pixels(spark, d).select("image_id", "place", rgb["r"].alias("r"), rgb["g"].alias("g"), rgb["b"].alias("b"), nm.scaled_byte(v, F.lit(12), F.lit(True)).alias("byte"))


@query(f"""WITH {PIXELS}, t AS (SELECT image_id, p AS place, (p // 4) * 2 * 8 + (p % 4) * 2 AS source FROM (SELECT DISTINCT image_id FROM px), range(16) r(p)), s AS (SELECT image_id, min(value) AS low, max(value) AS high FROM (SELECT t.image_id, value FROM t JOIN px ON px.image_id = t.image_id AND px.place = t.source) GROUP BY image_id)
SELECT t.image_id, CAST(t.place AS INT) AS place, CAST(CASE WHEN high > low THEN floor((value - low) * 255.0 / (high - low) + 0.5) ELSE 0 END AS INT) AS grey FROM t JOIN px ON px.image_id = t.image_id AND px.place = t.source JOIN s ON s.image_id = t.image_id""")
def thumbnails(spark: SparkSession, d: str) -> DataFrame:
    t = frames(spark, d).select("image_id", nm.stretched(nm.thumbnail(F.col("pixels"), F.lit(8), 4, 4, F.lit(8))).alias("p"))
    return t.select("image_id", F.posexplode("p").alias("place", "grey"))


@query("""WITH n AS (SELECT vec_id, [CAST(e AS DOUBLE) FOR e IN embedding] AS v FROM embeddings) SELECT vec_id, round((v[1] * nx + v[2] * ny + v[3] * nz) / sqrt(nx * nx + ny * ny + nz * nz), 5) AS projection FROM (SELECT vec_id, v, v[5] * v[9] - v[6] * v[8] AS nx, v[6] * v[7] - v[4] * v[9] AS ny, v[4] * v[8] - v[5] * v[7] AS nz FROM n)""")
def slice_projection(spark: SparkSession, d: str) -> DataFrame:
    v = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", F.round(nm.slice_projection(F.slice(v, 1, 3), F.slice(v, 4, 6)), 5).alias("projection"))


@query(f"""WITH {PIXELS} SELECT image_id, place, CASE WHEN ((value >> 2) & 1023) >= 512 THEN ((value >> 2) & 1023) - 1024 ELSE (value >> 2) & 1023 END AS bits, CAST(least(greatest(value - 2000, 0), 3) AS INT) AS lut_place, round(value / 4095.0::DOUBLE, 8) AS share FROM px""")
def stored_bits(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return pixels(spark, d).select("image_id", "place", nm.stored_bits(v, 10, 11, True).cast("int").alias("bits"), nm.lut_index(v, F.lit(2000), F.lit(4)).cast("int").alias("lut_place"), F.round(nm.lut_normalized(v, F.lit(12)), 8).alias("share"))
