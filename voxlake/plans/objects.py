"""Syntaxes, colour, loader rules, data sets, quantities and small header functions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color, elements, numeric, quantity, text
from ..operators import links, loader, search, syntaxes
from ..streaming import ingest
from .registry import query
from .tables import PIXELS, frames, table

_SYNTAX_ROWS = ", ".join(f"({i}, '{u}', '{c}', '{k}', '{e}', '{d}', '{n}')" for i, (u, c, k, e, d, n) in enumerate(syntaxes.SYNTAXES))
_SYNTAX = f"t(i, uid, codec, compression, encoding, decoder, encoder) AS (VALUES {_SYNTAX_ROWS})"


def _pick(values, place) -> F.Column:
    return F.get(F.array(*map(F.lit, values)), place.cast("int"))


@query(f"""WITH {_SYNTAX}, o AS (SELECT o_orderkey, o_orderkey % 37 AS a, o_custkey % 36 AS b FROM orders),
p AS (SELECT o_orderkey, CASE WHEN a = 36 THEN '1.2.3' ELSE s.uid END AS source, d.uid AS wanted, CASE WHEN a = 36 THEN NULL WHEN s.uid = d.uid THEN 'pass-through' WHEN s.encoding = 'referenced' OR d.encoding = 'referenced' THEN 'reference' WHEN s.compression = 'none' AND d.compression = 'none' THEN 'rewrite-native' WHEN d.compression = 'none' THEN 'decompress' WHEN s.compression = 'none' THEN 'compress' ELSE 'recompress' END AS route,
  CASE WHEN s.compression <> 'none' THEN s.decoder ELSE 'supported' END AS dec, d.encoder AS enc FROM o LEFT JOIN t s ON s.i = a JOIN t d ON d.i = b)
SELECT o_orderkey, source, wanted, route, CASE WHEN route IS NULL THEN NULL WHEN route = 'reference' THEN 'unsupported' WHEN route IN ('pass-through', 'rewrite-native') THEN 'supported' WHEN dec = 'unavailable' OR enc = 'unavailable' THEN 'unsupported' WHEN dec = 'best-effort' OR enc = 'best-effort' THEN 'ambiguous' ELSE 'supported' END AS status,
  route IN ('pass-through', 'rewrite-native') OR (route IN ('decompress', 'compress', 'recompress') AND dec = 'supported' AND enc = 'supported') AS can_transcode FROM p""")
def transcode_plans(spark: SparkSession, d: str) -> DataFrame:
    uids = [s[0] for s in syntaxes.SYNTAXES]
    files = table(spark, d, "orders").select("o_orderkey", _pick([*uids, "1.2.3"], F.col("o_orderkey") % 37).alias("source"), _pick(uids, F.col("o_custkey") % 36).alias("wanted"))
    return syntaxes.with_plans(files, spark, "source", "wanted")


@query(f"""WITH {_SYNTAX} SELECT o_orderkey, codec, CASE WHEN compression <> 'none' OR encoding = 'referenced' THEN CASE WHEN codec = 'deflate' THEN 'out-of-scope' WHEN codec IN ('jpegLossless', 'rle', 'jpegExtended') THEN 'decoded' WHEN codec IN ('jpip', 'mpeg2', 'h264', 'hevc') THEN 'streamed-only' ELSE 'delegated' END END AS pixel_support,
  CASE WHEN codec = 'deflate' THEN 'deflated-dataset' WHEN encoding = 'native' THEN 'native-dataset' WHEN encoding = 'encapsulated' THEN 'encapsulated-pass-through' ELSE 'referenced-dataset' END AS write_support FROM orders JOIN t ON i = o_orderkey % 36""")
def syntax_support(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "orders").select("o_orderkey", F.concat(_pick([s[0] for s in syntaxes.SYNTAXES], F.col("o_orderkey") % 36), F.lit("\0")).alias("syntax"))
    known = F.broadcast(syntaxes.registry(spark))
    return files.join(known, syntaxes.same_syntax(F.col("syntax"), F.col("uid"))).select("o_orderkey", "codec", "pixel_support", "write_support")


_KINDS = ("MONOCHROME1", "MONOCHROME2", "RGB", "PALETTE COLOR", "YBR_FULL", "YBR_FULL_422", "YBR_PARTIAL_420", "YBR_RCT", "YBR_ICT", "OTHER")


@query(f"""WITH s(kind, status, bits, planar) AS (VALUES {", ".join(f"('{k}', '{s}', '{','.join(map(str, b))}', '{','.join(map(str, p))}')" for k, s, _, p, b in color.SUPPORT)}),
p AS (SELECT p_partkey, [{", ".join(f"'{k}'" for k in _KINDS)}][CAST(p_partkey % 10 + 1 AS INT)] AS kind, CASE WHEN p_size % 4 = 3 THEN NULL ELSE p_size % 4 END AS planar_value FROM part)
SELECT p_partkey, coalesce(status, 'unsupported') AS status, coalesce(bits, '') AS bits, CASE WHEN planar_value IS NULL THEN true WHEN planar IS NULL OR planar = '' THEN false ELSE contains(planar, CAST(planar_value AS VARCHAR)) END AS planar_ok FROM p LEFT JOIN s USING (kind)""")
def color_support(spark: SparkSession, d: str) -> DataFrame:
    kind, planar = _pick(_KINDS, F.col("p_partkey") % 10), F.when(F.col("p_size") % 4 != 3, F.col("p_size") % 4)
    s = color.display_support(kind)
    return table(spark, d, "part").select("p_partkey", s["status"].alias("status"), F.array_join(s["bits"].cast("array<string>"), ",").alias("bits"), color.planar_supported(kind, planar).alias("planar_ok"))


_BYTE = lambda e: f"CAST(least(greatest(floor({e} + 0.5), 0), 255) AS INT)"
_RGB = f"{_BYTE('y + 1.402 * (cr - 128.0)')} AS r, {_BYTE('y - 0.344136 * (cb - 128.0) - 0.714136 * (cr - 128.0)')} AS g, {_BYTE('y + 1.772 * (cb - 128.0)')} AS b"


@query(f"""WITH {PIXELS}, v AS (SELECT image_id, list(value % 256 ORDER BY place) AS s FROM px GROUP BY image_id), k AS (SELECT image_id, s, unnest(range(32)) AS i FROM v)
SELECT image_id, CAST(i AS INT) AS place, {_RGB} FROM (SELECT image_id, i, CAST(s[CAST((i // 2) * 4 + i % 2 + 1 AS INT)] AS DOUBLE) AS y, CAST(s[CAST((i // 2) * 4 + 3 AS INT)] AS DOUBLE) AS cb, CAST(s[CAST((i // 2) * 4 + 4 AS INT)] AS DOUBLE) AS cr FROM k)""")
def packed_color(spark: SparkSession, d: str) -> DataFrame:
    pixels = color.ybr_422(F.transform("pixels", lambda p: p % 256))
    return frames(spark, d).select("image_id", F.posexplode(pixels).alias("place", "p")).select("image_id", "place", "p.*")


@query(f"""WITH {PIXELS} SELECT image_id, place, CAST(greatest(least(value - 1000, 2), 0) * 10 AS INT) AS r, CAST(greatest(least(value - 1000, 1), 0) + 7 AS INT) AS g, 200 AS b, value * 1 AS wide, (value % 256) * 257 AS widened FROM px""")
def palette_color(spark: SparkSession, d: str) -> DataFrame:
    ints = lambda *v: F.array(*map(F.lit, v))
    p = color.palette(F.col("pixels"), ints(0, 10, 20), ints(7, 8), ints(200), F.lit(1000))
    both = F.arrays_zip(p.alias("p"), color.rgb48(F.col("pixels"), F.lit(16)).alias("wide"), color.rgb48(F.transform("pixels", lambda v: v % 256), F.lit(8)).alias("widened"))
    return frames(spark, d).select("image_id", F.posexplode(both).alias("place", "z")).select("image_id", "place", "z.p.*", "z.wide", "z.widened")


@query(f"""WITH {PIXELS}, k AS (SELECT vec_id AS image_id, vec_id % 5 AS kind FROM embeddings), v AS (SELECT image_id, list(value % 256 ORDER BY place) AS s FROM px GROUP BY image_id),
u AS (SELECT image_id, kind, s, unnest(range(CASE kind WHEN 0 THEN 64 WHEN 4 THEN 0 ELSE 21 END)) AS i FROM v JOIN k USING (image_id)),
x AS (SELECT image_id, kind, i, CAST(s[CAST(CASE kind WHEN 0 THEN i WHEN 2 THEN i ELSE i * 3 END + 1 AS INT)] AS DOUBLE) AS y, CAST(s[CAST(CASE kind WHEN 0 THEN i WHEN 2 THEN i + 21 ELSE i * 3 + 1 END + 1 AS INT)] AS DOUBLE) AS cb, CAST(s[CAST(CASE kind WHEN 0 THEN i WHEN 2 THEN i + 42 ELSE i * 3 + 2 END + 1 AS INT)] AS DOUBLE) AS cr FROM u)
SELECT image_id, CAST(i AS INT) AS place, CAST(CASE WHEN kind = 0 THEN 255 - y WHEN kind IN (1, 2) THEN y ELSE {_BYTE('y + 1.402 * (cr - 128.0)')} END AS INT) AS r, CAST(CASE WHEN kind = 0 THEN 255 - y WHEN kind IN (1, 2) THEN cb ELSE {_BYTE('y - 0.344136 * (cb - 128.0) - 0.714136 * (cr - 128.0)')} END AS INT) AS g, CAST(CASE WHEN kind = 0 THEN 255 - y WHEN kind IN (1, 2) THEN cr ELSE {_BYTE('y + 1.772 * (cb - 128.0)')} END AS INT) AS b FROM x""")
def display_color(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("image_id") % 5
    kind = _pick(("MONOCHROME1", "RGB", "RGB", "YBR_FULL", "YBR_ICT"), k)
    none = F.array(F.lit(0))
    shown = color.display_rgb(F.transform("pixels", lambda p: p % 256), kind, F.when(k == 2, 1).otherwise(0), F.lit(8), (none, none, none, F.lit(0)))
    return frames(spark, d).select("image_id", F.posexplode(shown).alias("place", "p")).select("image_id", "place", "p.*")


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, [8, 16, 32, 12][CAST(l_linenumber % 4 + 1 AS INT)] AS bits, l_partkey % 2 AS rep, CASE WHEN l_suppkey % 5 = 0 THEN 3 ELSE 1 END AS samples, CASE WHEN l_partkey % 7 = 0 THEN 'RGB' ELSE 'MONOCHROME2' END AS kind, CASE WHEN l_orderkey % 6 = 0 THEN 0 END AS planar, CASE WHEN l_orderkey % 9 = 0 THEN 2 ELSE 1 END AS frames FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN bits = 12 THEN 'bits allocated' WHEN samples <> 1 THEN 'samples per pixel' WHEN kind = 'RGB' THEN 'photometric interpretation' WHEN frames <> 1 THEN 'frames' WHEN planar IS NOT NULL THEN 'planar configuration' END AS reason, NOT (l_suppkey % 4 = 0 OR l_partkey % 11 = 0 OR l_orderkey % 13 = 0) AS image FROM p""")
def loader_support(spark: SparkSession, d: str) -> DataFrame:
    bits = _pick((8, 16, 32, 12), F.col("l_linenumber") % 4)
    reason = loader.slice_support(bits, F.when(bits == 12, 16).otherwise(bits), F.col("l_partkey") % 2, F.when(F.col("l_suppkey") % 5 == 0, 3).otherwise(1), F.when(F.col("l_partkey") % 7 == 0, "RGB").otherwise("MONOCHROME2"), F.when(F.col("l_orderkey") % 6 == 0, 0), F.when(F.col("l_orderkey") % 9 == 0, 2).otherwise(1))
    sop = F.when(F.col("l_suppkey") % 4 == 0, "1.2.840.10008.5.1.4.1.1.88.11").when(F.col("l_suppkey") % 4 == 1, "1.2.840.10008.5.1.4.1.1.2")
    image = loader.is_image(sop, F.when(F.col("l_partkey") % 11 == 0, "DOC"), F.col("l_orderkey") % 13 == 0)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", reason.alias("reason"), image.alias("image"))


@query("""SELECT c_custkey, '1048592=X|' || '1048608=' || c_custkey || '|2097165=1.2' AS edited, '524384,1048592,1048608,2097165' AS tags, 2 AS vm, concat_ws('|', 'a', 'b', c_mktsegment) AS refs, c_custkey % 2 = 0 AS same, coalesce(CASE WHEN c_custkey % 3 = 0 THEN 'own' END, 'shared') AS spacing, 'shared' AS orientation,
  CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END AS hits, contains(c_mktsegment, 'BUILD') OR c_custkey % 5 = 0 AS cad FROM customer""")
def data_set_edits(spark: SparkSession, d: str) -> DataFrame:
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    s = lambda *v: F.array(*(F.lit(x) if isinstance(x, str) else x for x in v))
    tags = F.create_map(F.lit(0x0020000D), s("1.2"), F.lit(0x00100020), s(k.cast("string")), F.lit(0x00080060), s("CT"))
    edited = elements.in_tag_order(elements.without_tag(elements.with_tag(tags, 0x00100010, s("X")), 0x00080060))
    shown = F.array_join(F.transform(edited, lambda e: F.concat(e["key"].cast("string"), F.lit("="), F.get(e["value"], 0))), "|")
    union = F.array_join(elements.all_tags(tags, F.create_map(F.lit(0x00100010), s("Y"), F.lit(0x00100020), s("Z"))).cast("array<string>"), ",")
    ref = lambda frame: F.struct(F.lit("c").alias("sop_class"), F.lit(None).cast("string").alias("sop_uid"), F.array(frame).alias("frames"))
    group = lambda spacing: F.struct(spacing.alias("spacing"), F.lit(None).cast("string").alias("orientation"))
    groups = elements.resolved(group(F.when(k % 3 == 0, "own")), F.struct(F.lit("shared").alias("spacing"), F.lit("shared").alias("orientation")), ("spacing", "orientation"))
    hits = elements.matching_items(s("NUM", F.when(k % 4 == 0, "TEXT").otherwise("CODE")), lambda i: i == "TEXT")
    return c.select(
        "c_custkey", shown.alias("edited"), union.alias("tags"), elements.multiplicity(s("a", "b"), F.lit(None).cast("binary")).alias("vm"), F.array_join(elements.unique_references(s("a", "b", "a", F.col("c_mktsegment"), "b")), "|").alias("refs"),
        elements.same_object(ref(F.lit(1)), ref(F.when(k % 2 == 0, 1).otherwise(2))).alias("same"), groups["spacing"].alias("spacing"), groups["orientation"].alias("orientation"), F.size(hits).alias("hits"),
        elements.is_cad_finding(F.when(F.contains("c_mktsegment", F.lit("BUILD")), "Cad mark"), F.when(k % 5 == 0, "a finding")).alias("cad"),
    )


def _element_rows(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    row = lambda path, parent, depth, tag, vr, values, raw=None: F.struct(F.lit(path).alias("path"), F.lit(parent).cast("string").alias("parent"), F.lit(depth).alias("depth"), F.lit(tag).alias("tag"), F.lit(vr).alias("vr"), (F.array(*values) if values else F.lit(None).cast("array<string>")).alias("values"), F.lit(raw).cast("binary").alias("binary"))
    rows = F.array(
        row("00280010", None, 0, 0x00280010, "US", [F.lit("4")]), row("00100010", None, 0, 0x00100010, "PN", [F.col("c_name")]), row("00080060", None, 0, 0x00080060, "CS", [F.lit("a/b"), F.lit("<q>")]), row("0040A730", None, 0, 0x0040A730, "SQ", []),
        row("0040A730[1]/00100020", "0040A730[1]", 1, 0x00100020, "LO", [F.lit("two")]), row("0040A730[0]/00100020", "0040A730[0]", 1, 0x00100020, "LO", [F.col("c_custkey").cast("string")]), row("0040A730[0]/00400275", "0040A730[0]", 1, 0x00400275, "SQ", []),
        row("0040A730[0]/00400275[0]/00080060", "0040A730[0]/00400275[0]", 2, 0x00080060, "CS", [F.lit("MR")]), row("00420011", None, 0, 0x00420011, "OB", [], b"abc"), row("00081030", None, 0, 0x00081030, "LO", []), row("7FE00010", None, 0, 0x7FE00010, "OW", [], b"pixels"),
    )
    return c.select(F.col("c_custkey").cast("string").alias("file_path"), F.explode(rows).alias("e")).select("file_path", "e.*")


_JSON = r"""'{"00080060":{"Value":["a\/b","<q>"],"vr":"CS"},"00081030":{"vr":"LO"},"00100010":{"Value":[{"Alphabetic":"' || c_name || '"}],"vr":"PN"},"00280010":{"Value":[4],"vr":"US"},"0040A730":{"Value":[{"00100020":{"Value":["' || c_custkey || '"],"vr":"LO"},"00400275":{"Value":[{"00080060":{"Value":["MR"],"vr":"CS"}}],"vr":"SQ"}},{"00100020":{"Value":["two"],"vr":"LO"}}],"vr":"SQ"},"00420011":{"InlineBinary":"YWJj","vr":"OB"}}'"""


@query(f"SELECT CAST(c_custkey AS VARCHAR) AS file_path, {_JSON} AS json FROM customer")
def json_metadata(spark: SparkSession, d: str) -> DataFrame:
    return elements.json_documents(_element_rows(spark, d))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS file_path, '<NativeDicomModel><DicomAttribute tag="00080060" vr="CS"><Value number="1">a/b</Value><Value number="2">&lt;q&gt;</Value></DicomAttribute><DicomAttribute tag="00081030" vr="LO"></DicomAttribute><DicomAttribute tag="00100010" vr="PN"><Value number="1">' || c_name || '</Value></DicomAttribute><DicomAttribute tag="00280010" vr="US"><Value number="1">4</Value></DicomAttribute><DicomAttribute tag="0040A730" vr="SQ"></DicomAttribute><DicomAttribute tag="00420011" vr="OB"></DicomAttribute></NativeDicomModel>' AS xml FROM customer""")
def xml_metadata(spark: SparkSession, d: str) -> DataFrame:
    return elements.xml_documents(_element_rows(spark, d))


@query(r"""SELECT CAST(c_custkey AS VARCHAR) AS file_path, tag, vr, CASE tag WHEN 1048592 THEN c_name WHEN 524384 THEN 'a/b|<q>' WHEN 2621456 THEN '4' END AS value, CASE WHEN vr = 'OB' THEN 'abc' END AS raw
FROM customer, (VALUES (524384, 'CS'), (528432, 'LO'), (1048592, 'PN'), (2621456, 'US'), (4237104, 'SQ'), (4325393, 'OB')) v(tag, vr)""")
def json_parsing(spark: SparkSession, d: str) -> DataFrame:
    e = elements.json_elements(elements.json_documents(_element_rows(spark, d)))
    return e.select("file_path", "tag", "vr", F.when(F.col("vr") != "SQ", F.array_join("values", "|")).alias("value"), F.col("binary").cast("string").alias("raw"))


@query("""SELECT c_custkey, c_nationkey % 8 AS kind, array_to_string([x FOR x IN [CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE 'units' END, CASE WHEN c_custkey % 3 = 0 THEN 'dose' END, CASE WHEN c_custkey % 5 = 0 THEN 'half_life' END, 'acquired', CASE WHEN c_custkey % 7 = 0 THEN 'weight' END, CASE WHEN c_custkey % 4 = 0 THEN 'size' END, CASE WHEN c_custkey % 6 = 0 THEN 'sex' END] IF x IS NOT NULL], ',') AS lbm,
  CASE WHEN c_custkey % 2 = 0 THEN array_to_string([x FOR x IN [CASE WHEN c_custkey % 3 = 0 THEN 'dose' END, CASE WHEN c_custkey % 5 = 0 THEN 'half_life' END, 'acquired', CASE WHEN c_custkey % 7 = 0 THEN 'weight' END] IF x IS NOT NULL], ',') ELSE array_to_string([x FOR x IN ['units', CASE WHEN c_custkey % 3 = 0 THEN 'dose' END, CASE WHEN c_custkey % 5 = 0 THEN 'half_life' END, 'acquired', CASE WHEN c_custkey % 7 = 0 THEN 'weight' END] IF x IS NOT NULL], ',') END AS bw, 'b' AS lacking FROM customer""")
def uptake_gaps(spark: SparkSession, d: str) -> DataFrame:
    k, none = F.col("c_custkey"), F.lit(None).cast("double")
    have = lambda n, v: F.when(k % n != 0, F.lit(v))
    args = (F.when(k % 2 == 0, "BQML"), have(3, 1.0), none, have(5, 1.0), F.lit(1.0), none, have(7, 70.0), have(4, 1.7), F.when(k % 6 != 0, "Male").otherwise("U"))
    gaps = lambda kind: F.array_join(quantity.uptake_diagnostics(kind, *args), ",")
    lacking = quantity.missing(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("c"), F.lit("a")))
    return table(spark, d, "customer").select("c_custkey", (F.col("c_nationkey") % 8).alias("kind"), gaps("lbm").alias("lbm"), gaps("bw").alias("bw"), F.array_join(lacking, ",").alias("lacking"))


@query(f"""WITH {PIXELS}, v AS (SELECT image_id, list(value ORDER BY place) AS s FROM px GROUP BY image_id)
SELECT image_id, CASE WHEN image_id % 30 < 21 THEN s[CAST((image_id % 30) * 3 + 2 AS INT)] END AS stored, CASE WHEN image_id % 30 < 21 THEN s[CAST(21 + image_id % 30 + 1 AS INT)] END AS planar, CASE WHEN image_id % 30 < 21 THEN s[CAST((image_id % 30) * 3 + 2 AS INT)] * 2.0::DOUBLE - 10 END AS modality, CASE WHEN image_id % 30 < 21 AND s[CAST((image_id % 30) * 3 + 2 AS INT)] <= 2048 THEN s[CAST((image_id % 30) * 3 + 2 AS INT)] * 0.5::DOUBLE END AS physical,
  CASE WHEN image_id % 30 < 21 AND s[CAST((image_id % 30) * 3 + 2 AS INT)] <= 2048 THEN 'map:m' END AS source, s[1] <= 127 AND s[1] >= -128 AS fits, array_to_string(s[CAST(image_id % 10 + 1 AS INT):CAST(image_id % 10 + 4 AS INT)], ',') AS part, list_sum([s[CAST(least(7, (k // 4) * 8 // 4) * 8 + least(7, (k % 4) * 8 // 4) + 1 AS INT)] * (k + 1) FOR k IN range(16)])::BIGINT AS smaller FROM v""")
def pixel_quantities(spark: SparkSession, d: str) -> DataFrame:
    k, s = F.col("image_id"), F.col("pixels")
    stored = quantity.stored_at(s, k % 30, F.lit(1), F.lit(3), F.lit(0))
    q = quantity.quantity_at(stored, F.lit(2.0), F.lit(-10.0), F.lit("HU"), numeric.real_world_value(stored, F.lit(0), F.lit(2048), F.lit(0.5), F.lit(0.0), F.lit(None).cast("array<double>")), F.lit("m"), F.lit("u"))
    small = F.aggregate(F.transform(quantity.resized(s, 8, 8, 4, 4), lambda p, i: (p * (i + 1)).cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return frames(spark, d).select(
        "image_id", q["stored"].alias("stored"), quantity.stored_at(s, k % 30, F.lit(1), F.lit(3), F.lit(1)).alias("planar"), q["modality"].alias("modality"), q["physical"].alias("physical"), q["source"].alias("source"), quantity.in_sample_range(F.get(s, 0), F.lit("signed8")).alias("fits"),
        F.array_join(quantity.pixel_range(s, k % 10, k % 10 + 4).cast("array<string>"), ",").alias("part"), small.alias("smaller"),
    )


@query(r"""SELECT c_custkey, CAST(CASE c_custkey % 4 WHEN 0 THEN c_custkey WHEN 1 THEN 7.5 ELSE 0.0 END AS DOUBLE) AS center, CAST(CASE c_custkey % 3 WHEN 0 THEN 0.5 ELSE 1.0 END AS DOUBLE) AS height, CAST(CASE c_custkey % 3 WHEN 0 THEN 0.25 ELSE 1.0 END AS DOUBLE) AS width, 'img_frame' || lpad(CAST(c_custkey AS VARCHAR), CAST(greatest(4, length(CAST(c_custkey AS VARCHAR))) AS INTEGER), '0') || '.png' AS frame_name, '1.2_3.' || c_custkey || '.dcm' AS stored_name,
  CASE WHEN c_custkey % 2 = 0 THEN 2 END AS points, CASE c_custkey % 3 WHEN 0 THEN 'Bone' WHEN 1 THEN 'Lung' END AS preset, CAST(CASE WHEN c_custkey % 5 = 0 THEN 20.0 WHEN c_custkey % 5 = 1 THEN 10.0 ELSE 25.0 END AS DOUBLE) AS rate, 'a|b|' AS many, CASE c_custkey % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'F' ELSE 'U' END AS sex, 'A/' || c_custkey AS path, CASE WHEN c_custkey % 2 = 0 THEN 'extract' ELSE 'reject' END AS zip, 'x' AS filled, 'x - y' AS joined, 'US' AS vr, CASE WHEN c_custkey % 2 = 0 THEN '030Y' ELSE '40Y' END AS age, c_custkey % 2 = 0 AS oriented,
  CAST(CASE WHEN c_custkey % 2 = 0 THEN 30 ELSE c_custkey * 2.0 + 1 END AS DOUBLE) AS modality, CAST(0.5 * (c_custkey % 9 + 1) AS DOUBLE) AS seconds, TIMESTAMP '2020-02-03 04:05:00' AS at FROM customer""")
def header_functions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    word = k.cast("string")
    window = _pick(("", "7.5", "a\\b\\c", "x"), k % 4)
    window = F.when(k % 4 == 0, F.concat(F.lit("1\\"), word)).otherwise(window)
    contour = quantity.contour_points(F.array(*(F.lit(float(i)) for i in range(7))), F.when(k % 2 == 0, 2).otherwise(3))
    none = F.lit(None).cast("double")
    table_of = F.when(k % 2 == 0, F.array(*map(F.lit, (10.0, 20.0, 30.0))))
    axes = F.array(*map(F.lit, (1.0, 0.0, 0.0, 0.0)), F.when(k % 2 == 0, 1.0).otherwise(0.5), F.lit(0.0))
    return table(spark, d, "customer").select(
        "c_custkey", quantity.window_number(window).alias("center"), *(quantity.spacing_of(_pick(("0.5\\0.25", "0.5", "1\\2\\3"), k % 3))[c].alias(c) for c in ("height", "width")), quantity.frame_file_name(F.lit("img"), k - 1, k, "png").alias("frame_name"), quantity.stored_file_name(F.concat(F.lit("1.2/3."), word)).alias("stored_name"),
        F.when(contour.isNotNull(), F.size(contour)).alias("points"), numeric.preset_named(_pick(("BONE", "lung", "none"), k % 3))["name"].alias("preset"), numeric.frame_rate(F.when(k % 5 == 0, 20.0), F.when(k % 5 == 1, 10.0), F.lit(40.0)).alias("rate"), F.array_join(text.multi_values(F.lit("a \\ b\\")), "|").alias("many"), text.sex_of(_pick((" m", "F", "x"), k % 3)).alias("sex"),
        text.file_id_path(F.array(F.lit("A"), word)).alias("path"), text.zip_entry_disposition(F.concat(F.when(k % 2 == 0, "a/").otherwise("../"), word)).alias("zip"), text.first_filled(F.lit(" "), F.lit(" x")).alias("filled"), text.joined(" - ", F.lit("x"), F.lit(" "), F.lit("y")).alias("joined"), text.vr_of_entry(F.lit("USRows")).alias("vr"),
        text.display_age(F.when(k % 2 == 0, "030Y"), F.lit("19800101"), F.lit("2020-06-01").cast("date")).alias("age"), numeric.valid_orientation(axes).alias("oriented"), numeric.modality_value(F.when(k % 2 == 0, 9).otherwise(k), F.lit(2.0), F.lit(1.0), F.lit(0), table_of).cast("double").alias("modality"),
        numeric.duration_seconds(F.array().cast("array<double>"), (k % 9 + 1).cast("double"), F.lit(500.0), none).alias("seconds"), text.study_datetime(F.lit("20200203"), F.lit("0405")).alias("at"),
    )


@query("""SELECT event_id, event_type, CASE WHEN event_id % 3 = 0 THEN 0 ELSE CAST(event_id % 4 AS INT) END AS attempts, CASE WHEN event_id % 3 = 0 THEN 'pending' WHEN event_id % 4 >= 3 THEN 'failed' ELSE 'pending' END AS state FROM events WHERE event_id % 3 = 0 OR event_id % 4 > 0""")
def store_queue(spark: SparkSession, d: str) -> DataFrame:
    """A round of a queue: entries that failed count on, the others are done; every third is reset."""
    e = table(spark, d, "events").select("event_id", "event_type", (F.col("event_id") % 4 - 1).cast("int").alias("attempts"), F.lit("pending").alias("state"), (F.col("event_id") % 3 == 0).alias("again"))
    failed = e.where("event_id % 4 > 0 and not again")
    after = ingest.retry_queue(e.where("not again"), failed, "event_id", most=3).drop("again")
    reset = e.where("again").withColumns({"attempts": F.lit(3), "state": F.lit("failed"), "one": F.lit("x")})
    return after.unionByName(ingest.reset_failed(reset, "one", "x").drop("one", "again")).select("event_id", "event_type", "attempts", "state")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' AND o_orderkey = (SELECT max(o_orderkey) FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT')")
def instance_lookup(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    last = o.where("o_orderstatus = 'O' and o_orderpriority = '1-URGENT'").agg(F.max("o_orderkey").cast("string").alias("m")).first().m
    i = o.select(F.col("o_orderstatus").alias("study_uid"), F.col("o_orderpriority").alias("series_uid"), F.col("o_orderkey").cast("string").alias("sop_uid"), "o_orderkey", "o_orderstatus")
    return search.instance_at(i, "O", "1-URGENT", last or "").select("o_orderkey", "o_orderstatus")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE CASE WHEN o_orderkey % 4 = 0 THEN 'MR' ELSE o_orderstatus END = 'MR' OR o_orderstatus = 'F' AND o_orderkey % 4 = 0")
def modality_fallback(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumns({"modalities_in_study": F.when(F.col("o_orderkey") % 4 == 0, F.array(F.lit("MR"), F.lit("CT"))).otherwise(F.array().cast("array<string>")), "modality": F.col("o_orderstatus")})
    return o.where(search.study_filter(o.columns, modality="MR")).select("o_orderkey", "o_orderstatus")


@query("""SELECT conv_id, turn, length(text) AS num, list_aggregate(list_sort([x FOR x IN [NULL] IF x IS NOT NULL]), 'string_agg', ',') AS sources FROM conversations WHERE turn = 0 AND false
UNION ALL SELECT c.conv_id, c.turn, length(c.text) AS num, CASE WHEN n.text IS NULL THEN '' ELSE n.role END AS sources FROM conversations c LEFT JOIN conversations n ON n.conv_id = c.conv_id AND n.turn = c.turn + 1 WHERE c.turn % 2 = 0""")
def report_measurements(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    even = F.col("turn") % 2 == 0
    items = c.select(F.col("conv_id").alias("doc"), F.col("turn").alias("id"), F.when(~even, F.col("turn") - 1).alias("parent"), F.lit(0).alias("ord"), F.when(even, "NUM").otherwise("IMAGE").alias("value_type"), F.col("role").alias("text"), F.lit("c").alias("code"), F.length("text").alias("num"), F.lit("mm").alias("unit"))
    m = links.measurements(items)
    return m.select(F.col("doc").alias("conv_id"), F.col("id").alias("turn"), "num", F.coalesce(F.array_join("sources", ","), F.lit("")).alias("sources"))
