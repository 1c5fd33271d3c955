"""Plans, segmentations, functional groups, reports, captures and vendor headers over the driver's tables."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import objects
from .registry import query
from .tables import spread, table


def _text(path: str, value: Column, there: Column | None = None) -> Column:
    e = F.struct(F.lit(path).alias("path"), F.array(value.cast("string")).alias("values"), F.array().cast("array<double>").alias("numbers"))
    return e if there is None else F.when(there, e)


def _number(path: str, *values: Column | float, there: Column | None = None) -> Column:
    numbers = F.array(*((v if isinstance(v, Column) else F.lit(v)).cast("double") for v in values))
    e = F.struct(F.lit(path).alias("path"), numbers.cast("array<string>").alias("values"), numbers.alias("numbers"))
    return e if there is None else F.when(there, e)


def _rows(docs: DataFrame, key: str, *elements: Column) -> DataFrame:
    return docs.select(F.col(key).cast("string").alias("file_path"), F.explode(F.array_compact(F.array(*elements))).alias("e")).select("file_path", "e.*")


def _plans(spark: SparkSession, d: str) -> DataFrame:
    k, numbered = F.col("c_custkey"), F.expr("c_custkey % 4 <> 0")
    return _rows(
        spread(table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey"), "c_custkey",
        _number("300A00B0[0]/300A00C0", k % 5, there=numbered), _text("300A00B0[0]/300A00C2", F.col("c_name")), _number("300A00B0[0]/300A00B4", 1000.0), _number("300A00B0[1]/300A00C0", 9), _text("300A00B0[1]/300A00C2", F.lit(" ")),
        _number("300A00B0[0]/300A0111[0]/300A0112", 0), _number("300A00B0[0]/300A0111[0]/300A011E", k % 360), _number("300A00B0[0]/300A0111[0]/300A012C", 1.0, 2.0, 3.0),
        _number("300A00B0[0]/300A0111[1]/300A0112", 1), _number("300A00B0[0]/300A0111[1]/300A012C", 1.0, 2.0), _number("300A00B0[1]/300A0111[0]/300A011E", 10.0),
    )


@query("""SELECT CAST(c_custkey AS VARCHAR) AS file_path, 0 AS place, CAST(c_custkey % 5 AS INT) AS number, c_name AS name, CAST(1000 AS DOUBLE) AS source_axis_distance FROM customer WHERE c_custkey % 4 <> 0
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 1, 9, NULL, NULL FROM customer""")
def plan_beams(spark: SparkSession, d: str) -> DataFrame:
    return objects.beams(_plans(spark, d)).select("file_path", "place", "number", "name", "source_axis_distance")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS file_path, CAST(c_custkey % 5 AS INT) AS beam, p AS place, p AS point, CASE WHEN p = 0 THEN CAST(c_custkey % 360 AS DOUBLE) END AS gantry_angle, CASE WHEN p = 0 THEN '1,2,3' END AS isocenter FROM customer, (VALUES (0), (1)) v(p) WHERE c_custkey % 4 <> 0""")
def plan_control_points(spark: SparkSession, d: str) -> DataFrame:
    points = objects.control_points(_plans(spark, d))
    return points.select("file_path", "beam", "place", "point", "gantry_angle", F.when(F.col("isocenter").isNotNull(), F.array_join(F.transform("isocenter", lambda x: x.cast("int").cast("string")), ",")).alias("isocenter"))


def _frame_headers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("file_path"), (F.col("s_suppkey") % 3 + 1).cast("int").alias("frames"))


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS file_path, f AS frame, CASE WHEN f = 0 AND s_suppkey % 2 = 1 THEN 2 ELSE 1 END AS segment FROM supplier, (VALUES (0), (1), (2)) v(f) WHERE f <= s_suppkey % 3 AND NOT (s_suppkey % 2 = 1 AND s_suppkey % 5 = 0 AND s_suppkey % 3 > 0)""")
def segment_frames(spark: SparkSession, d: str) -> DataFrame:
    odd, named = F.expr("s_suppkey % 2 = 1"), F.expr("s_suppkey % 5 <> 0")
    e = _rows(
        table(spark, d, "supplier"), "s_suppkey",
        _number("00620002[0]/00620004", 1), _text("00620002[0]/00620005", F.lit("liver")), _number("00620002[1]/00620004", 2), _text("00620002[1]/00620005", F.when(odd, "lung").otherwise(" ")),
        _number("52009230[0]/0062000A[0]/0062000B", 2, there=odd), *(_number(f"52009230[{f}]/0062000A[0]/0062000B", 1, there=named) for f in (1, 2)),
    )
    return objects.segment_frames(_frame_headers(spark, d), e)


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS file_path, f AS frame, CAST(CASE WHEN f = 1 THEN 1 ELSE 0.5 END AS DOUBLE) AS spacing, CASE WHEN s_suppkey % 7 <> 0 THEN CAST(f AS DOUBLE) END AS y, 6 AS axes,
  CASE WHEN s_suppkey % 2 = 0 THEN CAST(2 AS DOUBLE) END AS slope, CASE WHEN s_suppkey % 2 = 0 THEN CAST(0 AS DOUBLE) END AS intercept, CASE WHEN f = 2 THEN '1.' || s_suppkey END AS source FROM supplier, (VALUES (0), (1), (2)) v(f) WHERE f <= s_suppkey % 3 AND s_suppkey % 10 <> 9""")
def frame_groups(spark: SparkSession, d: str) -> DataFrame:
    s, even = F.col("s_suppkey"), F.expr("s_suppkey % 2 = 0")
    docs = table(spark, d, "supplier")
    positions = [e for f in range(3) for e in (_number(f"52009230[{f}]/00209113[0]/00200032", s, float(f), 1.0, there=F.expr("s_suppkey % 7 <> 0")), _number(f"52009230[{f}]/00209113[0]/00200032", s, float(f), there=F.expr("s_suppkey % 7 = 0")))]
    e = _rows(
        docs.where("s_suppkey % 10 <> 9"), "s_suppkey",
        _number("52009229[0]/00289110[0]/00280030", 0.5, 0.5), _number("52009229[0]/00209116[0]/00200037", 1.0, 0.0, 0.0, 0.0, 1.0, 0.0), _number("52009229[0]/00289145[0]/00281053", 2.0, there=even),
        _number("52009230[1]/00289110[0]/00280030", 1.0, 2.0), *positions, _text("52009230[2]/00089124[0]/00082112[0]/00081155", F.concat(F.lit("1."), s.cast("string"))),
    )
    g = objects.functional_groups(_frame_headers(spark, d), e)
    return g.select("file_path", "frame", F.get("pixel_measures.spacing", 0).alias("spacing"), F.get("plane_position.position", 1).alias("y"), F.size("plane_orientation.orientation").alias("axes"), "transformation.slope", "transformation.intercept", F.col("derivation.source_uid").alias("source"))


@query(f"""WITH p AS (SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN '{objects.SEGMENTATION}' WHEN 1 THEN '{objects.DOSE}' WHEN 2 THEN '{objects.PARAMETRIC_MAP}' WHEN 3 THEN '1.2.840.10008.5.1.4.1.1.2' ELSE '' END AS sop,
    CASE WHEN p_partkey % 7 = 0 THEN 'float' WHEN p_partkey % 11 = 0 THEN 'double' WHEN p_partkey % 3 <> 0 THEN 'integer' ELSE 'none' END AS element FROM part),
f AS (SELECT *, CASE k % 5 WHEN 0 THEN 'segmentation' WHEN 1 THEN 'rt-dose' WHEN 2 THEN 'parametric-map' ELSE CASE element WHEN 'float' THEN 'float-pixel-data' WHEN 'double' THEN 'double-float-pixel-data' ELSE 'classic-image' END END AS family FROM p)
SELECT k AS part, element, family, CASE family WHEN 'classic-image' THEN 'image-display-input' WHEN 'segmentation' THEN 'overlay-or-segmentation' WHEN 'rt-dose' THEN 'dose-grid' WHEN 'parametric-map' THEN 'volume-input' ELSE 'out-of-scope' END AS role,
  CASE WHEN family = 'classic-image' THEN 'classic-pipelines' WHEN family LIKE '%float%' THEN 'unsupported' ELSE 'typed-payload' END AS status,
  CASE WHEN family = 'segmentation' AND k % 2 = 1 THEN 'no segments' WHEN family = 'rt-dose' THEN CASE WHEN k % 4 = 0 THEN 'no dose grid' WHEN k % 6 = 0 THEN 'no dose grid scaling' WHEN k % 9 = 0 AND k % 3 <> 1 THEN 'no grid frame offsets' END
    WHEN family = 'parametric-map' AND k % 2 = 0 THEN 'no real world values' WHEN family = 'classic-image' AND element <> 'integer' THEN 'no pixel data' WHEN family LIKE '%float%' THEN 'no consumer of float pixels' END AS problem FROM f""")
def object_payloads(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").withColumn("k", F.col("p_partkey"))
    sop = F.get(F.array(*map(F.lit, (objects.SEGMENTATION, objects.DOSE, objects.PARAMETRIC_MAP, "1.2.840.10008.5.1.4.1.1.2", ""))), (F.col("k") % 5).cast("int"))
    p = p.withColumn("element", objects.pixel_element(F.expr("k % 7 = 0"), F.expr("k % 11 = 0"), F.expr("k % 3 <> 0"))).withColumn("f", objects.object_family(sop, F.col("element")))
    problem = objects.payload_problem(F.col("f.family"), F.col("element"), F.expr("k % 2 = 0"), F.expr("k % 4 <> 0"), F.expr("if(k % 6 = 0, '', '0.1')"), F.expr("k % 9"), F.expr("k % 3"), F.expr("k % 2 = 1"))
    return p.select(F.col("k").alias("part"), "element", "f.family", "f.role", "f.status", problem.alias("problem"))


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN concat_ws(',', CASE WHEN o_orderkey % 5 = 0 THEN 'Patient Name' END, CASE WHEN o_orderkey % 7 = 0 THEN 'Study ID' END, CASE WHEN o_orderkey % 3 = 0 THEN 'Series Number' END) ELSE '' END AS missing FROM orders""")
def capture_issues(spark: SparkSession, d: str) -> DataFrame:
    uid = F.concat(F.lit("1.2."), F.col("o_orderkey").cast("string"))
    values = {
        "SOP Instance UID": uid, "Study Instance UID": uid, "Series Instance UID": uid, "Patient Name": F.expr("if(o_orderkey % 5 = 0, NULL, 'A^B')"), "Patient ID": F.col("o_custkey"),
        "Study ID": F.expr("if(o_orderkey % 7 = 0, ' ', 'S')"), "Study Date": F.date_format("o_orderdate", "yyyyMMdd"), "Series Number": F.expr("if(o_orderkey % 3 = 0, NULL, 1)"), "Instance Number": F.lit(1),
    }
    return table(spark, d, "orders").select("o_orderkey", F.array_join(objects.capture_issues(values, F.expr("o_custkey % 2 = 0")), ",").alias("missing"))


_CODE = "struct<code:string,scheme:string>"
_REFERENCES = "array<struct<sop_class:string,sop_uid:string>>"
_ITEM = f"path string, relationship string, value_type string, concept {_CODE}, text string, code {_CODE}, number double, units {_CODE}, references {_REFERENCES}, graphic_type string, graphic_data array<double>, uid string, date_time string, date string, time string, person_name string"


def _item(path: str, kind: str, relationship: str = "NULL", concept: str = "named_struct('code', '1', 'scheme', 'SCT')", **values: str) -> Column:
    """An item by SQL expressions; what is not named is null."""
    given = {"path": f"'{path}'", "relationship": relationship, "value_type": f"'{kind}'", "concept": concept} | values
    names = [part.split(" ", 1) for part in _ITEM.split(", ")]
    return F.struct(*(F.expr(f"CAST({given.get(n, 'NULL')} AS {t})").alias(n) for n, t in names))


@query("""WITH c AS (SELECT CAST(c_custkey AS VARCHAR) AS file_path, c_custkey AS k FROM customer)
SELECT file_path, 'root/0' AS path, 'missing number' AS issue, NULL AS detail FROM c WHERE k % 2 = 0 UNION ALL SELECT file_path, 'root/0.measurementUnits', 'unsupported coding scheme', 'X' FROM c WHERE k % 5 = 0 UNION ALL SELECT file_path, 'root/0', 'unsupported unit scheme', 'X' FROM c WHERE k % 5 = 0
UNION ALL SELECT file_path, 'root/1', 'missing value', 'TEXT' FROM c WHERE k % 3 = 0 UNION ALL SELECT file_path, 'root/1', 'missing relationship', NULL FROM c WHERE k % 4 = 0 UNION ALL SELECT file_path, 'root/1.conceptName', 'missing concept name', NULL FROM c WHERE k % 7 = 0
UNION ALL SELECT file_path, 'root/2', 'unsupported value type', 'SCOORD' FROM c UNION ALL SELECT file_path, 'root/2', 'invalid graphic data', 'POINT ' || (k % 4) FROM c WHERE k % 4 <> 2
UNION ALL SELECT file_path, 'root/3', 'unsupported relationship by reference', 'R-CONTAINS' FROM c UNION ALL SELECT file_path, 'root/3', 'missing referenced object', NULL FROM c WHERE k % 6 = 0 UNION ALL SELECT file_path, 'root/3.referencedSOP[1]', 'missing referenced object', NULL FROM c WHERE k % 6 <> 0 AND k % 2 = 1
UNION ALL SELECT file_path, NULL, 'unsupported class', 'x' FROM c WHERE k % 4 = 3 UNION ALL SELECT file_path, NULL, 'unsupported template', NULL FROM c WHERE k % 4 < 2 AND k % 5 = 0 UNION ALL SELECT file_path, NULL, 'unsupported template', '1500' FROM c WHERE k % 4 = 2 AND k % 5 <> 0
UNION ALL SELECT file_path, 'root', 'unsupported root concept', 'DCM/7' FROM c WHERE k % 4 < 2 AND k % 3 = 0 UNION ALL SELECT file_path, NULL, 'missing evidence', NULL FROM c WHERE k % 4 = 2 AND k % 3 = 0 UNION ALL SELECT file_path, 'evidence[0]', 'missing referenced object', NULL FROM c WHERE k % 8 = 0""")
def report_issues(spark: SparkSession, d: str) -> DataFrame:
    """Both rule sets over reports of five items."""
    docs = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("file_path"), F.col("c_custkey").alias("k"))
    root = "named_struct('code', if(k % 3 = 0, '7', '126000'), 'scheme', 'DCM')"
    items = F.array(
        _item("root", "CONTAINER", concept=root),
        _item("root/0", "NUM", "'CONTAINS'", number="if(k % 2 = 0, NULL, 1.5)", units="named_struct('code', 'mm', 'scheme', if(k % 5 = 0, 'X', 'UCUM'))"),
        _item("root/1", "TEXT", "if(k % 4 = 0, NULL, 'CONTAINS')", "if(k % 7 = 0, NULL, named_struct('code', '1', 'scheme', 'SCT'))", text="if(k % 3 = 0, ' ', 'seen')"),
        _item("root/2", "SCOORD", "'HAS OBS CONTEXT'", graphic_type="'POINT'", graphic_data="array_repeat(1.0, CAST(k % 4 AS INT))"),
        _item("root/3", "IMAGE", "'R-CONTAINS'", references="if(k % 6 = 0, array(), array(named_struct('sop_class', 'a', 'sop_uid', 'b'), named_struct('sop_class', 'a', 'sop_uid', if(k % 2 = 1, ' ', 'c'))))"),
    )
    rows = docs.select("file_path", F.explode(items).alias("i")).select("file_path", "i.*")
    kinds = F.get(F.array(*map(F.lit, (objects.ENHANCED_REPORT, objects.COMPREHENSIVE_REPORT, objects.KEY_OBJECTS, "x"))), (F.col("k") % 4).cast("int"))
    reports = docs.select(
        "file_path", kinds.alias("sop_class"), F.expr("if(k % 5 = 0, NULL, '1500')").alias("template"), F.lit("CONTAINER").alias("value_type"), F.expr(root).alias("concept"),
        F.expr("if(k % 8 = 0, array(named_struct('sop_class', 'a', 'sop_uid', CAST(NULL AS STRING))), array())").cast(_REFERENCES).alias("evidence"), (F.col("k") % 3).cast("int").alias("n_key_references"),
    )
    return objects.item_issues(rows).unionByName(objects.document_issues(reports))


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def tag(name: str, vr: str, values: list[str]) -> bytes:
        items = b"".join(struct.pack("<IIII", len(v), 0, 77, 0) + v.encode() + b"\0" * (-len(v) % 4) for v in values)
        return struct.pack("<64sI4sIII", name.encode(), len(values), vr.encode(), 1, len(values), 77) + items

    for batch in batches:
        out = []
        for key, brand in zip(batch["key"].to_pylist(), batch["brand"].to_pylist(), strict=True):
            data = struct.pack("<II", 2, 77) + tag("EchoTime", "DS", [str(key), " ", "7\0x"]) + tag("Maker", "LO", [brand])
            out.append((b"SV10\4\3\2\1" if key % 2 == 0 else b"") + (data[:-9] if key % 10 == 0 else data))
        yield pa.RecordBatch.from_arrays([pa.array([str(k) for k in batch["key"].to_pylist()]), pa.array(["00291010"] * len(out)), pa.array(out, pa.binary())], ["file_path", "path", "binary"])


@query("""SELECT CAST(p_partkey AS VARCHAR) AS file_path, name, vr, vm, CASE name WHEN 'Maker' THEN p_brand ELSE p_partkey || ',7' END AS value FROM part, (VALUES ('EchoTime', 'DS', CAST(3 AS BIGINT)), ('Maker', 'LO', 1)) v(name, vr, vm) WHERE p_partkey % 10 <> 0""")
def vendor_tags(spark: SparkSession, d: str) -> DataFrame:
    """Vendor headers with and without their mark; those cut short are none."""
    raw = table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("brand")).mapInArrow(_headers, "file_path string, path string, binary binary")
    return objects.vendor_headers(raw).select("file_path", F.explode("tags").alias("t")).select("file_path", "t.name", "t.vr", "t.vm", F.array_join("t.values", ",").alias("value"))
