from __future__ import annotations

import struct

import pytest
from pyspark.sql import functions as F

from voxlake.operators import objects
from voxlake.sources import part10


def _rows(spark, elements, syntax=part10.EXPLICIT_LE):
    content = part10.write(elements, syntax)
    return part10.element_rows(part10.elements(spark.createDataFrame([("a.dcm", content)], "file_path string, content binary")))


@pytest.mark.parametrize("syntax", [part10.EXPLICIT_LE, part10.IMPLICIT_LE])
def test_beams_of_a_written_plan(spark, syntax):
    point = [(0x300A0112, "IS", "0"), (0x300A011E, "DS", "90.5"), (0x300A012C, "DS", "1\\2\\3\\4")]
    rows = _rows(spark, [(0x300A00B0, "SQ", [[(0x300A00C0, "IS", "4"), (0x300A00C2, "LO", "first"), (0x300A0111, "SQ", [point, [(0x300A011E, "DS", "1")]])], [(0x300A00C2, "LO", "no number"), (0x300A0111, "SQ", [point])]])], syntax)
    assert [(b.place, b.number, b.name) for b in objects.beams(rows).collect()] == [(0, 4, "first")]
    assert [(p.beam, p.point, p.gantry_angle, p.isocenter) for p in objects.control_points(rows).collect()] == [(4, 0, 90.5, [1.0, 2.0, 3.0])]


def test_segments_of_a_written_segmentation(spark):
    rows = _rows(spark, [(0x00620002, "SQ", [[(0x00620004, "US", [3]), (0x00620005, "LO", "liver"), (0x00620003, "SQ", [[(0x00080104, "LO", "Tissue")]])]]), (0x52009230, "SQ", [[(0x0062000A, "SQ", [[(0x0062000B, "US", [7])]])]])])
    assert [(s.number, s.label, s.category) for s in objects.segments(rows).collect()] == [(3, "liver", "Tissue")]
    headers = spark.createDataFrame([("a.dcm", 2), ("b.dcm", 1)], "file_path string, frames int")
    assert sorted((f.frame, f.segment) for f in objects.segment_frames(headers, rows).collect()) == [(0, 7), (1, 3)]


def test_frames_without_known_groups_still_count(spark):
    rows = _rows(spark, [(0x52009229, "SQ", [[(0x00089999, "LO", "other")]])])
    headers = spark.createDataFrame([("a.dcm", 2), ("b.dcm", 1)], "file_path string, frames int")
    frames = objects.functional_groups(headers, rows).orderBy("frame").collect()
    assert [(f.file_path, f.frame, f.pixel_measures) for f in frames] == [("a.dcm", 0, None), ("a.dcm", 1, None)]


def test_sources_of_frames(spark):
    source = lambda uid: [(0x00081150, "UI", "1.2"), (0x00081155, "UI", uid)]
    rows = _rows(spark, [(0x52009230, "SQ", [[(0x00089124, "SQ", [[(0x00082112, "SQ", [source("5"), source("6")])]])]])])
    assert sorted((s.frame, s.source, s.sop_uid) for s in objects.frame_sources(rows).collect()) == [(0, 0, "5"), (0, 1, "6")]


def test_vendor_tags_cut_anywhere_are_none():
    items = struct.pack("<IIII", 3, 0, 77, 0) + b"abc\0"
    data = struct.pack("<II", 1, 77) + struct.pack("<64sI4sIII", b"Name\0junk", 1, b"LO\0\0", 1, 1, 77) + items
    assert objects.vendor_tags(data) == [{"name": "Name", "vr": "LO", "vm": 1, "values": ["abc"]}] == objects.vendor_tags(b"SV10\4\3\2\1" + data)
    assert all(objects.vendor_tags(data[:n]) is None for n in range(len(data)))
    assert objects.vendor_tags(struct.pack("<II", 0, 77)) is None


def test_objects_without_anything(spark):
    row = spark.range(1).select(objects.pixel_element(*[F.lit(None).cast("boolean")] * 3).alias("e")).withColumn("f", objects.object_family(F.lit(None).cast("string"), F.col("e")))
    none, no = F.lit(None).cast("int"), F.lit(None).cast("boolean")
    row = row.select("e", "f.family", objects.payload_problem(F.col("f.family"), F.col("e"), no, no, F.lit(None).cast("string"), none, none, no).alias("p")).first()
    assert tuple(row) == ("none", "classic-image", "no pixel data")


@pytest.mark.parametrize("syntax", [part10.EXPLICIT_LE, part10.IMPLICIT_LE])
def test_items_of_a_written_report(spark, syntax):
    code = lambda value, scheme: [(0x00080100, "SH", value), (0x00080102, "SH", scheme)]
    number = [(0x0040A010, "CS", "CONTAINS"), (0x0040A040, "CS", "NUM"), (0x0040A043, "SQ", [code("1", "SCT")]), (0x0040A300, "SQ", [[(0x0040A30A, "DS", "2.5"), (0x004008EA, "SQ", [code("mm", "UCUM")])]])]
    image = [(0x0040A010, "CS", "SELECTED FROM"), (0x0040A040, "CS", "IMAGE"), (0x00081199, "SQ", [[(0x00081150, "UI", "1.2"), (0x00081155, "UI", "5")], [(0x00081150, "UI", "1.2")]])]
    drawn = [(0x0040A040, "CS", "SCOORD"), (0x00700022, "FL", [1.0, 2.0]), (0x00700023, "CS", "POINT")]
    report = [(0x0040A040, "CS", "CONTAINER"), (0x0040A043, "SQ", [code("126000", "DCM")]), (0x0040A730, "SQ", [number, [(0x0040A730, "SQ", [image, drawn])], [(0x0040A121, "DA", "20200101")]])]
    items = {i.path: i for i in objects.content_items(_rows(spark, report, syntax)).collect()}
    assert sorted(items) == ["root", "root/0", "root/1", "root/1/0", "root/1/1"]
    assert (items["root/0"].number, tuple(items["root/0"].units), tuple(items["root"].concept)) == (2.5, ("mm", "UCUM"), ("126000", "DCM"))
    assert items["root/1"].value_type == "CONTAINER" and items["root/1/1"].graphic_data == [1.0, 2.0]
    assert [tuple(r) for r in items["root/1/0"].references] == [("1.2", "5"), ("1.2", None)]
    issues = {(i.path, i.issue) for i in objects.item_issues(objects.content_items(_rows(spark, report, syntax))).collect()}
    assert ("root/1/0.referencedSOP[1]", "missing referenced object") in issues and ("root/1", "missing relationship") in issues and not any(p.startswith("root/0") for p, _ in issues)
