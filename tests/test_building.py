"""Nested trees to bytes, and objects built and read again."""

from __future__ import annotations

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlake.functions import decoding, encoding
from voxlake.operators import links
from voxlake.operators.running import with_running_sums
from voxlake.sources import building, media, nesting, part10

ROWS = "file_path string, path string, vr string, value binary"


def test_numbers_as_bytes_and_back(spark):
    values = [0.0, 1.0, -1.5, 3.14159, 1e-40, -1e38, 65535.0, 2.0**-126, 1e-45, float("inf"), float("nan"), 16777217.0]
    row = spark.createDataFrame([(values, [0, 1, 65535, -1, 258], [7, 2**32 - 1])], "x array<double>, w array<int>, l array<bigint>").select(
        encoding.numbers(F.col("x"), "FL").alias("fl"), encoding.numbers(F.col("w"), "US").alias("us"), encoding.numbers(F.col("l"), "UL").alias("ul"), encoding.numbers(F.array().cast("array<int>"), "US").alias("none")
    ).first()
    assert row.fl == np.array(values, "<f4").tobytes() and row.us == struct.pack("<5H", 0, 1, 65535, 65535, 258) and row.ul == struct.pack("<2I", 7, 2**32 - 1) and row.none == b""
    double = np.array([0.0, -2.5, 1e300, 5e-324, float("-inf")], "<f8")
    back = spark.createDataFrame([(bytes(row.fl), double.tobytes(), double.astype(">f8").tobytes(), bytes(row.us) + b"x")], "fl binary, fd binary, be binary, us binary").select(
        decoding.real_numbers(F.col("fl"), "FL").alias("fl"), decoding.real_numbers(F.col("fd"), "FD").alias("fd"), decoding.real_numbers(F.col("be"), "FD", True).alias("be"), decoding.whole_numbers(F.col("us"), 2, True).alias("us"), decoding.whole_numbers(F.lit(b"\1"), 2).alias("none")
    ).first()
    assert np.array_equal(np.array(back.fl, np.float32), np.array(values, np.float32), equal_nan=True)
    assert back.fd == double.tolist() == back.be and back.us == [0, 1, -1, -1, 258] and back.none == []


@pytest.fixture
def tree():
    """A tree of some depth, with empty sequences and items, odd values, and more than nine items."""
    deep = [(0x0040A160, "UT", "x")]
    for i in range(6):
        deep = [(0x0040A730, "SQ", [deep, []] if i % 2 else [[], deep]), (0x0040A040, "CS", f"L{i}")]
    items = [[(0x00081155, "UI", f"1.{i}")] for i in range(12)]
    return [(0x00080005, "CS", "ISO_IR 192"), (0x00100010, "PN", "Öd^é"), (0x00081115, "SQ", items), (0x00081140, "SQ", []), *deep]


def flat(rows, before=""):
    for tag, vr, value in rows:
        path = f"{before}{tag:08X}"
        if vr == "SQ":
            if not value:
                yield "f", path, "SQ", None
            for i, item in enumerate(value):
                if not item:
                    yield "f", f"{path}[{i}]", None, None
                yield from flat(item, f"{path}[{i}]/")
        else:
            yield "f", path, vr, value.encode()


def test_trees_are_written_as_by_recursion(spark, tree):
    rows = spark.createDataFrame([*flat(tree), ("f", "00100020", "LO", None)], ROWS)
    heads = spark.createDataFrame([("f", b"HEAD"), ("none", b"H")], "file_path string, head binary")
    nodes = nesting.nodes(rows)
    found = {r.file_path: bytes(r.content) for r in nesting.files(nodes, heads).collect()}
    want = part10._encode(sorted(tree, key=lambda r: r[0]), True, "<")
    assert found == {"f": b"HEAD" + want, "none": b"H"}
    for r in nesting.with_offsets(nodes, heads).collect():
        assert found["f"][r.offset : r.offset + len(r.bytes)] == bytes(r.bytes)
    assert nesting.files(nesting.nodes(rows.where("false")), heads.where("false")).count() == 0


def test_running_sums_of_groups_that_are_spread(spark):
    rows = [(None if i % 3 == 0 else i % 3, i, None if i == 4 else i) for i in range(200)]
    df = spark.createDataFrame(rows, "g int, o int, v bigint").repartition(7)
    want, sums = {}, {}
    for g, o, v in rows:
        want[g, o] = sums.get(g, 0)
        sums[g] = want[g, o] + (v or 0)
    assert {(r.g, r.o): r.before for r in with_running_sums(df, ["g"], ["o"], {"before": "v"}).collect()} == want
    assert with_running_sums(df.where("false"), ["g"], ["o"], {"before": "v"}).count() == 0


def test_directory_files(spark):
    kinds = "file_path string, place int, patient_id string, patient_name string, study_uid string, study_id string, study_date string, series_uid string, modality string, series_number int, file_id array<string>, sop_class string, sop_uid string, transfer_syntax string, instance_number int"
    rows = [("d", i, f"p{i % 2}", None if i % 2 else "N^a", f"1.{i % 4}", "s", None, f"2.{i % 8}", "MR", i % 8, ["IMG", f"F{i}"], None, f"3.{i}", None, i) for i in range(24)]
    sets = spark.createDataFrame([("d", "SET", "9.1"), ("empty", None, "9.2")], "file_path string, file_set_id string, sop_uid string")
    files = building.directory_files(spark.createDataFrame(rows, kinds), sets)
    parsed = part10.elements(files, strict=True)
    records = media.directory_records(part10.element_rows(parsed))
    reached = links.linked_records(spark, records).join(records, ["directory", "offset"]).orderBy("place").collect()
    assert len(reached) == 2 + 4 + 8 + 24 and [r.place for r in reached] == list(range(38))
    by_offset = {r.offset: r for r in reached}
    for r in reached:
        if r.type == "IMAGE":
            series = by_offset[r.parent]
            study = by_offset[series.parent]
            i = int(r.file_id[5:])
            assert (series.series_uid, study.study_uid, by_offset[study.parent].patient_id) == (f"2.{i % 8}", f"1.{i % 4}", f"p{i % 2}")
    assert [r.type for r in reached if r.next == 0 and r.depth == 0] == ["PATIENT"] and sum(r.root for r in reached) == 1
    empty = {e.path: e for e in parsed.where("file_path = 'empty'").first().elements}
    assert empty["00041200"].numbers == [0.0] and empty["00041220"].length == 0


def test_directory_files_in_pieces(spark):
    """No value or parse holds more than a piece's records, and the pieces' elements are those of the whole files."""
    kinds = "file_path string, place int, patient_id string, patient_name string, study_uid string, study_id string, study_date string, series_uid string, modality string, series_number int, file_id array<string>, sop_class string, sop_uid string, transfer_syntax string, instance_number int"
    rows = [(d, i, f"p{i % 2}", "N^a", f"1.{i % 4}", "s", None, f"2.{i % 8}", "MR", i % 8, ["IMG", f"F{i}"], None, f"3.{i}", None, i) for d in "de" for i in range(24)]
    images = spark.createDataFrame(rows, kinds)
    sets = spark.createDataFrame([("d", "SET", "9.1"), ("e", "SET", "9.1"), ("empty", None, "9.2")], "file_path string, file_set_id string, sop_uid string")
    whole = {r.file_path: bytes(r.content) for r in building.directory_files(images, sets).collect()}
    pieces = building.directory_pieces(images, sets, 5)
    found = pieces.collect()
    assert sorted((r.file_path, r.item) for r in found if r.item is not None) == [(d, n) for d in "de" for n in range(5, 38, 5)] and len(found) == 2 * 8 + 1
    for r in found:
        assert bytes(r.content) == whole[r.file_path][r.offset : r.offset + len(r.content)]
    columns = ("file_path", "path", "offset", "length", "vr", "values", "numbers", "binary")
    told = part10.element_rows(part10.elements(building.directory_files(images, sets), strict=True)).select(*columns)
    again = part10.element_rows(part10.piece_elements(pieces, media.RECORDS)).select(*columns)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, told.collect()))


def test_records_of_pieces(spark):
    """Records are read out of pieces as they are out of their elements, also where a piece is not written plainly."""
    kinds = "file_path string, place int, patient_id string, patient_name string, study_uid string, study_id string, study_date string, series_uid string, modality string, series_number int, file_id array<string>, sop_class string, sop_uid string, transfer_syntax string, instance_number int"
    names, files = [None, "", "N^a", "M\u00fcller^J", " b "], [None, ["IMG", "F1"], ["A ", " B"], []]
    rows = [(d, 3 * i, [None, "", "p", "\u00e4"][i % 4], names[i % 5], [None, "1.2", "1.34"][i % 3], None, None, f"2.{i % 7}", "MR", i % 8, files[i % 4], None, f"3.{i}", None, i) for d in "de" for i in range(30)]
    sets = spark.createDataFrame([("d", "SET", "9.1"), ("e", None, "9.2"), ("empty", None, "9.3")], "file_path string, file_set_id string, sop_uid string")
    pieces = building.directory_pieces(spark.createDataFrame(rows, kinds), sets, 6)
    plain = {0x00041400: ("UL", [0]), 0x00041410: ("US", [65535]), 0x00041430: ("CS", "IMAGE")}
    items = [plain, plain | {0x00081140: ("SQ", [[(0x00081155, "UI", "1.2")]])}, plain | {0x00041511: ("UI", "1\\2")}, plain | {0x00100010: ("PN", "a\0b")}, plain | {0x00041420: ("UL", [1, 2])}, plain | {0x00041430: ("UT", "A\\B")}]
    odd = []
    for k, item in enumerate(items):
        content = part10._encode([(0x00041220, "SQ", [[(tag, vr, v) for tag, (vr, v) in i.items()] for i in (plain, item)])], True, "<")[12:]
        odd.append((f"odd{k}", 900, 5, content))
    twice = part10._encode([(0x00041430, "CS", "A"), (0x00041430, "CS", "B")], True, "<")
    odd.append(("twice", 900, 5, b"\xfe\xff\0\xe0" + len(twice).to_bytes(4, "little") + twice))
    odd.append(("open", 900, 5, b"\xfe\xff\0\xe0\xff\xff\xff\xff" + twice + b"\xfe\xff\x0d\xe0\0\0\0\0"))
    pieces = pieces.unionByName(spark.createDataFrame(odd, "file_path string, offset bigint, item bigint, content binary"))
    want = media.directory_records(part10.element_rows(part10.piece_elements(pieces, media.RECORDS)))
    found = media.piece_records(pieces)
    assert found.dtypes == want.dtypes and want.count() > 100
    assert sorted(map(repr, found.collect())) == sorted(map(repr, want.collect()))
    assert media.piece_records(pieces, ("type",)).columns == ["directory", "place", "offset", "type", "root"]
    assert media._plain_records(odd[0][3], 900, 5, ["type", "next"]) is not None and media._plain_records(odd[1][3], 900, 5, ["type"]) is None


def test_numbers_and_elements_as_bytes(spark):
    found = spark.range(1).select(*(encoding.number(F.lit(n).cast("bigint"), w).alias(f"n{i}") for i, (n, w) in enumerate(((0, 2), (255, 2), (65535, 2), (0x80FF00FE, 4), (-2, 2)))), encoding.element("00041500", "CS", F.lit(b"abc")).alias("odd"), encoding.element("00420011", "OB", F.lit(b"")).alias("long"), encoding.element("00041500", "CS", F.lit(None).cast("binary")).alias("none")).first()
    assert [bytes(c) for c in found[:5]] == [b"\0\0", b"\xff\0", b"\xff\xff", b"\xfe\0\xff\x80", b"\xfe\xff"]
    assert bytes(found.odd) == part10._encode([(0x00041500, "CS", "abc")], True, "<") and bytes(found.long) == part10._encode([(0x00420011, "OB", b"")], True, "<") and found.none is None


def test_whole_files_are_those_of_the_nodes(spark, tree):
    rows = spark.createDataFrame([*flat(tree), ("f", "00100020", "LO", None)], ROWS)
    documents = spark.createDataFrame([("f", "1.2", "1.3"), ("none", None, "1.4")], "file_path string, sop_class string, sop_uid string")
    heads = documents.select("file_path", nesting.meta(documents.sop_class, documents.sop_uid).alias("head"))
    want = {r.file_path: bytes(r.content) for r in nesting.files(nesting.nodes(rows), heads).collect()}
    assert {r.file_path: bytes(r.content) for r in nesting.whole_files(rows, documents).collect()} == want
