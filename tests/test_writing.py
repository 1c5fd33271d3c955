from __future__ import annotations

from voxlake.sources import part10, writing

KINDS = "file_path string, path string, vr string, `values` array<string>, binary binary"


def _again(spark, rows):
    written = writing.files(spark.createDataFrame([("a", *r) for r in rows], KINDS))
    return {r.path: (r.vr, r["values"]) for r in part10.element_rows(part10.elements(written)).collect()}, written.first()


def test_items_and_numbers_come_back(spark):
    rows = [("00081115", "SQ", None, None), ("00081115[1]/00081155", "UI", ["1.2"], None), ("00081140", "SQ", None, None), ("00280010", "US", ["4"], None), ("00189073", "FD", ["2.5"], None), ("00281050", "DS", ["1", "2"], None)]
    found, _ = _again(spark, rows)
    assert found["00081115[1]/00081155"] == ("UI", ["1.2"]) and found["00081140"][0] == "SQ" and found["00280010"] == ("US", ["4"]) and found["00189073"] == ("FD", ["2.5"]) and found["00281050"] == ("DS", ["1", "2"])


def test_texts_that_do_not_fit_their_set_turn_it_to_unicode(spark):
    found, _ = _again(spark, [("00080005", "CS", ["ISO_IR 100"], None), ("00100010", "PN", ["Müller"], None)])
    assert (found["00080005"][1], found["00100010"][1]) == (["ISO_IR 100"], ["Müller"])
    found, _ = _again(spark, [("00080005", "CS", ["ISO_IR 100"], None), ("00100010", "PN", ["Łódź"], None)])
    assert (found["00080005"][1], found["00100010"][1]) == (["ISO_IR 192"], ["Łódź"])


def test_what_cannot_be_written(spark):
    assert _again(spark, [("7FE00010", "OW", None, None)])[1].error == "pixels were not read"
    assert _again(spark, [("00280010", "US", ["many"], None)])[1].content is None
    assert _again(spark, [("00280010", "US", ["70000"], None)])[1].error


def test_pixels_come_back(spark):
    written = writing.files(spark.createDataFrame([("a", "7FE00010", "OW", None, b"\1\2\3\4")], KINDS))
    row = part10.element_rows(part10.elements(written, with_pixels=True)).where("path = '7FE00010'").first()
    assert bytes(row.binary) == b"\1\2\3\4"


def test_dictionaries(spark, tmp_path):
    path = tmp_path / "dictionary.csv"
    path.write_text('tag,vr,name\n"(0010,0020)",SH,Changed\n00189073,FD,Duration\n"(60xx,3000)",OB,Group\nnothing,LO,None\n')
    known = part10.dictionary_table(spark, str(path))
    assert sorted((r.tag, r.vr, r.name) for r in known.collect()) == [(0x00100020, "SH", "Changed"), (0x00189073, "FD", "Duration")]
    files = spark.createDataFrame([("a", part10.write([(0x00100020, "LO", "id"), (0x00189073, "FD", [1.5]), (0x00181030, "LO", "x")], part10.IMPLICIT_LE))], "file_path string, content binary")
    kinds = lambda **more: {e.tag: (e.vr, e.numbers) for e in part10.elements(files, **more).first().elements if e.tag >> 16 != 2}
    assert kinds(dictionary=known) == {0x00100020: ("SH", None), 0x00189073: ("FD", [1.5]), 0x00181030: ("UN", None)}
    assert kinds() == {0x00100020: ("LO", None), 0x00189073: ("UN", None), 0x00181030: ("UN", None)}


def test_only_the_top_level_is_limited(spark):
    items = [[(0x00081155, "UI", f"1.{i}")] for i in range(10_050)]
    content = part10.write([(0x00081115, "SQ", items), (0x00100020, "LO", "id")])
    file = part10.elements(spark.createDataFrame([("a", content)], "file_path string, content binary")).first()
    assert file.error is None and len(file.elements) == 10_050 + 2 + 3
