"""Imaging operators against fixed values, and with missing ones."""

from __future__ import annotations

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlake.functions import elements, quantity
from voxlake.functions import numeric as nm
from voxlake.functions import text as tx
from voxlake.operators import anonymize, catalog, links, loader, search, slices, statistics, syntaxes
from voxlake.sources import frames, part10
from voxlake.streaming import ingest


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def lit(*values):
    return [F.lit(v) for v in values]


def test_values(spark):
    none = F.lit(None).cast("array<double>")
    r = one(
        spark, nm.rescale(*lit(1024.0, 1.0, -1024.0)), nm.hu_to_stored(*lit(0.0, 1.0, -1024.0)), nm.hu_to_stored(*lit(5.0, 0.0, 1.0)), nm.real_world_value(*lit(10, 0, 100, 0.5, 2.0), none), nm.real_world_value(*lit(2, 1, 3, 0.0, 0.0), F.array(*lit(10.0, 20.0, 30.0))),
        nm.real_world_value(*lit(101, 0, 100, 0.5, 2.0), none), nm.parametric_value(*lit(7, 20, 5, 2.0, 1.0)), nm.modality_voxel(F.lit(65535.0)), nm.modality_voxel(F.lit(-2.5)),
    )
    assert list(r) == [0.0, 1024.0, 0.0, 7.0, 20.0, None, 15.0, 32767, -3]


def test_display_values(spark):
    window = lambda v: nm.display_value(F.lit(float(v)), F.lit(50.0), F.lit(100.0), F.lit(True))
    lut = lambda v: nm.lut_value(F.lit(v), F.lit(0), F.array(*lit(0, 64, 128, 255)))
    assert list(one(spark, window(0), window(100), lut(0), lut(2), lut(3), lut(9), nm.window_level(*lit(0, 0.0, 0.0)), nm.window_level(*lit(50, 50.0, 100.0)))) == [255, 0, 0, 128, 255, 255, 255, 127]


def test_uptake_values(spark):
    kg, m = F.lit(70.0), F.lit(1.75)
    factor = lambda k: nm.size_factor(k, kg, m, F.lit("M"))
    dose = nm.decayed_dose(F.lit(3.5e8), F.lit(1.0), F.lit(None).cast("double"), F.lit(None).cast("double"))
    suv = lambda k: nm.uptake_value(k, F.lit(1000.0), F.lit("BQML"), dose, factor(k))
    r = one(spark, suv("bw"), factor("lbm"), factor("ibw"), suv("lbm"), suv("ibw"), nm.uptake_value("bw", F.lit(5.0), F.lit("GML"), dose, factor("bw")), nm.size_factor("lbm", kg, m, F.lit("O")), nm.decay_seconds(*lit(86000.0, 100.0)))
    for got, want in zip(r, [0.2, 57800.0, 72380.0, 0.165142857, 0.2068, 5.0, None, 500.0], strict=True):
        assert got is want or math.isclose(got, want, rel_tol=1e-7)


def test_windows(spark):
    pick = lambda c, w, cs, ws: nm.chosen_window(F.lit(c).cast("double"), F.lit(w).cast("double"), F.array(*lit(*cs)), F.array(*lit(*ws)))
    r = one(spark, pick(None, None, [40.0, 80.0], [400.0, 2000.0]), pick(None, None, [40.0, 80.0], [400.0, 0.0]), pick(1.0, 2.0, [40.0], [400.0]), nm.preset_near(*lit(50.0, 350.0)), nm.preset_near(*lit(9e3, 1.0)), nm.preset_named(F.lit("PE"))["center"], nm.suggested_presets(F.lit("ct"), F.lit("HEAD")))
    assert [tuple(x) for x in r[:3]] == [(80.0, 2000.0), (40.0, 400.0), (1.0, 2.0)] and list(r[3:]) == ["Soft Tissue", None, 100.0, ["Brain", "Bone", "Soft Tissue"]]


@pytest.mark.parametrize("places,spacing,variable", [([i * 2.5 for i in range(5)], 2.5, False), ([0, 0, 5.0], 5.0, False), ([0, 2.46, 4.96, 7.5], 2.5, False), ([0, 0.3, 0.615, 0.9], 0.3, False), ([0, 1.0, 3.0], 1.5, True), ([None, None], None, None), ([4.0], None, None)])
def test_spacing(spark, places, spacing, variable):
    r = slices.spacing(spark.createDataFrame([("s", p if p is None else float(p)) for p in places], "series_uid string, projection double")).first()
    assert (r.spacing is None and spacing is None or math.isclose(r.spacing, spacing, abs_tol=1e-9)) and r.variable is variable


def test_histogram_and_windows(spark):
    p = spark.createDataFrame([("a", v) for v in range(0, 1001, 100)] + [("b", 7)] * 3, "image_id string, value int")
    h = {(r.image_id, r.bin): r.pixels for r in statistics.histogram(p).collect()}
    assert sum(n for (i, _), n in h.items() if i == "a") == 11 and h["a", 255] == 1 and h["b", 0] == 3
    w = {r.image_id: (r.center, r.width) for r in statistics.auto_window(p).collect()}
    assert w["b"] == (7.0, 1.0) and w["a"][1] > 800
    q = spark.createDataFrame([("a", float(v)) for v in (-1024, -924, 0, 1024)], "image_id string, value double")
    assert tuple(statistics.percentile_window(q, 0.0, 1.0).first())[1:] == (0.0, 2048.0)
    assert statistics.histogram(p.where("false")).count() == 0 and statistics.batch_summary(p.where("false"), F.lit(True)).first().rate == 0.0
    with pytest.raises(ValueError):
        statistics.percentile_window(p, 0.5, 0.5)


def test_search(spark):
    rows = [("s1", "i2", "DOE^JANE", "CT"), ("s1", "i1", "DOE^JOHN", "MR"), ("s2", "i3", None, "CT"), ("s3", "i4", "Roe", "CT")]
    i = spark.createDataFrame([(s, o, n, "p", "20200101", m) for s, o, n, m in rows], "study_uid string, sop_uid string, patient_name string, patient_id string, study_date string, modality string")
    found = lambda **f: [r.study_uid for r in search.search_studies(i, **f).collect()]
    assert found(patient_name="doe") == ["s1"] and found(modality="CT") == ["s2", "s3"] and found(patient_name=" ") == ["s1", "s2", "s3"] and found(offset=1, limit=1) == ["s2"]
    assert search.study_summary(search.search_studies(i, study_uid="s2")).first().patient_name == "Unknown"
    for bad in ({"offset": -1}, {"limit": "x"}, {"colour": "red"}):
        with pytest.raises(ValueError):
            found(**bad)


def test_text_functions(spark):
    name = tx.person_name(F.lit("Doe^Jane^^Dr^=山田^花=\0"))
    r = one(
        spark, name["alphabetic"]["family"], name["alphabetic"]["middle"], name["ideographic"]["given"], tx.multi_values(F.lit("a \\\\b")), tx.tag_text(F.lit(0x7FE00010)), tx.date_parts(F.lit("20260231"))["day"], tx.date_parts(F.lit("20261301")), tx.time_parts(F.lit("1360")), tx.time_parts(F.lit("235960.5"))["microsecond"],
        tx.age_parts(F.lit("012m"))["unit"], tx.datetime_parts(F.lit("202602031215-0130"))["offset_minutes"], tx.xml_escaped(F.lit('<a&"')), tx.file_id_path(F.array(*lit("A", "..", "B"))), tx.file_id_path(F.array(*lit("A", "B"))), tx.zip_entry_disposition(F.lit("a/../../b")), tx.natural_key(F.lit("IM10")) > tx.natural_key(F.lit("im9")),
        tx.sanitized(F.lit("a \x01\x02b\x03\x04c")), tx.first_filled(F.lit(" "), F.lit(" x ")),
    )
    assert list(r) == ["Doe", None, "花", ["a", "", "b"], "(7FE0,0010)", 31, None, None, 500000, "M", -90, "&lt;a&amp;&quot;", None, "A/B", "reject", True, "a b c", "x"]


def test_deterministic_uid(spark):
    def plain(uid):
        a, b = 0xCBF29CE484222325, 0x9E3779B97F4A7C15
        for c in uid.encode():
            a = (a ^ c) * 0x100000001B3 % 2**64
            b = (b * 31 + c) % 2**64
        return f"2.25.{a}.{b}"

    uids = ["1.2.840.10008.1.2", "", "1", "2.25.123456789012345678901234567890"]
    rows = spark.createDataFrame([(u,) for u in uids], "u string").select("u", tx.deterministic_uid(F.col("u")).alias("v")).collect()
    assert all(r.v == plain(r.u) for r in rows)


def picture(**more):
    rows = {
        0x00080016: ("UI", "1.2.840.10008.5.1.4.1.1.2"), 0x00080018: ("UI", "1.2.3.4"), 0x00080060: ("CS", "CT"), 0x00100010: ("PN", "Doe^Jane"), 0x0020000D: ("UI", "1.2"), 0x0020000E: ("UI", "1.2.3"), 0x00200013: ("IS", "5"),
        0x00280002: ("US", [1]), 0x00280010: ("US", [2]), 0x00280011: ("US", [2]), 0x00280100: ("US", [16]), 0x00280101: ("US", [16]), 0x00280102: ("US", [15]), 0x00280103: ("US", [1]), 0x00281050: ("DS", "40\\80"), 0x00281051: ("DS", "400\\2000"),
        0x00281053: ("DS", "1"), 0x00281052: ("DS", "-1024"), 0x00081140: ("SQ", [[(0x00081155, "UI", "9.9")], [(0x00081155, "UI", "9.8")]]), 0x7FE00010: ("OW", struct.pack("<4h", -16, 0, 7, 31)),
    } | {int(k, 16): v for k, v in more.items()}
    return [(t, vr, v) for t, (vr, v) in rows.items()]


@pytest.mark.parametrize("syntax", [part10.EXPLICIT_LE, part10.IMPLICIT_LE, part10.DEFLATED_LE, part10.EXPLICIT_BE])
def test_part10_round_trip(spark, syntax):
    files = spark.createDataFrame([("a", part10.write(picture(), syntax)), ("b", b"junk"), ("c", None)], "file_path string, content binary")
    parsed = part10.elements(files)
    i = part10.instance_rows(parsed).first()
    assert (i.file_path, i.transfer_syntax, i.patient_name, i.study_uid, i.instance_number, i.rows, i.intercept, i.centers, i.frames) == ("a", syntax, "Doe^Jane", "1.2", 5, 2, -1024.0, [40.0, 80.0], 1)
    assert {r.file_path: bool(r.error) for r in parsed.collect()} == {"a": False, "b": True, "c": True}
    nested = {r.path: r["values"] for r in part10.element_rows(parsed).where("depth > 0").collect()}
    assert nested == {"00081140[0]/00081155": ["9.9"], "00081140[1]/00081155": ["9.8"]}
    with pytest.raises(Exception, match="DICM"):
        part10.elements(files, strict=True).collect()


def test_scan_and_landing_stream(spark, tmp_path):
    folder = tmp_path / "in" / "deep"
    folder.mkdir(parents=True)
    for name in ("a.dcm", "b", ".hidden.dcm", "c.txt"):
        (folder / name).write_bytes(part10.write(picture()))
    assert part10.scan(spark, str(tmp_path / "in")).count() == 2
    query = ingest.write_batches(ingest.landing(spark, str(tmp_path / "in")).select("file_path", "transfer_syntax"), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() >= 3


def test_frames(spark):
    plane = lambda x: bytes([1, x[0], x[1]]) + bytes([255, x[2]])  # two copied, one repeated twice
    high, low = plane([0, 0, 1]), plane([5, 6, 7])
    head = struct.pack("<16I", 2, 64, 64 + len(high), *[0] * 13)
    rle = head + high + low
    item = lambda b: b"\xfe\xff\x00\xe0" + struct.pack("<I", len(b)) + b
    wrapped = item(b"") + item(rle) + b"\xfe\xff\xdd\xe0\0\0\0\0"
    rows = [("rle", wrapped, "1.2.840.10008.1.2.5", 2, 2, 1, 1, 16, 0), ("raw", struct.pack("<8h", *range(-4, 4)), part10.EXPLICIT_LE, 2, 2, 2, 1, 16, 1), ("jp2", b"", "1.2.840.10008.1.2.4.90", 2, 2, 1, 1, 8, 0), ("short", b"\0", part10.EXPLICIT_LE, 2, 2, 1, 1, 16, 0)]
    images = spark.createDataFrame(rows, "file_path string, pixel_data binary, transfer_syntax string, rows int, columns int, frames int, samples_per_pixel int, bits_allocated int, pixel_representation int")
    got = {(r.file_path, r.frame): (r.pixels, r.error) for r in frames.decoded_frames(images).collect()}
    assert got["rle", 0] == ([5, 6, 263, 263], None) and got["raw", 1] == ([0, 1, 2, 3], None) and "JPEG 2000" in got["jp2", 0][1] and got["short", 0][0] is None
    cut = {r.frame: bytes(r.bytes) for r in frames.native_frames(images.withColumn("photometric", F.lit("MONOCHROME2")).where("file_path = 'raw'")).collect()}
    assert cut == {0: struct.pack("<4h", *range(-4, 0)), 1: struct.pack("<4h", *range(4))}


def test_bits_and_waveforms(spark):
    masks = np.array([[1, 0, 1, 0, 1, 0, 1, 0, 1], [0, 1, 0, 1, 0, 1, 0, 1, 0]])
    assert (frames.bit_frames(frames.pack_bits(masks), 9, 2) == masks).all()
    assert one(spark, frames.deinterleave(F.array(*lit(1, 2, 3, 4, 5, 6)), F.lit(2)))[0] == [[1, 3, 5], [2, 4, 6]]
    assert one(spark, nm.waveform_value(F.lit(3.0), F.lit(None).cast("double"), F.lit(1.0), F.lit(0.0)))[0] is None
    flat = np.full((4, 5), 9.0)
    assert (frames.denoised(flat, 1.0) == flat).all() and frames.denoised(flat, 0.05) is flat


def test_anonymized(spark):
    rows = [("f", "00100010", 0x00100010, "PN", ["Doe"]), ("f", "0020000D", 0x0020000D, "UI", ["1.2"]), ("f", "00280010", 0x00280010, "US", ["2"]), ("f", "00090001", 0x00090001, "LO", ["x"]), ("f", "00081140", 0x00081140, "SQ", None), ("f", "00081140[0]/00081155", 0x00081155, "UI", ["1.3"]), ("f", "00100000", 0x00100000, "UL", ["8"])]
    elements = spark.createDataFrame(rows, "file_path string, path string, tag int, vr string, values array<string>")
    policy = anonymize.policy_table(spark, (*anonymize.DEFAULT_POLICY, (0x00280010, "remove", None)))
    a = {r.path: (r.disposition, r["values"]) for r in anonymize.apply_policy(elements, policy).collect()}
    assert a["00100010"] == ("changed", ["ANONYMIZED"]) and a["00280010"] == ("blocked", ["2"]) and a["00090001"] == ("removed", None) and a["00081140[0]/00081155"][0] == "remapped" and "00100000" not in a


def test_links(spark):
    records = [("d", 10, 30, 20, True), ("d", 20, 0, 0, False), ("d", 30, 10, 40, False), ("d", 40, 0, 10, False), ("d", 99, 0, 0, False)]
    got = {r.offset: (r.depth, r.parent) for r in links.linked_records(spark, spark.createDataFrame(records, "directory string, offset bigint, next bigint, lower bigint, root boolean")).collect()}
    assert got == {10: (0, None), 20: (1, 10), 30: (0, None), 40: (1, 30)}
    refs = spark.createDataFrame([("t", 1), ("t", 2), ("u", 3)], "t string, i int")
    done = links.commitment(refs, spark.createDataFrame([(1,), (1,)], "i int"), ["i"])
    asked = spark.createDataFrame([("t",), ("u",), ("v",)], "t string")
    assert {r.t: r.status for r in links.commitment_status(asked, done, "t").collect()} == {"t": "partial", "u": "failed", "v": "committed"}


def test_circuit_breaker():
    out, failures, opened = ingest._step([(0, False), (1, False), (2, True), (40, False), (50, True), (75, True)], 0, None, 2, 30.0)
    assert [(a, s) for _, a, s, _ in out] == [(True, "closed"), (True, "open"), (False, "open"), (True, "open"), (False, "open"), (True, "closed")] and (failures, opened) == (0, None)


def test_retry_queue(spark):
    q = spark.createDataFrame([("a", 0, "pending"), ("b", 2, "pending"), ("c", 1, "pending")], "k string, attempts int, state string")
    left = {r.k: (r.attempts, r.state) for r in ingest.retry_queue(q, q.where("k <> 'c'").select("k"), "k").collect()}
    assert left == {"a": (1, "pending"), "b": (3, "failed")}


def test_catalog(spark):
    row = spark.createDataFrame([("p", None, "", "s", "r", "", None)], "file_path string, patient_name string, patient_id string, study_uid string, series_uid string, modality string, instance_number string")
    for c in ("patient_sex", "patient_age", "study_date", "study_description", "body_part", "institution"):
        row = row.withColumn(c, F.lit(None).cast("string"))
    r = catalog.study_metadata(row.withColumn("file_size", F.lit(1))).first()
    assert (r.patient_name, r.patient_id, r.patient_age, r.study_date, r.modality, r.instance_number, r.institution) == ("Unknown Patient", "Unknown ID", "Unknown", "Unknown Date", "OT", 0, "Unknown Location")


def test_preset_lookup_of_all_lines(spark):
    from voxlake.plans import pixels

    d = "/root/testdata/sf0.001"
    whole = pixels.preset_lookup_whole(spark, d)
    assert whole.count() == spark.read.parquet(f"{d}/lineitem.parquet").count() == pixels.preset_lookup(spark, d).count()
    assert whole.where("preset is null").count() and whole.where("preset is not null").count()


def test_whole_orders_and_references(spark):
    from voxlake.plans import imaging

    d = "/root/testdata/sf0.001"
    rows = imaging.newest_first_whole(spark, d).orderBy("position").collect()
    assert [r.position for r in rows] == list(range(1, spark.read.parquet(f"{d}/orders.parquet").count() + 1)) and len(rows) > 200
    keys = [(r.o_orderdate is None, -r.o_orderdate.toordinal() if r.o_orderdate else 0, r.o_orderkey) for r in rows]
    assert keys == sorted(keys)
    rows = imaging.catalog_order_whole(spark, d).orderBy("position").collect()
    assert [r.position for r in rows] == list(range(1, spark.read.parquet(f"{d}/lineitem.parquet").count() + 1)) and len(rows) > 300
    keys = [(r.patient_name, r.study_date, r.study_uid, r.series_uid, f"{r.instance_number:08d}", r.sop_uid) for r in rows]
    assert keys == sorted(keys)
    found = {r.doc_id for r in imaging.key_references_whole(spark, d).collect()}
    assert found >= {r.doc_id for t in ("documents", "labels") for r in spark.read.parquet(f"{d}/{t}.parquet").select("doc_id").collect()}


def test_record_links_of_any_length(spark):
    """A chain of 5,000 siblings, records below records, and a cycle that no root reaches."""
    n = 5000
    rows = [(1, 10 + i, 10 + i + 1 if i + 1 < n else 0, 0, i == 0) for i in range(n)]
    rows += [(2, 1, 0, 2, True), (2, 2, 3, 4, False), (2, 3, 0, 0, False), (2, 4, 0, 0, False), (2, 8, 9, 0, False), (2, 9, 8, 0, False)]
    records = spark.createDataFrame(rows, "directory int, offset bigint, next bigint, lower bigint, root boolean")
    found = {(r.directory, r.offset): (r.depth, r.parent) for r in links.linked_records(spark, records).collect()}
    assert {k: v for k, v in found.items() if k[0] == 2} == {(2, 1): (0, None), (2, 2): (1, 1), (2, 3): (1, 1), (2, 4): (2, 2)}
    assert sum(k[0] == 1 for k in found) == n and set(v for k, v in found.items() if k[0] == 1) == {(0, None)}
    assert not links.linked_records(spark, records.where("false")).count()


def test_rounds_over_few_records(spark, monkeypatch):
    """Of records that lie together few take part in the rounds; ways over far records are followed all the same."""
    rows = [("a", 10 + 200 * i, 10 + 200 * (i + 1) if i + 1 < 20_000 else 0, 0, i == 0) for i in range(20_000)]
    far = 3 * links.NEAR
    rows += [("b", 8 + far * i, 8 + far * (i - 1) if i % 2 == 0 else 0, 8 + far * (i - 1) if i % 2 else 0, i == 40) for i in range(41)]
    rows += [("c", 1, far, 0, False), ("c", far, 1, 0, False), ("c", 7, 0, 0, True)]
    records = spark.createDataFrame([(*r, r[1] + 5) for r in rows], "directory string, offset bigint, next bigint, lower bigint, root boolean, place bigint")
    taken, rounds = [], links.ways_to_roots
    monkeypatch.setattr(links, "ways_to_roots", lambda rows, *a: taken.append(rows.count()) or rounds(rows, *a))
    found = {(r.directory, r.offset): (r.depth, r.parent) for r in links.linked_records(spark, records, parent="place").collect()}
    assert 0 < taken[0] < 100
    assert {v for k, v in found.items() if k[0] == "a"} == {(0, None)} and sum(k[0] == "a" for k in found) == 20_000
    assert [k for k in found if k[0] == "c"] == [("c", 7)]
    depth, parent = 0, None
    for i in range(40, -1, -1):
        assert found["b", 8 + far * i] == (depth, parent)
        depth, parent = (depth + 1, 13 + far * i) if i % 2 else (depth, parent)


def test_content_trees_of_any_depth(spark):
    rows = [(1, i, i - 1 if i else None, i % 3) for i in range(400)] + [(2, 0, None, 0), (2, 1, 0, 1), (2, 2, 0, 0), (2, 7, 8, 0), (2, 8, 7, 0)]
    tree = links.content_tree(spark, spark.createDataFrame(rows, "doc int, id int, parent int, ord int"))
    assert tree.where("doc = 1").agg(F.max("depth")).first()[0] == 399
    assert [(r.id, r.depth) for r in tree.where("doc = 2").orderBy("path").collect()] == [(0, 0), (2, 1), (1, 1)]


def test_syntax_plans(spark):
    pairs = [("1.2.840.10008.1.2", "1.2.840.10008.1.2.1"), ("1.2.840.10008.1.2.5", "1.2.840.10008.1.2.1"), ("1.2.840.10008.1.2.1", "1.2.840.10008.1.2.4.80"), ("1.2.840.10008.1.2.4.94", "1.2.840.10008.1.2"), ("1.2.840.10008.1.2.4.50", "1.2.840.10008.1.2.4.50"), ("9.9", "1.2.840.10008.1.2"), (None, None)]
    rows = syntaxes.with_plans(spark.createDataFrame(pairs, "a string, b string"), spark, "a", "b").collect()
    assert sorted((r.a or "", r.route or "", r.status or "") for r in rows) == sorted([("1.2.840.10008.1.2", "rewrite-native", "supported"), ("1.2.840.10008.1.2.5", "decompress", "supported"), ("1.2.840.10008.1.2.1", "compress", "ambiguous"), ("1.2.840.10008.1.2.4.94", "reference", "unsupported"), ("1.2.840.10008.1.2.4.50", "pass-through", "supported"), ("9.9", "", ""), ("", "", "")])
    assert len({s[0] for s in syntaxes.SYNTAXES}) == 36


def test_json_of_nested_sequences(spark):
    rows = [("f", "0040A730", None, 0, 0x0040A730, "SQ", None, None), ("f", "00080005", None, 0, 0x00080005, "CS", ["ISO/100", 'a"b'], None)]
    out = elements.json_documents(spark.createDataFrame(rows, "file_path string, path string, parent string, depth int, tag int, vr string, values array<string>, binary binary")).first().json
    assert out == '{"00080005":{"Value":["ISO\\/100","a\\"b"],"vr":"CS"},"0040A730":{"Value":[],"vr":"SQ"}}'


def test_quantity_edges(spark):
    none = F.lit(None).cast("double")
    r = one(spark, quantity.window_number(F.lit("1\\2\\3")), quantity.spacing_of(F.lit(None).cast("string")), quantity.contour_points(F.array().cast("array<double>"), F.lit(0)), quantity.stored_at(F.array(*lit(1, 2, 3)), *lit(1, 0, 3, 0)), quantity.in_sample_range(*lit(256, "unsigned8")), quantity.frame_file_name(*lit("x", 12344, 20000), "png"), quantity.uptake_diagnostics("bw", F.lit("GML"), *[none] * 7, none.cast("string")))
    assert list(r) == [0.0, (1.0, 1.0), None, None, False, "x_frame12345.png", []]
