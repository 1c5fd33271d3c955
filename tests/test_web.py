"""Web answers as tables, and the store of batches."""

from __future__ import annotations

import json
import sys
import urllib.parse

import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from voxlake.operators import rounds
from voxlake.sources import remote, store, web

STUDIES = [{"0020000D": {"vr": "UI", "Value": [f"1.{i}"]}, "00100020": {"vr": "LO", "Value": [f"p{i % 3}"]}, "00100010": {"vr": "PN", "Value": [{"Alphabetic": f"{'DOE' if i % 2 else 'Roe'}^{i}"}]}, "00080020": {"vr": "DA", "Value": [f"202001{i + 1:02d}"]}, "00201206": {"vr": "IS", "Value": [i]}, "00080061": {"vr": "CS", "Value": ["CT"]}} for i in range(23)]


# Workers can't import this file.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Server:
    """Answers searches out of a list, as a service does; writes what it was asked to a file."""

    def __init__(self, log: str):
        self.log = log

    def get(self, request: str, accept: str):
        with open(self.log, "a") as f:
            print(request, file=f)
        asked = dict(urllib.parse.parse_qsl(request.partition("?")[2]))
        limit, offset = int(asked.pop("limit")), int(asked.pop("offset"))
        tags = {"StudyInstanceUID": "0020000D", "PatientID": "00100020", "PatientName": "00100010", "StudyDate": "00080020"}

        def fits(s, name, wanted):
            value = s[tags[name]]["Value"][0]
            value = value["Alphabetic"] if isinstance(value, dict) else value
            if name == "StudyDate" and "-" in wanted:
                low, high = wanted.split("-")
                return (not low or value >= low) and (not high or value <= high)
            return value.lower().startswith(wanted[:-1].lower()) if wanted.endswith("*") else value == wanted

        found = [s for s in STUDIES if all(fits(s, n, w) for n, w in asked.items())][offset : offset + limit]
        return (200, web.JSON, json.dumps(found).encode()) if found else (204, "", b"")


@pytest.fixture
def search(spark, tmp_path):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    log = tmp_path / "log"

    def load(page=5, partitions=3):
        log.write_text("")
        spark.dataSource.register(web.study_source("test_studies", Server(str(log))))
        return spark.read.format("test_studies").option("page", page).option("partitions", partitions).load()

    return load, lambda: log.read_text().splitlines()


def test_pages_are_read_whole(search):
    load, asked = search
    for page, partitions in ((5, 3), (23, 2), (1, 4), (500, 8)):
        rows = load(page, partitions).collect()
        assert sorted(r.study_uid for r in rows) == sorted(f"1.{i}" for i in range(23)), (page, partitions)
    row = next(r for r in rows if r.study_uid == "1.4")
    assert (row.patient_id, row.patient_name, row.study_date, row.modalities, row.series, row.instances, row.accession) == ("p1", "Roe^4", "20200105", ["CT"], 4, None, None)


def plan_of(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_filters_reach_the_service(search):
    load, asked = search
    df = load().where("patient_id = 'p1' and study_date >= '20200110' and study_date <= '20200120' and patient_name like 'DOE%'")
    assert sorted(r.study_uid for r in df.collect()) == sorted(f"1.{i}" for i in range(9, 20) if i % 3 == 1 and i % 2)
    assert all("PatientID=p1" in r and "StudyDate=20200110-20200120" in r and "PatientName=DOE%2A" in r for r in asked())
    # What the service decides as Spark does is not in Spark's own filter any more.
    left = [line for line in plan_of(load().where("patient_id = 'p1'")).splitlines() if "Condition" in line]
    assert not any("p1" in line for line in left)
    # A service that is looser than Spark, here about case, does not change the result.
    assert load().where("patient_name like 'doe%'").count() == 0
    assert load().where("patient_id = 'p*'").count() == 0


def test_named_studies_are_asked_for_alone(search):
    load, asked = search
    assert sorted(r.study_uid for r in load().where("study_uid in ('1.3', '1.7', '9.9')").collect()) == ["1.3", "1.7"]
    assert len(asked()) == 3 and all("StudyInstanceUID=" in r for r in asked())


def test_errors_are_raised(spark, tmp_path):
    spark.dataSource.register(web.study_source("lost_studies", web.RecordedTransport(str(tmp_path / "none"))))
    with pytest.raises(Exception, match="status 404"):
        spark.read.format("lost_studies").load().collect()
    rows = web.answers(spark.createDataFrame([("a",), (None,)], "request string"), web.RecordedTransport(str(tmp_path / "none")), web.JSON).collect()
    assert [(r.status, r.body) for r in rows] == [(404, None), (None, None)]


@pytest.mark.parametrize("kind, body, want", [
    ('multipart/related; boundary=x', b"preamble\r\n--x\r\nContent-Type: a/b\r\n\r\n\x00\xff\r\n\r\n1\r\n--x\r\n\r\n\r\n--x--\r\nafter", [("a/b", b"\x00\xff\r\n\r\n1"), (None, b"")]),
    ('multipart/related; boundary="a.b+c"; type=z', b'--a.b+c\r\nX: y\r\ncontent-TYPE:  t \r\n\r\nbody--a.b+c\r\n--a.b+c--', [("t", b"body--a.b+c")]),
    ("application/dicom", b"DICM\r\n--x", [("application/dicom", b"DICM\r\n--x")]), ("multipart/related; boundary=x", b"", []), ("multipart/related; boundary=x", None, []),
])
def test_parts(spark, kind, body, want):
    rows = web.parts(spark.createDataFrame([(kind, body)], "content_type string, body binary")).orderBy("part").collect()
    assert [(r.part_type, bytes(r.content)) for r in rows] == want


def batch(spark, rows):
    return spark.createDataFrame([("1", "2", uid, "3", content) for uid, content in rows], store.SCHEMA).repartition(3)


def test_batches_are_published_once(spark, tmp_path):
    folder = str(tmp_path / "store")
    spark.dataSource.register(store.store_target("test_store", folder))
    save = lambda name, rows: batch(spark, rows).write.format("test_store").option("batch", name).mode("append").save()
    assert store.instances(spark, folder).count() == 0
    save("a", [(f"u{i}", b"one") for i in range(10)] + [(None, b"lost"), ("", b"lost")])
    save("b", [("u3", b"two"), ("new", b"two")])
    files = remote.names(f"file://{folder}/data")
    save("a", [(f"u{i}", b"again") for i in range(10)])
    # What the repeated batch wrote is gone again.
    assert remote.names(f"file://{folder}/data") == files
    found = {r.sop_uid: bytes(r.content) for r in store.instances(spark, folder).collect()}
    assert found == {f"u{i}": b"one" for i in range(10)} | {"u3": b"two", "new": b"two"}
    assert [(r.batch, r.stored, r.failed) for r in store.batches(spark, folder).orderBy("order").collect()] == [("a", 10, 2), ("b", 2, 0)]
    with pytest.raises(Exception, match="needs a name"):
        batch(spark, []).write.format("test_store").mode("append").save()


def test_failed_tasks_leave_nothing_that_counts(spark, tmp_path):
    folder = str(tmp_path / "store")
    spark.dataSource.register(store.store_target("failing_store", folder))
    rows = batch(spark, [(f"u{i}", b"x") for i in range(20)])
    broken = rows.withColumn("content", F.when(F.col("sop_uid") == "u13", F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="lost"):
        broken.write.format("failing_store").option("batch", "a").mode("append").save()
    assert store.instances(spark, folder).count() == 0 and not store.is_published(folder, "a")
    # A killed task's files stay, unnamed by any list.
    remote.write(f"file://{folder}/data/orphan.parquet", b"no table")
    rows.write.format("failing_store").option("batch", "a").mode("append").save()
    assert store.is_published(folder, "a") and store.batches(spark, folder).first().stored == 20


def test_large_answers_come_in_small_batches(spark):
    """A task's answers are not one batch of Arrow, however few its rows."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    rows = spark.range(0, 64, 1, 1).select(F.encode(F.repeat(F.lit("x"), 100_000), "UTF-8").alias("body"))
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    with rounds.small_batches(spark, 1 << 20):
        found = [r.n for r in rows.mapInArrow(sizes, "n bigint").collect()]
    assert sum(found) == 64 and max(found) <= 12 and spark.conf.get(name) == before
