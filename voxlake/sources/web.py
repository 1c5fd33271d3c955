"""Studies, metadata and bulk data of imaging web services as tables.

What asks a service is a transport: ``get(request, accept)`` gives (status, content type, body) and can be pickled. ``HttpTransport`` asks
a server; ``RecordedTransport`` reads responses that ``record`` has stored.
"""

from __future__ import annotations

import hashlib
import json
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, In, InputPartition, LessThanOrEqual, StringStartsWith

from . import remote

#: What is accepted of each kind of answer.
JSON, MULTIPART, FILE = "application/dicom+json", 'multipart/related; type="application/octet-stream"', "application/dicom"
#: Columns of a study search, with their elements and their names in requests.
STUDY = {
    "study_uid": ("0020000D", "StudyInstanceUID"), "patient_id": ("00100020", "PatientID"), "patient_name": ("00100010", "PatientName"), "study_date": ("00080020", "StudyDate"), "accession": ("00080050", "AccessionNumber"),
    "modalities": ("00080061", "ModalitiesInStudy"), "description": ("00081030", "StudyDescription"), "series": ("00201206", None), "instances": ("00201208", None),
}
STUDY_SCHEMA = "study_uid string, patient_id string, patient_name string, study_date string, accession string, modalities array<string>, description string, series bigint, instances bigint"
#: Columns whose equality a service decides as Spark does.
EXACT = ("study_uid", "patient_id", "study_date", "accession")


class HttpTransport:
    """Asks a server below ``base``."""

    def __init__(self, base: str, headers: dict[str, str] | None = None, seconds: float = 60):
        self.base, self.headers, self.seconds = base.rstrip("/"), dict(headers or {}), seconds

    def get(self, request: str, accept: str) -> tuple[int, str, bytes]:
        asked = urllib.request.Request(f"{self.base}/{request}", headers={**self.headers, "Accept": accept})
        try:
            with urllib.request.urlopen(asked, timeout=self.seconds) as answer:
                return answer.status, answer.headers.get("Content-Type", ""), answer.read()
        except urllib.error.HTTPError as e:
            return e.code, e.headers.get("Content-Type", ""), b""


class RecordedTransport:
    """Reads responses from a folder; what was not recorded is not found."""

    def __init__(self, folder: str):
        self.folder = remote.addressed(folder)

    def get(self, request: str, accept: str) -> tuple[int, str, bytes]:
        found = remote.read(f"{self.folder}/{hashlib.sha256(request.encode()).hexdigest()}")
        if found is None:
            return 404, "", b""
        kind, _, body = found.partition(b"\n")
        return 200 if body else 204, kind.decode(), body


def record(responses: DataFrame, folder: str) -> DataFrame:
    """Stores responses (request, content_type, body) for ``RecordedTransport``; a row per response with its size. A retry stores the same again."""
    folder = remote.addressed(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = []
            for request, kind, body in zip(batch["request"].to_pylist(), batch["content_type"].to_pylist(), batch["body"], strict=True):
                content = body.as_py() or b""
                remote.write(f"{folder}/{hashlib.sha256(request.encode()).hexdigest()}", kind.encode() + b"\n" + content)
                sizes.append(len(content))
            yield pa.RecordBatch.from_arrays([batch["request"], pa.array(sizes, pa.int64())], ["request", "bytes"])

    return responses.select("request", "content_type", "body").mapInArrow(run, "request string, bytes bigint")


# Study searches as a data source


class _Pages(InputPartition):
    """Every ``step``-th page of a search, from ``first``."""

    def __init__(self, query: list[tuple[str, str]], first: int, step: int):
        self.query, self.first, self.step = query, first, step


def _told(element: dict[str, Any] | None) -> list:
    values = (element or {}).get("Value") or []
    return [v.get("Alphabetic", "") if isinstance(v, dict) else v for v in values]


def _study(found: dict[str, Any]) -> tuple:
    """The columns of ``STUDY_SCHEMA`` out of one data set of an answer."""
    one = lambda column: next(iter(_told(found.get(STUDY[column][0]))), None)
    text = lambda column: None if one(column) is None else str(one(column))
    number = lambda column: None if one(column) is None else int(one(column))
    return (*(text(c) for c in ("study_uid", "patient_id", "patient_name", "study_date", "accession")), [str(v) for v in _told(found.get(STUDY["modalities"][0]))], text("description"), number("series"), number("instances"))


class _StudyReader(DataSourceReader):
    def __init__(self, transport, page: int, partitions: int):
        self.transport, self.page, self.step, self.query, self.uids = transport, page, partitions, [], None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters become parameters of the request. Those that a service may take more loosely than Spark are also left to Spark."""
        dates: dict[str, str] = {}
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            plain = isinstance(getattr(f, "value", None), str) and f.value and not set(f.value) & set("*?\\,-")
            if isinstance(f, EqualTo) and column in EXACT and plain:
                self.query.append((STUDY[column][1], f.value))
            elif isinstance(f, In) and column == "study_uid" and self.uids is None and all(isinstance(v, str) and v and not set(v) & set("*?\\,") for v in f.value):
                self.uids = list(f.value)
            elif isinstance(f, StringStartsWith) and column in ("patient_name", "description") and plain:
                self.query.append((STUDY[column][1], f"{f.value}*"))
                yield f
            elif isinstance(f, (GreaterThanOrEqual, LessThanOrEqual)) and column == "study_date" and plain and len(f.value) == 8:
                side = "from" if isinstance(f, GreaterThanOrEqual) else "to"
                dates[side] = max(dates.get(side, f.value), f.value) if side == "from" else min(dates.get(side, f.value), f.value)
                yield f
            else:
                yield f
        if dates and not any(name == "StudyDate" for name, _ in self.query):
            self.query.append(("StudyDate", f"{dates.get('from', '')}-{dates.get('to', '')}"))

    def partitions(self) -> list[InputPartition]:
        """Pages are dealt in strides, so that no one has to know how many there are; each named study is asked for alone."""
        if self.uids is not None:
            return [_Pages([*self.query, ("StudyInstanceUID", uid)], 0, 1) for uid in dict.fromkeys(self.uids)]
        return [_Pages(self.query, first, self.step) for first in range(self.step)]

    def read(self, partition: _Pages) -> Iterator[tuple]:
        page = partition.first
        while True:
            request = "studies?" + urllib.parse.urlencode([*partition.query, ("limit", self.page), ("offset", page * self.page)])
            status, _, body = self.transport.get(request, JSON)
            if status not in (200, 204):
                raise OSError(f"{request}: status {status}")
            found = json.loads(body) if body else []
            yield from map(_study, found)
            if len(found) < self.page:
                return
            page += partition.step


def study_source(name: str, transport) -> type[DataSource]:
    """A data source of studies, to be registered under ``name``; options ``page`` (rows of a request, 500) and ``partitions`` (8)."""

    class StudySource(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return STUDY_SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return _StudyReader(transport, int(self.options.get("page", 500)), int(self.options.get("partitions", 8)))

    return StudySource


# Other requests


def metadata_request(study: Column, series: Column | None = None, instance: Column | None = None) -> Column:
    """The metadata of a study, or of one of its series or instances."""
    parts = [F.lit("studies/"), study] + ([F.lit("/series/"), series] if series is not None else []) + ([F.lit("/instances/"), instance] if instance is not None else [])
    return F.concat(*parts, F.lit("/metadata"))


def object_request(study: Column, series: Column, instance: Column, content_type: str = FILE) -> Column:
    """The older form of a request for one object."""
    return F.concat(F.lit("wado?requestType=WADO&studyUID="), F.url_encode(study), F.lit("&seriesUID="), F.url_encode(series), F.lit("&objectUID="), F.url_encode(instance), F.lit("&contentType=" + urllib.parse.quote(content_type, safe="")))


def answers(requests: DataFrame, transport, accept: str, request: str = "request") -> DataFrame:
    """``requests`` with ``status, content_type, body``, asked one after the other by each task; bodies only of answers that are good."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, asked in enumerate(batch[request].to_pylist()):
                status, kind, body = (None, None, None) if asked is None else transport.get(asked, accept)
                row = batch.slice(i, 1)
                told = [pa.array([status], pa.int32()), pa.array([kind], pa.string()), pa.array([body if status == 200 else None], pa.binary())]
                yield pa.RecordBatch.from_arrays([*row.columns, *told], [*row.schema.names, "status", "content_type", "body"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema)
    return requests.mapInArrow(run, f"{kinds}, status int, content_type string, body binary")


def boundary(content_type: Column) -> Column:
    """What divides the parts of a multipart answer; null where the type names none."""
    found = F.regexp_extract(content_type, r'(?i)boundary=("([^"]+)"|([^;\s]+))', 1)
    return F.when(found != "", F.regexp_replace(found, '"', ""))


def parts(rows: DataFrame, content_type: str = "content_type", body: str = "body") -> DataFrame:
    """Multipart bodies to a row for each part: ``part`` (from 0), ``part_type``, ``content``. Bodies without a boundary are one part.

    Bytes are taken as characters one by one, which loses none, so that texts can be cut at the boundary.
    """
    text = F.decode(F.col(body), "ISO-8859-1")
    line = F.concat(F.lit("\r\n--"), boundary(F.col(content_type)))
    # The first boundary may stand at the start; what follows the last one is no part.
    cut = F.split(F.concat(F.lit("\r\n"), text), F.concat(F.lit(r"\Q"), line, F.lit(r"\E")))
    inner = F.filter(F.transform(F.slice(cut, 2, F.greatest(F.size(cut) - 1, F.lit(0))), lambda p: F.when(~p.startswith("--"), p)), lambda p: p.isNotNull())
    whole = F.array(F.concat(F.lit("\r\n\r\n"), text))
    listed = rows.where(F.col(body).isNotNull()).select("*", F.posexplode(F.when(line.isNull(), whole).otherwise(inner)).alias("part", "__part"))
    at = F.locate("\r\n\r\n", F.col("__part"))
    head, rest = F.substring("__part", F.lit(1), at - 1), F.substring("__part", at + 4, F.char_length("__part"))
    own = F.regexp_extract(head, r"(?im)^content-type:[ \t]*([^\r\n]*)", 1)
    kind = F.when(line.isNull(), F.col(content_type)).when(own != "", F.trim(own))
    return listed.where(at > 0).withColumns({"part_type": kind, "content": F.encode(rest, "ISO-8859-1")}).drop("__part")
