"""Web archives and a two-level index of their captures.

Archives are WARC 1.1 files whose records are gzip members of their own, so that a record is read by its offset and length. The
index has two levels: capture lines, sorted by the URL with its host reversed, are packed into compressed blocks of a part file, and
beside each part lies a sparse directory, one line for each block. A look-up finds its part among the parts' bounds, its block by
binary search in the directory, its lines by binary search in the block, and then reads the ranges of the archives.

Files are written by tasks under names that no other attempt uses; only those named in a task's committed rows count. Folders may be
on any file system that ``pyarrow.fs`` knows by its address.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_folder, small_arrow_batches, text_or_empty

#: Payloads of fewer bytes are stored each time.
LEAST_SHARED = 100
#: Bytes after which a task begins another archive, capture lines of a block and of a part file, and parts at most, whose bounds are broadcast.
ARCHIVE_BYTES, BLOCK_LINES, PART_LINES, MOST_PARTS = 1 << 30, 512, 100_000, 20_000
#: Characters of a part's first and last key that choose parts.
BOUND = 200
#: Groups of equal payloads that are broadcast at most; a row takes some 300 bytes.
MOST_BROADCAST = 100_000
#: Bytes that a scan asks its file system for at once, and hands to the unpacker at once.
AHEAD, WINDOW = 4 << 20, 1 << 16

RECORD = "archive string, offset bigint, length bigint, type string, record_id string, url string, key string, payload_bytes bigint, payload_digest string, refers_to string, refers_to_key string"
_FIELDS = [part.split() for part in RECORD.split(", ")]


# Files


def _file_system(address: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(address)


def _created(folder: str, suffix: str) -> tuple[str, pa.NativeFile]:
    """The address of a new file in ``folder`` that no other attempt of the task writes to, and the file."""
    address = f"{folder}/{uuid.uuid4().hex}{suffix}"
    fs, path = _file_system(address)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    return address, fs.open_output_stream(path, compression=None)


def _opened(address: str) -> pa.NativeFile:
    fs, path = _file_system(address)
    return fs.open_input_file(path)


def _addressed(folder: str) -> str:
    """Folders without a scheme are local ones."""
    return folder if "://" in folder else re.sub(r"^file:/(?!/)|^/", "file:///", folder)


def _packed(data: bytes) -> bytes:
    """One gzip member that is the same whenever it is made."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared folder: its tasks, and the files that they write, run once."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


# Records


def target(url: Column) -> Column:
    """The URL as it stands in a header: controls and blanks, which would end the line, as percent codes."""
    line = F.coalesce(url, F.lit(""))
    for code in (*range(0x21), 0x7F):
        line = F.replace(line, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return line


def reversed_host(url: str) -> str:
    """``https://user@www.example.com:443/a?b#c`` as ``com,example,www)/a?b``: neighbours in this order are neighbours on the web. Schemes, users, default ports and fragments do not count; hosts are lower-cased."""
    m = re.match(r"(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://)?(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)(?::(\d*))?([^#]*)", url)
    scheme, host, port, rest = m.groups()
    named = host.lower() if host.startswith("[") else ",".join(reversed(host.lower().rstrip(".").split(".")))
    default = {"http": "80", "https": "443"}.get((scheme or "").lower(), "")
    return f"{named}{f':{port}' if port and port != default else ''}){rest if rest.startswith('/') else '/' + rest}"


def captures_to_write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_SHARED) -> DataFrame:
    """(record_id, url, payload, type, digest, refers_to, refers_to_url) of each page.

    Of payloads that are equal (by SHA-256 and length) and have ``least`` bytes or more, that of the smallest id is a response and the
    others revisit it. Only the digests are grouped; payloads are not shuffled where the groups are few enough to be broadcast.
    """
    html = text_or_empty(html_col)
    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), target(F.col(url_col)).alias("url"), html.alias("payload"), F.octet_length(html).alias("n_bytes"), F.sha2(F.encode(html, "UTF-8"), 256).alias("digest"))
    own = F.struct(F.col("id").isNull().alias("unnamed"), "id", "url")
    equal = rows.where(F.col("n_bytes") >= least).groupBy("digest", "n_bytes").agg(F.count("*").alias("n"), F.min(own).alias("first")).where("n > 1")
    equal = _written(equal.select("digest", "n_bytes", F.col("first.id").alias("first_id"), F.col("first.url").alias("first_url")), "warc-equal")
    named = lambda i: F.concat(F.lit("<urn:page:"), F.coalesce(i.cast("string"), F.lit("")), F.lit(">"))
    later = F.col("first_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id"))
    joined = rows.join(F.broadcast(equal) if equal.count() <= MOST_BROADCAST else equal, ["digest", "n_bytes"], "left")
    return joined.select(
        named(F.col("id")).alias("record_id"), "url", F.when(~later, F.col("payload")).alias("payload"), F.when(later, "revisit").otherwise("response").alias("type"), "digest",
        F.when(later, named(F.col("first_id"))).alias("refers_to"), F.when(later, F.col("first_url")).alias("refers_to_url"),
    )


def record_bytes(kind: str, record_id: str, url: str, digest: str, payload: bytes | None, refers_to: str | None, refers_to_url: str | None, date: str) -> bytes:
    """A record as it stands in an archive, unpacked. A revisit has the response's headers alone."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {date}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {refers_to}", f"WARC-Refers-To-Target-URI: {refers_to_url}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """A record's headers, by their names in lower case, and its payload: of HTTP responses what follows their headers."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}
    block = rest[: int(headers["content-length"])]
    if len(rest) != len(block) + 4:
        raise ValueError("a WARC record ends before its length")
    return headers, block.partition(b"\r\n\r\n")[2] if headers.get("content-type", "").startswith("application/http") else block


def _row(kind: str, record_id: str, url: str, payload_bytes: int | None, digest: str, refers_to: str | None, refers_to_url: str | None) -> tuple:
    """What is known of a record, after its archive, offset and length."""
    return kind, record_id, url, reversed_host(url), payload_bytes, digest, refers_to, None if refers_to_url is None else reversed_host(refers_to_url)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "bigint": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[kind]) for i, (_, kind) in enumerate(_FIELDS)], [name for name, _ in _FIELDS])


def write_archives(captures: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes the captures into archives in ``folder``, one or more a task; a row per record: where it lies, and what it is."""
    folder = _addressed(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        address, file = "", None
        try:
            for batch in batches:
                rows = []
                for kind, record_id, url, digest, payload, refers_to, refers_to_url in zip(*(batch[c] for c in ("type", "record_id", "url", "digest", "payload", "refers_to", "refers_to_url")), strict=True):
                    if file is None:
                        address, file = _created(folder, ".warc.gz")
                    kind, record_id, url, digest, refers_to, refers_to_url = (x.as_py() for x in (kind, record_id, url, digest, refers_to, refers_to_url))
                    text = payload.as_py()
                    content = None if text is None else text.encode()
                    member = _packed(record_bytes(kind, record_id, url, digest, content, refers_to, refers_to_url, date))
                    rows.append((address, file.tell(), len(member), *_row(kind, record_id, url, None if kind == "revisit" else len(content or b""), digest, refers_to, refers_to_url)))
                    file.write(member)
                    if file.tell() >= ARCHIVE_BYTES:
                        file.close()
                        file = None
                yield _rows(rows)
        finally:
            if file is not None:
                file.close()

    return _written(captures.mapInArrow(write, RECORD), "warc-captures")


def _streamed(address: str) -> pa.NativeFile:
    fs, path = _file_system(address)
    return fs.open_input_stream(path, compression=None, buffer_size=AHEAD)


def _members(file: pa.NativeFile) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of each gzip member of a file, read once from its start to its end."""
    start, at, rest = 0, 0, b""
    unpacker, parts = zlib.decompressobj(31), []
    while True:
        data = rest or file.read(WINDOW)
        rest = b""
        if not data:
            break
        parts.append(unpacker.decompress(data))
        at += len(data)
        if unpacker.eof:
            rest = unpacker.unused_data
            at -= len(rest)
            yield start, at - start, b"".join(parts)
            start, unpacker, parts = at, zlib.decompressobj(31), []
    if at != start:
        raise ValueError("an archive ends within a record")


def _told(headers: dict[str, str], payload: bytes) -> tuple:
    """What a record itself says. A response's length and digest are those of the payload that is there; a revisit has the digest of its header and no length."""
    stored = headers["warc-type"] != "revisit"
    digest = hashlib.sha256(payload).hexdigest() if stored else headers.get("warc-payload-digest", "").removeprefix("sha256:")
    return _row(headers["warc-type"], headers["warc-record-id"], headers.get("warc-target-uri", ""), len(payload) if stored else None, digest, headers.get("warc-refers-to"), headers.get("warc-refers-to-target-uri"))


def read_archives(archives: DataFrame) -> DataFrame:
    """A row per record of the archives named in ``archive``, each read from start to end by one task: for archives that have no index."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for address in batch["archive"].to_pylist():
                rows: list[tuple] = []
                with _streamed(address) as file:
                    for offset, length, data in _members(file):
                        rows.append((address, offset, length, *_told(*parsed_record(data))))
                        if len(rows) == 1000:
                            yield _rows(rows)
                            rows = []
                yield _rows(rows)

    named = archives.select("archive").distinct()
    return named.repartition(max(1, named.count())).mapInArrow(read, RECORD)


# Index


def write_index(records: DataFrame, folder: str) -> DataFrame:
    """Writes the two-level index of ``records``; (part, directory, first, last, blocks, captures) of each part.

    Captures are sorted by (key, record id, archive, offset) across the parts, so those of one URL may fill several. A part's
    directory file names for each of its blocks the first key and record id, the offset and the length.
    """
    folder = _addressed(folder)
    n_parts = min(MOST_PARTS, max(1, -(-records.count() // PART_LINES)))
    order = ["key", "record_id", "archive", "offset"]
    names = [*order, "length", "type", "payload_digest"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines: list[str] = []
        heads: list[str] = []
        file, n, first, last = None, 0, "", ""

        def block() -> None:
            data = _packed("\n".join(lines).encode())
            heads.append("\t".join((*lines[0].split("\t")[:2], str(file.tell()), str(len(data)))))
            file.write(data)
            lines.clear()

        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in names), strict=True):
                if file is None:
                    (part, file), first = _created(folder, ".cdx.gz"), row[0]
                lines.append("\t".join(map(str, row)))
                last, n = row[0], n + 1
                if len(lines) == BLOCK_LINES:
                    block()
        if file is not None:
            if lines:
                block()
            file.close()
            directory, beside = _created(folder, ".dir.gz")
            with beside:
                beside.write(_packed("\n".join(heads).encode()))
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (part, directory, first[:BOUND], last[:BOUND], len(heads), n)], ["part", "directory", "first", "last", "blocks", "captures"])

    # Keys and ids hold no tab or line end: these are percent codes in targets.
    rows = records.select(names).repartitionByRange(n_parts, *order).sortWithinPartitions(*order)
    return _written(rows.mapInArrow(pack, "part string, directory string, first string, last string, blocks bigint, captures bigint"), "warc-index")


class _Part:
    """One part of the index, open for look-ups; the block read last is kept."""

    def __init__(self, part: str, directory: str) -> None:
        with _opened(directory) as file:
            lines = zlib.decompress(file.read(), 31).decode().split("\n")
        self.heads = [(key.encode(), record.encode(), int(offset), int(length)) for key, record, offset, length in (line.split("\t") for line in lines)]
        self.file, self.at, self.lines = _opened(part), -1, []

    def block(self, k: int) -> list[tuple[bytes, bytes, list[str]]]:
        if k != self.at:
            _, _, offset, length = self.heads[k]
            self.at, self.lines = k, [(r[0].encode(), r[1].encode(), r[2:]) for r in (line.split("\t") for line in zlib.decompress(self.file.read_at(length, offset), 31).decode().split("\n"))]
        return self.lines

    def find(self, key: bytes, record: bytes | None) -> Iterator[tuple[bytes, bytes, list[str]]]:
        """The captures of a key, or of a key and record id, in order."""
        wanted = (key,) if record is None else (key, record)
        cut = len(wanted)
        k = max(0, bisect.bisect_left(self.heads, wanted, key=lambda h: h[:cut]) - 1)
        while k < len(self.heads) and self.heads[k][:cut] <= wanted:
            block = self.block(k)
            for line in block[bisect.bisect_left(block, wanted, key=lambda x: x[:cut]) :]:
                if line[:cut] != wanted:
                    return
                yield line
            k += 1


def look_up(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """Captures (key, record_id, archive, offset, length, type, payload_digest) of ``wanted`` (key, record_id): of all of the URL's where ``record_id`` is null.

    The parts' bounds, ``MOST_PARTS`` at most, are broadcast to find the parts; each part's look-ups come sorted to one task, which reads
    its directory and each block that it needs once.
    """
    parts = sorted((r.first.encode(), r.last.encode(), r.part, r.directory) for r in index.select("first", "last", "part", "directory").collect())
    bounds = wanted.sparkSession.sparkContext.broadcast(parts)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for key, record in zip(batch["key"].to_pylist(), batch["record_id"].to_pylist(), strict=True):
                start = key[:BOUND].encode()
                k = bisect.bisect_left(bounds.value, start, key=lambda p: p[1])
                while k < len(bounds.value) and bounds.value[k][0] <= start:
                    rows.append((*bounds.value[k][2:], key, record))
                    k += 1
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(4)], ["part", "directory", "key", "record_id"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, part = None, None
        for batch in batches:
            rows: list[tuple] = []
            for where, directory, key, record in zip(*(batch[c].to_pylist() for c in ("part", "directory", "key", "record_id")), strict=True):
                if where != name:
                    name, part = where, _Part(where, directory)
                for k, r, (archive, offset, length, kind, digest) in part.find(key.encode(), None if record is None else record.encode()):
                    rows.append((k.decode(), r.decode(), archive, int(offset), int(length), kind, digest))
                    if len(rows) == 10_000:
                        yield table(rows)
                        rows = []
            yield table(rows)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["key", "record_id", "archive", "offset", "length", "type", "payload_digest"])

    routed = wanted.where("key is not null").select("key", "record_id").distinct().mapInArrow(route, "part string, directory string, key string, record_id string")
    return routed.repartition("part").sortWithinPartitions("part", "key", "record_id").mapInArrow(search, "key string, record_id string, archive string, offset bigint, length bigint, type string, payload_digest string")


def fetched(found: DataFrame, value: Callable[[dict[str, str], bytes], tuple], kinds: str, n_tasks: int = 64) -> DataFrame:
    """The captures with what ``value`` makes of each one's headers and payload, by range reads in the order of archives and offsets."""
    fields = [f.split() for f in kinds.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        address, file = None, None
        for batch in batches:
            made = []
            for archive, offset, length in zip(*(batch[c].to_pylist() for c in ("archive", "offset", "length")), strict=True):
                if archive != address:
                    if file is not None:
                        file.close()
                    address, file = archive, _opened(archive)
                made.append(value(*parsed_record(zlib.decompress(file.read_at(length, offset), 31))))
            arrow = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([m[i] for m in made], arrow[kind]) for i, (_, kind) in enumerate(fields))], [*batch.schema.names, *(name for name, _ in fields)])

    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema)
    return found.repartitionByRange(n_tasks, "archive", "offset").sortWithinPartitions("archive", "offset").mapInArrow(read, f"{columns}, {kinds}")


def payloads(found: DataFrame) -> DataFrame:
    """The captures with their ``payload``."""
    return fetched(found, lambda headers, payload: (payload,), "payload binary")


def archived_pages(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_SHARED) -> DataFrame:
    """Writes the pages into archives, indexes and reads them back; one row per page: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    Rows come from the records read back: each is found by the index and read by its range. What a revisit refers to is found and read likewise,
    once however many revisit it; length and digest are those of that payload. The payload is the html in UTF-8, null an empty one. Of equal payloads of ``least`` bytes
    or more the smallest id is the response; rows that repeat this id are responses too; a null id comes last and is never referred
    to; where all ids of equal payloads are null, all are responses. Null URLs are empty ones; controls and blanks in URLs become
    percent codes. Other columns are not read; a text may have any length that a task's memory holds a few times; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    small_arrow_batches(spark)
    folder = folder or shared_folder(spark, "warc")
    captures = write_archives(captures_to_write(pages, id_col, url_col, html_col, least), f"{folder}/archives")
    index = write_index(captures, f"{folder}/index")
    own = ", ".join(f"own_{name} {kind}" for name, kind in _FIELDS[3:])
    read = _written(fetched(look_up(index, captures), _told, own).select(*(F.col(f"own_{name}").alias(name) for name, _ in _FIELDS[3:])), "warc-read")
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d*)>$", 1).try_cast("bigint")
    revisits = read.where("type = 'revisit'")
    told = read.where("type <> 'revisit'").select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.lit(None).cast("bigint").alias("refers_to"))
    if not revisits.limit(1).count():
        return told
    found = look_up(index, revisits.select(F.col("refers_to_key").alias("key"), F.col("refers_to").alias("record_id"))).where("type <> 'revisit'")
    full = fetched(found, _told, own).select(F.col("own_record_id").alias("refers_to"), F.col("own_payload_digest").alias("payload_digest"), F.col("own_payload_bytes").alias("payload_bytes")).distinct()
    again = revisits.select("record_id", "refers_to", "payload_digest").join(full, ["refers_to", "payload_digest"], "left")
    return told.unionByName(again.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), page("refers_to").alias("refers_to")))


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p
), f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to
FROM f
"""
