"""WARC archives with a two-level capture index.

Writing. Pages are sorted by their URL key, whose host is reversed (``com,example,www)/path``), so that
the captures of a site lie together. Each task writes one archive of gzip members, one for each
record, and beside it the second level of the index: the sorted captures of the archive in
compressed blocks. The first level is a sparse directory with the first key and the place of each
block. A manifest table names the archives in key order.

Reading. A key is searched by bisection in the manifest and in the directory; one range read fetches
the block, a bisection in it finds the captures, and a range read fetches each record. Nothing else
of an archive is read.

Archives are written to names of their own for every attempt of a task, and only the manifest, which
Spark commits, says which of them count. A lost task is run again under another name.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coinbrook.llm.common import Batches, batch, by_arrow
from coinbrook.sinks.scratch import materialize, scratch_path

#: Payloads of fewer bytes are stored again rather than referred to.
LEAST_SHARED_BYTES = 100
BLOCK_CAPTURES = 300
GZIP_LEVEL = 3
#: Pages carry no time of capture.
CAPTURED = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_NO_ID = -(1 << 63) - 1

#: Bytes of an archive that a task reads where a whole one is looked up.
BYTES_PER_LOOKUP = 4 << 20
MANIFEST = "shard int, first_key string, first_id long, archive string, index string, directory long, captures long, bytes long"
MANIFEST_TYPES = {
    "shard": pa.int32(),
    "first_key": pa.string(),
    "first_id": pa.int64(),
    "archive": pa.string(),
    "index": pa.string(),
    "directory": pa.int64(),
    "captures": pa.int64(),
    "bytes": pa.int64(),
}
CAPTURE_TYPES = {
    "page_id": pa.int64(),
    "url": pa.string(),
    "record_type": pa.string(),
    "payload_bytes": pa.int64(),
    "payload_digest": pa.string(),
    "refers_to": pa.int64(),
    "payload": pa.binary(),
}
CAPTURE = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def url_key(url: Column) -> Column:
    """The URL with its host in lower case and reversed, without scheme, user and port; '' for null."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    authority = F.regexp_extract(text, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), ":[0-9]*$", ""))
    rest = F.regexp_extract(text, r"(?s)^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*(.*)$", 1)
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)
    return F.when(authority != "", key).otherwise(text)


def _sortable(page_id: int | None) -> int:
    """Ids in the order in which Spark sorts them: null comes first."""
    return _NO_ID if page_id is None else page_id


# -- writing -------------------------------------------------------------------------------


def _with_roles(pages: DataFrame) -> DataFrame:
    """Key, URL, payload, digest, and for revisits the page and URL that they refer to.

    A revisit gives up its payload here, before rows are moved.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        url_key(F.col("url")).alias("key"),
        F.col("page_id").cast("long"),
        F.col("url").cast("string"),
        payload.alias("payload"),
    )
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("n", F.octet_length("payload"))
    shared = (
        rows.filter(F.col("n") >= LEAST_SHARED_BYTES)
        .groupBy("digest")
        .agg(
            F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"),
            F.count("*").alias("copies"),
        )
        .filter("copies > 1 and first is not null")
        .select("digest", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"))
    )
    # Stored, so that its size is known: unless it is large, it is broadcast and no page moves for it.
    marked = rows.join(materialize(shared, "shared-payloads"), "digest", "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return marked.select(
        "key",
        "page_id",
        "url",
        "digest",
        F.when(~revisit, F.col("payload")).alias("payload"),
        F.when(revisit, F.col("first_id")).alias("refers_to"),
        F.when(revisit, F.col("first_url")).alias("refers_to_url"),
    )


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def _header(text: str | None) -> str:
    """A URL as a header value: other than visible ASCII characters are percent-encoded."""
    return quote(text or "", safe="%:/?#[]@!$&'()*+,;=-._~")


def warc_record(row: dict) -> bytes:
    """One record of an archive, as a gzip member."""
    headers = [("WARC-Type", "response" if row["refers_to"] is None else "revisit")]
    headers += [
        ("WARC-Record-ID", _record_id(row["page_id"], row["digest"])),
        ("WARC-Date", CAPTURED),
        ("WARC-Target-URI", _header(row["url"])),
        ("WARC-Payload-Digest", f"sha256:{row['digest']}"),
        ("Page-ID", "" if row["page_id"] is None else str(row["page_id"])),
    ]
    payload = row["payload"] or b""
    if row["refers_to"] is not None:
        headers += [
            ("WARC-Profile", REVISIT_PROFILE),
            ("WARC-Refers-To", _record_id(row["refers_to"], row["digest"])),
            ("WARC-Refers-To-Target-URI", _header(row["refers_to_url"])),
            ("Refers-To-Page-ID", str(row["refers_to"])),
        ]
    block = _HTTP % len(payload) + payload
    headers += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", GZIP_LEVEL, mtime=0)


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a record."""
    data = gzip.decompress(member)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def file_system(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a URI or a path, and the path in it."""
    if "://" not in uri and not uri.startswith("file:"):
        return pa.fs.LocalFileSystem(), uri
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pa.fs.FileSystem.from_uri(uri)


class _Shard:
    """One archive and its index while they are written."""

    def __init__(self, path: str, shard: int) -> None:
        self.files, root = file_system(path)
        self.files.create_dir(root, recursive=True)
        name = f"{shard:06d}-{uuid.uuid4().hex}"
        self.shard, self.archive, self.index = shard, f"{path}/{name}.warc.gz", f"{path}/{name}.cdx"
        # Not compressed by the stream, although the name ends in .gz: records are members already.
        self.records = self.files.open_output_stream(f"{root}/{name}.warc.gz", compression=None)
        self.blocks = self.files.open_output_stream(f"{root}/{name}.cdx", compression=None)
        info = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: %s\r\nWARC-Date: %s\r\nContent-Type: application/warc-fields\r\nContent-Length: 18\r\n\r\nformat: WARC/1.1\r\n\r\n\r\n"
        self.at = self._put(self.records, gzip.compress(info % (_record_id(None, name).encode(), CAPTURED.encode()), mtime=0))
        self.block_at = self.captures = 0
        self.first: tuple[str, int | None] | None = None
        self.lines: list[list] = []
        self.directory: list[list] = []

    @staticmethod
    def _put(stream: pa.NativeFile, data: bytes) -> int:
        stream.write(data)
        return len(data)

    def add(self, row: dict) -> None:
        if self.first is None:
            self.first = (row["key"], row["page_id"])
        member = warc_record(row)
        self.lines.append([row["key"], row["page_id"], row["url"], self.at, len(member)])
        self.at += self._put(self.records, member)
        self.captures += 1
        if len(self.lines) == BLOCK_CAPTURES:
            self._end_block()

    def _end_block(self) -> None:
        if self.lines:
            data = zlib.compress("\n".join(json.dumps(line) for line in self.lines).encode())
            self.directory.append([*self.lines[0][:2], self.block_at, len(data)])
            self.block_at += self._put(self.blocks, data)
            self.lines = []

    def close(self) -> dict:
        self._end_block()
        directory = self.block_at
        self.blocks.write(zlib.compress(json.dumps(self.directory).encode()))
        self.records.close()
        self.blocks.close()
        return {
            "shard": [self.shard],
            "first_key": [self.first[0]],
            "first_id": [self.first[1]],
            "archive": [self.archive],
            "index": [self.index],
            "directory": [directory],
            "captures": [self.captures],
            "bytes": [self.at],
        }


def write_archive(pages: DataFrame, path: str) -> DataFrame:
    """Write a record for every row of ``pages`` (``page_id``, ``url``, ``html``) below ``path``.

    Returns the manifest. The payload is the html in UTF-8, null being empty. Of equal payloads of at
    least ``LEAST_SHARED_BYTES`` that with the smallest page_id is a response, the others are revisits
    of it; rows that share that page_id as well are all responses, and so are all if none has a
    page_id. An empty table gives an archive without records.
    """
    rows = _with_roles(pages)

    def write(batches: Batches) -> Batches:
        shard = None
        for b in batches:
            for row in b.to_pylist():
                shard = shard or _Shard(path, TaskContext.get().partitionId())
                shard.add(row)
        if shard:
            yield batch(shard.close(), MANIFEST_TYPES)

    ordered = rows.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")
    manifest = by_arrow(ordered, write, MANIFEST)
    # One row a shard, first as the tasks leave them; then few files, since every reader opens them.
    manifest.write.parquet(f"{path}/shards")
    written = pages.sparkSession.read.schema(MANIFEST).parquet(f"{path}/shards")
    written.coalesce(8).write.parquet(f"{path}/manifest")
    return pages.sparkSession.read.schema(MANIFEST).parquet(f"{path}/manifest")


# -- reading -------------------------------------------------------------------------------


class Capture(NamedTuple):
    key: str
    page_id: int | None
    url: str | None
    offset: int
    length: int


class CaptureIndex:
    """Looks up captures by bisection and range reads. Keeps one directory and one block at a time."""

    def __init__(self, path: str) -> None:
        files, root = file_system(f"{path}/manifest")
        rows = pq.read_table(root, filesystem=files).to_pylist()
        self.shards = sorted(rows, key=lambda r: self._order(r["first_key"], r["first_id"]))
        self.firsts = [self._order(r["first_key"], r["first_id"]) for r in self.shards]
        self.open: dict[str, pa.NativeFile] = {}
        self.shard = self.block = -1
        self.directory: list[list] = []
        self.starts: list[tuple[bytes, int]] = []
        self.captures: list[Capture] = []
        self.places: list[tuple[bytes, int]] = []

    @staticmethod
    def _order(key: str, page_id: int | None) -> tuple[bytes, int]:
        return key.encode("utf-8", "surrogatepass"), _sortable(page_id)

    def read(self, uri: str, offset: int, length: int) -> bytes:
        if uri not in self.open:
            if len(self.open) > 8:
                self.open.popitem()[1].close()
            files, path = file_system(uri)
            self.open[uri] = files.open_input_file(path)
        source = self.open[uri]
        source.seek(offset)
        return source.read(length if length >= 0 else None)

    def _load_shard(self, shard: int) -> None:
        if shard != self.shard:
            row = self.shards[shard]
            self.directory = json.loads(zlib.decompress(self.read(row["index"], row["directory"], -1)))
            self.starts = [self._order(*d[:2]) for d in self.directory]
            self.shard, self.block = shard, -1

    def _load_block(self, block: int) -> None:
        if block != self.block:
            _, _, offset, length = self.directory[block]
            lines = zlib.decompress(self.read(self.shards[self.shard]["index"], offset, length)).split(b"\n")
            self.captures = [Capture(*json.loads(line)) for line in lines]
            self.places = [self._order(c.key, c.page_id) for c in self.captures]
            self.block = block

    def find(self, least: tuple[bytes, int], most: tuple[bytes, int]) -> Iterator[tuple[Capture, str]]:
        """Captures between two places of the order, both included, and their archives."""
        shard = max(0, bisect.bisect_left(self.firsts, least) - 1)
        while shard < len(self.shards) and self.firsts[shard] <= most:
            self._load_shard(shard)
            block = max(0, bisect.bisect_left(self.starts, least) - 1)
            while block < len(self.directory) and self.starts[block] <= most:
                self._load_block(block)
                at = bisect.bisect_left(self.places, least)
                for k in range(at, bisect.bisect_right(self.places, most)):
                    yield self.captures[k], self.shards[shard]["archive"]
                block += 1
            shard += 1

    def of_page(self, key: str, page_id: int | None) -> Iterator[tuple[Capture, str]]:
        place = self._order(key, page_id)
        return self.find(place, place)

    def of_key(self, key: str) -> Iterator[tuple[Capture, str]]:
        return self.find(self._order(key, None), (key.encode("utf-8", "surrogatepass"), 1 << 63))


def lookup(keys: DataFrame, path: str, payloads: bool = True, tasks: int | None = None) -> DataFrame:
    """The captures of an archive for every row of ``keys``.

    ``keys`` has a URL ``key`` and may have a ``page_id``; without that column all captures of the
    URL are returned. Returns page_id, url, record_type, payload_bytes, payload_digest, refers_to and
    payload (null unless asked for). Size and digest are taken from the payload that was read; a
    revisit has the digest of its header, no size and no payload. A key without captures gives no
    row, a repeated key repeats them. ``tasks`` is the number of tasks that read; without it Spark
    goes by the size of the keys, which suits a few of them.
    """
    single = "page_id" in keys.columns
    names = ["key", "page_id"] if single else ["key"]

    def fetch(batches: Batches) -> Batches:
        index = None
        for b in batches:
            index = index or CaptureIndex(path)
            out: list[tuple] = []
            size = 0
            for query in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for capture, archive in index.of_page(*query) if single else index.of_key(*query):
                    headers, payload = parse_record(index.read(archive, capture.offset, capture.length))
                    response = headers["WARC-Type"] == "response"
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                    if response and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"damaged record at {capture.offset} of {archive}")
                    refers = headers.get("Refers-To-Page-ID")
                    out.append(
                        (
                            int(headers["Page-ID"]) if headers["Page-ID"] else None,
                            capture.url,
                            headers["WARC-Type"],
                            len(payload) if response else None,
                            digest,
                            int(refers) if refers else None,
                            payload if response and payloads else None,
                        )
                    )
                    size += len(payload) if payloads else 0
                    if size > 8_000_000:
                        yield _captures(out)
                        out, size = [], 0
            yield _captures(out)

    dealt = keys.select(*names)
    dealt = dealt.repartitionByRange(tasks, *names) if tasks else dealt.repartitionByRange(*names)
    return by_arrow(dealt.sortWithinPartitions(*names), fetch, CAPTURE)


def _captures(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in CAPTURE_TYPES]
    return batch(dict(zip(CAPTURE_TYPES, map(list, columns), strict=True)), CAPTURE_TYPES)


def archive_and_read(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write ``pages`` to an archive in the shared folder, and look every page up in it.

    Returns page_id, payload_bytes, payload_digest, record_type and refers_to of every record; those
    of a revisit are the size and digest of the record that it refers to.
    """
    path = scratch_path(spark, "warc")
    written = write_archive(pages, path).agg(F.sum("bytes")).first()[0] or 0
    keys = pages.select(url_key(F.col("url")).alias("key"), F.col("page_id").cast("long")).distinct()
    tasks = max(1, -(-written // BYTES_PER_LOOKUP))
    found = materialize(lookup(keys, path, payloads=False, tasks=tasks).drop("payload", "url"), "captures")
    full = found.filter("record_type = 'response'").select(
        F.col("page_id").alias("refers_to"), "payload_digest", F.col("payload_bytes").alias("full_bytes")
    )
    full = full.distinct()
    revisits = found.filter("record_type = 'revisit'").join(full, ["refers_to", "payload_digest"])
    revisits = revisits.withColumn("payload_bytes", F.col("full_bytes"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return found.filter("record_type = 'response'").select(columns).unionByName(revisits.select(columns))
