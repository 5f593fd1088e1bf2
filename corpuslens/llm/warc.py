"""WARC archives with a two-level capture index."""

from __future__ import annotations

import base64
import hashlib
import math
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm import shared

#: Payloads from this size on are stored once. Lines of an index block; bytes after which a new archive is begun.
LEAST, BLOCK_LINES, ARCHIVE_BYTES = 1000, 512, 1 << 28
#: Keys that a task looks up, and bytes of records that it reads.
LOOKUPS, READ_BYTES = 50_000, 1 << 25
FIRST = -(1 << 63)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def reversed_key(url: str | None) -> str:
    """The URL without scheme, user, default port and fragment, its host lower-cased and its labels reversed: com,example,www)/path?query.
    Tabs, line ends and spaces are escaped."""
    rest = (url or "").strip()
    scheme, sep, after = rest.partition("://")
    rest = (after if sep else rest).partition("#")[0]
    cut = min((i for i in (rest.find("/"), rest.find("?")) if i >= 0), default=len(rest))
    host, path = rest[:cut].rpartition("@")[2].lower().rstrip("."), rest[cut:] or "/"
    name, colon, port = host.partition(":")
    if colon and port == {"http": "80", "https": "443"}.get(scheme.lower()):
        colon = port = ""
    key = ",".join(reversed(name.rstrip(".").split("."))) + colon + port + ")" + path
    return "".join(f"%{ord(c):02X}" if c <= " " else c for c in key)


@dataclass
class Archives:
    """captures: key, id, file, offset, length of every record, of which there are so many with so many bytes. parts: first_key,
    first_id, file, directory offset and length of each index file, in order: as many rows as there are index files."""

    captures: DataFrame
    parts: list[tuple]
    folder: str
    records: int
    bytes: int


def _open(uri: str):
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs, path


def _member(record: bytes) -> bytes:
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(record) + pack.flush()


def _named(place: str) -> str:
    """The id of the record at a place (file and offset), which no other record has."""
    return f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, place)}>"


def _info(name: str) -> bytes:
    """What stands first in an archive."""
    body = b"software: corpuslens\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", _named(f"{name}:0"), f"WARC-Date: {DATE}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _uri(url: str | None) -> str:
    return " ".join((url or "").split())


def _record(page_id: int | None, url: str | None, payload: bytes, digest: bytes, size: int, refers: int | None, refers_url: str | None = None, place: str = "") -> bytes:
    """The ids of pages stand in headers of their own, of which a null one has none."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http + payload if refers is None else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers is None else 'revisit'}",
        _named(place),
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_uri(url)}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
        "Content-Type: application/http;msgtype=response",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To-Target-URI: {_uri(refers_url)}", f"WARC-Refers-To-Date: {DATE}", f"X-Refers-To-Page-ID: {refers}"]
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(record: bytes) -> dict:
    """Of one response or revisit: page_id, url, type, refers_to, payload (None for a revisit), payload_bytes, payload_digest (hex)."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:"))
    own = fields.get("x-page-id")
    out = {"page_id": None if own is None else int(own), "url": fields.get("warc-target-uri", ""), "type": fields["warc-type"], "refers_to": None, "payload": payload, "payload_bytes": len(payload), "payload_digest": digest.hex()}
    if out["type"] == "revisit":
        size = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        out |= {"refers_to": int(fields["x-refers-to-page-id"]), "payload": None, "payload_bytes": size}
    elif hashlib.sha1(payload).digest() != digest:
        raise ValueError(f"the payload of page {out['page_id']} doesn't have its digest")
    return out


def _writer(folder: str):
    """Each record becomes a gzip member of its own. A task that runs again writes new files; only those that its rows name are read."""

    def run(batches):
        fs, path = _open(folder)
        fs.create_dir(path, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            rows = []
            for page_id, url, html, refers, refers_url in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                    at = out.write(_member(_info(name)))
                payload = (html or "").encode()
                member = _member(_record(page_id, url, payload, hashlib.sha1(payload).digest(), len(payload), refers, refers_url, f"{name}:{at}"))
                out.write(member)
                rows.append((reversed_key(url), FIRST if page_id is None else page_id, name, at, len(member)))
                at += len(member)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), CAPTURE_TYPES, strict=True)] if rows else [pa.nulls(0, t) for t in CAPTURE_TYPES], CAPTURE_NAMES)
        if out is not None:
            out.close()

    return run


CAPTURE_NAMES = ["key", "id", "file", "offset", "length"]
CAPTURE_TYPES = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
CAPTURES = "key string, id long, file string, offset long, length long"
PARTS = "first_key string, first_id long, file string, offset long, length long"


def _line(key: str, *rest) -> str:
    return "\t".join([key, *map(str, rest)])


def _split(line: str) -> tuple:
    key, page_id, file, offset, length = line.split("\t")
    return key, int(page_id), file, int(offset), int(length)


def _order(entry: tuple) -> tuple[bytes, int]:
    return entry[0].encode(), entry[1]


def _indexer(folder: str):
    """Sorted captures of one partition -> an index file of compressed blocks, with a directory of their first keys at its end."""

    def run(batches):
        fs, path = _open(folder)
        fs.create_dir(path, recursive=True)
        name, first, held, directory, at, out = f"{uuid.uuid4().hex}.idx", None, [], [], 0, None

        def block():
            nonlocal at, held
            data = zlib.compress("\n".join(held).encode())
            key, page_id = _split(held[0])[:2]
            directory.append(_line(key, page_id, name, at, len(data)))
            out.write(data)
            at, held = at + len(data), []

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    out, first = fs.open_output_stream(f"{path}/{name}", compression=None), row[:2]
                held.append(_line(*row))
                if len(held) == BLOCK_LINES:
                    block()
        if out is not None:
            if held:
                block()
            data = zlib.compress("\n".join(directory).encode())
            out.write(data)
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip([*first, name, at, len(data)], CAPTURE_TYPES, strict=True)], ["first_key", "first_id", "file", "offset", "length"])

    return run


def write(pages: DataFrame, least: int = LEAST) -> Archives:
    """Archives and index of pages(page_id, url, html, ...), in the shared folder: a record for each row, with the html in UTF-8 as
    payload (null: empty). Of equal payloads of `least` bytes or more, the row with the largest page_id is a response and the
    others are revisits of it; rows that share that page_id are all responses, each a record of its own. A null page_id counts as the
    smallest number and stays null, and a null url as empty. Other columns are ignored; of an empty table there are no files and no index."""
    spark = pages.sparkSession
    shared.small_batches(spark)
    digest = F.unhex(F.sha2("html", 256)).alias("digest")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("page_id").cast("long"), F.lit(FIRST)).alias("id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    large = own.where(F.octet_length("html") >= least).select("id", "url", digest)
    digests = shared.table(large.select("id", "digest"), "digests")
    heads = large.groupBy("digest").agg(F.max(F.struct("id", "url")).alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    heads = shared.table(heads, "heads")
    revisits = shared.join_groups(digests, heads, "digest").where("id <> head.id").distinct()
    rows = own.select("*", digest).join(revisits.hint("shuffle_hash"), ["id", "digest"], "left").select("page_id", "url", "html", F.col("head.id").alias("refers"), F.col("head.url").alias("refers_url"))
    folder = shared.new_path(spark, "warc")
    captures = shared.table(rows.mapInArrow(_writer(folder), CAPTURES), "captures")
    shared.drop(digests, heads)
    seen = captures.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("size")).first()
    ordered = captures.repartitionByRange(_tasks(spark, seen.n, LOOKUPS), "key", "id").sortWithinPartitions("key", "id")
    parts = shared.table(ordered.mapInArrow(_indexer(folder), PARTS), "parts").collect()  # a row for each partition
    return Archives(captures, sorted((tuple(r) for r in parts), key=_order), folder, seen.n, seen.size)


def _tasks(spark: SparkSession, size: int, share: int) -> int:
    """How many tasks share work of a size, with a share each at most; a number that is given isn't merged to fewer."""
    return max(spark.sparkContext.defaultParallelism, math.ceil(size / share))


class Index:
    """Reads an index: the part and then the block by binary search, and of archives only the bytes of a record."""

    def __init__(self, folder: str, parts: list[tuple]):
        self.fs, self.path = _open(folder)
        self.parts, self.starts = parts, [_order(p) for p in parts]
        self._directory: tuple = (None, [], [])
        self._block: tuple = (None, [], [])
        self._file: tuple = ("", None)

    def bytes_of(self, file: str, offset: int, length: int) -> bytes:
        if self._file[0] != file:
            if self._file[1]:
                self._file[1].close()
            self._file = (file, self.fs.open_input_file(f"{self.path}/{file}"))
        self._file[1].seek(offset)
        return self._file[1].read(length)

    def part(self, key: tuple[bytes, int]) -> int:
        """The part in which entries of this key begin. Equal keys may go on in the next ones."""
        return max(0, bisect_left(self.starts, key) - 1)

    def _lines(self, file: str, offset: int, length: int) -> list[tuple]:
        return [_split(x) for x in zlib.decompress(self.bytes_of(file, offset, length)).decode().split("\n")]

    def find(self, key: tuple[bytes, int]) -> Iterator[tuple]:
        """The captures (key, id, file, offset, length) of a key and id."""
        for k in range(self.part(key), len(self.parts)):
            if self.starts[k] > key:
                return
            if self._directory[0] != k:
                rows = self._lines(*self.parts[k][2:])
                self._directory = (k, rows, [_order(r) for r in rows])
            _, rows, starts = self._directory
            for b in range(max(0, bisect_left(starts, key) - 1), len(rows)):
                if starts[b] > key:
                    return
                if self._block[0] != (k, b):
                    lines = self._lines(*rows[b][2:])
                    self._block = ((k, b), lines, [_order(x) for x in lines])
                _, lines, keys = self._block
                yield from lines[bisect_left(keys, key) : bisect_right(keys, key)]

    def record(self, capture: tuple) -> bytes:
        return zlib.decompress(self.bytes_of(*capture[2:]), 31)


def lookup(spark: SparkSession, archives: Archives, wanted: DataFrame) -> DataFrame:
    """wanted(url, page_id) -> key, id, file, offset, length of their captures, through the index. Sorted by key, a task reads each block once."""
    folder, parts = archives.folder, archives.parts
    if not parts:
        return spark.createDataFrame([], CAPTURES)

    def keys(batches):
        for batch in batches:
            own = [(reversed_key(u), FIRST if i is None else i) for u, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in own], pa.string()), pa.array([i for _, i in own], pa.int64())], ["key", "id"])

    def find(batches):
        index = Index(folder, parts)
        for batch in batches:
            rows = [x for k, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for x in index.find((k.encode(), i))]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(CAPTURE_TYPES)], CAPTURE_NAMES)

    asked = wanted.select("url", F.col("page_id").cast("long").alias("page_id")).mapInArrow(keys, "key string, id long").distinct()
    ordered = asked.repartitionByRange(_tasks(spark, archives.records, LOOKUPS), "key", "id").sortWithinPartitions("key", "id")
    return shared.table(ordered.mapInArrow(find, CAPTURES), "found")


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_records(archives: Archives, captures: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of captures, read by ranges in the order of the archives: page_id, url, payload_bytes, payload_digest,
    record_type, refers_to, and with payloads the payload (null for revisits). A response whose payload lacks its digest is an error."""
    folder = archives.folder

    def run(batches):
        index = Index(folder, [])
        for batch in batches:
            size, rows = 0, []
            for capture in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                r = parse(index.record(capture))
                rows.append([r["page_id"], r["url"], r["payload_bytes"], r["payload_digest"], r["type"], r["refers_to"]] + [r["payload"]] * payloads)
                size += len(r["payload"] or b"") * payloads
                if size > shared.CHUNK_BYTES:
                    yield _batch(rows, payloads)
                    size, rows = 0, []
            yield _batch(rows, payloads)

    # Ranges of one archive go to several tasks, as each record is a member of its own.
    tasks = _tasks(captures.sparkSession, archives.bytes, READ_BYTES)
    ordered = captures.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return ordered.select(*CAPTURE_NAMES).mapInArrow(run, READ + ", payload binary" * payloads)


def _batch(rows: list, payloads: bool) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * payloads
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payloads
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)


def op5_warc(spark, sf_dir: str) -> DataFrame:
    pages = shared.read(spark, sf_dir, "pages")
    archives = write(pages)
    found = lookup(spark, archives, pages.select("url", "page_id"))
    return read_records(archives, found).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
SELECT page_id, size AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN size >= 1000 AND page_id <> head THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN size >= 1000 AND page_id <> head THEN head END AS refers_to
FROM (SELECT page_id, html, octet_length(encode(html)) AS size, max(page_id) OVER (PARTITION BY html) AS head
      FROM (SELECT page_id, coalesce(html, '') AS html FROM pages))
"""
