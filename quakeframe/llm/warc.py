"""WARC archives and a two-level capture index.

Archives have one gzip member per record, so that a record can be read by its offset and length alone. Of pages with
equal payloads (of ``least`` bytes or more) that of the largest id is a response; the others are revisits that refer
to it. The index sorts captures by the reversed-host form of their URL, cut into compressed blocks; each index file
ends with a sparse directory of its blocks (first key, offset, length). A lookup finds the files by their range of
keys and the blocks by binary search in the directory. The blocks found are dealt to tasks and read by range, each
once whatever the number of its keys that are asked for, and so are then the records. A URL with a third of all
captures is in many blocks, hence in many tasks.

Tasks write under names of their own and report them; the tables of names are committed by Spark, so that the files
of a task that died or ran twice are never read. Paths may be local to a shared file system or any URI that Arrow opens.

Defined results: a null html has an empty payload (of 0 bytes, equal to any other empty one); rows repeated with the
largest id are all responses; a null id is smaller than any; a null or broken URL is filed under what there is of it;
an empty table writes nothing and gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from typing import Any
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeframe.llm.common import scratch, spread_join, stored, text_batches

DATE = "2024-01-01T00:00:00Z"
#: Captures in an index block; bytes after which a task begins another archive; captures in an index file, about.
BLOCK = 1000
ARCHIVE_BYTES = 1 << 30
INDEX_ROWS = 5_000_000
#: Bytes of an archive that are read by one task together; bytes that a task reads, about.
RANGE_BYTES = 4 << 20
TASK_BYTES = 128 << 20
LEVEL = 4
_ID = "urn:x-page:"


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def surt(url: str | None) -> str:
    """Reversed-host key: host labels from the top, a closing parenthesis, path and query in lower case; without scheme, www., default port or fragment."""
    try:
        u = urlsplit((url or "").strip())
        host = (u.hostname or "").removeprefix("www.")
        port = f":{u.port}" if u.port and u.port not in (80, 443) else ""
    except ValueError:
        return (url or "").strip().lower()
    return ",".join(reversed(host.split("."))) + port + ")" + (u.path or "/").lower() + (f"?{'&'.join(sorted(u.query.lower().split('&')))}" if u.query else "")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str | None = None) -> bytes:
    """A response, or with ``refers_to`` a revisit, as one gzip member."""
    digest = digest or digest_of(payload)
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    target = "".join(c if c.isprintable() and c != " " else f"%{ord(c):02X}" for c in url or "")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_ID}{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", LEVEL, mtime=0)


def parse(member: bytes) -> dict[str, Any]:
    """Headers of a record by lower-case name, and its block's HTTP headers (http) and payload. A broken record raises ValueError."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    out: dict[str, Any] = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:] if ": " in x)}
    block = rest[: int(out["content-length"])]
    if lines[0] != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    http, _, out["payload"] = block.partition(b"\r\n\r\n")
    out["http"] = {k.lower(): v for k, v in (x.split(": ", 1) for x in http.decode().split("\r\n")[1:])}
    return out


def _to_id(uri: str) -> int | None:
    text = uri.strip("<>").removeprefix(_ID)
    return int(text) if text else None


def write_archives(pages: DataFrame, path: str, least: int = 0) -> DataFrame:
    """Write a record for every row of ``pages`` (page_id, url, html) under ``path``; returns the stored table of captures: key, page_id, url, file, offset, length."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), "url", html.alias("html"))
    hashed = rows.select("page_id", F.unhex(F.sha1("html")).alias("digest"), F.octet_length("html").alias("bytes"))
    # payloads that occur once are responses and are not joined
    groups = hashed.filter(F.col("bytes") >= least).groupBy("digest").agg(F.max("page_id").alias("latest"), F.count("*").alias("n")).filter(F.col("n") > 1)
    told = spread_join(rows.withColumn("digest", F.unhex(F.sha1("html"))), stored(groups.select("digest", "latest"), "payload-groups"), "digest")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("latest")), F.col("latest"))
    told = told.select("page_id", "url", F.col("html").alias("text"), refers.alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_fs(path)
        out, name, at = None, "", 0
        for rest, texts in text_batches(batches):
            rows = []
            for page_id, url, refers_to, text in zip(rest["page_id"], rest["url"], rest["refers_to"], texts, strict=True):
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                member = record(page_id, url, text.encode("utf-8", "replace"), refers_to)
                out.write(member)
                rows.append((surt(url), page_id, url, name, at, len(member)))
                at += len(member)
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["key", "page_id", "url", "file", "offset", "length"])
        if out is not None:
            out.close()

    store, root = open_fs(path)
    store.create_dir(root, recursive=True)
    return stored(told.mapInArrow(run, "key string, page_id long, url string, file string, offset long, length long"), "captures")


def build_index(captures: DataFrame, path: str, block: int = BLOCK, file_rows: int = INDEX_ROWS) -> DataFrame:
    """Sort captures by key into index files under ``path``; returns the stored table of files: file, first_key, last_key, captures.

    Ties of a key are dealt by page id, so that a host or URL of a third of all captures fills several files.
    """
    n = captures.count()
    files = max(-(-n // file_rows), min(16, 1 + n // (5 * block)))
    ordered = captures.repartitionByRange(files, "key", "page_id", "offset").sortWithinPartitions("key", "page_id", "file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_fs(path)
        name, at, directory, held, total = f"{uuid.uuid4().hex}.idx", 0, [], [], 0
        out = None
        last = ""

        def flush() -> None:
            nonlocal at
            data = zlib.compress("\n".join(json.dumps(x) for x in held).encode(), LEVEL)
            out.write(data)
            directory.append((held[0][0], at, len(data)))
            at += len(data)
            held.clear()

        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("key", "page_id", "url", "file", "offset", "length")], strict=True):
                out = out or store.open_output_stream(f"{root}/{name}", compression=None)
                held.append(row)
                last, total = row[0], total + 1
                if len(held) >= block:
                    flush()
        if out is not None:
            if held:
                flush()
            tail = zlib.compress(json.dumps(directory).encode(), LEVEL)
            out.write(tail + len(tail).to_bytes(8, "big"))
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([directory[0][0]]), pa.array([last]), pa.array([total], pa.int64())], ["file", "first_key", "last_key", "captures"])

    store, root = open_fs(path)
    store.create_dir(root, recursive=True)
    return stored(ordered.mapInArrow(run, "file string, first_key string, last_key string, captures long"), "index-files")


class IndexFile:
    """The directory of an index file: first key, offset and length of its blocks."""

    def __init__(self, store: fs.FileSystem, path: str):
        with store.open_input_file(path) as file:
            size = file.size()
            tail = int.from_bytes(file.read_at(8, size - 8), "big")
            self.directory = [tuple(x) for x in json.loads(zlib.decompress(file.read_at(tail, size - 8 - tail)))]
        self.firsts = [x[0] for x in self.directory]

    def blocks(self, key: str) -> Iterator[int]:
        """The blocks in which a key may be, from the last that begins before it."""
        for k in range(max(bisect.bisect_left(self.firsts, key) - 1, 0), len(self.firsts)):
            if self.firsts[k] > key:
                return
            yield k


_CAPTURE = "key string, page_id long, url string, file string, offset long, length long"
_TYPES = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())


def _capture_batch(rows: list[list]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)], ["key", "page_id", "url", "file", "offset", "length"])


def keys_of(urls: DataFrame) -> DataFrame:
    """url, key of all rows of ``urls``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([surt(u) for u in batch.column(0).to_pylist()], pa.string())], ["url", "key"])

    return urls.select("url").mapInArrow(run, "url string, key string")


def search(keys: DataFrame, files: DataFrame, path: str) -> DataFrame:
    """key, index, at, size: the blocks in which each key may be, by binary search. The ranges of the index files (a row each) reach every task."""
    ranges = sorted((r["first_key"], r["last_key"], r["file"]) for r in files.collect())  # index files are few: INDEX_ROWS captures each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_fs(path)
        firsts = [r[0] for r in ranges]
        opened: dict[str, IndexFile] = {}
        for batch in batches:
            rows = []
            for key in batch.column("key").to_pylist():
                at = bisect.bisect_right(firsts, key)
                while at and ranges[at - 1][1] >= key:  # files of one key follow each other
                    at -= 1
                    name = ranges[at][2]
                    if name not in opened:
                        if len(opened) > 64:
                            opened.clear()
                        opened[name] = IndexFile(store, f"{root}/{name}")
                    rows += [(key, name, *opened[name].directory[k][1:]) for k in opened[name].blocks(key)]
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["key", "index", "at", "size"])

    return keys.select("key").mapInArrow(run, "key string, index string, at long, size long")


def lookup(urls: DataFrame, files: DataFrame, path: str) -> DataFrame:
    """The captures (key, page_id, url, file, offset, length) of all URLs of ``urls``, each capture once however often it is asked for."""
    asked = keys_of(urls).select("key").distinct()
    # keys in order, so that a task opens few index files
    wanted = stored(search(asked.repartitionByRange("key").sortWithinPartitions("key"), files, path), "index-blocks")
    blocks = wanted.agg(F.count_distinct("index", "at")).first()[0]
    parts = max(1, min(blocks, max(64, blocks // 16)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_fs(path)
        last: tuple[str, int] | None = None
        held: dict[str, list[list]] = {}
        for batch in batches:
            rows = []
            for key, name, at, size in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (name, at) != last:
                    last, held = (name, at), {}
                    with store.open_input_file(f"{root}/{name}") as f:
                        for line in zlib.decompress(f.read_at(size, at)).decode().split("\n"):
                            x = json.loads(line)
                            held.setdefault(x[0], []).append(x)
                rows += held.get(key, ())
            yield _capture_batch(rows)

    # a number of its own keeps the blocks apart however few bytes their names are
    return wanted.repartition(parts, "index", "at").sortWithinPartitions("index", "at", "key").mapInArrow(read, _CAPTURE)


def read_captures(captures: DataFrame, path: str) -> DataFrame:
    """Read the records of captures by range: page_id, payload_bytes, payload_digest, record_type, refers_to. A payload that differs from its digest raises."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_fs(path)
        opened: dict[str, Any] = {}
        for batch in batches:
            rows = []
            for name, offset, length in zip(*[batch.column(c).to_pylist() for c in ("file", "offset", "length")], strict=True):
                if name not in opened:
                    if len(opened) > 256:
                        opened.clear()
                    opened[name] = store.open_input_file(f"{root}/{name}")
                r = parse(opened[name].read_at(length, offset))
                digest = r["warc-payload-digest"].removeprefix("sha1:")
                if r["warc-type"] == "response" and digest_of(r["payload"]) != digest:
                    raise ValueError(f"payload of {r['warc-record-id']} differs from its digest")
                refers = _to_id(r["warc-refers-to"]) if "warc-refers-to" in r else None
                rows.append((_to_id(r["warc-record-id"]), int(r["http"]["content-length"]), digest, r["warc-type"], refers))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    # records next to each other in an archive are read by one task, in order
    captures = stored(captures.select("file", "offset", "length"), "found")
    n, size = captures.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    parts = max(1, min(n // 500, 64), size // TASK_BYTES)
    dealt = captures.repartition(parts, "file", F.floor(F.col("offset") / RANGE_BYTES)).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_and_read(spark: SparkSession, pages: DataFrame, path: str | None = None) -> DataFrame:
    """Archive pages, index the captures, and read every record back by looking its URL up in the index."""
    path = path or scratch(spark, "warc")
    captures = write_archives(pages, f"{path}/archive")
    files = build_index(captures, f"{path}/index")
    return read_captures(lookup(pages, files, f"{path}/index"), f"{path}/archive")
