"""WARC archives with a two-level capture index.

``write_archives`` writes one gzip member per page. Of pages with equal payloads one is a response and the others are revisits
that refer to it. ``build_index`` sorts the captures by their reversed-host URL key, cuts each range of keys into compressed blocks, and
ends each index file with a sparse directory: first key, place and length of every block. A catalogue has one row per index file with its key
range. ``read_urls`` sends each wanted key to the files whose range holds it, bisects the directory, unpacks only the blocks that can have
it. ``read_records`` deals the records to tasks by file and place, and each task reads only their bytes from the archives, in order.

All files go to a folder that every executor reaches, through Arrow's file systems; a folder without a scheme lies where Hadoop's default file system says. A task that runs again writes files of other names, and only the
rows of the attempt that succeeded name a file.

Defined results: a null payload is empty. A null URL is empty; it has a key like any other. Control characters, spaces and non-ASCII
characters are percent-encoded in the record's target; such a record names the URL as captured in a field of its own, so that every URL is read back
as it was. Pages without an id are written too; on equal payloads they lose to any id. Of rows that repeat id and
payload one is the response. Empty tables give an empty index.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import math
import urllib.parse
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilframe.llm.dedup import duplicate_groups, keyed
from veilframe.session import file_system, materialize, scratch_path

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BLOCK_LINES = 512
FILE_ROWS = 50_000
#: Bytes of an archive that one task reads in a row, and about how many it reads in all.
STRETCH_BYTES, TASK_BYTES = 1 << 23, 1 << 26
#: Names that Hadoop's connectors give to file systems that Arrow knows by another.
SCHEMES = {"s3a": "s3", "s3n": "s3"}
#: The field that holds a URL, percent-encoded throughout, that can't be a record's target as it is.
CAPTURED = "X-Captured-URL"


@dataclass(frozen=True)
class Index:
    """The catalogue of index files: file, first key, last key; at most one row per FILE_ROWS captures."""

    catalogue: DataFrame
    captures: DataFrame


def url_key(url: Column) -> Column:
    """The sort key of a URL: host labels reversed and joined by commas, ``)``, then path and query; all in lower case."""
    rest = F.lower(F.regexp_replace(F.coalesce(url, F.lit("")), "^[^:/?#]*://", ""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.substring(rest, F.length(host) + 1, F.length(rest))
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), path)


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(page: int | None, url: str, payload: bytes, refers: int | None, revisit: bool, date: str) -> bytes:
    """One WARC record as a gzip member."""
    urn = lambda i: f"<urn:page:{'' if i is None else i}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = urllib.parse.quote(url, safe="%/:?#[]@!$&()*+,;=~'")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {urn(page)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{_digest(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if target != url:
        head.append(f"{CAPTURED}: {urllib.parse.quote(url, safe='')}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {urn(refers)}"]
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n") + packer.flush()


def parse_record(member: bytes) -> dict:
    """Type, ids, URL, full payload size and digest of a record; a response's digest is computed from its payload."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    page = lambda urn: int(urn[10:-1]) if len(urn) > 11 else None
    revisit = fields["WARC-Type"] == "revisit"
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    if not revisit and size != len(payload):
        raise ValueError(f"record {fields['WARC-Record-ID']} is cut short: {len(payload)} of {size} bytes")
    return {
        "page_id": page(fields["WARC-Record-ID"]),
        "url": urllib.parse.unquote(fields[CAPTURED]) if CAPTURED in fields else fields["WARC-Target-URI"],
        "payload_bytes": size,
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else _digest(payload),
        "record_type": fields["WARC-Type"],
        "refers_to": page(fields["WARC-Refers-To"]) if revisit else None,
        "payload": None if revisit else payload,
    }


def arrow_uri(qualified: str) -> str:
    """A qualified Hadoop path as Arrow's file systems take it."""
    scheme, _, rest = qualified.partition(":")
    return f"{SCHEMES.get(scheme, scheme)}:{rest if rest.startswith('//') else '//' + rest}"


def _attempt() -> str:
    context = TaskContext.get()
    return f"{context.partitionId():06d}-{context.taskAttemptId()}" if context else "0"


def write_archives(
    pages: DataFrame, folder: str, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html",
    least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z",
) -> DataFrame:
    """Write all pages; a row per record: key, page_id, file, offset, length. Revisits are made of payloads of ``least_bytes`` at least."""
    rows = pages.select(F.col(id_column).cast("long").alias("id"), F.col(url_column).alias("url"), F.col(payload_column).alias("html"))
    groups = duplicate_groups(rows, "id", "html").groupBy("id", "sha256").agg(F.max("keep_id").alias("keep_id"), F.max("kept").alias("kept"))
    left, right, key = keyed(rows, groups, "id", "html")
    joined = left.join(right.select(key, "keep_id", "kept"), key)
    # Rows that repeat id and payload share a key, by which they already lie together.
    first = F.row_number().over(Window.partitionBy(key).orderBy("url")) == 1
    revisit = F.coalesce(F.octet_length("html"), F.lit(0)) >= least_bytes
    records = joined.withColumn("revisit", revisit & ~(F.col("kept") & first)).select(
        "id", F.coalesce("url", F.lit("")).alias("url"), url_key(F.col("url")).alias("key"), "html", "keep_id", "revisit"
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = pyarrow.fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        stream, offset, name = None, 0, f"{root}/pages-{_attempt()}.warc.gz"
        try:
            for batch in batches:
                out = []
                for r in batch.to_pylist():
                    if stream is None:
                        stream = system.open_output_stream(name, compression=None)
                    payload = (r["html"] or "").encode()
                    member = _record(r["id"], r["url"], payload, r["keep_id"], r["revisit"], date)
                    stream.write(member)
                    out.append((r["key"], r["id"], name, offset, len(member)))
                    offset += len(member)
                columns = zip(*out, strict=True) if out else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array([*c], t) for c, t in zip(columns, _CAPTURE, strict=True)], names=_NAMES)
        finally:
            if stream is not None:
                stream.close()

    return materialize(records.mapInArrow(write, "key string, page_id long, file string, offset long, length long"), "captures")


_CAPTURE, _NAMES = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()], ["key", "page_id", "file", "offset", "length"]


def build_index(captures: DataFrame, folder: str) -> Index:
    """Sorted, compressed blocks of captures with a sparse directory per file, and the catalogue of files."""
    files = max(1, math.ceil(captures.count() / FILE_ROWS), captures.sparkSession.sparkContext.defaultParallelism)
    ordered = captures.repartitionByRange(files, "key", "page_id", "file", "offset").sortWithinPartitions("key", "page_id", "file", "offset")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = pyarrow.fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        name, stream, directory, offset, lines, last = f"{root}/index-{_attempt()}.cdx", None, [], 0, [], None

        def flush() -> None:
            nonlocal offset, lines
            packed = zlib.compress("\n".join(map(json.dumps, lines)).encode(), 6)
            directory.append((lines[0][0], offset, len(packed)))
            stream.write(packed)
            offset, lines = offset + len(packed), []

        for batch in batches:
            for r in batch.to_pylist():
                if stream is None:
                    stream = system.open_output_stream(name, compression=None)
                lines.append([r["key"], r["page_id"], r["file"], r["offset"], r["length"]])
                last = r["key"]
                if len(lines) == BLOCK_LINES:
                    flush()
        if stream is None:
            return
        if lines:
            flush()
        tail = zlib.compress(json.dumps(directory).encode(), 6)
        stream.write(tail + len(tail).to_bytes(8, "big"))
        stream.close()
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([directory[0][0]]), pa.array([last])], ["file", "first", "last"])

    return Index(materialize(ordered.mapInArrow(write, "file string, first string, last string"), "catalogue"), captures)


def _ranges(path: str, folder: str, pieces: list[tuple[int, int]] | None) -> Iterator[bytes]:
    """Pieces of a file by offset and length; without pieces, its tail: the directory."""
    system, _ = pyarrow.fs.FileSystem.from_uri(folder)
    with system.open_input_file(path) as file:
        if pieces is None:
            end = file.size()
            size = int.from_bytes(file.read_at(8, end - 8), "big")
            yield file.read_at(size, end - 8 - size)
        for offset, length in pieces or ():
            yield file.read_at(length, offset)


def find_captures(index: Index, folder: str, keys: DataFrame) -> DataFrame:
    """All captures of the given keys (a column ``key``, repeats allowed): key, page_id, file, offset, length."""
    # One row per index file, each of FILE_ROWS captures: a fraction of a thousandth of the captures.
    listed = sorted((r.first, r.last, r.file) for r in index.catalogue.collect())
    spark = keys.sparkSession
    sent = spark.sparkContext.broadcast(listed)

    @F.arrow_udf("array<string>")
    def files_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        firsts, lasts = [x[0] for x in sent.value], [x[1] for x in sent.value]
        for batch in batches:
            at = ((bisect.bisect_left(lasts, k), bisect.bisect_right(firsts, k)) for k in batch.to_pylist())
            yield pa.array([[x[2] for x in sent.value[a:b]] for a, b in at], pa.list_(pa.string()))

    def look_up(key: tuple, wanted: pd.DataFrame) -> pd.DataFrame:
        directory = json.loads(zlib.decompress(next(_ranges(key[0], folder, None))))
        firsts, found, needed = [d[0] for d in directory], [], {}
        names = set(wanted["key"])
        for name in names:
            # The block before the first one that begins with the key may end with it.
            for b in range(max(0, bisect.bisect_left(firsts, name) - 1), bisect.bisect_right(firsts, name)):
                needed[b] = None
        order = sorted(needed)
        for packed in _ranges(key[0], folder, [tuple(directory[b][1:]) for b in order]):
            for line in zlib.decompress(packed).decode().split("\n"):
                capture = json.loads(line)
                if capture[0] in names:
                    found.append(capture)
        return pd.DataFrame(found, columns=_NAMES).astype({"page_id": "Int64", "offset": "int64", "length": "int64"})

    wanted = keys.select("key").distinct().select("key", F.explode(files_of("key")).alias("index_file"))
    return wanted.groupBy("index_file").applyInPandas(look_up, "key string, page_id long, file string, offset long, length long")


def read_records(captures: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Read captures' records by their byte ranges: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_file: dict[str, list[tuple[int, int]]] = {}
            for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                by_file.setdefault(file, []).append((offset, length))
            out, size = [], 0
            for file, pieces in by_file.items():
                for member in _ranges(file, folder, sorted(pieces)):
                    record = parse_record(member)
                    if not payloads:
                        record["payload"] = None
                    out.append(record)
                    size += len(record["payload"] or b"") + 200
                    if size > 1 << 23:
                        yield _batch(out, names, kinds)
                        out, size = [], 0
            yield _batch(out, names, kinds)

    # Rows of a few bytes stand for records of any size, so tasks are counted by the records' bytes.
    pieces = materialize(captures.select("file", "offset", "length"), "pieces")
    tasks = max(pieces.sparkSession.sparkContext.defaultParallelism, math.ceil((pieces.agg(F.sum("length")).first()[0] or 0) / TASK_BYTES))
    dealt = pieces.repartition(tasks, "file", F.floor(F.col("offset") / STRETCH_BYTES)).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(read, schema)


def _batch(records: list[dict], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in records], k) for n, k in zip(names, kinds, strict=True)], names=names)


def archive(spark: SparkSession, pages: DataFrame, folder: str | None = None, least_bytes: int = 0, **columns: str) -> tuple[Index, str]:
    """Write and index all pages below ``folder`` (a fresh one in the shared folder if not given)."""
    folder = folder or scratch_path(spark, "warc")
    path, files = file_system(spark, folder)
    folder = arrow_uri(files.makeQualified(path).toString())
    return build_index(write_archives(pages, folder, least_bytes=least_bytes, **columns), folder), folder
