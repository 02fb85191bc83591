"""WARC archives of pages, and the external merge of their capture index.

1. ``write_archives``: tasks write pages as gzipped WARC records into archives of bounded size in the shared folder and return
   a manifest. An archive's name is new for each attempt and only archives in the manifest are ever read, so lost executors and
   repeated tasks leave nothing behind that counts.
2. ``read_runs``: each archive is read back record by record, payloads are digested again, and the archive's captures become one
   *run*, sorted by URL key and timestamp.
3. ``merge_runs``: the runs are cut at common range bounds (URL key, time, page, so a hot URL is cut too); each range merges its
   stretch of every run with a loser tree. Ranges are in order, so the result is one globally ordered capture history.

Equal payloads (SHA-1 and length): the capture with the largest page_id is the response, the others revisit it. Null html is an empty
payload, null url has no target and an empty URL key. A null page_id never is the one referred to; where a group has only such rows
all are responses, and so are repeated rows of the response's page_id; record ids come from archive and number, so they differ. Control characters in URLs are percent-encoded.
Empty tables give empty results. A column ``captured`` (timestamp) gives capture times; without it all are the epoch.
Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import itertools
import re
import urllib.parse
import uuid
import zlib
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE_ROWS, batch_of, materialise, new_folder

#: Compressed bytes after which a task begins another archive.
ARCHIVE_BYTES = 64 << 20
#: Captures in one merge range; bounds a merging task's memory.
RANGE_ROWS = 20_000
BATCH_ROWS = 8192
GZIP_LEVEL = 3
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RUN_SCHEMA = "run string, seq long, urlkey string, captured long, page_id long, record_offset long, record_length long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_URL_SAFE = "".join(map(chr, range(0x21, 0x7F)))


def url_key(url: str | None) -> str:
    """Sort-friendly key: host parts reversed and lower-cased, then the rest; '' without a host."""
    host, _, rest = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://", "", url or "").partition("/")
    return f"{','.join(reversed(host.lower().split('.')))})/{rest}" if host else ""


def _date(captured: int) -> str:
    return f"{datetime.fromtimestamp(captured, UTC):%Y-%m-%dT%H:%M:%SZ}"


def record(page_id: int | None, url: str | None, payload: bytes, captured: int, refers_to: tuple[int, str | None, int] | None, place: str) -> bytes:
    """One WARC record; revisits carry the HTTP headers of the full payload, but not the payload.

    ``refers_to`` is the response's page, url and time; ``place`` names the record's archive and number, so its id is unique.
    """
    kind = "response" if refers_to is None else "revisit"
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()  # noqa: S324
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block += payload if refers_to is None else b""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, place)}>"]
    head += [f"WARC-Date: {_date(captured)}", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {urllib.parse.quote(url, safe=_URL_SAFE)}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        page, target, when = refers_to
        head += [f"X-Refers-To-Page: {page}", f"WARC-Refers-To-Date: {_date(when)}", f"WARC-Profile: {PROFILE}"]
        if target is not None:
            head.append(f"WARC-Refers-To-Target-URI: {urllib.parse.quote(target, safe=_URL_SAFE)}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def with_revisits(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, captured, refers_to, target, target_captured); the last three tell the response of a revisit and are null for responses."""
    captured = F.unix_timestamp("captured") if "captured" in pages.columns else F.lit(0)
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), F.coalesce(captured, F.lit(0)).cast("long").alias("captured"))
    rows = rows.withColumns({"digest": F.sha1(F.encode("html", "UTF-8")), "size": F.octet_length("html")})
    response = F.max(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url", "captured"))).alias("last")
    groups = rows.groupBy("digest", "size").agg(response, F.count("*").alias("n")).where("n > 1 and last is not null")
    # Written first: its true size then decides between a broadcast and a shuffle that Spark may split.
    rows = rows.join(materialise(groups.drop("n"), "warc-groups"), ["digest", "size"], "left")
    revisit = F.when(~F.col("page_id").eqNullSafe(F.col("last.page_id")), F.col("last"))
    return rows.select("page_id", "url", "html", "captured", revisit["page_id"].alias("refers_to"), revisit["url"].alias("target"), revisit["captured"].alias("target_captured"))


def write_archives(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``with_revisits`` rows as archives under ``folder``; (path, records, bytes) of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out, name, records, size = None, "", 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                for page_id, url, html, captured, refers_to, target, target_captured in zip(*(c.to_pylist() for c in batch.slice(at, SLICE_ROWS).columns), strict=True):
                    if out is None:
                        name, records, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = store.open_output_stream(f"{base}/{name}", compression=None)
                    squeeze = zlib.compressobj(GZIP_LEVEL, wbits=31)
                    of = None if refers_to is None else (refers_to, target, target_captured)
                    data = squeeze.compress(record(page_id, url, html.encode(), captured, of, f"{name}:{records}")) + squeeze.flush()
                    out.write(data)
                    records, size = records + 1, size + len(data)
                    if size >= archive_bytes:
                        out.close()
                        out = None
                        yield batch_of(path=([f"{folder}/{name}"], pa.string()), records=([records], pa.int64()), bytes=([size], pa.int64()))
        if out is not None:
            out.close()
            yield batch_of(path=([f"{folder}/{name}"], pa.string()), records=([records], pa.int64()), bytes=([size], pa.int64()))

    return rows.mapInArrow(run, "path string, records long, bytes long")


def read_archive(stream: Any) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, block) of each gzip member of an archive, one in memory at a time."""
    offset, data = 0, stream.read(1 << 20)
    while data:
        squeeze, parts, length = zlib.decompressobj(31), [], 0
        while not squeeze.eof:
            if not data and not (data := stream.read(1 << 20)):
                raise ValueError(f"the archive ends within the record at {offset}")
            parts.append(squeeze.decompress(data))
            length += len(data) - len(squeeze.unused_data)
            data = squeeze.unused_data
        raw = b"".join(parts)
        head, _, rest = raw.partition(b"\r\n\r\n")
        headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        yield offset, length, headers, rest[: int(headers["Content-Length"])]
        offset += length
        data = data or stream.read(1 << 20)


def capture(headers: dict[str, str], block: bytes) -> tuple[str, int, int | None, int, str, str, int | None]:
    """(urlkey, captured, page_id, payload_bytes, payload_digest, record_type, refers_to), checked against the payload."""
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest, kind = headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"]
    if kind == "response" and (size != len(payload) or digest != base64.b32encode(hashlib.sha1(payload).digest()).decode()):  # noqa: S324
        raise ValueError(f"{headers['WARC-Record-ID']}: the payload doesn't have its digest")
    when = int(datetime.strptime(headers["WARC-Date"], "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=UTC).timestamp())
    page, refers = (int(x) if (x := headers.get(k)) is not None else None for k in ("X-Page-Id", "X-Refers-To-Page"))
    return url_key(headers.get("WARC-Target-URI")), when, page, size, digest, kind, refers


def _key(row: tuple) -> tuple:
    """Order of captures: URL key, time, page (nulls first), archive."""
    return row[2], row[3], row[4] is not None, row[4] or 0, row[0], row[1]


def read_runs(manifest: DataFrame) -> DataFrame:
    """A run for each archive of the manifest, read in a task of its own: its captures, sorted. An archive's size bounds the rows held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, base = fs.FileSystem.from_uri(path)
                with store.open_input_stream(base, compression=None) as stream:
                    rows = []
                    for offset, length, headers, block in read_archive(stream):
                        key, when, page, size, digest, kind, refers = capture(headers, block)
                        rows.append((path, 0, key, when, page, offset, length, size, digest, kind, refers))
                rows.sort(key=_key)
                for at in range(0, len(rows), BATCH_ROWS):
                    yield _rows([(r[0], at + i, *r[2:]) for i, r in enumerate(rows[at : at + BATCH_ROWS])])

    # A given number of partitions, dealt in turn: Spark would put so few paths into one task.
    return manifest.select("path").repartition(max(1, manifest.count())).mapInArrow(run, RUN_SCHEMA)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), *[pa.int64()] * 5, pa.string(), pa.string(), pa.int64())
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in RUN_SCHEMA.split(", ")])


def loser_tree(runs: Iterable[Iterable[tuple]]) -> Iterator[tuple]:
    """Merge sorted runs. Inner nodes hold the loser of their match, so the next winner costs one path of matches."""
    sources = [iter(r) for r in runs]
    k = len(sources)
    heads = [next(s, None) for s in sources]
    keys = [None if h is None else _key(h) for h in heads]
    tree = [-1] * max(k, 1)  # tree[0]: the overall winner; -1: not played yet

    def beats(a: int, b: int) -> bool:
        return keys[b] is None or (keys[a] is not None and keys[a] <= keys[b])

    def play(run: int) -> None:
        winner, node = run, (run + k) // 2
        while node:
            if tree[node] == -1:
                tree[node] = winner
                return
            if not beats(winner, tree[node]):
                winner, tree[node] = tree[node], winner
            node //= 2
        tree[0] = winner

    for run in range(k):
        play(run)
    while k and heads[tree[0]] is not None:
        run = tree[0]
        yield heads[run]
        heads[run] = next(sources[run], None)
        keys[run] = None if heads[run] is None else _key(heads[run])
        play(run)


def merge_runs(runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The capture history: run rows in global order, with their range and their place in it."""
    ranges = max(1, -(-runs.count() // range_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, stretches, last = TaskContext.get().partitionId(), [], None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != last:
                    last = row[0]
                    stretches.append([])
                stretches[-1].append(row)
        merged = loser_tree(stretches)
        for at in itertools.count(0, BATCH_ROWS):
            rows = _rows(list(itertools.islice(merged, BATCH_ROWS)))
            if not (n := rows.num_rows):
                return
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([part] * n, pa.int32()), pa.array(range(at, at + n), pa.int64())], names=[*rows.schema.names, "range_no", "place"])

    cut = runs.repartitionByRange(ranges, "urlkey", "captured", F.col("page_id").asc_nulls_first(), "run", "seq")
    return cut.sortWithinPartitions("run", "seq").mapInArrow(run, f"{RUN_SCHEMA}, range_no int, place long")


def archive_and_index(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Write the pages' archives, read them back and return the merged capture history, with each capture's position in it."""
    folder = new_folder(pages.sparkSession, "warc")
    manifest = materialise(write_archives(with_revisits(pages), folder, archive_bytes), "warc-manifest")
    merged = materialise(merge_runs(materialise(read_runs(manifest), "warc-runs"), range_rows), "warc-merged")
    # One row a range, so this window is small; it says how many captures lie in the ranges before.
    before = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    starts = merged.groupBy("range_no").agg(F.count("*").alias("n")).select("range_no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return merged.join(materialise(starts, "warc-starts"), "range_no").withColumn("position", F.col("first") + F.col("place")).drop("first")


def parse(data: bytes) -> list[tuple[int, int, dict[str, str], bytes]]:
    """All records of an archive in memory (for tests and small files)."""
    return list(read_archive(io.BytesIO(data)))
