"""WARC archives of captured pages, and their capture index by external merge.

``write_archives`` writes one gzip member per record (WARC/1.1). Of equal payloads of at least
``LEAST`` bytes the one with the smallest page_id is a response, the others are revisits that
carry its record id and no payload. Which record is what is decided on digests alone, by an
aggregation whose repeated digests are looked up; payloads aren't exchanged. Each
task sorts its captures by URL key and time and writes them as runs of about ``RUN_BYTES``.

``read_archives`` reads records back by file, offset and length and checks their digests; tasks
get equal shares of the records, in the order of the files.
``merge_runs`` cuts the history into ranges of (URL key, time) of about ``RANGE_ROWS`` rows; a task holds its slices
of the runs, each still sorted, and merges them through a loser tree, so that the ranges in order
are one sorted capture history. What a task holds depends on ``RANGE_ROWS`` alone, not on the corpus.

Records go to files named anew by each attempt, and index rows name only files that are complete.

Defined results: null html is an empty payload; a null url gives no target and the empty key;
repeated rows are records of their own (rows equal in page_id and payload are the same kind of
record); a record without a page_id is a revisit of an equal payload that has one, and a response where
none has; captures without a time are taken at ``EPOCH`` plus page_id seconds; captures of one key and time are
in order of page_id, null ones last; payloads of any length are stored whole; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections.abc import Callable, Iterator
from datetime import UTC, datetime, timedelta
from urllib.parse import quote, urlsplit
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weftline.session import reachable

from .common import looked_up, scratch, spread, staged
from .media import _Reader, _store, in_shares

#: Payloads below this many bytes are always stored.
LEAST = 100
EPOCH = datetime(2024, 1, 1, tzinfo=UTC)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Compressed bytes of a run that a task holds while it sorts.
RUN_BYTES = 64_000_000
#: Index rows in a range of the merge, about 300 bytes each in a task.
RANGE_ROWS = 100_000
RECORD = "urn:weftline:page:"
INDEX = "page_id long, url_key string, captured_at string, warc_file string, warc_offset long, warc_length long"
READ = INDEX + ", payload_bytes long, payload_digest string, record_type string, refers_to long"


def url_key(url: str | None) -> str:
    """The key by which captures sort: host labels from the top domain down, then path and query."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url.strip().lower()
    if not host:
        return url.strip().lower()
    host = host.removeprefix("www.")
    port = f":{port}" if port and port not in (80, 443) else ""
    return (",".join(reversed(host.split("."))) + port + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")).lower()


def _line(value: str) -> str:
    return quote(value, safe="%/:=&?~#+!$,;'@()*[]-._")


def record(page_id: int | None, url: str | None, date: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, compressed by itself."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{RECORD}{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {_line(url)}"] if url else []),
        f"WARC-Payload-Digest: sha256:{digest}",
        *([f"WARC-Refers-To: <{RECORD}{refers_to}>", f"WARC-Profile: {PROFILE}"] if refers_to is not None else []),
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def parsed(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC fields, HTTP fields, payload) of one compressed record."""
    data = zlib.decompress(raw, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def _kinds(pages: DataFrame) -> DataFrame:
    """``pages`` with payload, digest and refers_to."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "captured_at", payload.alias("payload"))
    pages = pages.withColumn("digest", F.sha2("payload", 256))
    equal = pages.filter(F.length("payload") >= LEAST).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
    found = looked_up(pages, staged(equal.filter("copies > 1"), "warc-equal"), ["digest"], "copies")
    again = F.coalesce(F.col("page_id") > F.col("first"), F.lit(True))
    return found.withColumn("refers_to", F.when(again, F.col("first"))).drop("first")


def write_archives(pages: DataFrame, folder: str, captured_at: str | None = None) -> DataFrame:
    """Index rows of all records; to be staged before anything reads them."""
    pages = pages.withColumn("captured_at", F.date_format(captured_at, "yyyy-MM-dd'T'HH:mm:ss'Z'") if captured_at else F.lit(None).cast("string"))
    kinds = _kinds(pages.select("page_id", "url", "html", "captured_at"))

    def write(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        captures, held = [], 0
        for batch in found:
            for page_id, url, at, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = at or (EPOCH + timedelta(seconds=page_id or 0)).strftime("%Y-%m-%dT%H:%M:%SZ")
                # records wait compressed for their place in the run
                captures.append((url_key(url), at, page_id, record(page_id, url, at, payload, digest, refers_to)))
                held += len(captures[-1][3])
                if held > RUN_BYTES:
                    yield _run(folder, captures)
                    captures, held = [], 0
        if captures:
            yield _run(folder, captures)

    return kinds.select("page_id", "url", "captured_at", "payload", "digest", "refers_to").mapInArrow(write, INDEX)


def _run(folder: str, captures: list[tuple]) -> pa.RecordBatch:
    """Writes one sorted run and gives its index rows."""
    captures.sort(key=lambda c: (c[0], c[1], c[2] is None, c[2] or 0))
    store, path = _store(folder)
    store.create_dir(path, recursive=True)
    name, at, rows = f"{uuid4().hex}.warc.gz", 0, []
    with store.open_output_stream(f"{path}/{name}", compression=None) as out:
        for key, date, page_id, raw in captures:
            out.write(raw)
            rows.append((page_id, key, date, f"{folder}/{name}", at, len(raw)))
            at += len(raw)
    columns = list(zip(*rows, strict=True))
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["page_id", "url_key", "captured_at", "warc_file", "warc_offset", "warc_length"])


def read_archives(index: DataFrame) -> DataFrame:
    """``index`` (staged) with what the records themselves say of their payloads."""

    def read(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader()
        for batch in found:
            rows = []
            for place in zip(*(batch.column(k).to_pylist() for k in (3, 4, 5)), strict=True):
                fields, http, payload = parsed(reader.read(*place))
                kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
                if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"damaged record in {place}")
                to = fields.get("WARC-Refers-To")
                rows.append((int(http["Content-Length"]), digest, kind, int(re.search(r"(-?\d+)>$", to)[1]) if to else None))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            more = [pa.array(c, k) for c, k in zip(columns, [pa.int64(), pa.string(), pa.string(), pa.int64()], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return in_shares(index, "warc_file", "warc_offset", "warc_length").mapInArrow(read, READ)


class LoserTree:
    """Merges sorted lists: each inner node keeps the loser of its match, the winner goes up.

    After a winner leaves, one path of matches, from its leaf to the root, finds the next.
    """

    def __init__(self, runs: list[list], key: Callable):
        self.runs, self.key, self.k = runs, key, len(runs)
        self.place = [0] * self.k
        self.head = [self._key(i) for i in range(self.k)]
        self.losers = [-1] * max(self.k, 1)
        self.winner = self._play(1) if self.k > 1 else 0

    def _key(self, i: int):
        run, at = self.runs[i], self.place[i]
        return (0, self.key(run[at]), i) if at < len(run) else (1, (), i)

    def _play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        if self.head[b] < self.head[a]:
            a, b = b, a
        self.losers[node] = b
        return a

    def __iter__(self):
        if not self.k:
            return
        while not self.head[self.winner][0]:
            i = self.winner
            yield self.runs[i][self.place[i]]
            self.place[i] += 1
            self.head[i] = self._key(i)
            node = (i + self.k) // 2
            while node >= 1 and self.k > 1:
                other = self.losers[node]
                if self.head[other] < self.head[i]:
                    self.losers[node], i = i, other
                node //= 2
            self.winner = i


def merge_runs(captures: DataFrame, ranges: int | None = None) -> DataFrame:
    """The rows of ``captures`` (staged) in order of URL key, time and page_id over its partitions."""

    def merge(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(batches) if (batches := list(found)) else None
        if held is None:
            return
        url_keys, times, ids, files = (held[c].to_pylist() for c in ("url_key", "captured_at", "page_id", "warc_file"))
        runs: dict[str, list[int]] = {}
        for k, name in enumerate(files):
            runs.setdefault(name, []).append(k)
        merged = iter(LoserTree(list(runs.values()), lambda k: (url_keys[k], times[k], ids[k] is None, ids[k] or 0)))
        while rows := list(itertools.islice(merged, 10_000)):
            yield from held.take(pa.array(rows, pa.int64())).combine_chunks().to_batches()

    n = ranges or max(spread(captures.sparkSession), -(-captures.count() // RANGE_ROWS))
    # file and offset tell equal captures apart, so that ranges are bounded; a run's slice is read in the run's own order
    dealt = captures.repartitionByRange(n, "url_key", "captured_at", F.col("page_id").asc_nulls_last(), "warc_file", "warc_offset").sortWithinPartitions("warc_file", "warc_offset")
    return dealt.mapInArrow(merge, captures.schema)


def archived(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` as archives, reads them back and merges their index."""
    spark = pages.sparkSession
    reachable(spark)
    index = staged(write_archives(pages, scratch(spark, "warc")), "warc-index")
    return merge_runs(staged(read_archives(index), "warc-read"))
