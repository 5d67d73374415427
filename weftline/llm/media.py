"""Media columns: payloads stored as images in tar shards, addressed by content.

``write_shards`` turns each payload into an 8-bit grey PNG of rows of ``WIDTH`` samples and appends
it to its task's tar shard under the name ``<sha256 of the payload>.png``. Of equal payloads one row's
is stored, told by an aggregation over hashes, and the place of that image is then looked up for the others. The rows
returned carry no payload but digest, shard, offset and length of the stored image. A task holds rows
only until their shard is whole. Shards of tasks that are run again get new names, and rows only ever name the shard
that the same attempt finished, so that a lost executor leaves unreferenced files at worst.

``with_header`` fills metadata columns from range reads of a few bytes: the tar header before an
image and the image's own header. ``with_features`` reads stored images back, decodes the payload
and computes digests and features.

Shards lie in a folder that all executors share; it may be on any store that
``pyarrow.fs`` opens (local or mounted, S3, GCS, HDFS).

Defined results: a null text is an empty one; an empty payload is padded to one row of samples; a text of
any length is one image; equal payloads have equal values and one place, repeated rows are kept (rows equal in all
columns may store their image once a task; the least place counts); extra columns pass through, but those of
the names that are made here are replaced; an empty table writes nothing and gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F, types as T

from weftline.session import reachable

from .common import looked_up, scratch, spread, staged, unused

WIDTH, PAD = 192, 32
BLOCK = 512  # of a tar archive
PNG = b"\x89PNG\r\n\x1a\n"
#: Bytes of a shard before the task starts the next one.
SHARD_BYTES = 1 << 28
#: Stored bytes that a task reads back, about.
SHARE_BYTES = 1 << 27
#: Texts that occur more than once, up to which their rows are broadcast: two hashes and a row's hash or place each.
LOOKUP_TEXTS = 500_000
INDEX = [T.StructField("digest", T.StringType()), T.StructField("n_bytes", T.LongType()), T.StructField("shard", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType())]


def padded(data: bytes) -> bytes:
    """``data`` with bytes ``PAD`` up to a positive multiple of ``WIDTH``."""
    return data + bytes([PAD]) * (-len(data) % WIDTH or (0 if data else WIDTH))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, level: int = 2) -> bytes:
    """A grey image, eight bits a sample, whose samples in reading order are ``payload``."""
    samples = np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH)
    rows = np.zeros((len(samples), WIDTH + 1), dtype=np.uint8)  # filter 0 before each row
    rows[:, 1:] = samples
    header = struct.pack(">IIBBBBB", WIDTH, len(samples), 8, 0, 0, 0, 0)
    return PNG + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def png_header(start: bytes) -> tuple[int, int, int]:
    """(width, height, bits a sample) from the first 25 bytes of an image."""
    if start[:8] != PNG or start[12:16] != b"IHDR":
        raise ValueError("not a PNG image")
    width, height, bits = struct.unpack(">IIB", start[16:25])
    return width, height, bits


def from_png(image: bytes) -> bytes:
    """The samples of an image written by ``to_png``; checks every chunk."""
    width, height, _ = png_header(image)
    at, data = len(PNG), []
    while at < len(image):
        (n,) = struct.unpack(">I", image[at : at + 4])
        kind, body = image[at + 4 : at + 8], image[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", image[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged image")
        if kind == b"IDAT":
            data.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(data)), dtype=np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("unknown row filter")
    return rows[:, 1:].tobytes()


def tar_header(name: str, size: int) -> bytes:
    """A ustar header of one file with fixed owner, mode and time."""
    h = bytearray(BLOCK)
    for at, field in ((0, name.encode()), (100, b"0000644\0"), (108, b"0000000\0"), (116, b"0000000\0"), (124, b"%011o\0" % size), (136, b"%011o\0" % 0), (148, b" " * 8), (156, b"0"), (257, b"ustar\x0000")):
        h[at : at + len(field)] = field
    h[148:156] = b"%06o\0 " % sum(h)
    return bytes(h)


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


class _Shards:
    """Appends images to the tar shards of one task."""

    def __init__(self, folder: str):
        self.store, self.folder = _store(folder)
        self.store.create_dir(self.folder, recursive=True)
        self.prefix = folder.rstrip("/")
        self.out, self.name, self.at = None, "", 0

    def put(self, digest: str, image: bytes) -> tuple[str, int, int]:
        if self.out is None or self.at >= SHARD_BYTES:
            self.close()
            self.name, self.at = f"{uuid4().hex}.tar", 0
            self.out = self.store.open_output_stream(f"{self.folder}/{self.name}")
        self.out.write(tar_header(f"{digest}.png", len(image)))
        self.out.write(image)
        self.out.write(b"\0" * (-len(image) % BLOCK))
        start = self.at + BLOCK
        self.at = start + len(image) + -len(image) % BLOCK
        return f"{self.prefix}/{self.name}", start, len(image)

    def close(self) -> None:
        if self.out is not None:
            self.out.write(b"\0" * (2 * BLOCK))
            self.out.close()
            self.out = None


def write_shards(docs: DataFrame, folder: str, text: str = "text", level: int = 2) -> DataFrame:
    """The columns of ``docs`` but ``text``, with digest, n_bytes, shard, offset and length."""
    reachable(docs.sparkSession)
    made = {f.name for f in INDEX}
    keep = [c for c in docs.columns if c != text and c not in made]
    own = [docs.schema[c] for c in keep]
    value, h1, h2, me, writer, copies = (unused(docs.columns, c) for c in ("_value", "_h1", "_h2", "_me", "_writer", "_copies"))
    rows = docs.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias(value))
    rows = rows.withColumns({h1: F.xxhash64(value), h2: F.xxhash64(value, value), me: F.xxhash64(*[f.name for f in own if "map<" not in f.dataType.simpleString()], F.lit(0))})
    equal = staged(rows.groupBy(h1, h2).agg(F.min(me).alias(writer), F.count("*").alias(copies)).filter(F.col(copies) > 1), "media-equal")
    rows = looked_up(rows, equal, [h1, h2], copies, LOOKUP_TEXTS)
    rows = rows.select(*keep, h1, h2, F.col(writer).isNotNull().alias(writer), F.coalesce(F.col(writer) == F.col(me), F.lit(True)).alias(me), value)
    schema = T.StructType([*[rows.schema[c] for c in [*keep, h1, h2, writer]], *INDEX])

    def write(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, known, held = _Shards(folder), {}, []
        for batch in found:
            made = []
            for stored, one in zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                data = one.encode()
                payload = padded(data)
                digest = hashlib.sha256(payload).hexdigest()
                if stored and digest not in known:
                    known[digest] = shards.put(digest, to_png(payload, level))
                made.append((digest, len(data), *(known[digest] if stored else (None, None, None))))
            columns = list(zip(*made, strict=True)) or [[]] * 5
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            held.append(pa.RecordBatch.from_arrays([*batch.columns[:-2], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [f.name for f in schema.fields]))
            if shards.at >= SHARD_BYTES:  # rows leave only when their shard is whole
                shards.close()
                yield from held
                known, held = {}, []
        shards.close()
        yield from held

    index = staged(rows.mapInArrow(write, schema), "media-written")
    place = unused(docs.columns, "_place")
    places = index.filter(F.col(writer)).groupBy(h1, h2).agg(F.min(F.when(F.col("shard").isNotNull(), F.struct("shard", "offset", "length"))).alias(place), F.count("*").alias(copies))
    index = looked_up(index, staged(places, "media-places"), [h1, h2], copies, LOOKUP_TEXTS)
    return index.select(*keep, "digest", "n_bytes", *[F.coalesce(F.col(place)[c], F.col(c)).alias(c) for c in ("shard", "offset", "length")])


def in_shares(index: DataFrame, file: str, offset: str, length: str) -> DataFrame:
    """``index`` (staged) dealt in the order of its files to tasks of about ``SHARE_BYTES`` stored bytes; places that many rows name are split."""
    total = index.agg(F.sum(length)).first()[0] or 0
    rest = [f.name for f in index.schema.fields if "map<" not in f.dataType.simpleString()]
    return index.repartitionByRange(max(spread(index.sparkSession), -(-total // SHARE_BYTES)), file, offset, F.xxhash64(*rest)).sortWithinPartitions(file, offset)


class _Reader:
    """Range reads, with the last shard kept open."""

    def __init__(self):
        self.name, self.file = None, None

    def read(self, shard: str, offset: int, length: int) -> bytes:
        if shard != self.name:
            if self.file:
                self.file.close()
            store, path = _store(shard)
            self.name, self.file = shard, store.open_input_file(path)
        return self.file.read_at(length, offset)


def _mapped(index: DataFrame, fields: list[T.StructField], make) -> DataFrame:
    """``index`` with columns that ``make`` returns for (reader, shard, offset, length, digest)."""
    names = {f.name for f in fields}
    index = index.drop(*names)
    schema = T.StructType([*index.schema.fields, *fields])
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}

    def read(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, last, value = _Reader(), None, None
        for batch in found:
            at = [batch.schema.get_field_index(c) for c in ("shard", "offset", "length", "digest")]
            rows = []
            for key in zip(*(batch.column(k).to_pylist() for k in at), strict=True):
                if key != last:
                    last, value = key, make(reader, *key)
                rows.append(value)
            columns = list(zip(*rows, strict=True)) or [[]] * len(fields)
            more = [pa.array(c, kinds[f.dataType.simpleString()]) for c, f in zip(columns, fields, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [f.name for f in schema.fields])

    return index.mapInArrow(read, schema)


def with_header(index: DataFrame) -> DataFrame:
    """``index`` with width, height, bits and payload_bytes, read from headers alone."""

    def make(reader: _Reader, shard: str, offset: int, length: int, digest: str) -> tuple:
        start = reader.read(shard, offset - BLOCK, BLOCK + 25)
        if start[:64].decode() != digest or int(start[124:135], 8) != length:
            raise ValueError(f"{shard} at {offset} is not {digest}")
        width, height, bits = png_header(start[BLOCK:])
        return width, height, bits, width * height

    fields = [T.StructField(c, T.IntegerType()) for c in ("width", "height", "bits")]
    return _mapped(index, [*fields, T.StructField("payload_bytes", T.LongType())], make)


def feature_of(payload: bytes) -> str:
    """Mean, deviation and a 64-bit average hash of the samples, shrunk to 8 by 8."""
    samples = np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH).astype(np.float32)
    edges = np.linspace(0, len(samples), 9).astype(int)
    totals = np.concatenate([np.zeros((1, 8)), np.cumsum(samples.reshape(len(samples), 8, WIDTH // 8).mean(axis=2, dtype=np.float64), axis=0)])
    cells = (totals[edges[1:]] - totals[edges[:-1]]) / np.maximum(np.diff(edges), 1)[:, None]
    bits = np.packbits(cells.ravel() > cells.mean()).tobytes().hex()
    return f"{samples.mean(dtype=np.float64):.4f} {samples.std(dtype=np.float64):.4f} {bits}"


def with_features(index: DataFrame) -> DataFrame:
    """``index`` with digests, check sum and feature of what is stored."""

    def make(reader: _Reader, shard: str, offset: int, length: int, digest: str) -> tuple:
        image = reader.read(shard, offset, length)
        payload = from_png(image)
        return hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(image), hashlib.sha256(image).hexdigest(), feature_of(payload)

    kinds = {"payload_sha256": T.StringType(), "tail_crc32": T.LongType(), "media_bytes": T.LongType(), "media_sha256": T.StringType(), "feature": T.StringType()}
    return _mapped(index, [T.StructField(c, k) for c, k in kinds.items()], make)


def media_folder(spark) -> str:
    return scratch(spark, "media")
