"""Content-addressed media in tar shards.

A payload (here a text, padded to whole rows of 192 samples) is stored as a lossless 8-bit greyscale PNG inside a tar
shard, under the SHA-256 of its payload. Rows carry digest, shard, offset and length; a range read of the first bytes
fills the metadata columns, a range read of the whole member gives the payload back.

Tasks write shards straight into the shared folder under names of their own and report them in the catalogue, which Spark
commits as a table. A shard whose task failed is in no catalogue row, so a retry leaves whole results. A shard stores each
payload once and lists the rows that have it, so the catalogue has at most one row for a payload and shard, however often
the payload comes. The first place of each digest is the one that readers use.
"""

from __future__ import annotations

import hashlib
import re
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isotherm.llm.common import map_batches, texts
from isotherm.session import materialize, staging_path

WIDTH = 192
#: a shard is closed at this many bytes, or rows
SHARD_BYTES, SHARD_ROWS = 32 << 20, 20_000
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: signature and the whole first chunk of a PNG: all that the metadata needs
HEADER_BYTES = 33
BLOCK = 512


def payload_of(text: str) -> tuple[bytes, int]:
    """UTF-8, followed by spaces up to a positive multiple of the width; and the length before."""
    data = text.encode()
    return data + b" " * (-len(data) % WIDTH or WIDTH * (not data)), len(data)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def to_png(payload: bytes) -> bytes:
    """8-bit greyscale, 192 samples a row, no row filter."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    scan = np.zeros((len(rows), WIDTH + 1), np.uint8)
    scan[:, 1:] = rows
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(scan.tobytes(), 6)) + _chunk(b"IEND", b"")


def header_of(head: bytes) -> tuple[int, int, int]:
    """Width, height and bits per sample from the first 33 bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    if struct.unpack(">I", head[29:33])[0] != zlib.crc32(head[12:29]):
        raise ValueError("damaged PNG header")
    return struct.unpack(">IIB", head[16:25])


def from_png(data: bytes) -> bytes:
    """The samples of a PNG that ``to_png`` wrote; every checksum is tested."""
    width, height, _ = header_of(data[:HEADER_BYTES])
    at, body = 8, []
    while at < len(data):
        size = struct.unpack(">I", data[at : at + 4])[0]
        kind, chunk = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0] != zlib.crc32(data[at + 4 : at + 8 + size]):
            raise ValueError(f"damaged {kind!r} chunk")
        if kind == b"IDAT":
            body.append(chunk)
        at += size + 12
    scan = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    return scan[:, 1:].tobytes()


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder's address, and the path in it."""
    local = re.sub(r"^file:/+", "/", folder)
    return (fs.LocalFileSystem(), local) if local.startswith("/") else fs.FileSystem.from_uri(folder)


class _Shard:
    """A tar file that grows member by member; remembers what it holds."""

    def __init__(self, folder: str):
        system, path = _open(folder)
        system.create_dir(path, recursive=True)
        name = f"{uuid.uuid4().hex}.tar"
        self.address = f"{folder}/{name}"
        self.file = system.open_output_stream(f"{path}/{name}")
        self.at, self.members, self.rows = 0, {}, 0

    def add(self, doc_id: int | None, text: str) -> None:
        payload, n_bytes = payload_of(text)
        digest = hashlib.sha256(payload).hexdigest()
        if digest not in self.members:
            data = to_png(payload)
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(data)
            head = info.tobuf(tarfile.GNU_FORMAT)
            self.file.write(head + data + b"\0" * (-len(data) % BLOCK))
            self.members[digest] = (self.at + len(head), len(data), [])
            self.at += len(head) + len(data) + -len(data) % BLOCK
        self.members[digest][2].append((doc_id, n_bytes))
        self.rows += 1

    def close(self) -> dict[str, list]:
        self.file.write(b"\0" * (2 * BLOCK))
        self.file.close()
        found = list(self.members.items())
        return {
            "digest": [d for d, _ in found], "shard": [self.address] * len(found), "offset": [m[0] for _, m in found], "length": [m[1] for _, m in found],
            "rows": [[{"doc_id": i, "n_bytes": n} for i, n in m[2]] for _, m in found],
        }


CATALOGUE = pa.schema(
    [("digest", pa.string()), ("shard", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("rows", pa.list_(pa.struct([("doc_id", pa.int64()), ("n_bytes", pa.int64())])))]
)


def store(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes every text and returns the committed catalogue ``digest, shard, offset, length, rows``.

    ``rows`` holds ``doc_id, n_bytes`` of the rows with this payload among those of the shard. A null text is stored as
    the empty one, an empty text as one row of spaces; repeated rows are listed each; an empty table gives no shards.
    """
    folder = folder or staging_path(docs.sparkSession, "media")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                shard = shard or _Shard(folder)
                shard.add(doc_id, text)
                if shard.at >= SHARD_BYTES or shard.rows >= SHARD_ROWS:
                    yield pa.RecordBatch.from_pydict(shard.close(), CATALOGUE)
                    shard = None
        if shard:
            yield pa.RecordBatch.from_pydict(shard.close(), CATALOGUE)

    schema = "digest string, shard string, offset long, length long, rows array<struct<doc_id: long, n_bytes: long>>"
    return materialize(texts(docs).mapInArrow(write, schema), "catalogue")


def places(catalogue: DataFrame) -> DataFrame:
    """One place for each digest: the first by shard and offset."""
    first = F.min(F.struct("shard", "offset", "length")).alias("place")
    return catalogue.groupBy("digest").agg(first).select("digest", "place.*")


class _Reader:
    """Range reads; keeps the last shard open."""

    def __init__(self):
        self.address, self.file = None, None

    def read(self, address: str, offset: int, size: int) -> bytes:
        if address != self.address:
            system, path = _open(address)
            self.address, self.file = address, system.open_input_file(path)
        return self.file.read_at(size, offset)


def with_headers(stored: DataFrame) -> DataFrame:
    """Adds ``width, height, bits`` to places, from the first 33 bytes of each member."""

    def make():
        reader = _Reader()

        def step(batch: pa.RecordBatch) -> dict[str, list]:
            out = batch.to_pydict()
            heads = [header_of(reader.read(s, o, HEADER_BYTES)) for s, o in zip(out["shard"], out["offset"])]
            return out | {name: [h[k] for h in heads] for k, name in enumerate(("width", "height", "bits"))}

        return step

    by_shard = stored.select("digest", "shard", "offset", "length").repartition("shard").sortWithinPartitions("shard", "offset")
    return map_batches(by_shard, "digest string, shard string, offset long, length long, width int, height int, bits int", make)


def read_back(stored: DataFrame) -> DataFrame:
    """Reads the members of places with headers and describes what was read.

    ``feature``: height and width, then how many samples fall into each sixteenth of the range of a sample.
    """

    def make():
        reader = _Reader()
        columns = ("digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")

        def step(batch: pa.RecordBatch) -> dict[str, list]:
            out: dict[str, list] = {c: [] for c in columns}
            for row in batch.to_pylist():
                data = reader.read(row["shard"], row["offset"], row["length"])
                payload = from_png(data)
                found = hashlib.sha256(payload).hexdigest()
                if found != row["digest"]:
                    raise ValueError(f"payload of {row['digest']} is damaged")
                bins = np.bincount(np.frombuffer(payload, np.uint8) >> 4, minlength=16)
                values = (row["digest"], len(payload), found, zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), f"{row['height']}x{row['width']}:" + ",".join(map(str, bins)))
                for c, v in zip(columns, values):
                    out[c].append(v)
            return out

        return step

    return map_batches(stored, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", make)


def describe(docs: DataFrame) -> DataFrame:
    """Stores every text, reads it back once per digest, and returns one row for each row of ``docs``."""
    catalogue = store(docs)
    read = read_back(with_headers(places(catalogue)))
    # a digest has one catalogue row for a shard at most, so the join is even; rows are unfolded after it
    return catalogue.select("digest", "rows").join(read, "digest").select(F.explode("rows").alias("row"), *read.columns[1:]).select("row.*", *read.columns[1:])
