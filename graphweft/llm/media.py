"""Media columns: payloads in content-addressed tar shards, rows with digest, shard, offset and length.

A text's UTF-8 bytes, filled up with bytes 255, become the samples of an 8-bit grey image 576 wide (PNG, lossless).
Images go into tar shards in the shared folder, one member for each distinct content, named by its digest. Rows keep
only digest, shard (its path), offset and length, by which anyone can read a payload; header-only range reads (33 bytes)
fill the metadata columns, full reads give the payload back for checks and features. Tasks read runs of a shard in order.

Defined results: a null text is an empty text, whose payload is one row of 255s. Equal texts share one member and so
have equal values; repeated rows and repeated doc_ids are answered row by row. Columns other than doc_id and text are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft.llm.common import materialise, scratch

WIDTH = 576
#: Bytes at the end whose CRC proves that a payload was read to its end.
TAIL = 32
#: A shard is closed when it has so many bytes.
SHARD_BYTES = 256 << 20
#: Stored bytes that one task reads, about, and bytes of a shard that stay together in it.
TASK_BYTES, RUN_BYTES = 16 << 20, 4 << 20
#: Signature and IHDR of a PNG: all that a header-only read fetches.
HEADER_BYTES = 33
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"
TAR_BLOCK = 512
INDEX = "digest string, shard string, offset long, length long"


def payload(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\xff" * (max(1, -(-len(raw) // WIDTH)) * WIDTH - len(raw))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(samples: bytes, level: int = 6) -> bytes:
    """8-bit grey image WIDTH wide, each line after filter byte 0."""
    lines = np.zeros((len(samples) // WIDTH, WIDTH + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    return PNG_SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(lines), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bits a sample from the first HEADER_BYTES."""
    if head[:8] != PNG_SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    return struct.unpack(">IIB", head[16:25])


def from_png(data: bytes) -> bytes:
    width, height, bits = png_header(data)
    at, body = 8, []
    while at < len(data):
        (length,) = struct.unpack_from(">I", data, at)
        if data[at + 4 : at + 8] == b"IDAT":
            body.append(data[at + 8 : at + 8 + length])
        at += 12 + length
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    if bits != 8 or lines[:, 0].any():
        raise ValueError("only 8-bit lines without a filter are stored")
    return lines[:, 1:].tobytes()


def _folder(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class ShardWriter:
    """Appends members to tar shards below a folder and tells where each landed. File names are new for each attempt
    of a task, so an attempt that is repeated after an executor's loss never touches what another has written."""

    def __init__(self, root: str):
        self.root, self.out = root, None
        self.files, self.path = _folder(root)

    def add(self, name: str, data: bytes) -> tuple[str, int, int]:
        if self.out is None:
            self.shard, self.at = f"shard-{uuid.uuid4().hex}.tar", 0
            self.out = self.files.open_output_stream(f"{self.path}/{self.shard}")
        info = tarfile.TarInfo(name)
        info.size = len(data)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        start = self.at + len(head)
        self.out.write(head)
        self.out.write(data)
        self.out.write(b"\0" * (-len(data) % TAR_BLOCK))
        self.at = start + -(-len(data) // TAR_BLOCK) * TAR_BLOCK
        place = self.shard, start, len(data)
        if self.at >= SHARD_BYTES:
            self.close()
        return place

    def close(self) -> None:
        if self.out is not None:
            self.out.write(b"\0" * (2 * TAR_BLOCK))
            self.out.close()
            self.out = None


def store(docs: DataFrame, root: str) -> DataFrame:
    """Writes each distinct text's image; returns the index (digest, shard, offset, length), one row for each digest.

    digest is the payload's SHA-256. Images are written where the texts are read, so no payload is shuffled: a task
    writes a content once, and of the addresses that several tasks have for it the index keeps the smallest. A content
    that a third of all rows have so takes the room of one member for each task at most.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        shards = ShardWriter(root)
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                samples = payload(text)
                digest = hashlib.sha256(samples)
                if digest.digest() not in seen:
                    seen.add(digest.digest())
                    name = digest.hexdigest()
                    rows.append((name, *shards.add(f"{name}.png", to_png(samples))))
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["digest", "shard", "offset", "length"])
        shards.close()

    files, path = _folder(root)
    files.create_dir(path, recursive=True)
    # written before it is used twice: another run of the tasks would write other shards
    written = materialise(docs.select("text").mapInArrow(write, INDEX))
    return materialise(written.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at")).select("digest", "at.*"))


def _ranges(index: DataFrame, root: str, length, row, schema: str) -> DataFrame:
    """row((digest, shard, offset, length), bytes) for the first ``length`` bytes of each member, or for all of it."""
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    fields = [x.split() for x in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _folder(root)
        for batch in batches:
            at, rows = sorted(zip(*(c.to_pylist() for c in batch.columns[1:]), batch.column(0).to_pylist())), []
            shard = source = None
            for name, offset, size, digest in at:
                if name != shard:
                    if source:
                        source.close()
                    shard, source = name, files.open_input_file(f"{path}/{name}")
                source.seek(offset)
                rows.append(row((digest, name, offset, size), source.read(min(size, length or size))))
            if source:
                source.close()
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), fields)], names=[n for n, _ in fields])

    # few index rows stand for many bytes: as many tasks as the bytes to be read ask for, each with whole runs of shards
    total = index.agg(F.sum(F.least("length", F.lit(length or 1 << 62)))).first()[0] or 0
    run = F.floor(F.col("offset") / RUN_BYTES)
    dealt = index.select("digest", "shard", "offset", "length").repartition(max(1, -(-total // TASK_BYTES)), "shard", run)
    return dealt.mapInArrow(read, schema)


def headers(index: DataFrame, root: str) -> DataFrame:
    """Metadata columns of each member, by header-only range reads."""
    return _ranges(index, root, HEADER_BYTES, lambda place, head: (place[0], *png_header(head)), "digest string, width int, height int, bits int")


def feature(samples: bytes) -> str:
    """Lines, mean, entropy in bits and a 16-cell brightness sketch of an image."""
    pixels = np.frombuffer(samples, np.uint8)
    share = np.bincount(pixels, minlength=256) / len(pixels)
    entropy = -(share[share > 0] * np.log2(share[share > 0])).sum()
    cells = pixels.reshape(-1, 16, WIDTH // 16).mean((0, 2))
    return f"{len(pixels) // WIDTH}x{WIDTH};mean={pixels.mean():.4f};entropy={entropy:.4f};sketch=" + "".join(f"{int(c):02x}" for c in cells)


def features(index: DataFrame, root: str) -> DataFrame:
    """The address and what full reads give: the decoded payload's digest, CRC and features, and the stored form's digest."""

    def row(place: tuple, data: bytes) -> tuple:
        samples = from_png(data)
        return *place, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-TAIL:]), len(data), hashlib.sha256(data).hexdigest(), feature(samples)

    return _ranges(index, root, None, row, f"{INDEX}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def addresses(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and digest of each row's payload, without the payload; built in."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    length = F.octet_length(raw).cast("long")
    fill = F.greatest(F.ceil(length / WIDTH), F.lit(1)) * WIDTH - length
    padding = F.unhex(F.repeat(F.lit("FF"), fill.cast("int")))
    return docs.select("doc_id", length.alias("n_bytes"), F.sha2(F.concat(raw, padding), 256).alias("digest"))


def media_columns(docs: DataFrame, root: str | None = None) -> DataFrame:
    """Stores below ``root`` (a new folder in the shared one, if none is given), reads back and joins: one row for each
    row of docs, with the payload's address."""
    root = root or scratch(docs.sparkSession)
    index = store(docs, root)
    found = features(index, root).join(headers(index, root), "digest")
    return addresses(docs).join(found, "digest").withColumn("shard", F.concat(F.lit(f"{root}/"), "shard")).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "bits", "digest", "shard", "offset", "length")
