"""Media columns: payloads in tar shards, addressed by content.

A row doesn't hold its payload but a digest of the stored form and where it is:
shard, offset and length. Writing goes through the corpus once, without a
shuffle: each task appends to its own shards and stores a digest it has had
before only once. The rows are written as a manifest; only files that a
committed manifest names count, so retried tasks leave nothing but unused files.

Payloads here are texts stored as greyscale PNG pictures, 192 samples of eight
bits a line. Metadata columns (width, height, depth) are filled by range reads
of the 33 bytes of a picture's header; payloads are read where they are asked
for, in the order in which they lie in the shards.

Defined results: null texts count as empty; the empty text is one line of
spaces; equal texts get equal values in all columns but the address; repeated
rows and null ids get a row each; an empty table gives an empty manifest.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.llm import stores
from graphloom.llm.shared import PRIVATE, filled, fresh_path, written

LINE = 192
HEADER = 33
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload_of(text: str) -> tuple[bytes, int]:
    """A text's bytes, filled up with spaces to a positive multiple of LINE, and
    their number before that."""
    data = text.encode("utf-8")
    return data.ljust(max(LINE, -(-len(data) // LINE) * LINE), b" "), len(data)


def to_png(payload: bytes) -> bytes:
    """Samples of eight bits as a PNG picture of LINE columns."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))

    lines = np.zeros((len(payload) // LINE, LINE + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, LINE)
    head = struct.pack(">IIBBBBB", LINE, len(lines), 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and depth from a picture's first 33 bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR" or zlib.crc32(head[12:29]) != struct.unpack(">I", head[29:33])[0]:
        raise ValueError("no PNG header")
    return struct.unpack(">IIB", head[16:25])


def from_png(data: bytes) -> bytes:
    """The samples of a picture made by ``to_png``, with all checksums tested."""
    width, height, depth = png_header(data[:HEADER])
    at, packed = HEADER, []
    while at < len(data):
        length, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + length]
        if zlib.crc32(body, zlib.crc32(kind)) != struct.unpack(">I", data[at + 8 + length : at + 12 + length])[0]:
            raise ValueError("a chunk's checksum differs")
        if kind == b"IDAT":
            packed.append(body)
        at += 12 + length
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width * depth // 8 + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines")
    return lines[:, 1:].tobytes()


def tar_header(name: str, size: int) -> bytes:
    """A member's header in the ustar format. The digest is the name, so equal
    content is the same member; times and owners are zero."""
    number = f"{size:011o}\0".encode() if size < 8**11 else b"\x80" + size.to_bytes(11, "big")
    head = bytearray(512)
    for at, value in ((0, name.encode()), (100, b"0000644\0"), (108, b"0000000\0"), (116, b"0000000\0"), (124, number), (136, b"00000000000\0"), (148, b" " * 8), (156, b"0"), (257, b"ustar\00000")):
        head[at : at + len(value)] = value
    head[148:156] = f"{sum(head):06o}\0 ".encode()
    return bytes(head)


def store(docs: DataFrame, keep: list[str], text_col: str = "text", folder: str | None = None, shard_bytes: int = 256 << 20) -> DataFrame:
    """Write payloads to shards; the manifest: kept columns, ``n_bytes``,
    ``digest``, ``shard``, ``offset``, ``length``."""
    folder = folder or fresh_path(docs.sparkSession, "media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        # Addresses in this task's shards by digest of the text.
        known: dict[bytes, tuple] = {}
        try:
            for batch in batches:
                rows = []
                for text in batch.column(len(keep)):
                    payload, size = payload_of(text.as_py())
                    key = hashlib.blake2b(payload, digest_size=20).digest() + size.to_bytes(8, "little")
                    if key not in known:
                        media = to_png(payload)
                        if shard is None or shard.at >= shard_bytes:
                            if shard is not None:
                                shard.write(bytes(1024))
                                shard.close()
                            shard = stores.Output(stores.task_file(folder, ".tar"))
                        digest = hashlib.sha256(media).hexdigest()
                        shard.write(tar_header(f"{digest}.png", len(media)))
                        at = shard.write(media)
                        shard.write(bytes(-len(media) % 512))
                        known[key] = size, digest, shard.uri, at, len(media)
                    rows.append(known[key])
                size, digest, uri, at, length = zip(*rows) if rows else ((),) * 5
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i) for i in range(len(keep))), pa.array(size, pa.int64()), pa.array(digest, pa.string()), pa.array(uri, pa.string()), pa.array(at, pa.int64()), pa.array(length, pa.int64())],
                    names=[*keep, "n_bytes", "digest", "shard", "offset", "length"],
                )
        finally:
            if shard is not None:
                shard.write(bytes(1024))
                shard.close()

    rows = docs.select(*keep, filled(text_col).alias(PRIVATE + "text"))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return written(rows.mapInArrow(run, f"{schema}, n_bytes long, digest string, shard string, offset long, length long"), "media-manifest")


def read_by_address(manifest: DataFrame, take, columns: str) -> DataFrame:
    """``manifest`` with columns from ``take(input, digest, shard, offset, length)``, a
    tuple; an address that follows itself is read once."""
    names = [c.split()[0] for c in columns.split(", ")]
    kinds = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[c.split()[1]] for c in columns.split(", ")]
    held = manifest.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, last, found = stores.Input(), None, ()
        try:
            for batch in batches:
                rows = []
                for address in zip(*(batch.column(c).to_pylist() for c in ("digest", "shard", "offset", "length"))):
                    if address != last:
                        found, last = take(source, *address), address
                    rows.append(found)
                new = list(zip(*rows)) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in held), *(pa.array(v, k) for v, k in zip(new, kinds))], names=[*held, *names])
        finally:
            source.close()

    schema = ", ".join(f"`{c}` {manifest.schema[c].dataType.simpleString()}" for c in held)
    return manifest.mapInArrow(run, f"{schema}, {columns}")


def in_shard_order(manifest: DataFrame) -> DataFrame:
    """The manifest dealt out in even ranges of addresses."""
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.repartitionByRange(parts, "shard", "offset").sortWithinPartitions("shard", "offset")


def with_metadata(manifest: DataFrame) -> DataFrame:
    """Width, height and bits a sample, from headers only."""
    return read_by_address(manifest, lambda source, digest, shard, offset, length: png_header(source.read(shard, offset, HEADER)), "width int, height int, bits int")


def describe(samples: np.ndarray) -> str:
    """Mean, spread and entropy of samples, and the share of each eighth of
    their range."""
    counts = np.bincount(samples, minlength=256).astype(np.float64)
    share = counts / counts.sum()
    values = np.arange(256)
    mean = float(share @ values)
    spread = float(np.sqrt(max(share @ (values - mean) ** 2, 0)))
    some = share[share > 0]
    eighths = share.reshape(8, 32).sum(axis=1)
    return ",".join(f"{x:.4f}" for x in (mean, spread, float(-(some * np.log2(some)).sum()), *eighths))


def with_features(manifest: DataFrame) -> DataFrame:
    """What the stored bytes hold: sizes and digests of payload and stored
    form, a checksum of the payload's last 16 bytes, and a feature."""

    def take(source: stores.Input, digest: str, shard: str, offset: int, length: int) -> tuple:
        media = source.read(shard, offset, length)
        if hashlib.sha256(media).hexdigest() != digest:
            raise ValueError(f"{shard} at {offset} holds another content than {digest}")
        payload = from_png(media)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), describe(np.frombuffer(payload, np.uint8))

    return read_by_address(manifest, take, "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_columns(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """Store, then read metadata and features back."""
    return with_features(with_metadata(in_shard_order(store(docs, keep, text_col))))
