"""WARC archives of pages, compressed record by record with Zstandard.

An archive starts with a skippable frame that holds a dictionary trained on the
archive's first records; each record is one frame, so a reader can start at any
record. Pages with equal payloads are stored once: the record of the smallest
page id is a ``response``, the others are ``revisit`` records that refer to it
and carry only its headers. Archives are written by the tasks of one stage;
the list of archives is a table, and only archives in it are read.

The reader loads the dictionary from the leading frame, decompresses one frame
per record, and tests version, required fields, lengths, the end of the block
and the payload's digest.

Defined results: null html is an empty payload; of rows that share both payload
and smallest id, all are responses; a null page id never is the smallest unless
a group has no other (then all its records are responses); a null url is
written as ``urn:none``; an empty table gives no archives and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import stores
from graphloom.llm.shared import PRIVATE, filled, fresh_path, with_classes, written

#: Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
FRAME = b"\x28\xb5\x2f\xfd"
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")

#: Bytes of records that a dictionary is trained on, and its size.
SAMPLE_BYTES, DICTIONARY_BYTES = 1 << 20, 1 << 14


def record(page_id, url: str | None, payload: bytes, refers_to, date: str) -> bytes:
    """A record with its end. ``refers_to`` None: a response."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "urn:none")
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:page:{page_id}>",
        "WARC-Date": date,
        "WARC-Target-URI": uri,
        "WARC-Payload-Digest": f"sha1:{digest}",
    }
    if refers_to is not None:
        fields |= {"WARC-Refers-To": f"<urn:page:{refers_to}>", "WARC-Profile": PROFILE}
    fields |= {"Content-Type": "application/http;msgtype=response", "Content-Length": str(len(block))}
    head = VERSION + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """A record's fields and block, tested."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8").split("\r\n")
    if not sep or version != VERSION:
        raise ValueError(f"no {VERSION} record")
    fields = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not name or name in fields:
            raise ValueError(f"bad header line {line!r}")
        fields[name] = value.strip()
    if missing := [x for x in REQUIRED if x not in fields]:
        raise ValueError(f"a record lacks {missing}")
    length = int(fields["Content-Length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"a block of {length} bytes doesn't end its record of {len(rest)}")
    return fields, rest[:length]


class Archive:
    """An archive that is being written. Its dictionary comes from the first
    records, which wait until there are enough of them."""

    def __init__(self, uri: str):
        self._out, self._waiting, self._size, self._compressor = stores.Output(uri), [], 0, None
        self.uri, self.records = uri, 0

    @property
    def size(self) -> int:
        return self._out.at + self._size

    def add(self, data: bytes) -> None:
        self.records += 1
        if self._compressor is not None:
            self._out.write(self._compressor.compress(data))
            return
        self._waiting.append(data)
        self._size += len(data)
        if self._size >= SAMPLE_BYTES:
            self._begin()

    def _begin(self) -> None:
        import zstandard

        try:
            trained = zstandard.train_dictionary(DICTIONARY_BYTES, self._waiting)
        except zstandard.ZstdError:
            # Too few or too equal records to train on: their beginning is the dictionary.
            trained = zstandard.ZstdCompressionDict(b"".join(self._waiting[:64])[:DICTIONARY_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held = trained.as_bytes()
        self._out.write(struct.pack("<II", DICTIONARY_FRAME, len(held)) + held)
        self._compressor = zstandard.ZstdCompressor(level=3, dict_data=trained, write_checksum=True, write_content_size=True)
        for data in self._waiting:
            self._out.write(self._compressor.compress(data))
        self._waiting, self._size = [], 0

    def close(self) -> None:
        if self._compressor is None:
            self._begin()
        self._out.close()


def records(uri: str, piece: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """An archive's records, with no more than one in memory."""
    import zstandard

    system, path = stores.opened(uri)
    with system.open_input_stream(path, compression=None) as source:
        held = source.read(8)
        given = None
        if len(held) == 8 and struct.unpack("<I", held[:4])[0] == DICTIONARY_FRAME:
            size = struct.unpack("<I", held[4:])[0]
            body = source.read(size)
            if len(body) != size:
                raise ValueError(f"{uri} ends within its dictionary")
            if body[:4] == FRAME:
                body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
            given, held = zstandard.ZstdCompressionDict(body), b""
        reader = zstandard.ZstdDecompressor(dict_data=given)
        while held or (held := source.read(piece)):
            frame, out = reader.decompressobj(), []
            while True:
                out.append(frame.decompress(held))
                if frame.eof:
                    held = frame.unused_data
                    break
                held = source.read(piece)
                if not held:
                    raise ValueError(f"{uri} ends within a frame")
            yield parsed(b"".join(out))


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = 256 << 20, folder: str | None = None) -> DataFrame:
    """Write ``pages`` to archives; returns their ``path`` and ``records``.

    Payloads of fewer than ``least_bytes`` bytes are always stored whole.
    """
    folder = folder or fresh_path(pages.sparkSession, "warc")
    key, first, html = PRIVATE + "key", PRIVATE + "first", PRIVATE + "html"
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), filled(html_col).alias(html)).withColumn(key, F.sha2(html, 256))
    # Only ids and digests meet by digest; html travels by digest and id, so
    # pages with equal payloads aren't sent to one task.
    ids = written(rows.filter(F.octet_length(html) >= least_bytes).groupBy(key, "id").agg(F.count(F.lit(1)).alias("rows")), "warc-ids")
    firsts = written(ids.groupBy(key).agg(F.min("id").alias(first), F.sum("rows").alias("n")).filter("n > 1"), "warc-firsts")
    later = with_classes(ids.drop("rows"), firsts, [key], "n").filter(F.col(first).isNotNull() & ~F.col("id").eqNullSafe(F.col(first)))
    later = later.select(F.col(key).alias(PRIVATE + "k"), F.col("id").alias(PRIVATE + "id"), first)
    same = (F.col(key) == F.col(PRIVATE + "k")) & F.col("id").eqNullSafe(F.col(PRIVATE + "id"))
    rows = rows.join(later, same, "left").select("id", "url", html, F.col(first).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, archive = [], None
        for batch in batches:
            for page_id, url, text, refers_to in zip(batch.column(0), batch.column(1), batch.column(2), batch.column(3)):
                if archive is None or archive.size >= archive_bytes:
                    if archive is not None:
                        archive.close()
                        done.append((archive.uri, archive.records))
                    archive = Archive(stores.task_file(folder, ".warc.zst"))
                archive.add(record(page_id.as_py(), url.as_py(), text.as_py().encode("utf-8"), refers_to.as_py(), date))
        if archive is not None:
            archive.close()
            done.append((archive.uri, archive.records))
        paths, number = zip(*done) if done else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(number, pa.int64())], names=["path", "records"])

    return written(rows.mapInArrow(run, "path string, records long"), "warc-archives")


def page_number(uri: str | None) -> int | None:
    """The whole number that a record's id was made from; None for null."""
    if uri is None:
        return None
    found = re.fullmatch(r"<urn:page:(-?\d+|None)>", uri)
    if found is None:
        raise ValueError(f"{uri} does not name a page by a whole number")
    return None if found[1] == "None" else int(found[1])


def read_archives(archives: DataFrame) -> DataFrame:
    """A row per record: page_id, url, payload_bytes, payload_digest,
    record_type, refers_to. Archives are dealt out one by one."""

    def described(fields: dict[str, str], block: bytes) -> tuple:
        http, sep, payload = block.partition(b"\r\n\r\n")
        told = re.search(rb"\r\nContent-Length: (\d+)", http)
        digest = fields.get("WARC-Payload-Digest", "")
        if not sep or told is None or not digest.startswith("sha1:"):
            raise ValueError("a record has no payload length or digest")
        size, digest, kind = int(told[1]), digest[5:], fields["WARC-Type"]
        if kind == "response" and (size != len(payload) or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
            raise ValueError(f"the payload of {fields['WARC-Record-ID']} is not what its headers say")
        return page_number(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), size, digest, kind, page_number(fields.get("WARC-Refers-To"))

    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, number in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, seen = [], 0
                for fields, block in records(path):
                    rows.append(described(fields, block))
                    seen += 1
                    if len(rows) == 5000:
                        yield batch_of(rows)
                        rows = []
                if seen != number:
                    raise ValueError(f"{path} has {seen} of {number} records")
                if rows:
                    yield batch_of(rows)

    spread = archives.repartitionByRange(max(1, archives.count()), "path")
    return spread.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")
