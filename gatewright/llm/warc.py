"""WARC archives in Zstandard: one frame per record, the dictionary in a skippable frame at the start.

Writing and reading are tasks over the storage that ``spark.checkpoint.dir`` (or the given folder) is on, by way of Arrow's file
systems. Each task writes archives of bounded size under names of its own and returns them; only archives in the returned
manifest count, so what a lost or repeated task leaves behind is never read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewright.llm.texts import as_bytes, pieces
from gatewright.session import cut_lineage, scratch_dir

VERSION = "WARC/1.1"
DICTIONARY_FRAME = 0x184D2A5D
FRAME = 0xFD2FB528
CHUNK = 1 << 14
#: Compressed bytes after which a task starts its next archive.
ARCHIVE_BYTES = 16 << 20
#: The dictionary is trained on so many payloads at most, of so many bytes each at most; longer ones are not drawn.
SAMPLES, SAMPLE_BYTES, DICTIONARY_BYTES = 200, 1 << 16, 1 << 15
REVISIT_BYTES = 1000
#: Tasks that read archives, at most.
READERS = 20_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
_PAGE = "urn:page:"


@dataclass
class Record:
    """One record: headers by lower-case name, and the block."""

    headers: dict[str, str]
    block: bytes

    def encode(self) -> bytes:
        lines = [VERSION, *(f"{k}: {v}" for k, v in self.headers.items()), f"Content-Length: {len(self.block)}"]
        return "\r\n".join(lines).encode() + b"\r\n\r\n" + self.block + b"\r\n\r\n"


def parse_record(data: bytes) -> Record:
    """Check and take apart the bytes of one frame; ValueError if they are not exactly one record."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8").split("\r\n")
    if not gap or not first.startswith("WARC/1."):
        raise ValueError("not a WARC record")
    headers = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"bad header line: {line[:80]!r}")
        headers[name.lower()] = value.strip()
    for name in ("warc-record-id", "warc-type", "warc-date", "content-length"):
        if name not in headers:
            raise ValueError(f"header {name} is missing")
    if not headers["content-length"].isdigit():
        raise ValueError("Content-Length is not a number")
    n = int(headers["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"block of {len(rest) - 4} bytes, Content-Length {n}")
    return Record(headers, rest[:n])


def sha1_header(digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()


def sha1_hex(header: str) -> str:
    kind, _, value = header.partition(":")
    if kind != "sha1" or len(value) != 32:
        raise ValueError(f"not a SHA-1 digest: {header[:60]!r}")
    return base64.b32decode(value).hex()


# --- archives ---------------------------------------------------------------------------------------------------------


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes | None:
    """A dictionary, or None where the samples are too few for one."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if len(samples) >= 8 else None
    except zstandard.ZstdError:
        return None


class ArchiveWriter:
    """Writes the dictionary's frame, then a frame per record."""

    def __init__(self, sink, dictionary: bytes | None):
        self.sink, self.size = sink, 0
        options = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        self.compressor = zstandard.ZstdCompressor(level=3, write_checksum=True, **options)
        if dictionary:
            body = zstandard.ZstdCompressor(level=19).compress(dictionary)
            self._put(struct.pack("<II", DICTIONARY_FRAME, len(body)) + body)

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.size += len(data)

    def add(self, record: Record) -> None:
        self._put(self.compressor.compress(record.encode()))


def read_archive(source) -> Iterator[Record]:
    """The records of an archive, one frame at a time; ValueError at the first frame that is cut off or no record."""
    head = source.read(8)
    dictionary, held = None, head
    if len(head) == 8:
        magic, size = struct.unpack("<II", head)
        if magic == DICTIONARY_FRAME:
            body = source.read(size)
            if len(body) != size:
                raise ValueError("dictionary frame is cut off")
            if body[:4] == struct.pack("<I", FRAME):
                body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
            dictionary, held = zstandard.ZstdCompressionDict(body), b""
    options = {"dict_data": dictionary} if dictionary else {}
    decompressor = zstandard.ZstdDecompressor(**options)
    while True:
        held = held or source.read(CHUNK)
        if not held:
            return
        frame, parts = decompressor.decompressobj(), []
        try:
            while not frame.eof:
                if not held:
                    raise ValueError("last frame is cut off")
                parts.append(frame.decompress(held))
                held = frame.unused_data if frame.eof else source.read(CHUNK)
        except zstandard.ZstdError as error:
            raise ValueError(f"bad frame: {error}") from error
        yield parse_record(b"".join(parts))


# --- pages ------------------------------------------------------------------------------------------------------------


def page_record(page: int | None, url: str | None, payload: bytes, digest: str, length: int, refers_to: int | None) -> Record:
    """A response with its payload, or (with ``refers_to``) a revisit without it. The HTTP header keeps the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    headers = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<{_PAGE}{'' if page is None else page}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": "".join((url or "").split()) or "urn:none",
        "WARC-Payload-Digest": sha1_header(digest),
        "Content-Type": "application/http; msgtype=response",
    }
    if refers_to is not None:
        headers |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<{_PAGE}{refers_to}>"}
    return Record(headers, http + (payload if refers_to is None else b""))


def _page(header: str) -> int | None:
    if not header.startswith(f"<{_PAGE}") or not header.endswith(">"):
        raise ValueError(f"not a page's id: {header[:60]!r}")
    return int(header[len(_PAGE) + 1 : -1]) if len(header) > len(_PAGE) + 2 else None


def page_of(record: Record) -> tuple[int | None, int, str, str, int | None, str, bytes]:
    """(page, payload bytes, digest, record type, page referred to, url, payload), checked against each other."""
    kind, headers = record.headers["warc-type"], record.headers
    http, gap, payload = record.block.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    if not gap or not fields.get("Content-Length", "").isdigit():
        raise ValueError("bad HTTP header")
    length, digest = int(fields["Content-Length"]), sha1_hex(headers.get("warc-payload-digest", ""))
    refers_to = None
    if kind == "response":
        if len(payload) != length or hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError("payload differs from its length or digest")
    elif kind == "revisit":
        refers_to = _page(headers.get("warc-refers-to", ""))
        if payload:
            raise ValueError("revisit with a payload")
    else:
        raise ValueError(f"unknown record type {kind}")
    return _page(headers["warc-record-id"]), length, digest, kind, refers_to, headers.get("warc-target-uri", ""), payload


def with_revisits(pages: DataFrame, id_column: str, url_column: str, html_column: str, least: int) -> DataFrame:
    """(page, url, payload, digest, length, refers_to): of equal payloads of ``least`` bytes or more that of the largest id stands.

    A page of null id stands for its payload only if no page with an id has it. Rows that share the largest id all stand.
    """
    rows = pages.select(
        F.col(id_column).cast("long").alias("page"), F.col(url_column).cast("string").alias("url"), as_bytes(html_column).alias("payload")
    ).withColumns({"digest": F.sha1("payload"), "length": F.octet_length("payload").cast("long")})
    keys = rows.select("digest", "length", "page").where(F.col("length") >= least)
    first = keys.groupBy("digest").agg(F.max("page").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    refers = F.when((F.col("length") >= least) & ~F.col("page").eqNullSafe(F.col("first")), F.col("first"))
    return rows.join(first, "digest", "left").select("page", "url", "payload", "digest", "length", refers.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, dictionary: bytes | None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write rows of :func:`with_revisits` to archives below ``folder``; returns the manifest (path, records, bytes), written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        done, writer, name, records = [], None, "", 0
        for batch in pieces(batches, "payload"):
            for row in batch.to_pylist():
                if writer is None:
                    name, records = f"{root}/{uuid.uuid4().hex}.warc.zst", 0
                    writer = ArchiveWriter(store.open_output_stream(name, compression=None), dictionary)
                writer.add(page_record(row["page"], row["url"], row["payload"], row["digest"], row["length"], row["refers_to"]))
                records += 1
                if writer.size >= archive_bytes:
                    writer.sink.close()
                    done.append((name, records, writer.size))
                    writer = None
        if writer is not None:
            writer.sink.close()
            done.append((name, records, writer.size))
        if done:
            kinds = (pa.string(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=["path", "records", "bytes"])

    return cut_lineage(pages.mapInArrow(run, "path string, records long, bytes long"), "warc-manifest")


def read_archives(manifest: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to[, url, payload]) of all records of the manifest's archives.

    An archive that is cut off, has a wrong length or digest, or fewer or more records than the manifest says, is an error.
    """
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    keep = len(names) if with_payload else 5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                n, part, size = 0, [], 0
                with store.open_input_stream(row["path"], compression=None) as source:
                    for record in read_archive(source):
                        part.append(page_of(record)[:keep])
                        n, size = n + 1, size + len(record.block)
                        if size >= 1 << 22 or len(part) >= 4096:
                            yield _batch(part, names, kinds)
                            part, size = [], 0
                if n != row["records"]:
                    raise ValueError(f"{row['path']}: {n} records, {row['records']} written")
                if part:
                    yield _batch(part, names, kinds)

    # a given number of tasks: AQE would size them by the manifest's few bytes and read all archives in one
    spread = manifest.repartition(max(1, min(manifest.count(), READERS)), F.col("path"))
    types = ["long", "long", "string", "string", "long", "string", "binary"]
    return spread.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in list(zip(names, types))[:keep]))


def _batch(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names[: len(rows[0])])


def drawn_payloads(payloads: DataFrame, most: int = SAMPLES, most_bytes: int = SAMPLE_BYTES) -> list[bytes]:
    """At most ``most`` different payloads of 1 to ``most_bytes`` bytes, drawn by their hashes.

    Hashes are drawn first: those under a threshold that some four times as many as wanted stay under, each once. Only the payloads of
    the smallest ``most`` are then fetched, so what tasks send to the driver doesn't grow with their number.
    """
    hashed = payloads.where(F.octet_length("payload").between(1, most_bytes)).select("payload", F.xxhash64("payload").alias("hash"))
    there = hashed.agg(F.approx_count_distinct("hash")).first()[0]
    share = min(1.0, 4 * most / max(there, 1))
    few = hashed.where(F.pmod("hash", F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("hash").distinct()
    hashes = [r[0] for r in few.orderBy("hash").limit(most).collect()]
    found = hashed.where(F.col("hash").isin(hashes)).groupBy("hash").agg(F.first("payload").alias("payload"))
    return [bytes(r["payload"]) for r in sorted(found.collect(), key=lambda r: r["hash"])]


def archive_pages(
    pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", least: int = REVISIT_BYTES
) -> tuple[DataFrame, str]:
    """Write all pages and return (manifest, folder). Null html is an empty payload; an empty table gives no archive.

    Scale: html is shuffled once by its digest (hot payloads split by AQE); an archive holds about 16 MB compressed. The driver
    sees some hashes and ``SAMPLES`` payloads of at most ``SAMPLE_BYTES`` for the dictionary, however many tasks there are.
    """
    folder = scratch_dir(pages.sparkSession, "warc")
    folder = folder if "://" in folder or folder.startswith("/") else folder.replace("file:", "file://", 1)
    samples = drawn_payloads(pages.select(as_bytes(html_column).alias("payload")))
    rows = with_revisits(pages, id_column, url_column, html_column, least)
    return write_archives(rows, folder, train_dictionary(samples)), folder
