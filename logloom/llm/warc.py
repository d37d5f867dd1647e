"""WARC archives compressed with a dictionary built from their own records.

Every archive is a ``.warc.zst`` file: a leading skippable frame holds a Zstandard
dictionary trained on records of this archive, each record follows as a frame of its own.
A reader needs nothing but the file, and may start at any record. Archives hold a bounded
amount of payload, so a task that writes or reads one holds one in memory.

Equal payloads of at least ``MIN_REVISIT`` bytes are stored once: the page of the largest id has
the response, the others are revisits that name it and its digest. Which they are is settled
by a partial aggregate on the digest and a join back that adaptive execution can split.

The dictionary is fitted on a sample of at most ``SAMPLE_BYTES`` of an archive's records; it
affects sizes only. Archives are written to the folder named by spark.checkpoint.dir; a job's
table of archives names the files of the attempts that succeeded, no other file is read.

Defined results: a null html is an empty payload; a null url leaves the target out; pages of
null id can be revisits but are never referred to; rows of one id and payload have the same
type; if all ids of equal payloads are null, all are responses; no pages give no archive.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm import store
from logloom.llm.texts import map_batches
from logloom.session import written

#: Payloads below this size are never revisits.
MIN_REVISIT = 1000
#: Bytes of payload in one archive, of its dictionary and of the records it is built from.
ARCHIVE_BYTES, DICTIONARY_BYTES, SAMPLE_BYTES = 16 << 20, 64 << 10, 2 << 20
LEVEL = 3
#: Fixed values of the format: the skippable frame of a dictionary, the revisit profile.
DICTIONARY_MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURED = "1970-01-01T00:00:00Z"


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                  min_revisit: int = MIN_REVISIT) -> DataFrame:
    """(page_id, url, html, digest, refers_to); refers_to is null for responses."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"),
                        F.coalesce(F.col(html_col), F.lit("")).alias("html")).withColumn("digest", F.sha1("html"))
    large = rows.where(F.octet_length("html") >= min_revisit)
    owners = large.groupBy("digest").agg(F.max("page_id").alias("owner"), F.count("*").alias("copies"))
    owners = written(owners.where("copies > 1 and owner is not null").select("digest", "owner"), "owners")
    return rows.join(owners, "digest", "left").select(
        "page_id", "url", "html", "digest",
        F.when(F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner")), F.col("owner")).alias("refers_to"))


def _name(page_id) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page_id(name: str):
    value = name.removeprefix("<urn:page:").removesuffix(">")
    return None if value == "null" else value


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record: a response with its payload, or a revisit with the response's headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_name(page_id)}",
             f"WARC-Date: {CAPTURED}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~', errors='replace')}")
    lines.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(refers_to)}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode().split("\r\n")[1:] if line)
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def parse(raw: bytes) -> dict:
    """What a record says; a response's payload is held against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = rest[:int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    found = {"page_id": _page_id(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "payload_digest": digest,
             "payload_bytes": int(_fields(http)["content-length"]), "record_type": fields["warc-type"],
             "refers_to": None, "payload": None}
    if found["record_type"] == "revisit":
        found["refers_to"] = _page_id(fields["warc-refers-to"])
    else:
        if len(payload) != found["payload_bytes"] or hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"payload of {fields['warc-record-id']} differs from its digest")
        found["payload"] = payload
    return found


def _dictionary(records: list[bytes]) -> bytes:
    """A dictionary from evenly spaced records of an archive; empty where too little is there to learn from."""
    total, samples, used = sum(map(len, records)), [], 0
    step = max(1, -(-total // SAMPLE_BYTES))
    for raw in records[::step]:
        if used >= SAMPLE_BYTES:
            break
        samples.append(raw[:SAMPLE_BYTES - used])
        used += len(samples[-1])
    size = min(DICTIONARY_BYTES, used // 8)
    if len(samples) < 8 or size < 1024:
        return b""
    try:
        return zstandard.train_dictionary(size, samples, k=512, d=8).as_bytes()
    except zstandard.ZstdError:  # samples from which nothing can be learned
        return b""


def archive(records: list[bytes]) -> tuple[bytes, list[int]]:
    """The bytes of an archive and where its records start."""
    words = _dictionary(records)
    given = zstandard.ZstdCompressionDict(words) if words else None
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=given, write_checksum=True)
    out, starts = [struct.pack("<II", DICTIONARY_MAGIC, len(words)), words], []
    at = 8 + len(words)
    for raw in records:
        starts.append(at)
        out.append(compressor.compress(raw))
        at += len(out[-1])
    return b"".join(out), starts


def _reader(data: bytes) -> tuple[zstandard.ZstdDecompressor, int]:
    magic, size = struct.unpack_from("<II", data)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("an archive starts with the frame of its dictionary")
    words = data[8:8 + size]
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words) if words else None), 8 + size


def record_at(data: bytes, start: int) -> bytes:
    """The record whose frame starts at ``start``; no other record is decompressed."""
    return _reader(data)[0].decompressobj().decompress(data[start:])


def records_of(data: bytes) -> Iterator[bytes]:
    """The records of an archive, one frame after the other."""
    decompressor, at = _reader(data)
    view = memoryview(data)
    while at < len(data):
        frame = decompressor.decompressobj()
        raw = frame.decompress(view[at:])
        at = len(data) - len(frame.unused_data)
        yield raw


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   min_revisit: int = MIN_REVISIT, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write all pages to archives; returns their table (path, records, bytes)."""
    folder = store.new_folder(pages.sparkSession, "warc")

    def run(batches):
        records, size, number = [], 0, 0

        def close() -> pa.RecordBatch:
            data, starts = archive(records)
            path = store.write_file(folder, f"{number:05d}.warc.zst", data)
            return pa.RecordBatch.from_pydict({"path": [path], "records": [len(starts)], "bytes": [len(data)]})

        for batch in batches:
            for page_id, url, html, digest, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = html.encode("utf-8", "surrogatepass")
                records.append(record(page_id, url, payload, digest, refers))
                size += len(records[-1])
                if size >= archive_bytes:
                    yield close()
                    records, size, number = [], 0, number + 1
        if records:
            yield close()

    return written(map_batches(with_revisits(pages, id_col, url_col, html_col, min_revisit), run,
                               "path string, records long, bytes long"), "archives")


def read_archives(archives: DataFrame, id_type: str = "bigint", payloads: bool = False) -> DataFrame:
    """Per record of the archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    ``payloads`` adds the payload of responses.
    """
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payloads
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                for raw in records_of(store.read_file(path)):
                    found = parse(raw)
                    rows.append([found[name] for name in names])
                    if len(rows) == 500:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    def _batch(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)], names=names)

    schema = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string"
    # a number of partitions, as a table of paths is so small that adaptive execution would leave it to one task
    spread = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    read = map_batches(archives.select("path").repartition(spread, "path"), run, schema + ", payload binary" * payloads)
    return read.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})
