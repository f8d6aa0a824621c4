"""WARC archives whose records are compressed one by one with a dictionary that the archive itself carries.

An archive begins with a skippable Zstandard frame that holds the dictionary, itself compressed; each record after it
is a frame of its own, so that any record can be read alone. The dictionary is built from the archive's own records. A
record whose payload another record has too is written as a revisit of that one, without the payload.

Tasks write archives of bounded size under names of their own and list them in a stored manifest; what a lost task
leaves behind is in no manifest. Archives are read as streams. The folder is any that both Spark and pyarrow open.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from placebook.llm.tables import LAST_ID, id_or_last
from placebook.operators.joins import shuffle_partitions, skew_join
from placebook.session import materialize, new_folder

# Payloads of so many bytes and more are written once; smaller ones each time.
LEAST_BYTES = 0
# Bytes of records, before compression, in an archive; a larger record has an archive of its own.
ARCHIVE_BYTES = 8 << 20
# Bytes of a dictionary; pieces of each record that it is built from, all over the record, and their bytes.
DICTIONARY_BYTES = 32 << 10
PIECES = 4
PIECE_BYTES = 1 << 10
LEVEL = 6
DATE = "1970-01-01T00:00:00Z"

# Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORDS = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """A response record, or a revisit of the response of `refers_to`, which keeps the response's header only."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block += payload if refers_to is None else b""
    target = None if url is None else re.sub(r"[\x00-\x1f\x7f]", lambda c: f"%{ord(c[0]):02X}", url)
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", date)]
    fields += [("WARC-Target-URI", target), ("Content-Type", "application/http; msgtype=response")]
    fields += [("WARC-Payload-Digest", f"sha1:{digest_of(payload)}"), ("Page-ID", page_id)]
    if refers_to is not None:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to)), ("Refers-To-Page-ID", refers_to)]
    fields += [("Content-Length", len(block))]
    head = "".join(f"{name}: {value}\r\n" for name, value in fields if value is not None)
    return f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def samples_of(r: bytes) -> list[bytes]:
    """A short record whole, of a longer one pieces from its start to its end, equally far apart."""
    if len(r) <= PIECES * PIECE_BYTES:
        return [r]
    last = len(r) - PIECE_BYTES
    return [r[i * last // (PIECES - 1) :][:PIECE_BYTES] for i in range(PIECES)]


def build_dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary trained on pieces of the records; of records too few or too alike for that the pieces themselves."""
    samples = [piece for r in records for piece in samples_of(r)]
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, samples)) // 8), samples, k=256, d=8, level=LEVEL)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[:DICTIONARY_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def write_archive(out, records: list[bytes]) -> None:
    dictionary = build_dictionary(records)
    packed = zstandard.ZstdCompressor(level=19).compress(dictionary.as_bytes())
    out.write(DICTIONARY_FRAME.to_bytes(4, "little") + len(packed).to_bytes(4, "little") + packed)
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True)
    for r in records:
        out.write(compressor.compress(r))


def read_archive(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """The fields (names in lower case) and the block of each record, one after the other."""
    start, dictionary = source.read(8), None
    if start[:4] == DICTIONARY_FRAME.to_bytes(4, "little"):
        packed = source.read(int.from_bytes(start[4:], "little"))
        plain = zstandard.ZstdDecompressor().decompress(packed) if packed[:4] == zstandard.FRAME_HEADER else packed
        dictionary, start = zstandard.ZstdCompressionDict(plain), b""
    reader = zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(_After(start, source), read_across_frames=True)
    stream = io.BufferedReader(reader, 1 << 20)
    while line := stream.readline():
        if line.strip() != b"WARC/1.1":
            raise ValueError(f"no record begins with {line[:40]!r}")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(":")
            fields[name.lower()] = value.strip()
        block = stream.read(int(fields["content-length"]))
        if stream.read(4) != b"\r\n\r\n" or len(block) != int(fields["content-length"]):
            raise ValueError(f"record {fields.get('warc-record-id')} is cut short")
        yield fields, block


class _After(io.RawIOBase):
    """A stream that begins with bytes already read."""

    def __init__(self, start: bytes, rest):
        self.start, self.rest = start, rest

    def readable(self) -> bool:
        return True

    def read(self, size: int = -1) -> bytes:
        if self.start:
            out, self.start = self.start, b""
            return out
        return self.rest.read(size)


def _parsed(fields: dict[str, str], block: bytes) -> tuple:
    head, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"(?im)^content-length:\s*(\d+)", head)[1])
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    revisit = fields["warc-type"] == "revisit"
    if not revisit and (len(payload) != length or digest_of(payload) != digest):
        raise ValueError(f"the payload of {fields['warc-record-id']} is not what its record says")
    number = lambda name: int(fields[name]) if name in fields else None
    return number("page-id"), fields.get("warc-target-uri"), fields["warc-type"], None if revisit else payload, length, digest, number("refers-to-page-id")


def write_archives(pages: DataFrame, folder: str, date: str = DATE) -> DataFrame:
    """Archives with a record for each row of `pages` (page_id, url, html); returns the stored manifest (path, records).

    The payload is the html in UTF-8; null is empty. Of rows with equal payloads of LEAST_BYTES or more, that with the
    smallest page_id is the response and the others are revisits of it; a missing id comes last. Rows that repeat both
    id and payload of a response are responses too. Line ends and other control characters in a url are escaped.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    named = pages.select("page_id", "url", "html", id_or_last("page_id").alias("page"), F.unhex(F.sha1(payload)).alias("digest"), F.octet_length(payload).alias("bytes"))
    firsts = named.where(F.col("bytes") >= LEAST_BYTES).groupBy("digest", "bytes").agg(F.min("page").alias("first"), F.count("*").alias("n"))
    firsts = materialize(firsts.where("n > 1").drop("n"), "first-pages")
    marked = skew_join(named, firsts, ["digest", "bytes"], "left")
    marked = marked.select("page_id", "url", "html", F.when(F.col("page") != F.col("first"), F.col("first")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = fs.FileSystem.from_uri(folder)
        system.create_dir(place, recursive=True)

        def flush(records: list[bytes]) -> pa.RecordBatch:
            path = f"{place}/{uuid.uuid4().hex}.warc.zst"
            with system.open_output_stream(path) as out:
                write_archive(out, records)
            return pa.RecordBatch.from_pydict({"path": [path], "records": [len(records)]})

        records, size = [], 0
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch[name] for name in ("page_id", "url", "html", "refers_to"))):
                records.append(record(page_id.as_py(), url.as_py(), (html.as_py() or "").encode(), refers_to.as_py(), date))
                size += len(records[-1])
                if size >= ARCHIVE_BYTES:
                    yield flush(records)
                    records, size = [], 0
        if records:
            yield flush(records)

    return materialize(marked.mapInArrow(write, "path string, records long"), "manifest")


def read_archives(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of all archives of a manifest (RECORDS); a revisit has no payload. Payloads are compared with their
    digests on the way; without `payloads` they are left out after that.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch["path"].to_pylist():
                rows, size = [], 0
                with system.open_input_stream(path) as source:
                    for fields, block in read_archive(source):
                        row = _parsed(fields, block)
                        rows.append(row if payloads else (*row[:3], None, *row[4:]))
                        size += len(block) if payloads else 0
                        if size >= ARCHIVE_BYTES or len(rows) >= 10_000:
                            yield _batch(rows)
                            rows, size = [], 0
                yield _batch(rows)

    return manifest.repartition(shuffle_partitions(manifest), "path").mapInArrow(read, RECORDS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    columns = [column.split() for column in RECORDS.split(", ")]
    arrays = [pa.array([row[i] for row in rows], kinds[kind]) for i, (_, kind) in enumerate(columns)]
    return pa.RecordBatch.from_arrays(arrays, [name for name, _ in columns])


def archived(pages: DataFrame) -> DataFrame:
    """Writes `pages` to archives in the shared folder and reads back what they hold, without the payloads."""
    folder = new_folder(pages.sparkSession, "warc")
    records = read_archives(write_archives(pages, folder), folder, payloads=False)
    return records.withColumn("refers_to", F.when(F.col("refers_to") != LAST_ID, F.col("refers_to")))


ORACLE = """
with payloads as (
  select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, coalesce(html, '') as payload, unhex(sha1(coalesce(html, '')))::bit::varchar as bits
  from pages
), firsts as (
  select payload, min(page_id) as first from payloads group by payload
)
select page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + list_sum(list_transform(range(0, 5), lambda b: case when substr(bits, 5 * k + b + 1, 1) = '1' then 16 >> b else 0 end))::bigint, 1)), '') as payload_digest,
       case when page_id = first then 'response' else 'revisit' end as record_type,
       case when page_id <> first then first end as refers_to
from payloads join firsts using (payload)
"""
