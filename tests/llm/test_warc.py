import io
import random

import pytest
import zstandard
from pyarrow import fs
from pyspark.sql import functions as F

from placebook.llm import warc
from placebook.session import new_folder

SCHEMA = "page_id long, url string, html string"
ROWS = [
    (5, "http://a.example/x", "<p>same</p>"),
    (2, "http://a.example/y\r\nEvil: 1", "<p>same</p>"),
    (9, None, "<p>same</p>"),
    (4, "http://b.example", None),
    (1, "http://b.example", ""),
    (7, "http://é.example/ü", "é\r\n\r\nWARC/1.1\r\n" * 50),
    (None, "u", "<p>same</p>"),
    (None, "u", "alone"),
    (3, "u", "<p>" + "long " * 100_000),
]


def test_round_trip(spark, monkeypatch):
    df = spark.createDataFrame(ROWS, SCHEMA).withColumn("digest", F.lit("clash"))
    folder = new_folder(spark, "test-warc")
    manifest = warc.write_archives(df, folder)
    assert manifest.agg(F.sum("records")).first()[0] == len(ROWS)
    got = {(r.page_id, r.payload_digest): r for r in warc.read_archives(manifest, folder).collect()}
    assert len(got) == len(ROWS)
    smallest = {}
    for page, _, html in ROWS:
        smallest[html or ""] = min(smallest.get(html or "", 1 << 63), warc.LAST_ID if page is None else page)
    for page, url, html in ROWS:
        payload = (html or "").encode()
        r = got[page, warc.digest_of(payload)]
        first = smallest[html or ""]
        response = first == (warc.LAST_ID if page is None else page)
        assert (r.record_type, r.refers_to) == (("response", None) if response else ("revisit", first))
        assert r.payload_bytes == len(payload) and r.payload == (payload if response else None)
        assert r.url == (url and url.replace("\r\n", "%0D%0A"))


def test_small_payloads_may_all_be_written(spark, monkeypatch):
    monkeypatch.setattr(warc, "LEAST_BYTES", 5)
    df = spark.createDataFrame([(1, "u", "abc"), (2, "u", "abc"), (3, "u", "abcdef"), (4, "u", "abcdef")], SCHEMA)
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.archived(df).collect()}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("response", None), 4: ("revisit", 3)}


def test_no_rows(spark):
    assert warc.archived(spark.createDataFrame([], SCHEMA)).count() == 0


def test_each_record_is_a_frame_and_the_dictionary_comes_first():
    rng = random.Random(1)
    words = [f"word{i}" for i in range(500)]
    records = [warc.record(i, f"http://x.example/{i}", " ".join(rng.choices(words, k=120)).encode(), None) for i in range(400)]
    out = io.BytesIO()
    warc.write_archive(out, records)
    data = out.getvalue()
    assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_FRAME
    size = int.from_bytes(data[4:8], "little")
    dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + size]))
    rest, frames = data[8 + size :], []
    while rest:
        one = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
        frames.append(one.decompress(rest))
        rest = one.unused_data
    assert frames == records
    assert [block for _, block in warc.read_archive(io.BytesIO(data))] == [r.partition(b"\r\n\r\n")[2][:-4] for r in records]
    plain = sum(len(zstandard.ZstdCompressor(level=warc.LEVEL).compress(r)) for r in records)
    assert len(data) < 0.8 * plain


@pytest.mark.parametrize("payloads", [[b"x"], [b""], [b"same"] * 3, [b"long " * 1_000_000], [b"\x37\xa4\x30\xec"]])
def test_archives_of_few_records_have_a_dictionary_too(payloads):
    out = io.BytesIO()
    warc.write_archive(out, [warc.record(i, None, payload, None) for i, payload in enumerate(payloads)])
    assert int.from_bytes(out.getvalue()[:4], "little") == warc.DICTIONARY_FRAME
    out.seek(0)
    assert [(fields["page-id"], block.partition(b"\r\n\r\n")[2]) for fields, block in warc.read_archive(out)] == [(str(i), payload) for i, payload in enumerate(payloads)]


def test_samples_come_from_all_over_a_record():
    assert warc.samples_of(b"short") == [b"short"]
    r = bytes(range(256)) * 100
    pieces = warc.samples_of(r)
    assert len(pieces) == warc.PIECES and r.startswith(pieces[0]) and r.endswith(pieces[-1]) and {len(p) for p in pieces} == {warc.PIECE_BYTES}


def test_damage_is_noticed(spark):
    df = spark.createDataFrame([(1, "u", "abc")], SCHEMA)
    folder = new_folder(spark, "test-warc")
    manifest = warc.write_archives(df, folder)
    path = manifest.first().path
    system, _ = fs.FileSystem.from_uri(folder)
    r = warc.record(1, "u", b"abc", None).replace(b"\r\n\r\nabc", b"\r\n\r\nabd")
    with system.open_output_stream(path) as out:
        warc.write_archive(out, [r])
    with pytest.raises(Exception, match="not what its record says"):
        warc.read_archives(manifest, folder).collect()
