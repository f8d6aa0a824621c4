import hashlib
import random

import corpus_pipeline
import public_tokenizers
import tiktoken

from placebook.llm import bpe, quality
from placebook.llm.queries import VOCABULARY
from tests.llm import test_decontam, test_jaccard, test_linededup


def test_all_stages_equal_plain_ones(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [tuple(row) for row in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    good = quality.judge(docs).where("kept").select("doc_id", "text").collect()
    rows = [(doc, text) for doc, _, n_dropped, text in test_linededup.brute_force([tuple(row) for row in good]) if not n_dropped or text.strip(" \t\n\x0b\x0c\r")]
    texts = dict(rows)
    rows = [(doc, texts[doc]) for doc, _, component in test_jaccard.brute_force(rows) if doc == component]
    rows = [(doc, texts[doc]) for doc, _, _, _, contaminated in test_decontam.brute_force(rows, items) if not contaminated]
    assert 50 < len(rows) < len(good) < docs.count()

    with open(public_tokenizers.path(VOCABULARY), "rb") as file:
        peer = tiktoken.Encoding("peer", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(file.read()), special_tokens={})
    got = {row.doc_id: row for row in corpus_pipeline.run(spark, sf_dir).collect()}
    assert sorted(got) == sorted(doc for doc, _ in rows)
    for doc, text in rows:
        ids = peer.encode_ordinary(text)
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        assert (got[doc].n_tokens, bytes(got[doc].ids)) == (len(ids), packed)
        assert got[doc].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_stages_keep_columns_and_bear_odd_tables(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_lines int, kept string, place int, _doc int, _mark int, _row int, `a.b` int"
    good = " ".join(f"word{i}" for i in range(30))
    rows = [(1, good, "en", "s", 1, 7, "a", 1, 5, 6, 7, 8), (1, good, "en", "s", 1, 7, "a", 1, 5, 6, 7, 8), (None, *[None] * 11), (2, good + " more", None, None, None, 7, "b", 2, 5, 6, 7, 8), (3, "", "xx", "s", 0, 7, "c", 3, 5, 6, 7, 8)]
    for table in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        docs = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf_dir)
            assert docs.columns == table.columns
            assert {tuple(row)[5:] for row in docs.collect()} <= {(7, "a", 1, 5, 6, 7, 8), (7, "b", 2, 5, 6, 7, 8)}
        last = corpus_pipeline.encoding(spark, docs, sf_dir)
        assert last.count() == (2 if table.limit(1).count() else 0) and set(r.doc_id for r in last.collect()) <= {1}


def test_no_row_without_words_and_no_copies(spark):
    """Exact copies lose all their lines; near copies, whose lines all differ, are found by their shingles."""
    rng = random.Random(3)
    line = lambda: " ".join(f"w{rng.randrange(500)}" for _ in range(40))
    lines = [[line() for _ in range(5)] for _ in range(30)]
    rows = [(i, "\n".join(text)) for i, text in enumerate(lines)]
    rows += [(100 + i, "\n".join(text)) for i, text in enumerate(lines[:10])]  # exact copies
    rows += [(200 + i, "\n".join(f"{one} x{k}" for k, one in enumerate(text))) for i, text in enumerate(lines[10:20])]  # each line differs
    rows += [(300 + i, "\n".join(text[:4] + [line()])) for i, text in enumerate(lines[20:])]  # four of five lines shared
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.line_dedup(spark, docs, "")
    texts = {row.doc_id: row.text for row in kept.collect()}
    assert set(texts) == {*range(30), *range(200, 210), *range(300, 310)} and all(text.strip() for text in texts.values())
    assert {row.doc_id for row in corpus_pipeline.similar_documents(spark, kept, "").collect()} == {*range(30), *range(300, 310)}


def test_registered(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert names["pipeline"].__wrapped__ is corpus_pipeline.run and "pipeline" not in entry.oracle_sql()
    assert [name.split("_")[0] for name in names if name.startswith("op")] == [f"op{n}" for n in range(1, 14)]
    assert set(entry.oracle_sql()) <= set(names)
