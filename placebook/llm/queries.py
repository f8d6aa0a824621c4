"""The queries of this package, one for each operator, over whole tables."""

from __future__ import annotations

import zlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from placebook.llm import bpe, decontam, html, jaccard, langid, licenses, linededup, periods, pii, quality, toxicity, vectorcodes, warc
from placebook.llm.tables import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.toxicity(documents, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op2_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_byte_pair_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = bpe.round_trip(documents, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return done.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


# Not a secret: real jobs pass their own.
PSEUDONYM_KEY = "key of the checks"


def op5_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PSEUDONYM_KEY)
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("pseudonyms", lambda p: p["kind"]))), ",").alias("kinds")
    return done.select("doc_id", F.size("pseudonyms").cast("long").alias("n_replaced"), kinds, "text")


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontam.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return judged.select("doc_id", "n_words", "n_hit", "n_items", items, "contaminated")


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_groups(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archived(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("licenses", lambda m: m["license"]))), ",")
    share = F.coalesce(F.array_max(F.transform("licenses", lambda m: m["share"])), F.lit(0.0))
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_matches"), share.alias("largest_share"), names.alias("licenses"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, codebooks = vectorcodes.compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    done = vectorcodes.with_label_errors(coded)
    return done.select("vec_id", "code", "error", "label_error", F.lit(vectorcodes.digest(codebooks)).alias("codebooks_sha256"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = langid.languages(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return done.select("doc_id", "held_out", "lang_pred", "score")


def _with_planted_runs(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of one row in ten repeat from some place on, as a number of their id says; those without an id never."""
    number = zlib.crc32(str(doc_id).encode())
    if doc_id is None or number % 10 or not words:
        return words
    drawn, n = number // 10, len(words)
    start = drawn % n
    period = 1 + (n - start) // (3 + drawn % 8)
    return words[:start] + [words[start + i % period] for i in range(n - start)]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.periodic_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), _with_planted_runs)
    ranked = F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("shorter")))
    found = found.withColumn("best", F.array_max(ranked))
    start, length, period = -F.col("best.before"), F.col("best.length"), -F.col("best.shorter")
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        start.alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_distribution_divergence": op2_distribution_divergence,
    "op3_byte_pair_encoding": op3_byte_pair_encoding,
    "op4_line_dedup": op4_line_dedup,
    "op5_pseudonyms": op5_pseudonyms,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_warc": op8_warc,
    "op9_html_extraction": op9_html_extraction,
    "op10_license_scan": op10_license_scan,
    "op11_vector_codes": op11_vector_codes,
    "op12_language_id": op12_language_id,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE = {
    "op2_distribution_divergence": quality.ORACLE,
    "op4_line_dedup": linededup.ORACLE,
    "op6_benchmark_decontamination": decontam.ORACLE,
    "op8_warc": warc.ORACLE,
    "op11_vector_codes": vectorcodes.ORACLE,
}
