import re
from collections import Counter

from hypothesis import given, settings, strategies as st

from placebook.llm import quality

SCHEMA = "doc_id long, text string, lang string"
GOOD = "the cat of the house and a dog went to it in the rain for that is as was on with by this at an end of all"


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)}
    lines = [line for line in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(hit)


def judged(spark, rows, **options):
    return quality.judge(spark.createDataFrame(rows, SCHEMA), **options)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("ab é\n\t|# ")), max_size=120), min_size=25, max_size=25))
def test_base_columns_equal_brute_force(spark, texts):
    texts = [*texts, None, "", " \n", "a b c d e f a b c d e f a b c d", "x " * 3000]
    rows = judged(spark, [(i, text, "en") for i, text in enumerate(texts)], found={}).collect()
    for row in rows:
        expected = base(texts[row.doc_id])
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == expected
        assert row.base_failed == (expected[0] < 10 or 100 * expected[4] > 20 * expected[0]) and row.kept == (not row.base_failed)


def variants(n):
    words = GOOD.split()
    return " ".join(words[(i * 7 + i // 26) % len(words)] + ("" if i % 2 else str(i)) for i in range(n))


def test_odd_distributions_are_rejected_and_short_or_foreign_texts_are_not(spark):
    clean = [(i, variants(200 + i), "en") for i in range(30)]
    odd = [(100, variants(200).upper().replace(" ", "!! "), "en"), (101, variants(200).replace(" ", "%%% "), "en")]
    short = [(102, "ODD!! " + " ".join(f"W{i}!!" for i in range(30)), "en"), (103, variants(200), "xx"), (104, variants(200), None), (105, None, "en")]
    kept = {row.doc_id for row in judged(spark, clean + odd + short).where("kept").collect()}
    assert kept == {row[0] for row in clean} | {102, 103, 104}


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, GOOD, "en", 7, "x")], SCHEMA + ", n_words int, c string")
    got = quality.judge(df)
    assert got.columns[:5] == ["doc_id", "text", "lang", "n_words", "c"] and "_words" not in got.columns
    assert got.first().n_words == len(GOOD.split())
    assert quality.judge(df.limit(0)).count() == 0
    assert got.unionAll(got).count() == 2


def test_no_python_runs(spark, plan_of):
    plan = plan_of(judged(spark, [(1, GOOD, "en")]))
    assert not re.search("Python|Arrow|Pandas|Join|Exchange", plan.split("== Physical Plan ==")[-1].replace("PythonRDD", ""))
