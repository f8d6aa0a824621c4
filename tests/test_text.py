import random
import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from placebook.functions import text as t


def values(spark, texts, *expressions):
    df = spark.createDataFrame([(i, text) for i, text in enumerate(texts)], "i int, t string")
    return [tuple(row)[1:] for row in df.select("i", *[e.alias(f"e{n}") for n, e in enumerate(expressions)]).orderBy("i").collect()]


def random_texts(seed, n=400):
    pick = random.Random(seed)
    alphabet = "abcXYZ 019-'\t\n éèêëàâçÉÀœŒæßøłđñüöÎ́̈  ^`´¨ĲǅΆ한"
    return ["".join(pick.choice(alphabet) for _ in range(pick.randrange(0, 30))) for _ in range(n)]


def test_index_form(spark):
    cases = {
        None: "",
        "": "",
        "  Café   de\tla Gare \n": "cafe de la gare",
        "Œuvre d’Ænid – Straße «Łódź»": "oeuvre d'aenid - strasse <<lodz>>",
        "L^A `B`": "l^a `b`",
        "Þórr Ðaði": "thorr dadi",
        "a\x1cb\x85c": "a b c",
        "été": "ete",
        "東京 Tōkyō": "東京 tokyo",
        "Щукин, ЁЖ объект Їжак": "shchukin, iozh ob'ekt yizhak",
        "Αθήνα Ψυχή Ξένος ΩΣ": "athena psukhe xenos os",
    }
    got = values(spark, list(cases), t.normalize_index("t"))
    assert [g[0] for g in got] == list(cases.values())


def test_units_are_spelled_longest_first_and_once(spark):
    units = {"ab": "x", "abc": "y", "b": "ab", "é": "", "]": "[", "^": "é"}
    cases = {None: None, "": "", "abcab": "yx", "bab": "abx", "cabbé\n]": "cxab\n[", "ccc": "ccc", "^é": "é", "a" * 3000 + "b": "a" * 2999 + "x"}
    got = values(spark, list(cases), t.spell_units(F.col("t"), units))
    assert [g[0] for g in got] == list(cases.values())


def test_units_and_the_stretches_between_them(spark):
    """Characters at the borders of what is searched by itself, against one character after the other."""
    units = {"é": "e", "ß": "ss", "Ж": "Zh", "ж": "zh", "…": "...", "ﬁ": "fi", "😀": ":)"}
    pick, alphabet = random.Random(5), "".join(units) + "".join(chr(ord(char) + step) for char in units for step in (-1, 1)) + "a\n \x7f東\U0010ffff"
    texts = ["".join(pick.choice(alphabet) * pick.choice((1, 1, 3)) for _ in range(pick.randrange(40))) for _ in range(300)]
    got = values(spark, texts, t.spell_units(F.col("t"), units))
    assert [g[0] for g in got] == ["".join(units.get(char, char) for char in text) for text in texts]


def seconds(df):
    """The least of three runs over all rows."""
    taken = []
    for _ in range(3):
        start = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        taken.append(time.perf_counter() - start)
    return min(taken)


def test_index_form_costs_little_more_than_a_plain_replacement(spark):
    """A character's cost does not grow with the number of letters that have a spelling."""
    words = spark.range(400).select(F.repeat(F.lit("l’œuvre était près de la grande maison de Nantes, "), 100).alias("t")).cache()
    words.count()
    assert seconds(words.select(t.normalize_index("t"))) < 8 * seconds(words.select(F.regexp_replace("t", r"(?U)[\s\p{M}]{2}", " ")))


def test_search_text_of_short_rows_costs_little_more_than_a_plain_replacement(spark):
    rows = spark.range(100000).select(F.concat(F.lit("Société "), "id").alias("a"), F.lit("Allée des Œillets").alias("b"), F.lit("Forêt-NATION").alias("c")).cache()
    rows.count()
    plain = F.regexp_replace(F.concat_ws(" ", "a", "b", "c"), r"(?U)[\s\p{M}]{2}", " ")
    assert seconds(rows.select(t.search_text("a", "b", "c"))) < 10 * seconds(rows.select(plain))


def test_query_form(spark):
    cases = {
        None: "",
        "  Crème  Brûlée ": "creme  brulee",
        "Œuvre ^ `x` ¨": "œuvre  x",
        "﻿ Ça ": "ca",
        "ÉCOLE\tÀ": "ecole\ta",
    }
    got = values(spark, list(cases), t.normalize_query("t"))
    assert [g[0] for g in got] == list(cases.values())


def test_query_form_against_unicode_tables(spark):
    def expected(text):
        kept = (c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c)[0] != "M" and c not in "^`¨¯´·¸")
        return "".join(kept).lower().strip(t.BROWSER_SPACE)

    texts = [text.replace("한", "") for text in random_texts(1)]
    assert [g[0] for g in values(spark, texts, t.normalize_query("t"))] == [expected(text) for text in texts]


@pytest.mark.parametrize("normal", [t.normalize_index, t.normalize_query])
def test_normalising_twice_changes_nothing(spark, normal):
    once = normal("t")
    assert all(a == b for a, b in values(spark, random_texts(2), once, normal(once)))


def test_white_space_is_that_of_python(spark):
    texts = [f"a{chr(i)}b" for i in range(0x3001) if not 0xD800 <= i < 0xE000]
    split = [" ".join(text.split()) == "a b" for text in texts]
    collapsed = [g[0] == "a b" for g in values(spark, texts, F.regexp_replace("t", t.RUN_OF_SPACE, " "))]
    assert collapsed == split
    blanks = [chr(i).isspace() for i in range(1, 0x3001) if not 0xD800 <= i < 0xE000]
    assert [g[0] for g in values(spark, [chr(i) for i in range(1, 0x3001) if not 0xD800 <= i < 0xE000], t.is_blank("t"))] == blanks


def test_address_skips_blanks_and_keeps_parts_as_they_are(spark):
    df = spark.createDataFrame(
        [("12", "RUE", "Haute"), (None, "RUE", "Haute"), ("  ", "\t", "Haute"), (" 12 ", "", "Haute"), (None, None, " ")],
        "a string, b string, c string",
    )
    got = [row[0] for row in df.select(t.join_filled("a", "b", "c")).collect()]
    assert got == ["12 RUE Haute", "RUE Haute", "Haute", " 12  Haute", ""]


def test_name_takes_empty_for_missing_but_not_blank(spark):
    df = spark.createDataFrame([("a", "b"), ("", "b"), (None, "b"), (" ", "b"), ("", None), (None, "")], "a string, b string")
    assert [row[0] for row in df.select(t.first_filled("a", "b")).collect()] == ["a", "b", "b", " ", "", ""]


def test_file_name(spark):
    urls = ["http://h/a/b.parquet", "b.parquet", "http://h/a/b/", "", None, "x/y.z?q=1"]
    assert [g[0] for g in values(spark, urls, t.file_name_from_url("t"))] == ["b.parquet", "b.parquet", "b", "", None, "y.z?q=1"]


def test_short_queries(spark):
    texts = ["abc", " ab ", " abc", "", None, "a b"]
    assert [g[0] for g in values(spark, texts, t.long_enough("t"))] == [True, False, True, False, False, True]


def test_trigrams(spark):
    pick = random.Random(3)
    texts = ["", "ab", "abc", "aaaa", "a😀bcd", "été\nà"] + random_texts(4, 100)
    texts += ["".join(pick.choice("ab c😀é\n") for _ in range(n)) for n in (510, 511, 512, 513, 514, 5000)]
    expected = [list(dict.fromkeys(text[i : i + 3] for i in range(len(text) - 2))) for text in texts]
    assert [g[0] for g in values(spark, texts, t.trigrams("t"))] == expected


def test_latin_letters_and_signs_become_ascii_for_good(spark):
    chars = [chr(i) for i in [*range(0xA0, 0x250), *range(0x1E00, 0x1F00)]]
    df = spark.createDataFrame([(i, f"x{c}y") for i, c in enumerate(chars)], "i int, t string")
    once = df.select("i", t.normalize_index("t").alias("t"))
    twice = once.select("i", t.normalize_index("t").alias("t"))
    got = dict(once.collect())
    assert all(text.isascii() for text in got.values()) and dict(twice.collect()) == got
    signs = spark.createDataFrame([("N° 5 m² 3€ ħ ŧ ı ŋ ẞ №",)], "t string").select(t.normalize_index("t")).first()[0]
    assert signs == "ndeg 5 m2 3eur h t i ng ss no"
