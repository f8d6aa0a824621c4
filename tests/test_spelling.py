import math
import random
import re

import pytest
from pyspark.sql import functions as F

from placebook.operators.search import WEIGHTS, build_index
from placebook.operators.spelling import MOST_EDITS, SHORT, build_spelling, forms_of, load_spelling, misspelled_search, near_pieces, pieces_of, search_with_spelling
from placebook.session import new_folder


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (x != y))
    return row[-1]


def pieces(text):
    words = re.findall(r"[^\W_]+", text)
    runs = {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}
    return {piece for piece in runs if 2 <= len(piece) <= SHORT + MOST_EDITS}


def brute_force(queries, records, k=5):
    found = []
    for qid, typed in queries:
        q = " ".join(re.findall(r"[^\W_]+", (typed or "").lower()))
        if len((typed or "").strip()) < 3 or not 3 <= len(q) <= SHORT:
            continue
        most, scored = (1 if len(q) < 6 else 2), []
        for id_, *fields in records:
            nearest = [min((edits(p, q) for p in pieces(text.lower())), default=9) if text and len(text) >= 3 else 9 for text in fields]
            misses = [(n / len(q), weight) for n, weight in zip(nearest, WEIGHTS.values()) if n <= most]
            if misses:
                scored.append((round(math.exp(sum(weight * math.log(max(miss, 0.001)) for miss, weight in misses)), 6), id_))
        found += [(qid, rank, id_, score) for rank, (score, id_) in enumerate(sorted(scored)[:k], 1)]
    return sorted(found)


def tables(spark, seed):
    pick = random.Random(seed)
    words = ["nantes", "paris", "rue", "gare", "la", "le havre", "st", "port", "porte", "mare", "lyon", "42", "x", "place-royale"]
    phrase = lambda least, most: " ".join(pick.choice(words) for _ in range(pick.randrange(least, most)))
    records = [(i * 7 % 401, phrase(0, 4) or None, phrase(1, 4)) for i in range(250)] + [(900, "", "ab"), (901, "nantes", "nantes")]

    def typo(text):
        for _ in range(pick.randrange(3)):
            at = pick.randrange(len(text) + 1)
            text = pick.choice([text[:at] + text[at + 1 :], text[:at] + "z" + text[at:], text[:at] + "y" + text[at + 1 :]])
        return text

    queries = [(i, typo(phrase(1, 3))) for i in range(60)]
    queries += [(100, "natnes"), (101, "natnes"), (102, None), (103, ""), (104, "--- "), (105, "a b"), (106, "nantes " * 9), (107, "NANTE S"), (108, "lharve")]
    return queries, records, spark.createDataFrame(queries, "qid long, text string"), spark.createDataFrame(records, "id long, nom string, adresse string").repartition(3)


@pytest.mark.parametrize("seed, limit", [(1, 500_000), (2, 0)])
def test_equals_brute_force(spark, seed, limit):
    queries, records, queries_df, records_df = tables(spark, seed)
    spelling = build_spelling(build_index(records_df))
    got = sorted(tuple(row) for row in misspelled_search(queries_df, spelling, limit=limit).collect())
    assert got == brute_force(queries, records)
    assert {row[0] for row in got} >= {100, 101, 107}
    saved = spelling.save(new_folder(spark, "spelling"))
    assert sorted(tuple(row) for row in misspelled_search(queries_df, saved, limit=limit, k=3).collect()) == brute_force(queries, records, 3)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id long, nom string, adresse string")
    queries = spark.createDataFrame([(1, "natnes")], "qid long, text string")
    spelling = build_spelling(build_index(none))
    assert misspelled_search(queries, spelling).collect() == []
    assert misspelled_search(queries.limit(0), spelling).collect() == []
    with pytest.raises(ValueError, match="too few"):
        misspelled_search(queries, spelling, k=9)


def test_texts_within_reach_share_a_form(spark):
    pick = random.Random(5)
    rows = []
    for _ in range(400):
        text = "".join(pick.choice("abc é") for _ in range(pick.randrange(4, 13)))
        other = text
        for _ in range(MOST_EDITS):
            at = pick.randrange(len(other) + 1)
            other = pick.choice([other[:at] + other[at + 1 :], other[:at] + "z" + other[at:], other[:at] + "b" + other[at + 1 :]])
        rows.append((text, other))
    pairs = spark.createDataFrame([row for row in rows if len(row[1]) >= 4], "a string, b string")
    assert pairs.where(~F.arrays_overlap(forms_of("a"), forms_of("b"))).collect() == []


def test_pieces_and_forms(spark):
    row = spark.sql("select 'place-royale de st x' as t, 'abcd' as f, 'ab' as g").select(pieces_of("t").alias("p"), forms_of("f").alias("f"), forms_of("g").alias("g")).first()
    assert set(row.p) == pieces("place-royale de st x") and len(row.p) == len(set(row.p))
    assert set(row.f) == {"abcd", "bcd", "acd", "abd", "abc", "ab", "ac", "ad", "bc", "bd", "cd"} and set(row.g) == {"ab", "a", "b"}


def test_a_saved_index_is_asked_for_the_forms_only(spark, plan_of):
    _, _, _, records_df = tables(spark, 3)
    saved = build_spelling(build_index(records_df)).save(new_folder(spark, "spelling"))
    assert load_spelling(spark, str(saved.forms.inputFiles()[0]).rsplit("/", 2)[0]).depth == saved.depth
    near = near_pieces(spark.createDataFrame([("natnes",)], "q string"), saved)
    assert [tuple(row) for row in near.collect()] == [("natnes", "nantes", 2)]


def test_both_searches(spark):
    queries, records, _, records_df = tables(spark, 4)
    index = build_index(records_df)
    typed = spark.createDataFrame([(1, "natnes"), (2, "nantes"), (3, "qqqqqq"), (4, None)], "qid long, text string")
    got = search_with_spelling(typed, index, build_spelling(index)).collect()
    assert {row.qid for row in got} == {1, 2}
    expected = brute_force([(1, "natnes")], records)
    assert sorted(tuple(row) for row in got if row.qid == 1) == expected
