import math
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from placebook.operators import search
from placebook.operators.search import (
    THRESHOLD,
    WEIGHTS,
    build_index,
    first_ids,
    find_hits,
    fuzzy_search,
    least_overlap,
    load_index,
    match_texts,
    rare_grams,
    wanted_postings,
)
from placebook.plans.picker import search_table, searchable_records, write_best
from placebook.session import materialize, new_folder


def plain(text):
    return "".join(c for c in unicodedata.normalize("NFD", text or "") if not unicodedata.combining(c)).lower().strip()


def grams(text):
    return {text[i : i + 3] for i in range(len(text) - 2)}


def late_by(wanted, text, q, reach):
    """Trigrams within reach, and the shift that most of them have, by hand."""
    near = [g for g in wanted if g in text and text.index(g) - q.index(g) <= reach]
    shifts = [text.index(g) - q.index(g) for g in near]
    return len(near), max(0, min(shifts, key=lambda s: (-shifts.count(s), s), default=0))


def brute_force(queries, records, k=5, threshold=THRESHOLD, weights=WEIGHTS, distance=None):
    found = []
    for qid, typed in queries:
        wanted = grams(plain(typed))
        if len((typed or "").strip()) < 3 or not wanted:
            continue
        scored = []
        for id_, *fields in records:
            if distance is None:
                misses = [(1 - len(wanted & grams(plain(text))) / len(wanted), weight) for text, weight in zip(fields, weights.values())]
            else:
                found_at = [late_by(wanted, plain(text), plain(typed), int(threshold * distance)) for text in fields]
                misses = [(1 - n / len(wanted) + late / distance if n else 1, weight) for (n, late), weight in zip(found_at, weights.values())]
            matching = [(miss, weight) for miss, weight in misses if miss <= threshold and miss < 1]
            if matching:
                scored.append((round(math.exp(sum(weight * math.log(max(miss, 0.001)) for miss, weight in matching)), 6), id_))
        found += [(qid, rank, id_, score) for rank, (score, id_) in enumerate(sorted(scored)[:k], 1)]
    return sorted(found)


def tables(spark, seed, n_records=300, n_queries=60, words=8):
    pick = random.Random(seed)
    vocabulary = ["mairie", "école", "paris", "nantes", "rue", "café", "gare", "é", "saint-jean", "de", "la", "forêt"][: words + 2]

    def phrase(least, most):
        return " ".join(pick.choice(vocabulary) for _ in range(pick.randrange(least, most)))

    records = [(i * 3 % 1009, phrase(0, 4) or None, phrase(1, 4)) for i in range(n_records)]
    # A third of the records have one name, and a third of those one address too.
    records = [(i, "mairie de paris" if i % 3 == 0 else name, "rue de paris" if i % 9 == 0 else address) for i, name, address in records]

    def typo(text):
        at = pick.randrange(len(text) + 1)
        return pick.choice([text, text[:at] + text[at + 1 :], text[:at] + pick.choice("xyz") + text[at:], text.upper(), f"  {text}"])

    queries = [(i, typo(phrase(1, 4))) for i in range(n_queries)] + [(n_queries + i, typo("mairie de paris")) for i in range(n_queries // 2)]
    queries += [(900, "é"), (901, None), (902, "^^a"), (903, "paris"), (904, "de "), (905, "rue")]
    return (
        queries, records,
        spark.createDataFrame(queries, "qid long, text string"),
        spark.createDataFrame(records, "id long, nom string, adresse string").repartition(3),
    )


@pytest.mark.parametrize("seed,limit,distance", [(11, 500_000, 100.0), (12, 0, 30.0)])
def test_places_equal_brute_force(spark, monkeypatch, seed, limit, distance):
    monkeypatch.setattr(search, "COSTLY_FROM", 20)
    queries, records, queries_df, records_df = tables(spark, seed, n_records=250, n_queries=40)
    records += [(2000 + i, "rue de la gare " * (i % 4) + "mairie de paris" + " école" * (i % 3), "paris") for i in range(12)]
    records_df = spark.createDataFrame(records, "id long, nom string, adresse string")
    expected = brute_force(queries, records, distance=distance)
    assert expected != brute_force(queries, records)
    got = sorted(tuple(row) for row in fuzzy_search(queries_df, records_df, limit=limit, distance=distance).collect())
    assert got == expected
    saved = build_index(records_df).save(new_folder(spark, "index"))
    assert sorted(tuple(row) for row in fuzzy_search(queries_df, saved, limit=limit, distance=distance).collect()) == expected
    few = [query for query in queries if query[0] < 2]
    few_df = spark.createDataFrame(few, "qid long, text string")
    assert sorted(tuple(row) for row in fuzzy_search(few_df, saved, limit=limit, distance=distance).collect()) == brute_force(few, records, distance=distance)


def test_a_scan_reads_trigrams_near_the_start_only(spark, plan_of):
    records = spark.createDataFrame([(1, "abcdef", "x"), (2, "z" * 60 + "abcdef", "x")], "id long, nom string, adresse string")
    saved = build_index(records).save(new_folder(spark, "index"))
    rare = rare_grams(spark.createDataFrame([("abcdef",)], "q string"), saved.grams, THRESHOLD)
    assert "LessThanOrEqual(pos" in plan_of(wanted_postings(rare, saved, 35))
    queries = spark.createDataFrame([(1, "abcdef")], "qid long, text string")
    assert [row.id for row in fuzzy_search(queries, saved, distance=100.0).collect()] == [1]
    assert [row.id for row in fuzzy_search(queries, saved).collect()] == [1, 2]


@pytest.mark.parametrize("seed,limit,rounds", [(1, 500_000, ()), (2, 500_000, (0.1, 0.2)), (3, 0, ()), (4, 0, (0.0, 0.15, 0.3, 0.5))])
def test_equals_brute_force(spark, monkeypatch, seed, limit, rounds):
    monkeypatch.setattr(search, "COSTLY_FROM", 20 if rounds else 1_000_000)
    queries, records, queries_df, records_df = tables(spark, seed)
    got = sorted(tuple(row) for row in fuzzy_search(queries_df, records_df, limit=limit, rounds=rounds).collect())
    assert got == brute_force(queries, records)


@pytest.mark.parametrize("rounds", [(), (0.1, 0.2)])
def test_names_that_nearly_agree(spark, monkeypatch, rounds):
    """A third of names and queries differ in their last letters only."""
    monkeypatch.setattr(search, "COSTLY_FROM", 0)
    pick = random.Random(10)
    names = [f"societe civile immobiliere {pick.choice(['du', 'pont', 'val', 'bel'])}{i % 40}" for i in range(120)]
    records = [(i, name, f"{i % 7} place du {pick.choice(['pont', 'bel air'])}") for i, name in enumerate(names)]
    queries = [(i, name.replace("v", pick.choice("vw"))) for i, name in enumerate(names[:40])] + [(90, "place du pont")]
    got = fuzzy_search(
        spark.createDataFrame(queries, "qid long, text string"), spark.createDataFrame(records, "id long, nom string, adresse string"), rounds=rounds
    )
    assert sorted(tuple(row) for row in got.collect()) == brute_force(queries, records)


def test_other_limits(spark):
    queries, records, queries_df, records_df = tables(spark, 5, 150, 30)
    weights = {"nom": 0.4, "adresse": 0.6}
    got = sorted(tuple(row) for row in fuzzy_search(queries_df, records_df, k=2, threshold=0.6, weights=weights).collect())
    assert got == brute_force(queries, records, 2, 0.6, weights)


def test_saved_index(spark):
    queries, records, queries_df, records_df = tables(spark, 6, 150, 30)
    folder = new_folder(spark, "test-index")
    build_index(records_df, depth=4).save(folder)
    got = sorted(tuple(row) for row in fuzzy_search(queries_df, load_index(spark, folder), k=3).collect())
    assert got == brute_force(queries, records, 3)
    with pytest.raises(ValueError, match="keeps 4 ids"):
        fuzzy_search(queries_df, load_index(spark, folder), k=5)


def test_no_records_and_no_queries(spark):
    _, _, queries_df, records_df = tables(spark, 7, 20, 5)
    assert fuzzy_search(queries_df.limit(0), records_df).count() == 0
    assert fuzzy_search(queries_df, records_df.limit(0)).count() == 0


@pytest.mark.parametrize("miss", [0.0, 0.1, 0.2, THRESHOLD, 0.6, 1.0])
def test_need_is_the_least_overlap_that_matches(spark, miss):
    got = spark.range(1, 400).select("id", least_overlap(F.col("id"), miss)).collect()
    assert [(n, need) for n, need in got if need != min(c for c in range(1, n + 1) if 1 - c / n <= miss)] == []


def test_few_trigrams_are_joined_and_each_hit_comes_once(spark):
    _, _, queries_df, records_df = tables(spark, 8)
    index = build_index(records_df)
    typed = queries_df.selectExpr("qid", "lower(text) as q").where("length(q) >= 3")
    rare = rare_grams(typed, index.grams, THRESHOLD)
    for row in rare.collect():
        assert row["place"] <= len(row["grams"]) - row["need"] and row["grams"][row["place"]] == row["gram"]
    hits = [(row["q"], row["field"], row["text"]) for row in match_texts(rare, index, True).collect()]
    assert len(hits) == len(set(hits)) > 0


def test_rounds_check_fewer_texts(spark, monkeypatch):
    """A text with enough good hits takes no part in later rounds, and no hit is found twice."""
    monkeypatch.setattr(search, "COSTLY_FROM", 0)
    records = spark.range(400).selectExpr("id", "concat('societe civile immobiliere ', substr(md5(string(id % 50)), 1, 6)) as nom", "'3 rue haute' as adresse")
    typed = records.select("id", F.col("nom").alias("q")).limit(30)
    index = build_index(records)
    rare = materialize(rare_grams(typed, index.grams, THRESHOLD), "test-rare")
    once = find_hits(rare, index, 5, search.Rule(THRESHOLD), True, 1000, ()).select("q", "field", "text").collect()
    rounds = find_hits(rare, index, 5, search.Rule(THRESHOLD), True, 1000, (0.0, 0.1)).select("q", "field", "text").collect()
    assert len(set(rounds)) == len(rounds) <= len(once)
    assert set(rounds) <= set(once)


def test_small_batches_leave_the_texts_in_place(spark, plan_of):
    _, _, queries_df, records_df = tables(spark, 9)
    index = build_index(records_df)
    rare = rare_grams(queries_df.selectExpr("lower(text) as q").where("length(q) >= 3"), index.grams, THRESHOLD)
    plan = plan_of(match_texts(rare, index, True))
    join = plan.split("BroadcastHashJoin")[0]
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in join


def test_choice_is_written(spark):
    table = spark.createDataFrame([(1, "École du Port", "3 rue Haute", "111"), (2, "Mairie", "4 place", "222")], "id long, Nom string, Adresse string, SIRET string")
    rows = spark.createDataFrame([(10, "ecole du prt"), (11, "zzzz")], "qid long, text string")
    found = search_table(rows, table, k=1)
    target = rows.selectExpr("qid as id", "'old' as SIRET", "'old' as RaisonSociale", "'old' as Place")
    got = write_best(target, found, {"AdresseNormalisee": "Place"}).orderBy("id").collect()
    assert [tuple(row) for row in got] == [(10, "111", "École du Port", "3 rue Haute"), (11, "old", "old", "old")]


def test_many_results_and_many_ids(spark):
    """More than the rows that Spark's own limit within groups covers."""
    records = spark.range(2500).selectExpr("id", "'mairie' as nom", "concat('rue ', id % 3) as adresse")
    ids = first_ids(records, ["nom"], 1500).first().ids
    assert ids == list(range(1500))
    queries = spark.createDataFrame([(1, "mairie")], "qid long, text string")
    got = fuzzy_search(queries, records, k=400).orderBy("rank").collect()
    assert [row.id for row in got] == list(range(400)) and [row.rank for row in got] == list(range(1, 401))


def test_repeated_rows_searched_for_keep_one_choice(spark):
    table = spark.createDataFrame([(1, "mairie", "", "111"), (2, "ecole", "", "222")], "id long, Nom string, Adresse string, SIRET string")
    rows = spark.createDataFrame([(10, "ecole"), (10, "mairies")], "qid long, text string")
    target = spark.createDataFrame([(10, "", "", "")], "id long, SIRET string, RaisonSociale string, AdresseNormalisee string")
    assert [row.SIRET for row in write_best(target, search_table(rows, table, k=1)).collect()] == ["222"]


def test_a_table_is_searched_through_a_saved_index(spark):
    table = spark.createDataFrame([(1, "mairie", "", "111"), (2, "ecole", "", "222")], "id long, Nom string, Adresse string, SIRET string")
    folder = new_folder(spark, "test-index")
    index = build_index(searchable_records(table), depth=2).save(folder)
    rows = spark.createDataFrame([(10, "ecole")], "qid long, text string")
    assert [row.result.siret for row in search_table(rows, table, k=1, index=index).collect()] == ["222"]


def test_a_saved_index_is_read_where_the_texts_trigrams_are(spark, monkeypatch, plan_of):
    """Of 256 files only those that hold one of a dozen trigrams are read."""
    monkeypatch.setattr(search, "POSTING_PARTS", 64)
    pick = random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(i, "".join(pick.choice(letters) for _ in range(12)), f"{i} rue") for i in range(3000)]
    folder = new_folder(spark, "test-postings")
    index = build_index(spark.createDataFrame(rows, "id long, nom string, adresse string")).save(folder)
    typed = spark.createDataFrame([(i, rows[i * 7][1]) for i in range(3)], "qid long, text string")
    rare = materialize(rare_grams(typed.selectExpr("qid", "text as q"), index.grams, THRESHOLD), "test-rare")
    read = wanted_postings(rare, index)
    plan = plan_of(read)
    assert "EqualTo(field,nom)" in plan and "EqualTo(gram," in plan
    assert read.count() > 0
    read.collect()
    leaves = read._jdf.queryExecution().executedPlan().collectLeaves()
    scanned = sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))
    assert 0 < scanned < index.postings.count() / 10
    got = {(row.qid, row.id) for row in fuzzy_search(typed, index).where("rank = 1").collect()}
    assert got == {(i, i * 7) for i in range(3)}
