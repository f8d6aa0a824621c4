import re

from placebook.llm import decontam

ITEMS = [(10, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15"), (9, "Short item, é!"), (8, None), (7, "--"), (10, "short ITEM é"), (6, "one")]
LONG = " ".join(f"w{i}" for i in range(1, 16))
DOCS = [
    (1, "A " + LONG.upper().replace(" ", ", ") + " b"),
    (2, LONG[: len(LONG) // 2]),
    (3, "x short item é short item é y " * 2 + "z " * 500),
    (4, None),
    (5, ""),
    (6, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13"),
    (7, "one"),
    (8, "z " * 3000 + "one"),
    (8, "z " * 3000 + "one"),
    (None, "short item é"),
]


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_force(docs, items):
    out = []
    for doc, text in docs:
        words, hit, found = words_of(text), set(), set()
        for item, passage in items:
            wanted = words_of(passage)
            n = min(13, len(wanted))
            windows = {tuple(wanted[i : i + n]) for i in range(len(wanted) - n + 1)} if n else set()
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found.add(str(item))
        out.append((doc or 0, len(words), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(words)))
    return sorted(out)


def frames(spark, docs=DOCS, items=ITEMS):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def results(df):
    return sorted((r.doc_id or 0, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in df.collect())


def test_equals_brute_force(spark):
    got = results(decontam.contamination(*frames(spark)))
    assert got == brute_force(DOCS, ITEMS)


def test_a_set_beyond_the_limits_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(decontam, "fits_broadcast", lambda df: False)
    assert results(decontam.contamination(*frames(spark))) == brute_force(DOCS, ITEMS)


def test_empty_tables_and_clashing_columns(spark):
    docs, items = frames(spark)
    assert results(decontam.contamination(docs, items.limit(0))) == brute_force(DOCS, [])
    assert decontam.contamination(docs.limit(0), items).count() == 0
    more = docs.selectExpr("*", "1 as n_hit", "2 as place", "'x' as window", "3 as words", "4 as item_id")
    assert results(decontam.contamination(more, items)) == brute_force(DOCS, ITEMS)
    left = decontam.remove_contaminated(more, items)
    assert left.columns == more.columns
    assert sorted(r.doc_id for r in left.collect()) == [2, 3, 4, 5, 8, 8] and {r.n_hit for r in left.collect()} == {1}


def test_spans_are_taken_out(spark):
    docs, items = frames(spark, [(1, "Keep, this! Short  item\té; and this."), (2, "nothing here"), (3, None)])
    got = {r.doc_id: r.text for r in decontam.remove_spans(docs, items).collect()}
    assert got == {1: "Keep, this!   \t; and this.", 2: "nothing here", 3: None}


def test_no_python_runs(spark, plan_of):
    plan = plan_of(decontam.contamination(*frames(spark)))
    assert not re.search("ArrowEvalPython|BatchEvalPython|MapIn|NestedLoop|Cartesian", plan)
