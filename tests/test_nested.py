import json

import pytest

from placebook.sources.nested import columns_to_rows, flatten_companies, pick_resource, unreadable_answers


def test_columns_become_rows(spark):
    df = spark.createDataFrame(
        [
            ("even", ["a", "b"], [1, 2], "x"),
            ("short", ["a"], [1, 2, 3], "x"),
            ("long", ["a", "b", "c"], [1], "x"),
            ("no ids", ["a", "b"], [], "x"),
            ("null ids", ["a"], None, "x"),
            ("nothing", [], [], "x"),
            ("null", None, None, "x"),
        ],
        "t string, name array<string>, id array<long>, scalar string",
    )
    rows = columns_to_rows(df, ["name", "id", "scalar"], keep=["t"]).collect()
    got = {}
    for row in sorted(rows, key=lambda row: row["position"]):
        got.setdefault(row["t"], []).append((row["name"], row["id"], row["scalar"]))
    assert got == {
        "even": [("a", 1, None), ("b", 2, None)],
        "short": [("a", 1, None), (None, 2, None), (None, 3, None)],
        "long": [("a", 1, None)],
        "no ids": [("a", None, None), ("b", None, None)],
        "null ids": [("a", None, None)],
    }


def test_first_column_counts_without_ids(spark):
    df = spark.createDataFrame([(["a"], ["x", "y"])], "name array<string>, other array<string>")
    assert [(row["name"], row["other"]) for row in columns_to_rows(df, ["other", "name"]).collect()] == [("a", "x"), (None, "y")]
    assert columns_to_rows(df, []).count() == 0
    scalar = spark.createDataFrame([("a", ["x"])], "name string, other array<string>")
    assert columns_to_rows(scalar, ["name", "other"]).count() == 0


def test_company_answers(spark):
    answers = [
        {"results": [{"nom_complet": "A", "siege": {"siret": "1", "adresse": "r"}}, {"nom_complet": None}, {"nom_complet": "C", "siege": None, "more": 1}]},
        {"results": []},
        {"results": None},
        {},
    ]
    df = spark.createDataFrame([(i, json.dumps(answer)) for i, answer in enumerate(answers)] + [(9, "broken"), (10, None)], "i int, answer string")
    got = [tuple(row)[:5] for row in flatten_companies(df, keep=["i"]).orderBy("i", "position").collect()]
    assert got == [(0, 0, "A", "r", "1"), (0, 1, "", "", ""), (0, 2, "C", "", "")]
    whole = [(row.origine, row.source) for row in flatten_companies(df, keep=["i"]).orderBy("i", "position").collect()]
    assert all(a == b for a, b in whole) and [json.loads(a) for a, _ in whole] == answers[0]["results"]
    assert [row.i for row in unreadable_answers(df).collect()] == [9]


@pytest.mark.parametrize(
    "data,picked",
    [
        ([{"resources": [{"title": "Autre", "format": "parquet", "url": "u/a"}, {"title": "Le StockEtablissement", "format": "PARQUET", "url": "u/b"}]}], "u/b"),
        ([{"resources": [{"title": "stocketablissement", "format": "csv", "url": "u/c.Parquet"}, {"title": "stocketablissement", "format": "parquet", "url": "u/d"}]}], "u/c.Parquet"),
        ([{"resources": [{"title": "stocketablissement", "format": None, "url": None}]}], None),
        ([{"resources": []}, {"resources": [{"title": "stocketablissement", "format": "parquet", "url": "u"}]}], None),
        ([{"resources": [{"format": "parquet", "url": "u"}]}], None),
        ([], None),
        (None, None),
    ],
)
def test_resource(spark, data, picked):
    df = spark.createDataFrame([(json.dumps({"data": data}),)], "answer string")
    assert [row["url"] for row in pick_resource(df).collect()] == ([picked] if picked else [])


def test_other_resource(spark):
    df = spark.createDataFrame([(json.dumps({"data": [{"resources": [{"title": "Unites", "format": "csv", "url": "h/x/u.zip"}]}]}),)], "answer string")
    assert [row["file_name"] for row in pick_resource(df, "unite", "csv").collect()] == ["u.zip"]
