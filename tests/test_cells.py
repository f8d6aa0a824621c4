import pytest
from pyspark.sql import functions as F

from placebook.functions.cells import has_number, is_filled, parse_diff_cell
from placebook.operators.columns import MissingColumns, check_columns, default_mapping, map_columns, map_info, prepare_searchable, rename_columns
from placebook.operators.filters import valid_points
from placebook.plans.mapview import map_points, markers


def test_diff_cells(spark):
    cases = {
        'V({"remote":"a","local":"b"})': "a",
        'V({"remote":"","local":"b"})': "b",
        'V({"remote":0,"local":false,"parent":"c"})': "c",
        'V({"remote":null,"local":"0"})': "0",
        'V({"remote":0.0,"local":1.5})': "1.5",
        'V({"remote":"false"})': "false",
        'V({"remote":true})': "true",
        'V({"remote":{"a":1}})': '{"a":1}',
        'V({"remote":"","local":0})': '{"remote":"","local":0}',
        'V({"other":1})': '{"other":1}',
        "V(broken)": "broken",
        "plain": "plain",
        " V({})": " V({})",
        "": "",
        None: None,
    }
    df = spark.createDataFrame([(i, cell) for i, cell in enumerate(cases)], "i int, c string")
    got = [row[0] for row in df.orderBy("i").select(parse_diff_cell("c")).collect()]
    assert got == list(cases.values())


def test_filled(spark):
    df = spark.createDataFrame(
        [("", 0, 0.0, False), ("0", 1, 0.5, True), (None, None, None, None), (" ", -1, float("nan"), True)],
        "s string, n long, d double, b boolean",
    )
    got = df.select(*[is_filled(f.name, f.dataType) for f in df.schema.fields]).collect()
    assert [tuple(row) for row in got] == [(False,) * 4, (True,) * 4, (False,) * 4, (True, True, False, True)]


def test_coordinates_in_text(spark):
    cells = ["", None, "0", "0.0", "...", "2.5", "-1"]
    df = spark.createDataFrame([(i, cell) for i, cell in enumerate(cells)], "i int, c string")
    assert [row[0] for row in df.orderBy("i").select(has_number("c")).collect()] == [False, False, False, False, True, True, True]


def test_valid_points(spark):
    cells = [("...", "1"), (None, None), ("0.001", "-0.001"), ("0.001", "0.5"), ("10", None), ("x", "1"), ("0.01", "0"), ("-0.009", "0.0099"), ("2", "48")]
    df = spark.createDataFrame([(i, *cell) for i, cell in enumerate(cells)], "id long, lng string, lat string")
    assert [tuple(row) for row in valid_points(df).orderBy("id").collect()] == [(3, 0.001, 0.5), (6, 0.01, 0.0), (8, 2.0, 48.0)]


def test_numbers_are_not_taken_for_diff_cells(spark):
    df = spark.createDataFrame([(1, "V({\"remote\":\"x\"})", 2.5, 48.0)], "id long, Name string, Longitude double, Latitude double")
    assert map_info(df).dtypes == [("id", "bigint"), ("name", "string"), ("lng", "double"), ("lat", "double")]
    assert [tuple(row) for row in map_points(df).collect()] == [(1, "x", 2.5, 48.0)]


def test_last_row_of_an_id_makes_the_marker(spark):
    df = spark.createDataFrame([(1, "a", "1", "1", 1), (1, None, "2", "2", 2), (2, "c", "3", "3", 1)], "id long, Name string, Longitude string, Latitude string, seq int")
    got = markers(map_points(df, order=["seq"]), selected=2).orderBy("id").collect()
    assert [tuple(row) for row in got] == [(1, 2.0, 2.0, "", "otherMarkers"), (2, 3.0, 3.0, "c", "selectedMarker")]


def test_missing_columns_are_reported(spark):
    df = spark.range(1)
    with pytest.raises(MissingColumns, match="Name, Longitude"):
        check_columns(df, ["id", "Name", "Longitude"])
    assert check_columns(df.withColumn("x", F.lit(1)), ["id"], ["x", "y"]).columns == ["id", "x"]
    assert default_mapping(df.withColumn("Address", F.lit(""))) == {
        "Name": "Name", "Longitude": "Longitude", "Latitude": "Latitude", "Geocode": None, "Address": "Address", "GeocodedAddress": None,
    }


def test_mapping(spark):
    df = spark.createDataFrame([(1, "", "b", 0), (2, "a", "b", 7), (3, None, None, None)], "id long, Enseigne string, Nom string, Num long")
    got = map_columns(df, {"Nom": "Enseigne", "SIRET": "Num", "Adresse": None}).orderBy("id").collect()
    assert [tuple(row) for row in got] == [(1, "b", "", ""), (2, "a", "7", ""), (3, "", "", "")]
    assert rename_columns(df, {"Name": "Nom", "Gone": None, "Far": "absent"}).columns == ["id", "Enseigne", "Name", "Num"]
    assert rename_columns(df, {"Nom": "Enseigne"}).columns == ["id", "Nom", "Num"]


def test_result_keeps_the_raw_row(spark):
    df = spark.createDataFrame([(1, " Été ", None)], "id long, Nom string, Adresse string")
    row = prepare_searchable(df).first()
    assert (row["result"]["nom"], row["result"]["adresse"], row["result"]["siret"], row["result"]["latitude"]) == (" Été ", "", "", None)
    assert row["result"]["origine"].asDict() == {"id": 1, "Nom": " Été ", "Adresse": None}
    assert (row["searchable_nom"], row["searchable_adresse"]) == ("ete", "")


def test_names_may_be_chained_swapped_and_doubled(spark):
    df = spark.createDataFrame([("a", "n", "x")], "A string, Name string, Rest string")
    for mapping, expected in [
        ({"Name": "A", "Address": "Name"}, {"Name": "a", "Address": "n", "Rest": "x"}),
        ({"Name": "A", "A": "Name"}, {"Name": "a", "A": "n", "Rest": "x"}),
        ({"Name": "A", "Address": "A"}, {"Name": "a", "Address": "a", "Rest": "x"}),
        ({"Address": "A"}, {"Address": "a", "Name": "n", "Rest": "x"}),
    ]:
        assert rename_columns(df, mapping).first().asDict() == expected
