import pytest
from pyspark.sql import functions as F

from placebook.operators.geocode import geocode, geocode_candidates, geocode_table
from workload.standins import view

ROWS = [
    # id, Longitude, Geocode, Address, GeocodedAddress
    (1, None, True, "a", None),  # never tried
    (2, "5", True, "a", None),  # has coordinates
    (3, "0", True, "a", ""),  # zero is nothing
    (4, None, True, "a", "a"),  # tried before
    (5, "5", True, "a", "b"),  # address changed
    (6, "5", True, "", "b"),  # changed to nothing
    (7, None, False, "a", None),  # switched off
    (8, None, None, "a", None),  # never switched on
    (9, None, True, None, None),  # no address
    (10, "...", True, "a", None),  # being geocoded
    (11, "", True, "lost", None),  # address unknown
]
SCHEMA = "id long, Longitude string, Geocode boolean, Address string, GeocodedAddress string"


@pytest.fixture
def table(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumn("Latitude", F.col("Longitude"))


@pytest.fixture
def gazetteer(spark):
    return spark.createDataFrame([("a", 2.0, 9.0), ("a", 1.0, 8.0), ("a", 1.0, 7.0), ("b", 3.0, 3.0)], "address string, lat double, lng double")


def test_candidates(table):
    assert sorted(row["id"] for row in geocode_candidates(table).collect()) == [1, 3, 5, 11]


def test_without_cache_column(table):
    assert sorted(row["id"] for row in geocode_candidates(table.drop("GeocodedAddress")).collect()) == [1, 3, 4, 11]


def test_without_switch_nothing_is_looked_up(table):
    assert geocode_candidates(table.drop("Geocode")).count() == 0


def test_switch_may_be_a_number(table):
    numbered = table.withColumn("Geocode", F.when(F.col("id") == 1, 0).otherwise(1))
    assert sorted(row["id"] for row in geocode_candidates(numbered).collect()) == [3, 5, 7, 8, 11]


@pytest.mark.parametrize("limit", [1000, 3, 0])
def test_table(table, gazetteer, limit):
    done = {row["id"]: (row["Longitude"], row["Latitude"], row["GeocodedAddress"]) for row in geocode_table(table, gazetteer, limit).collect()}
    found = ("7.0", "1.0", "a")
    assert done[1] == done[3] == done[5] == found
    assert done[11] == (None, None, "lost")
    assert {id_: done[id_] for id_ in (2, 4, 6, 10)} == {2: ("5", "5", None), 4: (None, None, "a"), 6: ("5", "5", "b"), 10: ("...", "...", None)}


def test_nothing_is_left_to_do_afterwards(spark, sf_dir):
    done = geocode_table(view(spark, sf_dir, "places"), view(spark, sf_dir, "gazetteer"))
    assert geocode_candidates(view(spark, sf_dir, "places")).count() > 0
    assert geocode_candidates(done).count() == 0


def test_all_ways_of_joining_agree(spark):
    """Half of the rows have the same address."""
    rows = spark.range(600).select("id", F.expr("if(id % 2 = 0, 'hot', concat('a', id % 50))").alias("Address"))
    gazetteer = spark.range(40).select(F.expr("if(id = 0, 'hot', concat('a', id))").alias("address"), F.col("id").cast("double").alias("lat"), F.lit(1.0).alias("lng"))
    expected = sorted(tuple(row) for row in geocode(rows, gazetteer).collect())
    assert len(expected) == 600
    for limit in (30, 0):
        assert sorted(tuple(row) for row in geocode(rows, gazetteer, limit).collect()) == expected
