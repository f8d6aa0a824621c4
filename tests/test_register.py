import json
from pathlib import Path

import pytest

from placebook.operators.columns import REGISTER_COLUMNS, MissingColumns
from placebook.plans.register import SEARCH_READY, build_register, export_register, select_register
from placebook.sources.register import read_register
from placebook.session import new_folder
from workload.standins import view

HEADER = ",".join(["extra", *REGISTER_COLUMNS[::-1]])


def line(**given):
    row = {"siret": "1", "codePostalEtablissement": "44000", "etatAdministratifEtablissement": "A"} | given
    return ",".join(["x", *[row.get(name, "") for name in REGISTER_COLUMNS[::-1]]])


@pytest.fixture
def csv(tmp_path):
    def write(*lines):
        path = tmp_path / "register.csv"
        path.write_text("\n".join([HEADER, *lines]) + "\n", encoding="utf8")
        return str(path)

    return write


def test_digits_stay_text_and_columns_go_by_name(spark, csv):
    path = csv(
        line(siret="00000000000001", codePostalEtablissement="04400"),
        line(siret="00000000000002", codePostalEtablissement="44100", enseigne1Etablissement='"Le ""Bon"", bar"'),
        line(siret="00000000000003", codePostalEtablissement="85000", etatAdministratifEtablissement="F"),
    )
    register = read_register(spark, path, "csv")
    assert register.dtypes == [(name, "string") for name in REGISTER_COLUMNS]
    built = [row.asDict() for row in build_register(register).collect()]
    assert [(row["id"], row["siret"], row["nom"]) for row in built] == [(0, "00000000000002", 'Le "Bon", bar')]


def test_short_csv_lines_are_filled_with_nulls(spark, csv):
    register = read_register(spark, csv("x,A", line(siret="2")), "csv")
    assert sorted(((row["etatAdministratifEtablissement"], row["siret"]) for row in register.collect()), key=str) == [("A", "2"), ("A", None)]


def test_missing_register_column(spark, tmp_path):
    (tmp_path / "r.csv").write_text("siret,siren\n1,2\n")
    with pytest.raises(MissingColumns, match="r.csv: .*nic"):
        read_register(spark, str(tmp_path / "r.csv"), "csv")
    with pytest.raises(ValueError, match="unknown format"):
        read_register(spark, str(tmp_path), "xml")


def test_typed_parquet_becomes_text(spark, tmp_path, sf_dir):
    typed = view(spark, sf_dir, "establishment").selectExpr("* except (nic)", "cast(nic as int) as nic")
    typed.write.parquet(str(tmp_path / "p"))
    assert dict(read_register(spark, str(tmp_path / "p")).dtypes)["nic"] == "string"


def test_null_siret_comes_first_and_ids_are_consecutive(spark, csv):
    path = csv(*[line(siret=siret, siren=str(i)) for i, siret in enumerate(["3", "", "1", "", "2"])])
    rows = [(row["id"], row["siret"]) for row in build_register(read_register(spark, path, "csv")).orderBy("id").collect()]
    assert rows == [(0, None), (1, None), (2, "1"), (3, "2"), (4, "3")]


def test_export(spark, sf_dir):
    folder = new_folder(spark, "test-export")
    counts = export_register(view(spark, sf_dir, "establishment"), folder, prefixes=["44"])
    lines = [json.loads(text) for part in Path(folder.removeprefix("file:")).glob("part-*") for text in part.read_text("utf8").splitlines()]
    assert counts["read"] == 150 and counts["kept"] == 30 and counts["exported"] == len(lines)
    assert sorted(row["id"] for row in lines) == list(range(len(lines)))
    assert set().union(*lines) <= set(SEARCH_READY)
    assert any("Allée" in row["adresse"] for row in lines) and all("allee" in row["search"] for row in lines)


def test_filters_and_columns_reach_the_scan(spark, sf_dir, tmp_path, plan_of):
    view(spark, sf_dir, "establishment").selectExpr("*", "'x' as other").write.parquet(str(tmp_path / "p"))
    plan = plan_of(select_register(read_register(spark, str(tmp_path / "p"))))
    assert "Or(StringStartsWith(codePostalEtablissement,44),StringStartsWith(codePostalEtablissement,85))" in plan
    assert "EqualTo(etatAdministratifEtablissement,A)" in plan
    assert "other" not in plan.split("ReadSchema")[1]


def test_csv_files_may_differ_in_the_order_of_their_columns(spark):
    folder = new_folder(spark, "test-csv")
    names = list(REGISTER_COLUMNS)
    one = spark.createDataFrame([["1", *["a"] * (len(names) - 1)]], names)
    two = spark.createDataFrame([["2", "first\nsecond", *["b"] * (len(names) - 2)]], names).select(*reversed(names))
    one.coalesce(1).write.mode("append").csv(folder, header=True)
    two.coalesce(1).write.mode("append").option("escape", '"').csv(folder, header=True)
    got = sorted(tuple(row) for row in read_register(spark, folder, "csv", multi_line=True).select("siret", "siren", "etatAdministratifEtablissement").collect())
    assert got == [("1", "a", "a"), ("2", "first\nsecond", "b")]


@pytest.mark.parametrize("multi_line", [False, True])
def test_blank_lines_before_the_header_lose_no_rows(spark, tmp_path, multi_line):
    (tmp_path / "a.csv").write_text("\n".join([HEADER, line(siret="1")]) + "\n")
    (tmp_path / "b.csv").write_text("\n".join(["", "" if multi_line else "  ", HEADER, line(siret="2"), line(siret="3")]) + "\n")
    (tmp_path / "c.csv").write_text("\n\n")
    assert sorted(r.siret for r in read_register(spark, str(tmp_path), "csv", multi_line).select("siret").collect()) == ["1", "2", "3"]
    if multi_line:
        (tmp_path / "d.csv").write_text("\n".join(["  ", HEADER, line(siret="4")]) + "\n")
        with pytest.raises(MissingColumns):
            read_register(spark, str(tmp_path), "csv", multi_line)
