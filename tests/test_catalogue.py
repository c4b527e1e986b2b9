"""Queries over whole tables against their SQL in DuckDB."""

import json
from collections import Counter

import duckdb

import pytest

from missiva.__main__ import main
from missiva.plans import cases
from missiva.plans.catalogue import ORACLES, QUERIES
from missiva.plans.profiles import scan_profile, text_profile

SMALL = "/root/testdata/sf0.001"


def same_as_sql(spark, name):
    """The query's rows, when they are those of its SQL."""
    con = duckdb.connect()
    for table in ("orders", "documents", "labels", "pages", "lineitem"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    out = QUERIES[name](spark, SMALL)
    want = con.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(out.columns) == sorted(names)
    rows = out.select(*names).collect()
    assert Counter(map(tuple, rows)) == Counter(want.fetchall())
    return rows


def test_all_letters_have_a_text_profile(spark):
    rows = same_as_sql(spark, "text_profile_all_letters")
    assert len(rows) == spark.read.parquet(f"{SMALL}/orders.parquet").count()
    by_id = {r.id: r for r in rows}
    assert by_id[3].numero == "103/1003" and by_id[3].etablissement == "La Présidence - Marrakech" and by_id[3].langue == "fr"
    assert by_id[7].type_document == "note" and by_id[15].type_document == "bordereau"


def test_all_records_have_json(spark):
    rows = same_as_sql(spark, "json_all_rows")
    assert len(rows) == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    by_id = {r.id: r.json for r in rows}
    assert by_id[2].endswith('"confidence":{"numero":6,"date":8,"objet":10,"expediteur":12,"destinataire":14,"type_document":16,"etablissement":18}}')
    assert by_id[10].endswith('"confidence":{}}')


@pytest.mark.parametrize("name", ["normalise_text_profile", "normalise_scan_profile"])
def test_repairs(spark, name):
    assert len(same_as_sql(spark, name)) == spark.read.parquet(f"{SMALL}/orders.parquet").count()


@pytest.mark.parametrize("profile, read", [(scan_profile, cases.SCAN), (text_profile, cases.TEXT)])
def test_letters_with_stated_results(spark, profile, read):
    def fill(text):
        return text and text.replace("@N@", "731").replace("@D@", "17").replace("@K@", "88")

    df = spark.createDataFrame([(i, fill(t)) for i, t in enumerate(cases.LETTERS)], "id long, texte_complet string")
    out = {r.id: r for r in profile(df).collect()}
    for i, row in enumerate(read):
        got = [out[i][c if c != "langue" else "langue_detectee"] for c in cases.READ]
        assert got == [fill(v) for v in row], i
    if profile is scan_profile:
        assert tuple(i for i in out if out[i].has_stamp) == cases.STAMPED


@pytest.mark.parametrize("name", ["mail_text_fields", "mail_text_scores"])
def test_keys_that_look_like_misread_years(spark, tmp_path, name):
    """Keys that the year repair changes, each in every letter, and their neighbours that it leaves."""
    keys = [2066, 2076, 2086, 2096, 6026, 7026, 8026, 9026, 42020, 42076, 42099, 2026, 2056, 2077, 5026, 42019, 42100]
    n = len(cases.LETTERS)
    rows = [(k,) for k in keys] + [(k,) for k in range(42020, 42020 + n)] + [(88 + i,) for i in range(n)]
    spark.createDataFrame(sorted(set(rows)), "o_orderkey long").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    out = QUERIES[name](spark, str(tmp_path))
    want = con.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    assert Counter(map(tuple, out.select(*names).collect())) == Counter(want.fetchall())


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.txt").write_text(cases.LETTERS[9].replace("@N@", "731").replace("@D@", "17").replace("@K@", "88"))
    (tmp_path / "b.txt").write_text("court")
    assert main([str(tmp_path)], spark) == 0
    shown = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert len(shown) == 1 and shown[0]["numero"] == "731/2031" and shown[0]["type_document"] == "invitation"
    assert shown[0]["path"].endswith("a.txt")


@pytest.mark.parametrize("name", ["stored_files", "text_ingestion", "overview", "engine_dispatch", "arabic_fix", "word_confidence", "variants_text", "page_merge"])
def test_small_queries(spark, name):
    same_as_sql(spark, name)
