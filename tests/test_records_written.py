"""The durable table after crashes and reruns, and the trigram index against plain search."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from missiva.operators import records, search_index
from missiva.operators.record_table import RecordTable
from missiva.plans import record_queries  # noqa: F401  registers its queries
from missiva.plans.measures import Stages, measured_scan
from missiva.sources.cache import RecognitionCache
from missiva.plans.catalogue import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
COLUMNS = "id long, filename string, texte_complet string, status string, objet string, confidence map<string,int>"


@pytest.fixture
def table(spark, tmp_path):
    rows = [(i, f"f{i}", f"text {i}" if i % 5 else None, "pending", f"o{i}", {"numero": i} if i % 2 else None) for i in range(40)]
    out = RecordTable(spark, str(tmp_path / "records"), buckets=4)
    out.create(spark.createDataFrame(rows, COLUMNS))
    return out


def state(table):
    return sorted(map(str, table.rows().select("id", "filename", "texte_complet", "status", "objet", "confidence").collect()))


def patches(spark, ids, status="validated"):
    return spark.createDataFrame([(i, 1, {"status": status, "objet": None}, None) for i in ids], "id long, seq int, fields map<string,string>, at timestamp")


def test_changes_are_written_and_read_back(spark, table):
    table.update(patches(spark, [3, 4, 99]))
    table.delete(spark.createDataFrame([(5,), (77,)], "id long"))
    rows = {r.id: r for r in table.rows().collect()}
    assert len(rows) == 39 and rows[3].status == "validated" and rows[3].objet is None and rows[6].status == "pending"
    assert table.lookup(3).first().status == "validated" and table.lookup(5).count() == 0
    assert rows[1].confidence == {"numero": 1} and rows[2].confidence is None


def test_a_rerun_inserts_nothing_twice(spark, table):
    more = [(100, "n", "t", "pending", None, None), (101, "n", "t", "pending", None, None), (102, None, None, None, None, None), (3, "new", "new", None, None, None)]
    df = spark.createDataFrame(more, COLUMNS)
    table.insert(df)
    once = state(table)
    assert {r.id for r in table.rows().collect()} == {*range(40), 100, 102}  # 101 has 100's content, 3 is taken
    table.insert(df)
    table.insert(df.limit(0))
    assert state(table) == once


@pytest.mark.parametrize("stop", ["copy", "replace", "clean"])
def test_a_crash_leaves_the_table_before_or_after(spark, table, monkeypatch, stop):
    before = state(table)
    if stop == "copy":  # the copy isn't whole
        monkeypatch.setattr(RecordTable, "_placed", lambda self, df: df.withColumn("bucket", F.raise_error(F.lit("killed")).cast("int")))
    elif stop == "replace":  # the copy is whole, the table untouched
        monkeypatch.setattr(RecordTable, "_replace", lambda self: (_ for _ in ()).throw(RuntimeError("killed")))
    else:  # replaced, but not tidied
        monkeypatch.setattr("missiva.operators.record_table.remove", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        monkeypatch.setattr(RecordTable, "recover", lambda self: None)
    with pytest.raises(Exception, match="killed"):
        table.delete(spark.createDataFrame([(i,) for i in range(0, 40, 3)], "id long"))
    monkeypatch.undo()
    after = state(table)
    gone = [x for x in before if x not in after]
    assert len(gone) == (0 if stop == "copy" else 14) and set(after) <= set(before)
    table.delete(spark.createDataFrame([(i,) for i in range(0, 40, 3)], "id long"))  # the rerun
    assert len(state(table)) == 26


@pytest.mark.parametrize("done", [1, 2])
def test_a_crash_between_two_buckets_is_mended(spark, table, monkeypatch, done):
    from missiva.operators import record_table

    calls, rename = [], record_table.renamed

    def stopping(*a):
        if len(calls) == done:
            raise RuntimeError("killed")
        calls.append(a)
        rename(*a)

    monkeypatch.setattr(record_table, "renamed", stopping)
    with pytest.raises(RuntimeError, match="killed"):
        table.delete(spark.createDataFrame([(i,) for i in range(0, 40, 3)], "id long"))
    monkeypatch.undo()
    assert len(state(table)) == 26
    table.recover()
    assert len(state(table)) == 26


def test_whole_rows_are_exchanged_and_written_once(spark, table, monkeypatch):
    """A change writes its rows once and exchanges them by id alone; a rerun of an insert exchanges keys alone."""
    plans = []
    write = type(spark.range(1).write)
    kept = write.parquet
    monkeypatch.setattr(write, "parquet", lambda self, path, *a, **k: (plans.append((path, self._df._jdf.queryExecution().optimizedPlan().toString())), kept(self, path, *a, **k))[1])
    table.update(patches(spark, range(0, 40, 2)))
    assert [path.rsplit("/", 1)[1] for path, _ in plans] == ["next", "ready"]
    assert plans[0][1].count("RepartitionByExpression [id") == 1 == plans[0][1].count("RepartitionByExpression")
    plans.clear()
    table.insert(table.rows())
    assert len(plans) == 1 and "missiva-new" in plans[0][0]


def test_a_bucket_can_become_empty(spark, table):
    table.delete(table.rows().select("id"))
    assert table.rows().count() == 0
    table.insert(spark.createDataFrame([(1, "a", "b", "pending", None, None)], COLUMNS))
    assert table.rows().count() == 1


TEXTS = ["Bonjour le Monde", "BONJOUR", "bon%jour_x", None, "", "ab", "L'École été", "ΟΔΟΣ οδός", "a\\b\\c", "jourbon", "bon bon bon jour", "Straße İstanbul", "été ÉTÉ", "日本語テキスト"]


CASES = [(term, search_index.LISTED_IDS) for term in ("bonjour", "BON%jour", "ab", "%", "ΟΔΟΣ", "\\b\\", "İst", "本語テ", "___jour")] + [("our", 1), ("nowhere", 1), ("été", 1)]


@pytest.mark.parametrize(("term", "listed"), CASES)
def test_index_finds_what_search_finds(spark, tmp_path_factory, monkeypatch, term, listed):
    monkeypatch.setattr(search_index, "LISTED_IDS", listed)
    rows = [(i, t, TEXTS[(i + 3) % len(TEXTS)]) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "id long, objet string, texte_complet string")
    for c in ("numero", "expediteur", "destinataire", "corps"):
        df = df.withColumn(c, F.lit(None).cast("string"))
    df = df.withColumn("created_at", F.timestamp_seconds(F.col("id") % 5))
    global _path
    if "_path" not in globals():
        _path = str(tmp_path_factory.mktemp("index"))
        search_index.build(df, _path)
    for field in ("objet",) if len(term) > 3 else ("all",):
        assert [r.id for r in search_index.search(df, _path, term, field, 5).collect()] == [r.id for r in records.search(df, term, field, 5).collect()]


@pytest.mark.parametrize(("together", "texts"), [(1 << 22, 1 << 14), (8, 3), (1 << 22, 1)])
def test_postings_are_lists(spark, monkeypatch, together, texts):
    """Each text's trigrams once, as the query's own expressions give them; texts read together share a row for each trigram."""
    monkeypatch.setattr(search_index, "TOGETHER", together)
    monkeypatch.setattr(search_index, "TEXTS", texts)
    df = spark.createDataFrame([*enumerate([*TEXTS, "a\U0001f600b\U0001f600", "aaaaaa"])], "id long, objet string").coalesce(1)
    got = search_index.postings(df, ("objet",)).collect()
    want = df.select("id", F.explode(search_index.grams_of(F.col("objet"))).alias("gram")).collect()
    assert Counter((i, r.gram) for r in got for i in r.ids) == Counter((r.id, r.gram) for r in want)
    assert all(r.n == len(r.ids) for r in got)
    if texts == 1 << 14:
        assert together == 8 or len(got) == len({r.gram for r in want}) < len(want)


def test_letters_too_many_for_one_number():
    """Texts of very many letters are taken apart, down to one."""
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    texts = [every[i : i + 70_000] for i in range(0, len(every), 70_000)]
    found = list(search_index.posting_lists()(texts))
    assert len(found) > 1
    assert sum(len(places) for _, _, places in found) == sum(len(t) - 2 for t in texts)
    assert {int(p) for _, _, places in found for p in places} == set(range(len(texts)))


def test_only_the_querys_trigrams_are_read(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text number {i}") for i in range(50)], "id long, objet string")
    search_index.build(df, str(tmp_path / "i"), ("objet",))
    ids = search_index.candidates(spark, str(tmp_path / "i"), "ber 17", "objet")
    plan = ids._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [part" in plan and "PushedFilters: [" in plan and "In(gram" in plan
    assert [r.id for r in ids.collect()] == [17]
    assert search_index.candidates(spark, str(tmp_path / "i"), "x_%", "objet") is None


@pytest.mark.parametrize("name", ["table_written_back", "indexed_search_objet", "indexed_search_contenu", "indexed_search_all", "stage_measures", "recognition_cache"])
def test_queries(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "orders", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    out = QUERIES[name](spark, SMALL)
    want = con.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    assert Counter(map(tuple, out.select(*names).collect())) == Counter(want.fetchall())


def test_recognised_texts_last(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def engine(data):
        calls.add(1)
        return data.decode().upper(), 0.5

    rows = [(1, b"a", None), (2, b"b", None), (3, b"a", None), (4, b"c", "size"), (5, b"", None)]
    files = spark.createDataFrame(rows, "id long, content binary, refused string")
    cache = RecognitionCache(spark, str(tmp_path / "cache"))
    got = {r.id: (r.text, r.batch) for r in cache.recognised(files, engine, "e", "one").collect()}
    assert got == {1: ("A", "one"), 2: ("B", "one"), 3: ("A", "one"), 4: (None, None), 5: ("", "one")} and calls.value == 3
    again = {r.id: (r.text, r.batch) for r in RecognitionCache(spark, str(tmp_path / "cache")).recognised(files, engine, "e", "two").collect()}
    assert again == got and calls.value == 3  # none of the second run
    cache.recognised(files.filter("id < 3"), engine, "other", "two")
    assert calls.value == 5  # another engine reads for itself
    assert cache.recognised(files.limit(0), engine, "e").count() == 0 and calls.value == 5


def test_stages_are_observed(spark):
    letters = spark.createDataFrame([(1, "N° 123/2024\nObjet : essai de lettre\n"), (2, None), (3, "")], "id long, texte_complet string")
    stages = Stages()
    measured_scan(letters, stages).write.format("noop").mode("overwrite").save()
    text, corrected, fields = stages.table(spark).collect()
    assert (text.stage, text.rows, text.characters, text.fields) == ("text", 3, 36, 0)
    assert corrected.rows == fields.rows == 3 and fields.fields >= 2
    none = Stages()
    measured_scan(letters.limit(0), none).write.format("noop").mode("overwrite").save()
    assert [(r.rows, r.characters, r.fields) for r in none.table(spark).collect()] == [(0, 0, 0)] * 3
