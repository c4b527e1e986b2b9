"""The mail engine on literal letters and small tables."""

import pytest
from pyspark.sql import functions as F

from missiva.functions import language, normalise
from missiva.functions.patterns import matches, start
from missiva.operators import ocr, records, scan_fields, scoring
from missiva.plans.profiles import scan_fields_scored, scan_profile, text_fields_scored, text_profile
from missiva.sources import files

LETTER = (
    "Université Cadi Ayyad\nFaculté des Sciences Semlalia\nN° 221/1234\nMarrakech, le 12 mars 2024\nLe Doyen\nA\nMADAME LA PRÉSIDENTE DE L'UCA MARRAKECH\n"
    "Objet : Demande de matériel informatique\n\nMadame,\nJ'ai l'honneur de vous transmettre la liste du matériel demandé.\nVeuillez agréer mes salutations.\n"
)


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first().x


def test_scan_letter(spark):
    row = scan_profile(spark.createDataFrame([(1, LETTER)], "id long, texte_complet string")).first()
    assert row.numero == "221/1234" and row.date == "12 mars 2024" and row.etablissement == "FSS-Marrakech"
    assert row.objet == "Demande de matériel informatique" and row.type_document == "demande"
    assert row.expediteur == "Le Doyen — FSS Semlalia"
    assert row.corps.startswith("Madame,") and row.corps.endswith("demandé.")


def test_short_and_null_letters(spark):
    rows = scan_fields_scored(spark.createDataFrame([(1, None), (2, ""), (3, "abc")], "id long, texte_complet string")).collect()
    assert len(rows) == 21 and {r.value for r in rows if r.field != "type_document"} == {None}
    assert {r.action for r in rows} == {"manual"}


@pytest.mark.parametrize(
    "text,date",
    [
        ("le 1er avril 2025", "01 avril 2025"),
        ("01 AVR. 2026", "01 avril 2026"),
        ("02 أبريل 2026", "02 avril 2026"),
        ("45/01/2024", "45 janvier 2024"),
        ("01/13/2024", None),
        ("01-02-2019", None),
        ("12 Marrakech 2024", None),
    ],
)
def test_dates(spark, text, date):
    assert one(spark, scan_fields.date_in, text) == date


@pytest.mark.parametrize("text,name", [("une description", "CRI-Marrakech-Safi"), ("FSTG", "FST-Marrakech"), ("rien", None), ("La Présidence\n", "La Présidence - Marrakech")])
def test_body(spark, text, name):
    assert one(spark, scan_fields.etablissement, text) == name


@pytest.mark.parametrize(
    "step,text,out",
    [
        (normalise.digits, "٠۹", "09"),
        (normalise.unflatten, "a  b  c  d", "a\nb\nc\nd"),
        (normalise.unflatten, "a  b  c", "a  b  c"),
        (normalise.years, "2076 7026 42026 2066", "2026 2026 2026 2026"),
        (normalise.stamp_days, "0 2 avr", "02 avr"),
        (normalise.noise_lines, "a\n\n\nb", "a\n\nb"),
        (normalise.french_text, "03 MR 2026", "03 AVR 2026"),
        (normalise.french_text, "mars 9024", "mars 2024"),
        (normalise.arabic_text, "الرئاسه", "الرئاسة"),
        (normalise.arabic_scan, "الرئاسه", "الرئاسه"),
        (normalise.normalise_scan, "été", "été"),
    ],
)
def test_repair(spark, step, text, out):
    assert one(spark, step, text) == out


def test_languages(spark):
    assert [one(spark, f, "مرحبا بكم في الجامعة") for f in (language.language_scan, language.language_text)] == ["ar", "ar"]
    assert one(spark, language.language_scan, "abc") == "unknown" and one(spark, language.ocr_mode, "bonjour") == "tesseract"


def test_offsets(spark):
    text = "é1 xx 22 👍 333"
    found = one(spark, lambda t: matches(t, r"\d+"), text)
    assert [(r.m, r["at"]) for r in found] == [("1", 1), ("22", 6), ("333", 11)] and one(spark, lambda t: start(t, "x"), text) == 3


def test_scores(spark):
    df = spark.createDataFrame([("ab", False), ("a" * 10, True), (None, True)], "v string, s boolean")
    got = [r.x for r in df.select(scoring.score_scan("numero", F.col("v"), F.col("s")).alias("x")).collect()]
    assert got == [0.7 - 0.15, 0.9, 0.0]


def test_records(spark):
    df = spark.createDataFrame([(1, "pending", "a", "2024-01-01"), (2, "validated", "b", "2024-01-02"), (3, None, "50%", "2024-01-02")], "id long, status string, objet string, created_at string")
    counts = records.status_counts(df).first()
    assert (counts.total, counts.validated, counts.pending, counts.rejected) == (3, 1, 1, 1)
    assert [r.id for r in records.page(df, 1, 2).collect()] == [3, 2]
    assert [r.id for r in records.delete(df, df.filter("id = 1")).orderBy("id").collect()] == [2, 3]
    with pytest.raises(ValueError):
        records.page(df, 0)


def test_ocr_helpers(spark):
    pages = spark.createDataFrame([(1, 2, "b", "tess", 0.5), (1, 1, "a", "easy", 1.0)], "doc_id long, page_no int, text string, engine string, confidence double")
    row = ocr.merge_pages(pages).first()
    assert row.text == "a\n\n--- Page suivante ---\n\nb" and row.engine == "easy,tess" and row.confidence == 0.75
    texts = spark.createDataFrame([((" ", "x"), ("t", "y"))], "a struct<text string, engine string>, b struct<text string, engine string>")
    assert texts.select(ocr.first_text(F.col("a"), F.col("b")).alias("r")).first().r.engine == "y"


def test_engine_sees_each_content_once(spark, tmp_path):
    for name, data in (("a.png", b"one"), ("b.PNG", b"one"), ("c.txt", b"two"), ("d.pdf", b"three")):
        (tmp_path / name).write_bytes(data)
    read = files.read_files(spark, str(tmp_path))
    out = files.recognise(read, lambda data: (data.decode().upper(), 0.5), "stub").collect()
    assert sorted(r.text for r in out) == ["ONE", "THREE"]


def test_stream(spark, tmp_path):
    from missiva.streaming.ingest import letters_stream, run_profile

    source = str(tmp_path / "in")
    spark.createDataFrame([(1, LETTER)], "id long, texte_complet string").write.parquet(source)
    run_profile(letters_stream(spark, source), str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).first().numero == "221/1234"


TEXT_LETTER = (
    "Université Cadi Ayyad\nFaculté des Sciences Semlalia\nN° 830/26\nMarrakech, le 27 JAN 2022\nLe Doyen\nA\nMonsieur le Président de l'Université Cadi Ayyad\n"
    "OBJET : Envoi de dossiers\nMonsieur le Président,\nJ'ai l'honneur de vous adresser les dossiers des candidats.\n||| --- |||\nVeuillez agréer mes salutations.\nLe Doyen\n"
)


def test_text_letter(spark):
    from missiva.plans.profiles import text_profile

    df = spark.createDataFrame([(1, TEXT_LETTER), (2, ""), (3, None)], "id long, texte_complet string")
    rows = {r.id: r for r in text_profile(df).collect()}
    row = rows[1]
    assert (row.numero, row.date, row.etablissement, row.type_document) == ("830/26", "27 janvier 2022", "FSS-Marrakech", "lettre")
    assert row.objet == "Envoi de dossiers" and row.expediteur == "Le Doyen — FSS Semlalia"
    assert row.destinataire == "Monsieur le Président de l'Université Cadi Ayyad"
    assert row.corps == "OBJET : Envoi de dossiers\nMonsieur le Président,\nJ'ai l'honneur de vous adresser les dossiers des candidats.\nVeuillez agréer mes salutations."
    assert rows[2].type_document is None and rows[3].numero is None


@pytest.mark.parametrize(
    "text,date",
    [
        ("12 Marrakech 2024", "12 mars 2024"),
        ("3 JUILL 2024", "03 juin 2024"),
        ("3 JUILLET 2024", "03 juillet 2024"),
        ("du 3 mai 2024", None),
        ("le 3 mai 2024 à 10h", None),
        ("45/01/2024", None),
        ("05/01/2031", "05 janvier 2031"),
        ("2 8 avril 2026", "28 avril 2026"),
    ],
)
def test_text_dates(spark, text, date):
    from missiva.operators import text_fields

    assert one(spark, text_fields.date_in, text) == date


def test_text_stamp(spark):
    from missiva.operators import text_fields

    stamp = "Bruit\nPRESIDENCE DE L'UNIVERSITE\nCADI AYYAD - MARRAKECH\nArrivé le : 04512\n0 2 AVR. 2026\n"
    zone = spark.createDataFrame([(stamp,)], "t string").select(text_fields.stamp_zone(F.col("t")).alias("z"))
    row = zone.select(text_fields.stamp_number(F.col("z")).alias("n"), text_fields.stamp_date(F.col("z")).alias("d")).first()
    assert (row.n, row.d) == ("4512", "02 avril 2026")


@pytest.mark.parametrize(
    "text,subject",
    [
        ("Veuillez trouver ci-joint :\nNature\n12\nDemande de mutation de :\nKarim Alami\n", "Demande de mutation de : Karim Alami"),
        ("Bordereau d'envoi\nTransmission des dossiers de candidature\n", "Transmission des dossiers de candidature"),
        ("Rien", None),
    ],
)
def test_slip_subjects(spark, text, subject):
    from missiva.operators import text_fields

    assert one(spark, text_fields.objet, text) == subject


@pytest.mark.parametrize(
    "text,who",
    [
        ("Bonjour\nMonsieur le Président de l'Université Cadi Ayyad, Marrakech et suite", "Monsieur le Président de l'Université Cadi Ayyad, Marrakech"),
        ("\nMonsieur le Président, voici\n", None),
        ("\nA\nMADAME LE DIRECTEUR DE L'ENSA MARRAKECH\n", "Madame le Directeur de L'ensa Marrakech"),
        ("\nA\nLe service du Doyen\n", "Le service du Doyen"),
    ],
)
def test_text_recipients(spark, text, who):
    from missiva.operators import text_fields

    got = one(spark, text_fields.destinataire, text)
    assert got == who or (who and got and got.lower() == who.lower())


def test_insert_pending_rows(spark, tmp_path):
    from missiva.plans.profiles import scan_records, text_records

    path = str(tmp_path / "records")
    scans = spark.createDataFrame(
        [(1, "a.png", "in/a.png", "image", LETTER, 12, "tesseract")],
        "id long, filename string, file_path string, file_type string, texte_complet string, processing_time_ms int, ocr_engine_used string",
    )
    records.insert(scan_records(scans), path)
    records.insert(text_records(spark.createDataFrame([(2, "b.pdf", TEXT_LETTER), (3, "c.pdf", None)], "id long, filename string, texte_complet string")), path)
    table = spark.read.parquet(path)
    assert [(f.name, f.dataType) for f in table.schema] == [(f.name, f.dataType) for f in records.SCHEMA]
    a, b, c = table.orderBy("id").collect()
    assert {r.status for r in (a, b, c)} == {"pending"} and all(r.created_at and r.validated_by is None and r.updated_at is None for r in (a, b, c))
    assert (a.numero, a.date_courrier, a.processing_time_ms, a.ocr_engine_used, a.confidence["numero"]) == ("221/1234", "12 mars 2024", 12, "tesseract", 70)
    assert (b.numero, b.date_courrier, b.file_type, b.processing_time_ms, b.ocr_engine_used) == ("830/26", "27 janvier 2022", "pdf", 0, "pdf.js (client)")
    assert len(b.confidence) == 7 and b.texte_complet == TEXT_LETTER and c.numero is None


CIRCULAR = """Royaume du Maroc
Université Cadi Ayyad – Marrakech
La Présidence
Présidence Université Cadi Ayyad – Bd. de l'Université, B.P. 511- Marrakech
Tél : 05.00.00.00.01/05.00.00.00.02 – Fax : 05.00.00.00.03 - Email : accueil@example.org

Marrakech, le 27 JAN 2022
N° 400/UCA/2022/586

Le Président
A
Mesdames et Messieurs les Professeurs,
Les Personnels administratif et technique et
Les Etudiants de l'Université

OBJET : Organisation des Assises régionales Marrakech – Safi 2021-2022

Cher(e)s collègues,

Les Assises régionales de la recherche se tiendront au mois de mars prochain ; les préparatifs ont commencé.

Veuillez agréer, Mesdames et Messieurs, l'expression de ma haute considération.

Le Président
"""
SLIP = """Royaume du Maroc
Ministère de l'Enseignement Supérieur
Direction des Ressources Humaines

BORDEREAU D'ENVOI

N° BE/2024/RH/0042
Rabat, le 03 mars 2024

Expéditeur : Direction des Ressources Humaines
Destinataire : Service du Personnel, Présidence UCA

Objet : Transmission des dossiers de promotion — Session 2024

1. Liste des enseignants
2. Procès-verbaux
"""


def test_a_letter_and_a_slip(spark):
    """A circular with a number of four parts and a slip with labelled lines, through both profiles; an empty text has no fields."""
    df = spark.createDataFrame([(1, CIRCULAR), (2, SLIP), (3, "")], "id long, texte_complet string")
    text, scan = ({r.id: r for r in f(df).collect()} for f in (text_profile, scan_profile))
    assert "400" in text[1].numero and ("UCA" in text[1].numero or "2022" in text[1].numero)
    assert text[1].date == "27 janvier 2022" and text[1].type_document == "lettre"
    assert "Assises régionales" in text[1].objet and "Président" in text[1].expediteur and "préparatifs" in text[1].corps
    assert text[2].type_document == "bordereau" and text[2].date == "03 mars 2024"
    for r in (text[3], scan[3]):
        assert (r.numero, r.date, r.objet) == (None, None, None)
    assert scan[1].date == "27 janvier 2022" and scan[2].type_document == "bordereau"
    scores = text_fields_scored(df.filter("id = 1")).collect()
    assert len(scores) == 7 and all(0 <= r.score <= 1 for r in scores)


def test_costly_steps_are_worked_out_once(spark):
    """What earlier steps made stands once in each expression, however many rules look at it."""
    from pyspark.sql import functions as F

    from missiva.functions import normalise, rules_text
    from missiva.operators import text_fields

    def times(column, pattern):
        plan = spark.createDataFrame([("a",)], "t string").select(column(F.col("t")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
        return plan.count(pattern)

    spark.conf.set("spark.sql.maxPlanStringLength", 100_000_000)
    spark.conf.set("spark.sql.debug.maxToStringFields", 100_000)
    try:
        assert times(normalise.normalise_text, normalise.FRENCH_TEXT[0][0]) == 1
        assert times(text_fields.corps, rules_text.SALUTATIONS[0]) == 1
        assert times(lambda t: text_fields.expediteur(t, F.lit("x")), rules_text.RECIPIENT_START) <= 2
    finally:
        spark.conf.unset("spark.sql.maxPlanStringLength")
        spark.conf.unset("spark.sql.debug.maxToStringFields")


@pytest.mark.parametrize("flags", ["", "i"])
def test_literals_guard_patterns_and_change_nothing(spark, flags):
    """A pattern is tried only where a text holds one of its literals; letters of odd cases count as the pattern counts them."""
    from missiva.functions import patterns, rules

    assert patterns.literals(r"\b[Rr]apport\b|تقرير\b") == ("apport", "تقرير") and patterns.literals(r"N[°ºoO]\s*(\d{2,4})") == ()
    assert patterns.literals(r"(?:abc)?\d+") == () and patterns.literals(r"x(?:ab|cd)+") == ("ab", "cd")
    tables = (rules.TYPES, rules.TITLES, rules.BODIES_FR, rules.BODIES_AR)
    rows = [x[0] for t in tables for x in t] + [rules.PRESIDENCY_LINE, rules.SENDER_TITLED, *rules.SCAN_STAMPS]
    texts = ["Note de service", "PV", "le RAPPORT", "Demande de", "FST", "La Prés\u0131dence", "La Pre\u017f\u0130dence", "cade", "CAD\u0130 AYYAD MAR", "\u212af", "", None,
             "رئاسة جامعة القاضي عياض", "من السيد عميد كلية العلوم", "قرار", "a\nLa Présidence\n", "faculté des ſciences et techniques", "Le  Doyen"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    got = df.select(*(patterns.has(t, p, flags).alias(f"c{i}") for i, p in enumerate(rows))).collect()
    want = df.select(*(F.coalesce(t.rlike(patterns.rx(p, flags)), F.lit(False)).alias(f"c{i}") for i, p in enumerate(rows))).collect()
    assert got == want and any(any(r) for r in got)


def test_classes_are_run_over_not_tried_at_each_place(spark):
    from missiva.functions import normalise, patterns

    df = spark.createDataFrame([(t,) for t in ("", "abc", "٣", "a۹", "\U0001f600", "x\n\u064b", "e\u0301", None)], "t string")
    for letters in (normalise.ARABIC_DIGITS + normalise.PERSIAN_DIGITS, patterns.ARABIC_BLOCK[1:-1], "^" + normalise.COMPOSED):
        assert df.select(patterns.any_of(F.col("t"), letters)).collect() == df.select(F.col("t").rlike(f"[{letters}]")).collect()
    groups = df.select(patterns.groups(F.lit("le 12 mai 2024, le 13 juin 2025"), r"(\d{1,2})\s+(\w+)\s+(\d{4})\b", 3).alias("g")).first()
    assert groups.g == ["12", "mai", "2024"]


def test_a_body_is_found_in_a_long_line_and_rules_are_tried_only_where_they_may_change(spark):
    """The issuing body's first rule began with all of a line, so that it cost the square of the line's length."""
    import time

    from missiva.operators import text_fields

    long = "Université Cadi Ayyad " * 9000
    began = time.time()
    got = spark.createDataFrame([(long,), (long + "La Présidence",)], "t string").select(text_fields.etablissement(F.col("t")).alias("b")).collect()
    assert [r.b for r in got] == [None, "La Présidence - Marrakech"] and time.time() - began < 60
