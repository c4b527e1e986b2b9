"""Field extraction, scan profile: every field a column expression over the corrected text."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from missiva.functions import rules as R
from missiva.functions.language import ARABIC, script_counts
from missiva.functions.patterns import after, before, best_name, cut, either, end, first_name, folded, group, groups, has, has_arabic, let, mapped, non_empty, rx, start, strip, sub, zone_before

FIELDS = ("numero", "date", "objet", "expediteur", "destinataire", "type_document", "etablissement")


def header(t: Column, ends: tuple[str, ...] = R.SCAN_HEADER_ENDS) -> Column:
    """The text up to 200 characters past the first marker, between 800 and 3000 characters."""
    limit = start(t, either(ends))
    long = F.substring(t, F.lit(1), F.greatest(F.lit(800), F.least(limit + 200, F.lit(3000))))
    return F.when(F.length(t) > 800, long).otherwise(t)  # a shorter text is whole, wherever its markers stand


def sender_zone(t: Column) -> Column:
    return zone_before(t, R.RECIPIENT_START, 1500)


def stamp_zone(t: Column, low: Column | None = None) -> Column:
    """The first arrival stamp's surroundings; null without one. ``low``, here and below: folded(t), where that is known."""

    def around(p: str) -> Column:
        zone = cut(t, start(t, p, "i") - 50, end(t, p, "i") + 400)
        marked = let(zone, lambda z: F.when(reduce(lambda a, b: a | b, (has(z, m, "i") for m in R.SCAN_STAMP_MARKS)), z))
        return F.when(has(t, p, "i", low), marked)

    return F.coalesce(*map(around, R.SCAN_STAMPS))


def date_in(t: Column) -> Column:
    """``DD month YYYY`` of the first rule that gives one."""

    def said(pattern: str, month: Callable[[Column, Column], Column]) -> Column:
        def sentence(g: Column) -> Column:
            day, name, year = (F.get(g, F.lit(i)) for i in range(3))
            named = month(name, year)
            return F.when(named.isNotNull(), F.concat(F.lpad(day, 2, "0"), F.lit(" "), named, F.lit(" "), year))

        return let(groups(t, pattern, 3), sentence)

    def by_number(number: Column, year: Column) -> Column:
        fits = number.cast("int").between(1, 12) & year.cast("int").between(*R.SCAN_NUMERIC_YEARS)
        return F.when(fits, F.get(F.array(*map(F.lit, R.MONTHS)), number.cast("int") - 1))

    return F.coalesce(
        F.when(has_arabic(t), said(R.SCAN_DATE_ARABIC, lambda name, year: mapped(name, R.ARABIC_MONTHS))),
        said(R.SCAN_DATE_FRENCH, lambda name, year: mapped(F.lower(name), R.MONTH_NAMES)),
        said(R.SCAN_DATE_STAMP, lambda name, year: mapped(F.upper(name), R.MONTH_STAMPS)),
        said(R.SCAN_DATE_NUMERIC, by_number),
    )


def numero(t: Column, head: Column) -> Column:
    """The candidates in the order of their scores, 90 to 60."""
    return F.coalesce(
        _joined(head, R.NUMBER_SLASH, 2),
        _joined(head, R.NUMBER_BODY, 3),
        F.when(F.length(group(t, R.NUMBER_ARABIC, 2)) >= 3, _joined(t, R.NUMBER_ARABIC, 2)),
        _joined(t, R.NUMBER_ARABIC_OTHER, 2),
        group(head, R.NUMBER_ALONE),
        group(t, R.NUMBER_ARABIC_ALONE),
        group(head, R.NUMBER_FRAMED),
    )


def _joined(t: Column, pattern: str, n: int) -> Column:
    """Groups 1 to n with slashes between; null without a match."""
    return F.array_join(groups(t, pattern, n), "/")


def stamp_number(zone: Column) -> Column:
    return F.coalesce(*(group(zone, p, 1, "i") for p in R.SCAN_STAMP_NUMBERS))


def clean_objet(s: Column) -> Column:
    s = sub(sub(strip(s), r"\A[_\-=:*\s\|\.]+", ""), r"[_\-=\s]+\z", "")
    return let(sub(s, r"\s+", " "), lambda x: F.when(F.length(x) > 5, x))


def objet(t: Column, low: Column | None = None) -> Column:
    found = [clean_objet(group(t, pattern, 1, flags, low)) for pattern, flags in R.SUBJECTS]
    joint = clean_objet(group(t, R.SUBJECT_JOINT, 1, "s"))
    return F.coalesce(*found, F.when(~F.lower(joint).rlike("^(nature|nombre)"), joint), clean_objet(group(t, R.SUBJECT_ENCLOSED, 1, "s")))


def type_document(t: Column) -> Column:
    return F.coalesce(let(F.substring(t, 1, 3000), lambda x: first_name(x, R.TYPES)), F.lit("lettre"))


def _presidency(zone: Column, low: Column | None = None) -> Column:
    return has(zone, R.PRESIDENCY_LETTERHEAD, "i", low) | has(zone, R.PRESIDENCY_LINE, "im", low)


def etablissement(zone: Column) -> Column:
    president = has(zone, r"من\s+السيد(?:ة)?\s+رئيس\s+الجامعة") | (has(zone, r"رئيس\s+الجامعة") & has(zone, r"جامعة\s+القاض[يى]\s+عياض"))
    return F.coalesce(
        F.when(_presidency(zone), R.PRESIDENCY),
        first_name(zone, R.BODIES_FR, "i"),
        F.when(has_arabic(zone), F.coalesce(first_name(zone, R.BODIES_AR), F.when(president, R.PRESIDENCY))),
    )


def expediteur(t: Column, zone: Column, body: Column) -> Column:
    """zone: sender_zone(t); body: etablissement(zone)."""
    name = strip(group(t, R.SENDER_TITLED, 1))
    opening = F.substring(t, 1, 1500)
    arabic = has_arabic(zone)
    institution = F.when(~_presidency(zone), best_name(zone, R.INSTITUTIONS, "i", arabic))
    inferred = (
        F.when(body.rlike("^(FST-|FSS-|FSJES-|FMP-|FLSH-)"), "Le Doyen")
        .when(body.rlike("^(EST-|ENSA-|CRI-)"), "Le Directeur")
        .when(body.contains("Présidence"), "Le Président")
    )
    in_arabic = F.coalesce(
        F.when(has(t, R.SENDER_PRESIDENT), R.PRESIDENT),
        F.concat(F.coalesce(mapped(name, R.ARABIC_TITLES), name), F.lit(" de "), strip(group(t, R.SENDER_TITLED, 2))),
        F.when(has(opening, r"رئيس\s+الجامعة") & has(opening, r"رئاسة|الرئاسة|جامعة\s+القاض[يى]\s+عياض"), R.PRESIDENT),
    )
    return F.coalesce(
        F.when(has_arabic(t), in_arabic),
        non_empty(F.concat_ws(" — ", first_name(zone, R.TITLES, "", arabic), institution)),
        inferred,
    )


# Words that keep their capitals, and those that lose all, in texts that are all capitals.
ACRONYMS = ("UCA", "FST", "FSS", "FSJES", "CRI", "EST", "ENSA", "ENCG", "FMP", "FLSH")
SMALL_WORDS = ("LE", "LA", "LES", "DE", "DU", "DES", "D'L")


def capitalised(s: Column, kept: tuple[str, ...] = ACRONYMS, small: tuple[str, ...] = SMALL_WORDS) -> Column:
    """A text of over ten characters, all capitals, word by word in mixed case; others as they are."""

    def word(w: Column) -> Column:
        mixed = F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))
        return F.when(w.isin(*kept), w).when(w.isin(*small), F.lower(w)).otherwise(mixed)

    def named(x: Column) -> Column:
        joined = F.array_join(F.transform(F.array_remove(F.split(x, rx(r"\s+")), ""), word), " ")
        return let(joined, lambda j: F.concat(F.upper(F.substring(j, 1, 1)), F.substring(j, F.lit(2), F.length(j))))

    return let(s, lambda x: F.when((x == F.upper(x)) & x.rlike(r"\p{Lu}") & (F.length(x) > 10), named(x)).otherwise(x))


def is_arabic(s: Column) -> Column:
    """Over three Arabic characters, and as many as Latin ones or more."""
    arabic, latin = script_counts(s, ARABIC)
    return (arabic > 3) & (arabic >= latin)


# Words that keep their capitals, and that lose all, in the scan profile.
SCAN_ACRONYMS = ("UCA", "FST", "FSS", "FSJES", "CRI", "EST", "ENSA", "FMP", "FLSH")
SCAN_SMALL_WORDS = ("LE", "LA", "LES", "DE", "DU", "DES")


def clean_destinataire(raw: Column) -> Column:
    s = sub(strip(raw), r"\A[\|\s«»\-,]+", "")
    s = sub(sub(sub(s, r"\n+", ", "), r"\s+", " "), r"[\s,]+\z", "")

    def before_marks(x: Column) -> Column:
        return before(x, R.RECIPIENT_ENDS)

    def finished(x: Column) -> Column:
        latin = before_marks(strip(sub(sub(x, r"[\x{0600}-\x{06FF}]+", ""), r"\s+", " ")))
        return F.when(is_arabic(x), before_marks(x)).otherwise(capitalised(latin, SCAN_ACRONYMS, SCAN_SMALL_WORDS))

    return let(let(s, finished), lambda x: F.when(F.length(x) > 5, strip(x)))


def destinataire(t: Column) -> Column:
    line, following = strip(group(t, R.RECIPIENT_FREE, 1)), non_empty(group(t, R.RECIPIENT_FREE, 2))
    more = F.when(~has(following, R.RECIPIENT_OVER), strip(following))
    in_arabic = F.coalesce(clean_destinataire(group(t, R.RECIPIENT_ARABIC)), F.when(has(line, R.RECIPIENT_NAMES), clean_destinataire(F.concat_ws(" ", line, more))))
    return F.coalesce(
        clean_destinataire(group(t, R.RECIPIENT_FRENCH)),
        F.when(has_arabic(t), in_arabic),
        clean_destinataire(group(t, R.RECIPIENT_LABEL)),
    )


def corps(t: Column, low: Column | None = None) -> Column:
    """What stands between the subject's line and the closing formula."""
    inner = strip(before(after(t, R.BODY_OPENING, "i", low), either(R.BODY_ENDS)))
    body = let(inner, lambda x: F.when(x.contains("\n\n\n"), sub(x, r"\n{3,}", "\n\n")).otherwise(x))
    return let(F.when(F.length(t) >= 50, body), lambda b: F.when(F.length(b) > 30, b))


def extract(df: DataFrame, text: str = "texte_complet") -> DataFrame:
    """df with the fields, ``corps`` and has_stamp, in layers so that each zone is worked out once."""
    t = F.col(text)
    low, zone = F.col("_low"), F.col("_zone")
    zones = df.withColumns({"_low": folded(t), "_head": header(t), "_zone": sender_zone(t)})
    first = zones.withColumns({"_stamp": stamp_zone(t, low), "etablissement": etablissement(zone)})
    head = F.col("_head")
    short = F.length(strip(t)) < 5
    stamped, over = F.col("_stamp").isNotNull(), F.length(head) < F.length(t)
    values = {
        "numero": F.coalesce(F.when(stamped, stamp_number(F.col("_stamp"))), numero(t, head)),
        "date": F.coalesce(F.when(stamped, date_in(F.col("_stamp"))), date_in(head), F.when(over, date_in(cut(t, F.length(head), F.length(t))))),
        "objet": objet(t, low),
        "expediteur": expediteur(t, zone, F.col("etablissement")),
        "destinataire": destinataire(t),
        "type_document": type_document(t),
        "corps": corps(t, low),
        "has_stamp": F.col("_stamp").isNotNull(),
    }
    out = first.withColumns(values).withColumn("type_document", F.when(short | t.isNull(), "lettre").otherwise(F.col("type_document")))
    return out.drop("_low", "_head", "_zone", "_stamp")
