"""OCR text repair: the two profiles as ordered steps on one column, all native but NFC."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from missiva.functions.patterns import any_bytes, any_of, folded, has_arabic, let, may_hold, rx, sub

# Digits, quotes and dashes.
ARABIC_DIGITS, PERSIAN_DIGITS, LATIN_DIGITS = "٠١٢٣٤٥٦٧٨٩", "۰۱۲۳۴۵۶۷۸۹", "0123456789"
QUOTES, PLAIN_QUOTES = "’‘“”", "''\"\""
DASHES = r"[\x{2010}-\x{2015}\x{2212}]"
HARAKAT = r"[\x{064B}-\x{0670}\x{065F}]"

# Arabic spellings that both profiles repair.
ARABIC_BOTH = (
    (r"\bعيا[دظذ]\b", "عياض"),
    (r"\bالموضوغ\b", "الموضوع"),
    (r"\bالموصوع\b", "الموضوع"),
    (r"\bالموظوع\b", "الموضوع"),
)
# Word endings in the text profile (no boundary before) and in the scan profile (one on both sides).
ENDINGS_TEXT = (("رئاسه", "رئاسة"), ("جامعه", "جامعة"), ("كليه", "كلية"), ("مدرسه", "مدرسة"), ("مدينه", "مدينة"), ("لجنه", "لجنة"), ("رسالـ?ه", "رسالة"))
ENDINGS_SCAN = (("رئاسه", "رئاسة"), ("جامعه", "جامعة"), ("كليه", "كلية"), ("مدرسه", "مدرسة"), ("رسالـ?ه", "رسالة"))
HAMZA_TEXT = (("ابريل", "أبريل"), ("اكتوبر", "أكتوبر"), ("اغسطس", "أغسطس"), ("استاذ", "أستاذ"))
HAMZA_SCAN = HAMZA_TEXT[:3]
MONTH_ALTERNATIVES = (
    "JAN|FEV|MAR|AVR|AOU|SEP|OCT|NOV|DEC|AVRI|AVRIL|FEVR|MARS|JUIN|JUIL|JUILLET|AOUT|SEPT|OCTOBRE|NOVEMBRE|DECEMBRE|"
    "janvier|février|mars|avril|mai|juin|juillet|août|septembre|octobre|novembre|décembre"
)

# Repairs as (pattern, replacement, flags), in the order in which they are made.
YEARS = ((r"\b20[6-9]6\b", "2026", ""), (r"\b[6-9]026\b", "2026", ""), (r"(?<![\d])4(20[2-9]\d)\b", "$1", ""))
FRENCH_TEXT = (
    (r"CADI\s+AW?A?Y?A?D", "CADI AYYAD", "i"),
    (r"\bCRl[\s\-]", "CRI-", ""),
    (r"\bN\s*['\"`´]\s*(?=[\s:.]*\d)", "N° ", ""),
    (r"(\b\d{1,2}\s+)AR(\.|\\s)", "$1AVR$2", ""),
    (r"\b[ÀÂA][VY]R(?:IL)?\b", "AVR", "i"),
    (r"\b(\d{1,2})\s+MR\.?\s+(20\d{2})\b", "$1 AVR $2", ""),
    (r"\b(\d)\s+(\d)\s+(AVR|JAN|FEV|MAR|MAI|JUIN|JUIL|AOU|SEP|OCT|NOV|DEC)\b", "$1$2 $3", "i"),
    (rf"(\b(?:{MONTH_ALTERNATIVES})\.?\s+)9(0\d{{2}})\b", "$12$2", "i"),
)
FRENCH_SCAN = (
    (r"CADI\s+AW?A?Y?A?D", "CADI AYYAD", "i"),
    (r"\bCRl(?=\s|\-|$)", "CRI", "i"),
    (r"\bN\s*['\"`´]\s*(?=[\s:.]*\d)", "N° ", "i"),
    (r"(\b\d{1,2}\s+)AR(\.|\s)", "$1AVR$2", "i"),
    (r"\b(JAN|FEV|MAR|AVR|MAI|JUI|AOU|SEP|OCT|NOV|DEC)\.?\s+9(0\d{2})\b", "$1. 2$2", "i"),
)
UNIVERSITY = (r"القاض[ى]\s+عياض", "القاضي عياض", "")
TO, ON = (r"(?<=\s)إلي(?=\s)", "إلى", ""), (r"(?<=\s)علي(?=\s)", "على", "")
ARABIC_TEXT = (
    UNIVERSITY,
    TO,
    ON,
    *((wrong + r"\b", right, "") for wrong, right in ENDINGS_TEXT),
    *((wrong, right, "") for wrong, right in ARABIC_BOTH),
    *((rf"\b{wrong}\b", right, "") for wrong, right in HAMZA_TEXT),
    (r"\bرئاسئ\b", "رئاسة", ""),
)
ARABIC_SCAN = (
    *((rf"\b{wrong}\b", right, "") for wrong, right in ENDINGS_SCAN),
    UNIVERSITY,
    *((wrong, right, "") for wrong, right in ARABIC_BOTH),
    TO,
    *((rf"\b{wrong}\b", right, "") for wrong, right in HAMZA_SCAN),
)
STAMP_DAYS = ((r"\b(\d)\s+(\d)\s+(AVR|JAN|FEV|MAR|MAI|JUI|AOU|SEP|OCT|NOV|DEC)", "$1$2 $3", "i"),)
MARKS = (("ـ+", "", ""), (HARAKAT, "", ""), ("﷽", "بسم الله الرحمن الرحيم", ""), *((rf"\s*{mark}\s*", f"{mark} ", "") for mark in "،؛؟"))
NOISE_LINES = ((r"^[\s\-_.=·•]+$", "", "m"),)
SPACES = ((r"\t[ \t]*| [ \t]+", " ", ""), (r"\n{4,}", "\n\n\n", ""))

#: What a text holds, one of these, that a repair may change, for each pattern that has such; ``contains`` is far cheaper than the pattern.
HELD = {
    FRENCH_TEXT[1]: ("CRl",),
    FRENCH_TEXT[3]: ("AR",),
    FRENCH_TEXT[5]: ("MR",),
    FRENCH_TEXT[7]: ("90",),
    FRENCH_SCAN[4]: ("90",),
    SPACES[0]: ("\t", "  "),
    SPACES[1]: ("\n\n\n\n",),
    **{rule: (rule[0][3],) for rule in MARKS[3:]},
    MARKS[0]: ("ـ",),
}

#: The same for a rule without case, looked for in the text in lower case.
HELD_CASELESS = {FRENCH_TEXT[4]: ("vr", "yr")}
#: A pattern that each match of a rule's holds one of, and that is tried far sooner than one that begins with ``\b``.
SOONER = {
    FRENCH_TEXT[2]: r"N\s*['\"`´]",
    FRENCH_SCAN[2]: r"[Nn]\s*['\"`´]",
    FRENCH_TEXT[6]: r"\d\s+\d\s+\w",
    STAMP_DAYS[0]: r"\d\s+\d\s+\w",
}
#: Of what a year repair may change, one stands in the text.
YEARS_HELD = ("026", *(f"20{i}6" for i in range(6, 10)), *(f"420{i}" for i in range(2, 10)))

#: Characters that composition leaves alone wherever they stand: all below U+0300, Arabic letters without marks, common
#: punctuation. A text of these alone is composed already.
COMPOSED = (
    r"\x{0}-\x{02FF}\x{0600}-\x{060F}\x{061B}-\x{064A}\x{0660}-\x{066F}\x{0671}-\x{06D5}\x{06EE}-\x{06FF}"
    r"\x{2010}-\x{2027}\x{20AC}\x{2116}\x{2122}"
)


@F.pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def nfc(t: Column) -> Column:
    """Unicode's canonical composition, which Spark has no function for. Only texts that may need it are sent to Python."""
    return F.coalesce(_nfc(F.when(any_of(t, f"^{COMPOSED}"), t)), t)


def where(t: Column, holds: Callable[[Column], Column], then: Callable[[Column], Column]) -> Column:
    """then(t) where holds(t), else t; t, which earlier steps made, is worked out once."""
    return let(t, lambda x: F.when(holds(x), then(x)).otherwise(x))


def _may_change(rule: tuple[str, str, str], t: Column, low: Column | None) -> Column | None:
    if rule in SOONER:
        return t.rlike(rx(SOONER[rule]))
    if rule in HELD_CASELESS:
        return let(folded(t) if low is None else low, lambda x: reduce(lambda a, b: a | b, (x.contains(y) for y in HELD_CASELESS[rule])))
    if rule in HELD:
        return reduce(lambda a, b: a | b, (t.contains(x) for x in HELD[rule]))
    return may_hold(t, rule[0], rule[2], low)


def repaired(t: Column, rules: tuple[tuple[str, str, str], ...]) -> Column:
    """The rules one after the other, each only where the text holds what it may change; the text in lower case is made anew only where a rule changed it."""
    caseless = any("i" in flags for _, _, flags in rules)

    def state(x: Column) -> Column:
        return F.struct(x.alias("t"), folded(x).alias("low"))

    def one(held: Column, rule: tuple[str, str, str]) -> Column:
        def then(s: Column) -> Column:
            x, may = s["t"], _may_change(rule, s["t"], s["low"])
            changed = let(sub(x, *rule), lambda y: F.when(y == x, s).otherwise(state(y)))
            return changed if may is None else F.when(may, changed).otherwise(s)

        return let(held, then)

    def plain(x: Column, rule: tuple[str, str, str]) -> Column:
        """The rule by itself; most are, since what nests deeply takes Spark long to analyse."""
        if _may_change(rule, x, None) is None:
            return sub(x, *rule)
        return where(x, lambda y: _may_change(rule, y, None), lambda y: sub(y, *rule))

    return reduce(one, rules, let(t, state))["t"] if caseless and len(rules) > 1 else reduce(plain, rules, t)


def quotes_dashes(t: Column) -> Column:
    return where(t, lambda x: any_bytes(x, "E280", "E28892"), lambda x: sub(F.translate(x, QUOTES, PLAIN_QUOTES), DASHES, "-"))


def digits(t: Column) -> Column:
    return where(t, lambda x: has_arabic(x) & any_of(x, ARABIC_DIGITS + PERSIAN_DIGITS), lambda x: F.translate(x, ARABIC_DIGITS + PERSIAN_DIGITS, LATIN_DIGITS * 2))


def unflatten(t: Column) -> Column:
    """Runs of spaces become line ends where there are three or more, and more than lines."""

    def flat(x: Column) -> Column:
        runs = F.regexp_count(x, F.lit("  +"))
        lines = F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
        return x.contains("  ") & (runs >= 3) & (runs > lines)

    return where(t, flat, lambda x: sub(x, " {2,}", "\n"))


def years(t: Column) -> Column:
    return where(t, lambda x: reduce(lambda a, b: a | b, (x.contains(y) for y in YEARS_HELD)), lambda x: repaired(x, YEARS))


def marks(t: Column) -> Column:
    """Tatweel and vowel marks go, the basmala ligature is spelt out, Arabic punctuation is spaced."""
    return where(t, lambda x: has_arabic(x) | x.contains("﷽"), lambda x: repaired(x, MARKS))


def noise_lines(t: Column) -> Column:
    return repaired(t, NOISE_LINES)


def spaces(t: Column) -> Column:
    return repaired(t, SPACES)


def french_text(t: Column) -> Column:
    return repaired(t, FRENCH_TEXT)


def french_scan(t: Column) -> Column:
    return repaired(t, FRENCH_SCAN)


def arabic_text(t: Column) -> Column:
    return where(t, has_arabic, lambda x: repaired(x, ARABIC_TEXT))


def arabic_scan(t: Column) -> Column:
    return where(t, has_arabic, lambda x: repaired(x, ARABIC_SCAN))


def stamp_days(t: Column) -> Column:
    return repaired(t, STAMP_DAYS)


def normalise_text(t: Column) -> Column:
    """The text profile."""
    for step in (quotes_dashes, unflatten, years, french_text, arabic_text, digits, marks, noise_lines, spaces):
        t = step(t)
    return t


def normalise_scan(t: Column, compose: bool = True) -> Column:
    """The scan profile; compose=False leaves out NFC, the one step that needs Python, for texts known to be composed."""
    t = nfc(t) if compose else t
    for step in (quotes_dashes, digits, unflatten, french_scan, arabic_scan, stamp_days, spaces, noise_lines):
        t = step(t)
    return t
