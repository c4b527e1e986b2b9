"""Script and language rules; four of them, which differ on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from missiva.functions.patterns import any_bytes, any_of, has_arabic, let, others

ARABIC, ARABIC_WIDE = r"[\x{0600}-\x{06FF}]", r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}]"
#: A to Z, a to z, À to ÿ.
LATIN = "".join(map(chr, (*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100))))


def script_counts(t: Column, arabic: str) -> tuple[Column, Column]:
    """Characters of either script. Arabic letters are what is left without the others; of Latin letters, which stand in many short runs, the text without them is shorter."""
    held = F.length(F.regexp_replace(t, others(arabic[1:-1]) + "+", ""))
    return F.when(~any_of(t, arabic[1:-1]), 0).otherwise(held), F.length(t) - F.length(F.translate(t, LATIN, ""))


def has_latin(t: Column, n: int) -> Column:
    """Whether the text has n Latin letters or more: it is read as far as the nth."""
    letters = r"A-Za-z\x{C0}-\x{FF}"
    return t.rlike(rf"\A(?:[^{letters}]*+[{letters}]){{{n}}}")


def language_scan(t: Column) -> Column:
    """Letters are counted only in texts with an Arabic one."""

    def said(a: Column, lat: Column) -> Column:
        ratio = a / (a + lat)
        return F.when(a + lat < 10, "unknown").when(ratio > 0.7, "ar").when(ratio < 0.2, "fr").otherwise("fr+ar")

    def mixed(x: Column) -> Column:
        return let(F.array(*script_counts(x, ARABIC)), lambda n: said(F.get(n, F.lit(0)), F.get(n, F.lit(1))))

    return let(t, lambda x: F.when(x.isNull() | has_arabic(x), mixed(x)).when(has_latin(x, 10), "fr").otherwise("unknown"))


def language_text(t: Column) -> Column:
    """Letters are counted only in texts with an Arabic one."""

    def said(a: Column, lat: Column) -> Column:
        return F.when(a > lat, "ar").when((a > 0) & (a > lat * 0.2), "fr+ar").otherwise("fr")

    def mixed(x: Column) -> Column:
        return let(F.array(*script_counts(x, ARABIC_WIDE)), lambda n: said(F.get(n, F.lit(0)), F.get(n, F.lit(1))))

    return let(t, lambda x: F.when(any_bytes(x, "D8", "D9", "DA", "DB", "DD"), mixed(x)).otherwise("fr"))


def language_zones(t: Column) -> Column:
    """struct(language, arabic_ratio, specialist)."""
    a, lat = script_counts(t, ARABIC_WIDE)
    ratio = F.when(a + lat == 0, 0.0).otherwise(a / (a + lat))
    return F.struct(
        F.when(ratio > 0.6, "ar").when(ratio > 0.15, "fr+ar").otherwise("fr").alias("language"),
        ratio.alias("arabic_ratio"),
        (ratio > 0.2).alias("specialist"),
    )


def ocr_mode(t: Column) -> Column:
    a, lat = script_counts(t, ARABIC)
    ratio = a / (a + lat)
    return F.when(a + lat < 20, "tesseract").when(ratio < 0.15, "tesseract").when(ratio > 0.6, "easyocr").otherwise("hybrid")
