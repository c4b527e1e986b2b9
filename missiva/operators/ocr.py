"""What surrounds an OCR engine: choosing, ordering, joining. The engine itself is injected (see sources.files)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from missiva.functions.language import ARABIC, language_scan, ocr_mode
from missiva.functions.patterns import sub

PAGE_BREAK = "\n\n--- Page suivante ---\n\n"


def lines_of_words(words: DataFrame) -> DataFrame:
    """doc_id, text: words with text, in lines by (block, paragraph, line), each from left to right."""
    full = words.filter(F.trim("text") != "")
    lines = full.groupBy("doc_id", "block_num", "par_num", "line_num").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("left", "ord", "text"))), lambda w: w["text"]), " ").alias("line")
    )
    return lines.groupBy("doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_num", "par_num", "line_num", "line"))), lambda x: x["line"]), "\n").alias("text")
    )


def reading_order(found: DataFrame, gap: float = 20.0) -> DataFrame:
    """doc_id, line, place, text: boxes by mean y; a step of ``gap`` or more begins a line; Arabic lines run right to left."""
    down = Window.partitionBy("doc_id").orderBy("y_mean", "ord")
    step = F.col("y_mean") - F.lag("y_mean").over(down)
    lined = found.withColumn("_new", F.when(step >= gap, 1).otherwise(0)).withColumn("line", F.sum("_new").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    arabic = F.max(F.col("text").rlike(ARABIC)).over(Window.partitionBy("doc_id", "line"))
    key = F.when(arabic, -F.col("x_max")).otherwise(F.col("x_max"))
    across = Window.partitionBy("doc_id", "line").orderBy("_key", "ord")
    return lined.withColumn("_key", key).select("doc_id", "line", F.row_number().over(across).alias("place"), "text")


def word_confidence(words: DataFrame) -> DataFrame:
    """doc_id, confidence: mean of the positive word confidences / 100; 0.5 without any."""
    return words.groupBy("doc_id").agg(F.coalesce(F.avg(F.when(F.col("conf") > 0, F.col("conf"))) / 100, F.lit(0.5)).alias("confidence"))


def variants_text(runs: DataFrame) -> DataFrame:
    """doc_id, text: the texts of all of a document's image variants in order, blank ones left out, with an empty line between."""
    full = runs.filter(F.trim("text") != "")
    return full.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda v: v["text"]), "\n\n").alias("text"))


def engine_asked(requested: Column, quick_text: Column) -> Column:
    """The engine for a page: the one requested, or for ``auto`` the one that a quick look at its text calls for."""
    return F.when(requested == "auto", ocr_mode(quick_text)).otherwise(requested)


def dispatched(engine: Column, results: dict[str, Column]) -> Column:
    """The result (text, engine) of the engine asked for; if that has no text, Tesseract's, then EasyOCR's; else ``failed``."""
    own = F.coalesce(*(F.when(engine == name, r) for name, r in results.items()))
    return first_text(own, results["tesseract"], results["easyocr"])


def hybrid(arabic_easy: Column, arabic_tess: Column, conf_easy: Column, conf_tess: Column) -> Column:
    return F.when(arabic_easy > arabic_tess * 1.3, "easyocr").when(conf_easy > conf_tess, "easyocr").otherwise("tesseract")


def hybrid_weighted(arabic_ratio: Column, conf_specialist: Column, conf_tess: Column) -> Column:
    """Above 0.3 of Arabic the specialist counts 1.3 and Tesseract 0.9; else Tesseract 1.1; Tesseract wins ties."""
    tess = conf_tess * F.when(arabic_ratio > 0.3, 0.9).otherwise(1.1)
    other = conf_specialist * F.when(arabic_ratio > 0.3, 1.3).otherwise(1.0)
    return F.when(tess >= other, "tesseract").otherwise("specialist")


def segmentation_score(conf: Column, chars: Column) -> Column:
    return 0.7 * conf + 0.3 * F.least(chars / 500, F.lit(1.0))


def best_segmentation(runs: DataFrame) -> DataFrame:
    """doc_id, psm, score: the best of a document's runs; the first wins ties. runs: doc_id, ord, psm, conf, chars."""
    score = segmentation_score(F.col("conf"), F.col("chars"))
    best = runs.groupBy("doc_id").agg(F.max(F.struct(score.alias("score"), (-F.col("ord")).alias("_ord"), "psm")).alias("b"))
    return best.select("doc_id", "b.psm", "b.score")


def first_text(*results: Column) -> Column:
    """The first of the (text, engine) structs with text; engine ``failed`` without any."""
    full = [F.when(F.trim(r["text"]) != "", r) for r in results]
    return F.coalesce(*full, F.struct(F.lit("").alias("text"), F.lit("failed").alias("engine")))


def merge_pages(pages: DataFrame) -> DataFrame:
    """doc_id, text, engine, confidence, langue: pages in order, engines sorted, mean confidence."""
    merged = pages.groupBy("doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda p: p["text"]), PAGE_BREAK).alias("text"),
        F.array_join(F.array_sort(F.collect_set("engine")), ",").alias("engine"),
        F.avg("confidence").alias("confidence"),
    )
    return merged.withColumn("langue", language_scan(F.col("text")))


def arabic_fix(text: Column, arabic_ratio: Column) -> Column:
    """Above 0.1 of Arabic: single spaces, and no Latin letter between Arabic ones."""
    fixed = sub(sub(text, r"\s+", " "), r"([\x{0600}-\x{06FF}])[a-zA-Z]([\x{0600}-\x{06FF}])", "$1$2")
    return F.when(arabic_ratio > 0.1, fixed).otherwise(text)
