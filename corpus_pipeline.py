"""A training corpus from the documents table: cleaning, line dedup, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; run() writes each stage's rows to the
shared folder as Parquet and reads them again. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from missiva.llm import jaccard, line_dedup, mixing, packing, quality
from missiva.llm.common import SPACES, drop, table, written


def _with_text(docs: DataFrame, columns: list[str], text: str) -> DataFrame:
    """The columns of ``doc`` with another text (a null text stays null) and its length."""
    new = F.when(F.col("doc.text").isNull(), F.col("doc.text")).otherwise(F.col(text))
    changed = {"text": new} | ({"n_chars": F.length(new).cast("long")} if "n_chars" in columns else {})
    return docs.select(*((changed[c] if c in changed else F.col(f"doc.`{c}`")).alias(c) for c in columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail a rule go; documents that fail the base conditions or lose over half of their words go.

    Null and empty texts have too few words and go. Repeated rows are judged one by one. Columns other than text and
    n_chars stay as they are, null or not. An empty table stays empty.
    """
    return _with_text(quality.quality(docs, keep_columns=True).filter("kept"), docs.columns, "cleaned")


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go, and with them documents of which no word is left.

    Such a document held nothing but lines of earlier ones. Documents that had no word before (null texts among them)
    stay as they are; so do rows with a null doc_id but for lines that other documents hold (null counts as the largest
    doc_id). Repeated rows are treated alike. Other columns stay. An empty table stays empty.
    """
    rows = line_dedup.deduplicated_lines(docs, keep_columns=True)
    emptied = (F.col("n_dropped") > 0) & (F.btrim("kept_text", F.lit(SPACES)) == "")
    return _with_text(rows.filter(~emptied), docs.columns, "kept_text")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates stays, that with the least doc_id.

    Rows without words (null texts among them) all stay. Of rows with equal doc_id and text one stays; of ties of doc_id
    the text with the least hash. A null doc_id counts as the largest. Other columns stay. An empty table stays empty.
    """
    return jaccard.without_near_duplicates(docs)


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, which may be never.

    A null source is a source of its own, the last. Null and empty texts have size 0 and are taken at their source's
    rate. Rows with the same doc_id draw alike, null ones among them. Other columns stay. An empty table stays empty.
    """
    return mixing.mixed(docs)


def packing_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences: doc_id (null stays null), places, lengths and digests.

    Null and empty texts are the end id alone; repeated rows are packed each; columns other than doc_id and text are not
    read. An empty table gives no pieces.
    """
    return packing.pack(docs, special=True)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_deduplication),
    ("near duplicates", near_duplicates),
    ("mixing", mixing_to_weights),
    ("packing", packing_sequences),
]

#: SQL has no tokeniser; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the packed corpus; a stage's table goes when the next stage has been written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        drop(before)
    return docs
