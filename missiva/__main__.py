"""Command line: text files in, one JSON object a file out.

``spark-submit missiva/__main__.py PATH [--profile scan|text] [--out FOLDER]``: PATH is a file, a folder or a pattern in
any store that Spark reads. Without --out the objects are printed, at most ``--show`` of them.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from missiva.operators.scan_fields import FIELDS
from missiva.plans.profiles import scan_profile, text_profile
from missiva.sources.files import text_rows

PROFILES = {"scan": scan_profile, "text": text_profile}


def read_letters(spark: SparkSession, path: str, profile: str = "scan") -> DataFrame:
    """path and json: the file's fields, body and language. Files with under ten characters are left out."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("texte_complet"))
    out = PROFILES[profile](text_rows(rows, "texte_complet"))
    shown = F.struct("path", *FIELDS, "corps", "langue_detectee")
    return out.select("path", F.to_json(shown, {"ignoreNullFields": "false"}).alias("json"))


def main(argv: list[str], spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="missiva", description=__doc__.splitlines()[0])
    parser.add_argument("path")
    parser.add_argument("--profile", choices=PROFILES, default="scan")
    parser.add_argument("--out")
    parser.add_argument("--show", type=int, default=20)
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("missiva").getOrCreate()
    letters = read_letters(spark, args.path, args.profile)
    if args.out:
        letters.select("json").write.text(args.out)
    else:
        for row in letters.orderBy("path").limit(args.show).collect():
            print(row.json)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
