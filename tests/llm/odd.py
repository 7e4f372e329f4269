"""Rows that every operator must bear: nulls, empty and long texts, ties, repeats, and extra columns that clash."""

from pyspark.sql import functions as F

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{k % 997}" for k in range(40_000))
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, "   \n\t ", "en", "a", 6), (4, LONG, "en", "b", len(LONG)), (5, LONG, "en", "b", len(LONG)),
    (6, "one two three four five six", "en", "a", 27), (6, "one two three four five six", "en", "a", 27), (None, "no id at all", "en", None, 12),
    (None, None, None, None, None), (7, "x" * 100_000, "en", "c", 100_000), (8, "Été çà \U0001f600 là", "fr", "c", 10),
]
CLASHES = ("fp", "size", "score", "held_out", "copies", "taken", "target", "component_id", "spans", "rank", "key", "row")


def odd_documents(spark, more=()):
    rows = spark.createDataFrame([*ODD, *more], COLUMNS)
    return rows.select("*", *[F.lit("clash").alias(c) for c in CLASHES])


def no_documents(spark):
    return spark.createDataFrame([], COLUMNS)
