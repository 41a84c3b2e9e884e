"""Odd documents: nulls everywhere, empty and very long texts, repeated rows, columns with names that operators use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASHES = ("fp", "rep", "component_id", "size", "score", "label", "id", "k", "n", "train", "ref", "held_out", "word", "a", "b", "src", "target", "v")
LONG = "the long story goes on and on " * 4000
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from it.", "en", "s1", 66),
    (2, "The quick brown fox jumps over the lazy dog and runs away from it.", "en", "s2", 66),
    (2, "The quick brown fox jumps over the lazy dog and runs away from it.", "en", "s2", 66),
    (3, None, None, None, None),
    (4, "", "de", "", 0),
    (5, "   \n\t ", "fr", "s1", 6),
    (6, LONG, "en", "s1", len(LONG)),
    (None, "Ein Text ohne Nummer, der aber da ist.", "de", "s3", 38),
    (7, "1234 5678 !!! ??? ###", None, "s3", 21),
    (8, "héllo wörld ñandú 漢字 🙂 \u0000 x", "es", None, 20),
]


def documents(spark: SparkSession, rows: list[tuple] = ROWS) -> DataFrame:
    return spark.createDataFrame(rows, SCHEMA)


def clashing(docs: DataFrame) -> DataFrame:
    for name in CLASHES:
        docs = docs.withColumn(name, F.lit(f"clash {name}"))
    return docs


def sample(spark: SparkSession, data: str) -> DataFrame:
    return spark.read.parquet(f"{data}/documents.parquet")
