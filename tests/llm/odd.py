"""Documents with every odd case the operators promise to handle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LONG = "lorem ipsum dolor sit amet " * 8000
SCHEMA = (
    "doc_id long, text string, source string, lang string, n_chars long, size string, key string, "
    "place long, gone int, n_lines string, class_id string, slots string, weight string, bucket string"
)


def odd_documents(spark: SparkSession) -> DataFrame:
    extra = ("x",) + (None,) * 10
    rows = [
        (1, "The quick brown fox jumps over the lazy dog near the old stone bridge.", "a", *extra),
        (2, None, "a", *extra),
        (None, "A row without an id but with a text that is long enough for everything.", "b", *extra),
        (3, "", None, *extra),
        (4, " \n\t ", "b", *extra),
        (5, LONG, "a", *extra),
        (5, LONG, "a", *extra),  # repeated row
        (6, LONG, None, *extra),  # copy
        (7, "word", "b", *extra),
        (None, None, None, *extra),
        (8, "Ünïcödé текст 漢字 😀 mixed with plain words on one line here.", "a", *extra),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def empty_documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
