"""Keyword recall over stored notes, and fingerprints of their subjects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that say nothing about a subject.
STOP_WORDS = (
    "the and for with this that from into over under about what when where which while will would could should does did are was were has have had "
    "you your our its his her their them they can may might must let now then than too very just also how why use using"
).split()


def keywords(text: Column) -> Column:
    """Distinct lower-case words of two or more ASCII letters, digits or underscores."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9_]{2,}"), F.lit(0)))


def keyword_recall(notes: DataFrame, query: str, limit: int = 16) -> DataFrame:
    """Per session: the notes that share most words with the query, plus a tenth of their importance; ties go to the newest."""
    score = F.size(F.array_intersect(keywords(F.col("content")), keywords(F.lit(query)))) + F.col("importance") / 10
    best = Window.partitionBy("session_id").orderBy(F.col("score").desc(), F.col("created_seq").desc())
    return notes.withColumn("score", score).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit).select("session_id", "rank", "note_id", "score")


def count_by_kind(notes: DataFrame) -> DataFrame:
    return notes.where("not forgotten").groupBy("kind").agg(F.count("*").alias("notes"))


def text_fingerprint(text: Column, words: int = 6) -> Column:
    """Eight hex digits that order, case, numbers and punctuation don't change; ``-`` for a text without significant words."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]+"), F.lit(0)))
    kept = F.slice(F.array_sort(F.array_except(F.filter(found, lambda w: F.length(w) > 2), F.array(*[F.lit(w) for w in STOP_WORDS]))), 1, words)
    return F.when(F.size(kept) > 0, F.substring(F.sha2(F.array_join(kept, " ").cast("binary"), 256), 1, 8)).otherwise("-")
