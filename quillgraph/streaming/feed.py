"""Postings of a stream of documents, and windowed term counts with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import text as T


def postings_stream(documents: DataFrame) -> DataFrame:
    """documents(id, text, at) as a stream -> item, term, tf, len, at: stateless, so it may be written with any trigger."""
    words = T.tokens(F.coalesce("text", F.lit("")))
    counted = F.transform(F.array_distinct(words), lambda w: F.struct(w.alias("term"), F.size(F.filter(words, lambda x: x == w)).alias("tf")))
    return documents.select("id", "at", F.size(words).alias("len"), F.explode(counted).alias("p")).select(F.col("id").alias("item"), "p.term", "p.tf", "len", "at")


def term_counts(documents: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Per event-time window and term the documents and occurrences; rows later than `late` are dropped by the watermark."""
    rows = postings_stream(documents.withWatermark("at", late))
    return rows.groupBy(F.window("at", window).alias("window"), "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).select(F.col("window.start").alias("start"), "term", "df", "cf")
