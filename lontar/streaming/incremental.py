"""Extension: prepared rows from a stream of raw JSON lines. The strategies used here are stateless."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lontar.functions import text as X

RAW = "docid string, doc_id string, id string, title string, text string"


def raw_passages(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(RAW)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)


def prepared_stream(raw: DataFrame, strategy: str = "naive_strip", suffix: str = "nya") -> DataFrame:
    """id, contents under a strategy that needs no dictionary; rows without an id or text are left out."""
    rewrite = {"keep": X.keep, "naive_strip": lambda c: X.naive_strip(c, suffix), "sentinel": lambda c: X.sentinel(c, suffix)}[strategy]
    rows = raw.select(X.first_filled(F.col("docid"), F.col("doc_id"), F.col("id")).alias("id"), X.first_filled(F.col("title")).alias("title"), X.first_filled(F.col("text")).alias("text"))
    return rows.where("id is not null and text is not null").select("id", rewrite(F.concat_ws("\n", "title", "text")).alias("contents"))


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events and their summed value by window and type, for rows (ts, event_type, value) at most ``late`` late."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("w.start", "w.end", "event_type", "n", "total")
