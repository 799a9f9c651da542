"""Pretoken counts that are kept up to date while a corpus grows (Structured Streaming)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tokenloom.functions.text import byte_level, split


def pretoken_stream(docs: DataFrame, mode: str = "nanochat", text: str = "text") -> DataFrame:
    """Running (pretoken, frequency) of a stream of documents; use output mode update or complete."""
    words = docs.select(F.explode(split(text, mode)).alias("word")).where("word <> ''")
    return words.groupBy(byte_level(F.col("word")).alias("pretoken")).agg(F.count("*").alias("frequency"))


def windowed_stream(docs: DataFrame, time: str, width: str, delay: str, mode: str = "nanochat") -> DataFrame:
    """Counts by window of event time; rows later than ``delay`` are dropped, as watermarks do."""
    words = docs.withWatermark(time, delay).select(time, F.explode(split("text", mode)).alias("word")).where("word <> ''")
    return words.groupBy(F.window(time, width), byte_level(F.col("word")).alias("pretoken")).agg(F.count("*").alias("frequency"))


def start(counts: DataFrame, checkpoint: str, write, mode: str = "update") -> StreamingQuery:
    """Run a stream; ``write(batch, id)`` gets each micro-batch."""
    return counts.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write).start()
