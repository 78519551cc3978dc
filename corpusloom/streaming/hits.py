"""Collected hits as a stream: records that come again are dropped, arrivals are counted in windows.

An extension: what this engine computes is batch work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import utc_time
from ..sources.collect import ENVELOPE


def read_hits(spark: SparkSession, path: str, files_at_once: int = 100) -> DataFrame:
    """Envelopes from JSON lines that are added to a folder; retrieved_at is null for those without a real time."""
    raw = spark.readStream.schema(ENVELOPE).option("maxFilesPerTrigger", files_at_once).json(path)
    return raw.withColumn("retrieved_at", utc_time("retrieved_at_utc"))


def first_hits(hits: DataFrame, record_id: str, late: str = "1 day") -> DataFrame:
    """Each record of a source once; state of ids older than the watermark is given up."""
    known = hits.withColumn("record_id", F.get_json_object("raw_record", record_id))
    return known.withWatermark("retrieved_at", late).dropDuplicatesWithinWatermark(["source", "record_id"])


def arrivals(hits: DataFrame, late: str = "1 hour", width: str = "10 minutes") -> DataFrame:
    """Hits by source and window of time."""
    return hits.withWatermark("retrieved_at", late).groupBy(F.window("retrieved_at", width), "source").agg(F.count("*").alias("hits")).select(F.col("window.start").alias("start"), "source", "hits")
