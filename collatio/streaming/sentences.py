"""Sentences and annotation on a stream: both are work on one row, so the batch
operators run unchanged and hold no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from collatio.operators import reports, segment
from collatio.profiles import HAN_CORPUS, TextProfile


def read_json_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def sentence_stream(rows: DataFrame, keys: list[str], text: str, profile: TextProfile = HAN_CORPUS) -> DataFrame:
    return reports.annotate(segment.sentences(rows, keys, text, profile), "plain", profile)


def write_parquet_stream(rows: DataFrame, path: str, checkpoint: str):
    """Starts the query; files are committed exactly once by the checkpoint."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()
