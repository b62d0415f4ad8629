"""Frozen fits over streams: scaling, projection and label votes of new rows, without refitting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.scalers import FittedScaler
from tessella.operators.space import FittedSpace


def table_stream(spark: SparkSession, path: str, schema, *, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def scaled(stream: DataFrame, scaler: FittedScaler) -> DataFrame:
    return scaler.apply(stream)


def projected(stream: DataFrame, scaler: FittedScaler, space: FittedSpace, id_col: str) -> DataFrame:
    rows = scaler.apply(stream).select(id_col, F.array(*[F.col(c) for c in scaler.columns]).alias("features"))
    return space.transform(rows, id_col)


def windowed_counts(events: DataFrame, *, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and sum of values by hour and type; rows over `late` behind are dropped when run as a stream."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    out = marked.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
