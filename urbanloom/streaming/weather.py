"""Daily weather from a stream of clean hourly Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def daily_stream(spark: SparkSession, path: str, schema: StructType, ts: str, rain: str, temp: str, rad: str, delay: str = "2 days") -> DataFrame:
    """Watermarked daily totals; a day is emitted once the watermark has passed it, late rows are dropped."""
    s = spark.readStream.schema(schema).parquet(path).withColumn("_ts", F.col(ts).cast("timestamp"))
    g = s.withWatermark("_ts", delay).groupBy(F.window("_ts", "1 day")).agg(
        F.sum(rain).alias("rain"), F.avg(temp).alias("temp"), F.avg(rad).alias("radiation")
    )
    return g.select(F.col("window.start").cast("date").alias("date"), "rain", "temp", "radiation")
