"""A synthetic motion field over the events table: pictures of 8 x 8 blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinefield.operators.vectors import export


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, video, frame, source, bx, by_, mvx, mvy, cx, cy and columns of the event."""
    e = F.col("event_id")
    rows = events(spark, sf_dir).select(
        e.alias("seq"),
        F.floor(e / 4096).cast("int").alias("video"),
        F.floor(e / 64).cast("int").alias("frame"),
        F.when(F.col("event_type").isin("click", "view"), 1).otherwise(-1).alias("source"),
        (e % 8).cast("int").alias("bx"),
        (F.floor(e / 8) % 8).cast("int").alias("by_"),
        ((e * 7919 + F.col("user_id") * 31) % 129 - 64).cast("int").alias("mvx"),
        ((e * 104729 + F.col("user_id") * 17) % 129 - 64).cast("int").alias("mvy"),
        "user_id",
        "event_type",
        "value",
    )
    return rows.withColumns({"cx": F.col("bx") * 16 + 8, "cy": F.col("by_") * 16 + 8, "mv_x": F.col("mvx"), "mv_y": F.col("mvy")})


def vectors(spark: SparkSession, sf_dir: str, codec: str = "h264") -> DataFrame:
    return export(blocks(spark, sf_dir), codec)
