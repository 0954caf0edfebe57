"""The test tables as timelines: which columns stand for assets, segments, signals and frames.

The tables hold no media, so each idea has a stand-in of the same shape: users and event types are assets,
event times are hours since the first day, values are durations in minutes or luma, embeddings are 8 by 8
pictures, parts are sizes and orders are cache entries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOURS = 720.0
SIDE, TILE = 8, 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, asset_id (a user), event_type, value, t (hours)."""
    t = (F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000)) / F.lit(3.6e9)
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("asset_id"), "event_type", "value", t.alias("t"))


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same events with their type as the asset: few assets of many times."""
    return events(spark, sf_dir).select("event_id", F.col("event_type").alias("asset_id"), "value", "t")


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("asset_id").distinct().withColumn("duration", F.lit(HOURS))


def dense_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense(spark, sf_dir).select("asset_id").distinct().withColumn("duration", F.lit(HOURS))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("asset_id", F.col("event_id").alias("seq"), F.col("t").alias("start_s"), (F.col("t") + F.col("value") / 60.0).alias("end_s"), F.col("event_type").alias("text"))


def silence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir).filter("text = 'error'").select("asset_id", "seq", "start_s", "end_s")


def luma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("asset_id", "event_id", "t", F.col("value").alias("yavg"))


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("asset_id", F.col("t").alias("pts"), (F.col("event_type") == "view").alias("is_key"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asset_id (a label), t (the vector's id), thumb (8 by 8)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").cast("string").alias("asset_id"), F.col("vec_id").cast("double").alias("t"), F.col("embedding").alias("thumb"))


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p_partkey, width, height: wide and tall sources of many sizes."""
    w = 160 + F.col("p_size") * 32
    even = F.col("p_partkey") % 2 == 0
    return table(spark, sf_dir, "part").select("p_partkey", w.alias("width"), F.when(even, F.floor(w * 9 / 16)).otherwise(F.floor(w * 16 / 9)).cast("int").alias("height"))
