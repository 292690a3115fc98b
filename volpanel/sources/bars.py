"""Bars from ticks and from CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from volpanel.operators.prep import window_of
from volpanel.sources.schema import BAR_COLUMNS, BAR_SCHEMA

BAD = "bad_line"


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of the paths that are there, by the file system that holds each."""
    found = []
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            found.append(path)
    return found


def read_bars(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    """Bars of all given CSV files in one read, with a fixed schema; None if none of them is there.

    Files that are missing are passed over.  A line that does not fit the schema (torn, or
    with values that are no numbers) keeps what could be read, and is itself in ``bad_line``.
    """
    there = existing(spark, paths)
    if not there:
        return None
    schema = T.StructType([*BAR_SCHEMA.fields, T.StructField(BAD, T.StringType())])
    return spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).csv(there, header=True)


def write_bars(bars: DataFrame, path: str) -> None:
    """CSV sink with a header, in order of asset and date; a rerun replaces the folder."""
    ordered = bars.select(*BAR_COLUMNS).repartitionByRange("asset", "date").sortWithinPartitions("asset", "date")
    ordered.write.mode("overwrite").csv(path, header=True)


def load_window(spark: SparkSession, paths: list[str], low: str | None = None, high: str | None = None) -> DataFrame:
    """Bars of the CSV files between two dates, both inclusive; torn lines are left out.

    ``FileNotFoundError`` if none of the files is there, ``ValueError`` if no bar lies in the
    window: one row is looked for, not all counted.  Order is left to the windows that need it.
    """
    bars = read_bars(spark, paths)
    if bars is None:
        raise FileNotFoundError(f"none of these is there: {', '.join(paths)}")
    bars = window_of(bars.where(F.col(BAD).isNull()).select(*BAR_COLUMNS), low, high)
    if bars.isEmpty():
        raise ValueError(f"no bars between {low} and {high}")
    return bars


def write_panel(panel: DataFrame, path: str, by: str = "category") -> None:
    """Parquet sink: partitioned by a coarse column, in order of asset and date within files.

    A rerun replaces the partitions that it writes and leaves the others, so rows are not added twice.
    """
    ordered = panel.repartitionByRange(by, "asset", "date").sortWithinPartitions(by, "asset", "date")
    ordered.write.partitionBy(by).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def ohlc(ticks: DataFrame, unit: str = "hour") -> DataFrame:
    """OHLC bars of ``ticks`` (asset, ts, seq, price): one aggregate, combined before the shuffle.

    Ticks of price 0 or less, or null, are left out; ties in time follow ``seq``.
    """
    order = F.struct("ts", "seq")
    return (
        ticks.where(F.col("price") > 0)
        .groupBy("asset", F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("date"))
        .agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.count("*").alias("ticks"))
    )


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(F.col("event_type").alias("asset"), F.col("ts"), F.col("event_id").alias("seq"), F.col("value").alias("price"))


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of the event stream, one asset per event type."""
    return ohlc(event_ticks(spark, sf_dir))


def brand_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A multi-year daily panel: unit prices by brand and shipping day."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_quantity", "l_extendedprice")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("asset"))
    price = F.try_divide("l_extendedprice", "l_quantity")
    return lines.join(parts, "l_partkey").select("asset", F.col("l_shipdate").alias("ts"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), price.alias("price"))


def user_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream by user: assets grow with the tables."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("asset"), F.col("ts"), F.col("event_id").alias("seq"), F.col("value").alias("price"))


def wide_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of every user, and minute bars of all events as one hot asset, ``ALL``."""
    ticks = user_ticks(spark, sf_dir)
    return ohlc(ticks).unionByName(ohlc(ticks.withColumn("asset", F.lit("ALL")), "minute"))
