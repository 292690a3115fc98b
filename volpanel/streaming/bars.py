"""Bars from a stream of ticks that come late and out of order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TICKS = "asset string, ts timestamp_ntz, seq long, price double"
#: Asset of the row that ends a replay: it moves the watermark past all windows and makes no bar.
END = "end of ticks"


def bars(ticks: DataFrame, unit: str = "1 hour", delay: str = "6 hours") -> DataFrame:
    """OHLC bars (asset, date, open, high, low, close) of a stream of ``ticks``, each given out once it is complete.

    A window is complete when the watermark, the latest time seen less ``delay``, has passed
    its end; later ticks of it are dropped.  Ticks of one window may come in any order and in
    any micro-batch: the aggregate holds one row for each open window.  Ticks of price 0 or less, or null, are left out.
    """
    order = F.struct("ts", "seq")
    live = ticks.where((F.col("price") > 0) & F.col("asset").isNotNull()).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    found = live.groupBy("asset", F.window("ts", unit).alias("w")).agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.max(F.col("asset") == END).alias("ended"))
    # A filter by the asset itself would be pushed below the watermark, which the end marker must reach.
    return found.where(~F.col("ended")).select("asset", F.col("w.start").cast("timestamp_ntz").alias("date"), "open", "high", "low", "close")


def replay(ticks: DataFrame, folder: str, arrival: Column, parts: int = 8) -> DataFrame:
    """``ticks`` (TICKS) as a stream that reads one part a micro-batch, in the order of ``arrival``, which may differ from ``ts``.

    The parts are written one after another, since a file source goes by time of writing.
    Two end markers follow, a year later: the first moves the watermark, the second makes the batch that sees it.
    """
    spark = ticks.sparkSession
    marked = ticks.select("asset", F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("seq").cast("long").alias("seq"), F.col("price").cast("double").alias("price"), F.unix_micros(arrival.cast("timestamp")).alias("_at"))
    edges = marked.approxQuantile("_at", [k / parts for k in range(1, parts)], 0.01)
    bounds = [None, *sorted(set(edges)), None]
    for low, high in zip(bounds, bounds[1:], strict=False):
        inside = (F.lit(True) if low is None else F.col("_at") > low) & (F.lit(True) if high is None else F.col("_at") <= high)
        marked.where(inside).drop("_at").coalesce(1).write.mode("append").parquet(folder)
    last = ticks.agg(F.max("ts").cast("timestamp_ntz").alias("ts"))
    ended = last.select(F.lit(END).alias("asset"), (F.col("ts") + F.expr("INTERVAL 365 DAYS")).alias("ts"), F.lit(0).cast("long").alias("seq"), F.lit(1.0).alias("price"))
    for _ in range(2):
        ended.write.mode("append").parquet(folder)
    return spark.readStream.schema(TICKS).option("maxFilesPerTrigger", 1).parquet(folder)


def run_to_end(stream: DataFrame, folder: str) -> str:
    """Drive a stream of bars over what there is now into Parquet files under ``folder``; return where they are.

    An asset's bars of a micro-batch are in one file, so a reader that takes files by time gets them in order.
    """
    query = stream.repartition("asset").writeStream.format("parquet").option("path", f"{folder}/bars").option("checkpointLocation", f"{folder}/bars-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return f"{folder}/bars"
