"""Small Spark helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, which a cluster must set.

    Only a session on one machine (a local test) gets a folder of its own without it.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        app = spark.sparkContext.applicationId
        path = _OWN.setdefault(app, _OWN.get(app) or tempfile.mkdtemp(prefix="spark-shared-"))
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: a reliable checkpoint in the shared folder.

    Spark removes its files when the result is no longer used if the session has
    ``spark.cleaner.referenceTracking.cleanCheckpoints``; else they stay with the folder.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """Write ``df`` as a Parquet table in the shared folder; return it reread, and its path."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table made by :func:`stored`, through the file system that holds it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def numbered(df: DataFrame, group: str, order: list[str]) -> tuple[DataFrame, str]:
    """``df`` with gid (ascending with ``group``), idx (from 0, by ``order`` within the group) and n (rows of the group).

    Rows are sorted by ranges, written once, and counted by (group, range): a group with
    most of the rows is many ranges, and only the counts of its ranges meet in one task.
    Returns the rows, which read the table at the path returned too.
    """
    keys = [F.col(c).asc() for c in (group, *order)]
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed, path = stored(df.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33).alias("part")
    whole = Window.partitionBy(group)
    before = F.sum("many").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    cells = placed.groupBy(group, part).agg(F.count("*").alias("many"), F.min("at").alias("first"))
    cells = cells.select(F.col(group).alias("_group"), F.col("part").alias("_part"), F.min("first").over(whole).alias("gid"), (F.coalesce(before, F.lit(0)) - F.col("first")).alias("_shift"), F.sum("many").over(whole).alias("n"))
    cells = cut(cells)
    few = F.broadcast(cells) if cells.count() <= 100_000 else cells
    met = placed.join(few, (F.col(group).eqNullSafe(F.col("_group"))) & (F.shiftright("at", 33) == F.col("_part")))
    return met.withColumn("idx", F.col("at") + F.col("_shift")).drop("at", "_group", "_part", "_shift"), path


BATCH_ROWS = 1000
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def arrow_map(df: DataFrame, task, schema) -> DataFrame:
    """``df.mapInArrow``, with the session's batches held to BATCH_ROWS rows where its setting is larger or unbounded.

    A batch is whole in the memory of the JVM and of Python; texts are long rows.
    """
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(ARROW_ROWS)) <= BATCH_ROWS:
        conf.set(ARROW_ROWS, str(BATCH_ROWS))
    return df.mapInArrow(task, schema)


def held_out(doc_id: Column) -> Column:
    """True for the quarter of documents that no model learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def bounded_sample(ids: DataFrame, id_col: str, rows: int) -> DataFrame:
    """At most ``rows`` distinct ids, the same on every run: those of the smallest hashes.

    The result is bounded by its parameter, so callers may broadcast it.
    """
    return (
        ids.select(id_col).distinct().orderBy(F.xxhash64(F.col(id_col)), F.col(id_col)).limit(rows)
    )


def small_join(big: DataFrame, small: DataFrame, on: str, how: str = "inner", most: int = 100_000) -> DataFrame:
    """Join with a table of a few numbers a key: broadcast behind a count of its rows, else by a shuffle."""
    return big.join(F.broadcast(small) if small.count() <= most else small, on, how)
