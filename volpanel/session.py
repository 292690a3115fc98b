"""Make the package importable in Spark's Python workers."""

from __future__ import annotations

import tempfile
import threading
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_SHIPPING = threading.Lock()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once per application (as ``--py-files`` would).

    The archive is made on the driver, and Spark serves it to every executor.
    """
    app = spark.sparkContext.applicationId
    with _SHIPPING:  # queries may start in several threads
        if app in _SHIPPED:
            return spark
        package = Path(__file__).parent
        archive = Path(tempfile.mkdtemp(prefix="spark-ship-")) / "volpanel_package.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for path in sorted(package.rglob("*.py")):
                out.write(path, path.relative_to(package.parent))
        spark.sparkContext.addPyFile(str(archive))
        _SHIPPED.add(app)
    return spark


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share; a local session without it gets its own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        path = _OWN.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="spark-shared-")
        _OWN[spark.sparkContext.applicationId] = path
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def written(df: DataFrame) -> DataFrame:
    """``df`` as a reliable checkpoint in the shared folder: computed once, however often it is read."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
