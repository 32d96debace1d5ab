"""Session settings and the cutting of lineage.

Intermediate results that are read more than once, or that close a round of an
iterative operator, are written as Parquet below the folder named by
``spark.checkpoint.dir``: every executor shares it, so a lost executor costs a
re-read and never a failed job.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIR: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The session's shared folder; a temporary one only where none is set and Spark runs in one process."""
    global _LOCAL_DIR
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _LOCAL_DIR is None:
        _LOCAL_DIR = tempfile.mkdtemp(prefix="siltstone-")
        atexit.register(shutil.rmtree, _LOCAL_DIR, ignore_errors=True)
    return f"file://{_LOCAL_DIR}"


def _sweep(spark: SparkSession, folder: str) -> None:
    """Removes a session's intermediate tables when the driver ends; a session that was stopped before leaves them."""
    try:
        if spark.sparkContext._jsc is not None:
            p = spark._jvm.org.apache.hadoop.fs.Path(folder)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  (nothing can be done about it at the end)
        pass


class Scratch:
    """Written intermediate tables of one operator call.

    ``keep(df)`` writes and reads back; ``drop(df)`` removes a table that no
    later plan reads. Tables that the returned plan still reads stay until the
    driver ends with its session open, or else until the folder is emptied.
    """

    _swept: set[str] = set()

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_folder(spark).rstrip('/')}/siltstone/{spark.sparkContext.applicationId}"
        self._path: dict[int, str] = {}
        if self.base not in Scratch._swept:
            Scratch._swept.add(self.base)
            atexit.register(_sweep, spark, self.base)

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._path[id(out)] = path
        return out

    def table(self) -> str:
        """A path for a table that is written in parts."""
        return f"{self.base}/{uuid.uuid4().hex}"

    def drop(self, *dfs: DataFrame) -> None:
        jvm = self.spark._jvm
        for df in dfs:
            path = self._path.pop(id(df), None)
            if path:
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def build_session(app: str = "siltstone", master: str | None = None, partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    b = SparkSession.builder.appName(app).master(master or f"local[{os.cpu_count() or 4}]")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "6g",
    }
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its few files would leave some idle; large inputs have more parts than that and stay as they are.

    For steps that cost far more than moving their rows.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``folder``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
