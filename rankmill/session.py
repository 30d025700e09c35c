"""Session helpers: where intermediate tables go, and how lineage is cut.

Long jobs write intermediate tables to the folder that the cluster names in
``spark.checkpoint.dir``.  All executors can reach it, so a lost executor costs
a recomputation of its own tasks and nothing else.  Only in local
mode (tests, a laptop) may the setting be absent, and a local folder is used.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
        where = "file://" + tempfile.mkdtemp(prefix="rankmill-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone already
        pass


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        _remove(spark, path)


class Scratch:
    """A run's own folder inside the shared one; tables written to it cut lineage."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/rankmill-{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        _made.append((spark, self.path))

    def write(self, df: DataFrame, *partition_by: str) -> DataFrame:
        """Write ``df`` once and read it back: later uses do not recompute it."""
        self._n += 1
        to = f"{self.path}/t{self._n}"
        writer = df.write.mode("overwrite").option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(to)
        return self.spark.read.schema(df.schema).parquet(to) if not partition_by else self.spark.read.parquet(to)

    def drop(self, df: DataFrame) -> None:
        """Delete the tables behind ``df`` that this run wrote and no longer needs."""
        for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            if f.startswith(self.path) or f.split(":", 1)[-1].lstrip("/").startswith(self.path.split(":", 1)[-1].lstrip("/")):
                _remove(self.spark, f)


def parallelism(spark: SparkSession) -> int:
    """Tasks that can be used at once, or the session's shuffle width if larger."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), spark.sparkContext.defaultParallelism, 1)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over more tasks, if it comes in far fewer partitions than can work at once (one small file, say).

    Meant for scans before work that is heavy on the CPU; a scan that has enough
    partitions stays as it is, so large inputs are never shuffled for it.
    """
    n = parallelism(df.sparkSession)
    return df.repartition(n) if 2 * df.rdd.getNumPartitions() <= n else df
