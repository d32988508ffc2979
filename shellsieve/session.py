"""Session defaults and the one place that decides where shared files go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster pass your own."""
    builder = (SparkSession.builder.master(master).appName("shellsieve")
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.ui.enabled", "false"))
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset,
    and only on a local master, a temporary folder is used.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured:
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="shellsieve-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, never used before."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write once to the shared folder and read back.

    Cuts the lineage of a frame that several branches of a plan need; unlike a
    cache it survives lost executors, and later scans still prune columns.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that are written on the way to a result and removed when they are dropped, or at the end unless kept.

    Shuffle files of a written table go as soon as it is written. On Sparks before
    4.1 the setting is unknown and they stay until the driver collects its garbage.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: list[tuple[DataFrame, str]] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error: object) -> None:
        self.drop(*[table for table, _ in self.paths])

    def write(self, df: DataFrame, name: str = "table", batch_rows: int = 64) -> DataFrame:
        """``df`` as a table; ``batch_rows`` rows, which may hold long arrays, or about 4 MB go to Python at once."""
        conf, path = self.spark.conf, scratch_path(self.spark, name)
        own = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": str(batch_rows),
               "spark.sql.execution.arrow.maxBytesPerBatch": str(1 << 22)}
        before = {key: conf.get(key, None) for key in own}
        try:
            for key, value in own.items():
                conf.set(key, value)
            df.write.parquet(path)
        finally:
            for key, value in before.items():
                conf.unset(key) if value is None else conf.set(key, value)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.paths.append((table, path))
        return table

    def keep(self, table: DataFrame) -> DataFrame:
        self.paths = [x for x in self.paths if x[0] is not table]
        return table

    def drop(self, *tables: DataFrame) -> None:
        sc = self.spark.sparkContext
        for table, path in self.paths:
            if any(table is x for x in tables):
                place = sc._jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)
        self.paths = [x for x in self.paths if not any(x[0] is y for y in tables)]


# Rows up to which a narrow table is copied to every executor.
BROADCAST_ROWS = 1_000_000


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a table has at most ``rows`` rows; reads no more than needed to tell."""
    return df.limit(rows + 1).count() <= rows
