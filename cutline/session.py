"""Session settings and the shared folder for checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(master: str = "local[8]", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(master)
        .appName("cutline")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The folder every executor can reach. A cluster names it in
    `spark.checkpoint.dir`; only where that is unset, as in tests, a local one
    is made for this session."""
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="cutline-checkpoint-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame, name: str, instead_of: DataFrame | None = None) -> DataFrame:
    """Write a frame that several branches read into the shared folder and read it
    back: later plans start from a scan that prunes columns, and a lost executor
    re-reads files. Files of its own exchanges are not needed any more and go at its
    end; the session's own setting is restored. `instead_of` is a stored frame that only this one reads: its files go, too."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/cutline-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    if instead_of is not None:
        _remove(spark, {f.rsplit("/", 1)[0] for f in instead_of.inputFiles()})
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, folders: set[str]) -> None:
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise once in the shared folder, so a lost executor re-reads files
    instead of recomputing the lineage."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)
