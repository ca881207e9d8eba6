"""Session and table helpers shared by the query modules."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "lamina", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings the tests and the benchmark use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; Spark's reader resolves the path, so any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share.

    It is the one that the cluster names in spark.checkpoint.dir. Where that is unset a local session, as in tests,
    gets a temporary folder; on a cluster no folder of one machine can serve, so that is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="lamina-checkpoint-"))
    return context.getCheckpointDir()


#: Spark's setting that removes a query's shuffle files when the query ends.
SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def held_setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """Queries that end within run under a setting of the session, which then is as it was."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def swept_shuffles(spark: SparkSession) -> AbstractContextManager[None]:
    """Queries that end within leave no shuffle files: for results that are written, so that nothing reads those files again.

    Without it they stay until the driver happens to collect its garbage, and the rounds of an iterative job pile them up.
    """
    return held_setting(spark, SWEEP, "true")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint into the shared folder; the shuffle files that led to it go."""
    shared_root(df.sparkSession)
    with swept_shuffles(df.sparkSession):
        return df.checkpoint(eager=True)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder of intermediate files, wherever it is stored."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
