"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"
CLEANUP_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution on; master and sizes come from the cluster unless given."""
    builder = (
        SparkSession.builder.appName("quireflow")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master).config("spark.driver.memory", "8g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder the cluster names in its settings.

    Only where neither the setting nor a context-level folder exists (a test on
    one machine) is a temporary folder chosen.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get(CHECKPOINT_SETTING, None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError(f"Set {CHECKPOINT_SETTING} to a folder every executor can reach.")
            folder = tempfile.mkdtemp(prefix="quireflow-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for round trips, below the shared folder where the cluster names one."""
    shared = spark.conf.get(CHECKPOINT_SETTING, None)
    if shared:
        return f"{shared.rstrip('/')}/quireflow-{name}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"Set {CHECKPOINT_SETTING} to a folder every executor can reach.")
    return tempfile.mkdtemp(prefix=f"quireflow-{name}-")


class Stages:
    """Tables that are stored one after the other, each of which replaces the one before.

    What is stored must be made from the one before and from nothing earlier, and the last one stays. It is
    written compressed below the shared folder; unlike a checkpoint it does not keep how rows are dealt to tasks.
    What was shuffled to make it goes as soon as it is stored, not when the driver collects its garbage.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.stored = spark, scratch_folder(spark, name), 0

    def keep(self, df: DataFrame) -> DataFrame:
        as_set = self.spark.conf.get(CLEANUP_SETTING)
        self.spark.conf.set(CLEANUP_SETTING, "true")
        try:
            df.write.option("compression", "zstd").parquet(f"{self.folder}/{self.stored}")
        finally:
            self.spark.conf.set(CLEANUP_SETTING, as_set)
        if self.stored:
            before = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{self.stored - 1}")
            before.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(before, True)
        self.stored += 1
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{self.stored - 1}")
