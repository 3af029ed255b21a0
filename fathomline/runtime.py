"""Session, table access, lineage cuts and size checks shared by all operators."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(cores: str | int = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the engine is tested under."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("fathomline")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; a temporary one only in local mode, as in tests, where one machine is all there is."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "fathomline-checkpoints"))
    return sc._jsc.sc().getCheckpointDir().get()


_written: list[tuple[SparkSession, str]] = []


def release() -> None:
    """Delete what cut has written so far; results that read it can no longer be computed. Done when the process ends."""
    while _written:
        spark, place = _written.pop()
        try:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001 - a session that has ended takes its gateway with it
            continue


def cut(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder as parquet and read it back.

    Unlike checkpoint() the written columns keep pruning and file statistics, and
    the result survives the loss of any executor. Each call writes a folder of its own.
    """
    spark = df.sparkSession
    place = f"{_shared_folder(spark)}/{uuid.uuid4().hex}"
    if not _written:
        atexit.register(release)
    _written.append((spark, place))
    df.write.parquet(place)
    return spark.read.schema(df.schema).parquet(place)


def latest(df: DataFrame, keys: list[str], *columns: str, by: str = "loaded_at") -> DataFrame:
    """One row per key with the columns of the row loaded last.

    Rows with a null key are dropped. Ties of `by` are settled by the greatest
    column values, so the outcome does not depend on row order. The aggregate
    combines on the map side, so a key repeated often costs one row per task.
    """
    packed = F.struct(F.col(by).alias("_by"), *[F.col(c) for c in columns])
    present = df
    for k in keys:
        present = present.filter(F.col(k).isNotNull())
    out = present.groupBy(*keys).agg(F.max(packed).alias("_row"))
    return out.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in columns])


def fan_out(scan: DataFrame, parts: int | None = None) -> DataFrame:
    """Spread a scan of few splits over all cores when a Python stage follows.

    A small compressed file is one split however long its decoded text. parts: the number of
    partitions, always made. Without it a scan that already has a split per core is left as it
    is; the plan must then be free of shuffles, since counting its splits would run them.
    """
    cores = parts or scan.sparkSession.sparkContext.defaultParallelism
    return scan if not parts and scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)
