"""Session helpers: table access and lineage cuts that outlive lost executors."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "factloom", cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings that tests and the benchmark use."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the cluster's shared folder (spark.checkpoint.dir); where none is named, a local master gets a temporary one
    and any other raises, as its executors couldn't see this machine's folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="factloom-ckpt-"))


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """Cut lineage like cut(), with compressed parquet files in the shared folder, a fraction of a checkpoint's size. The files
    of instead_of, an earlier result of kept() that nothing reads any more, are deleted then."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/kept-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    out = spark.read.schema(df.schema).parquet(folder)
    out._kept_in = folder
    if instead_of is not None:
        old = spark._jvm.org.apache.hadoop.fs.Path(instead_of._kept_in)
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return out


def _signature(spark: SparkSession, sf_dir: str, sources: Sequence[str]) -> str:
    """What the source tables' files are: paths, sizes and times."""
    told = [sf_dir]
    for name in sources:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        told += [f"{x.getPath()} {x.getLen()} {x.getModificationTime()}" for x in fs.listStatus(path)]
    return hashlib.sha256("\n".join(told).encode()).hexdigest()[:24]


def stored(spark: SparkSession, sf_dir: str, name: str, sources: Sequence[str], build: Callable[[], DataFrame], partition_by: str | None = None) -> DataFrame:
    """A layer that is built once per application and state of its source tables, and then read as a parquet table.

    It lies beside the checkpoints in the shared folder. Later queries push filters and columns into its scan; a layer of
    another application, whose code may differ, is never read.
    """
    ensure_checkpoint_dir(spark)
    sc = spark.sparkContext
    folder = f"{sc.getCheckpointDir()}/layers-{sc.applicationId}/{name}-{_signature(spark, sf_dir, sources)}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        writer = build().write.mode("overwrite")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(folder)
    return spark.read.parquet(folder)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
