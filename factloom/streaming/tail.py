"""Streams over growing line logs: counts by stratum, and upserts where the later record wins (section 2.10)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def tail_log(spark: SparkSession, folder: str, schema: StructType | str, files_per_batch: int = 100) -> DataFrame:
    """A stream of the records of line-JSON files that arrive in a folder; malformed lines are dropped."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("mode", "DROPMALFORMED").json(folder)


def stratum_counts(records: DataFrame, stratum: str, at: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Records per stratum and window of event time; the watermark bounds the state."""
    return records.withWatermark(at, late).groupBy(F.window(at, width), stratum).agg(F.count("*").alias("n")).select("window.start", stratum, "n")


def upsert_latest(records: DataFrame, key: str, at: str, target: str, checkpoint: str, merge: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Keeps the last record of each key in a parquet table. Each batch writes a new version beside the old one and
    then names it in CURRENT, so that a lost batch is simply written again."""

    def settle(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        old = _version(spark, target)
        rows = batch.unionByName(spark.read.parquet(f"{target}/{old}")) if old and old != f"v{epoch}" else batch
        both = merge(rows, batch) if merge else rows
        last = both.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rows.columns), at).alias("r")).select("r.*")
        last.write.mode("overwrite").parquet(f"{target}/v{epoch}")
        _name_version(spark, target, f"v{epoch}")

    return records.writeStream.foreachBatch(settle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _files(spark: SparkSession, target: str):
    """The file system of a folder, whichever it is, and a path in it by name."""
    path = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{target}/{name}")
    return path("CURRENT").getFileSystem(spark._jsc.hadoopConfiguration()), path


def _version(spark: SparkSession, target: str) -> str | None:
    fs, path = _files(spark, target)
    return spark.read.text(f"{target}/CURRENT").first()[0].strip() if fs.exists(path("CURRENT")) else None


def _name_version(spark: SparkSession, target: str, version: str) -> None:
    """Writes the pointer beside the old one and puts it in its place by one overwriting rename."""
    fs, path = _files(spark, target)
    out = fs.create(path("CURRENT.new"), True)
    out.write(bytearray(version.encode()))
    out.close()
    fc = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    how = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    fc.rename(path("CURRENT.new"), path("CURRENT"), how)


def current(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(f"{target}/{_version(spark, target)}")
