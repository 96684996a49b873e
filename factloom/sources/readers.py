"""Sources: tables, delimited and line files, rule files and text directories (section 2.1 of the survey)."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def attach(spark: SparkSession, sf_dir: str, names: list[str], prefix: str = "") -> list[str]:
    """SRC-SQLITE-RO, SRC-ATTACH: registers tables as temporary views, which nothing here can write to."""
    views = []
    for n in names:
        spark.read.parquet(f"{sf_dir}/{n}.parquet").createOrReplaceTempView(prefix + n)
        views.append(prefix + n)
    return views


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """SRC-CSV with a header; a byte-order mark before the first name is dropped, quoted fields may span lines; a header
    that names other columns, or in another order, is refused."""
    return spark.read.csv(path, header=True, schema=schema, encoding="UTF-8", multiLine=True, escape='"', enforceSchema=False)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """SRC-JSONL: one record per line; blank and malformed lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_jsonl_until_torn(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """SRC-JSONL that stops at the first malformed line of a file, as after a crash while it was written.

    The line's place comes from the file's own offsets, so that a file of many splits still has one order.
    """
    lines = spark.read.text(path, wholetext=False).select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at")).filter(F.trim("value") != "")
    parsed = lines.withColumn("r", F.from_json("value", schema, {"mode": "PERMISSIVE"})).withColumn("bad", F.get_json_object("value", "$").isNull())
    first = parsed.filter("bad").groupBy("file").agg(F.min("at").alias("torn"))
    return parsed.join(first, "file", "left").filter(F.col("torn").isNull() | (F.col("at") < F.col("torn"))).select("r.*")


def latest_by_key(spark: SparkSession, path: str, schema: StructType | str, key: str) -> DataFrame:
    """SRC-JSONL-GZ: the last line of each key wins; plain and gzipped files. A gzipped file is one split."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("__at"))
    rows = lines.select(F.from_json("value", schema).alias("r"), "__at").filter("r is not null").select("r.*", "__at").filter(F.col(key).isNotNull())
    cols = [c for c in rows.columns if c != "__at"]
    return rows.groupBy(key).agg(F.max_by(F.struct(*cols), "__at").alias("r")).select("r.*")


def read_rules(spark: SparkSession, path: str, section: str, schema: str) -> DataFrame:
    """SRC-YAML: one list of a rule file, whose root must be a mapping, as a small frame."""
    import yaml

    root = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    if not isinstance(root, dict):
        raise ValueError(f"{path}: the root is no mapping")
    rows = root.get(section) or []
    return spark.createDataFrame([tuple(r.values()) if isinstance(r, dict) else tuple(r) for r in rows], schema)


def read_text_tree(spark: SparkSession, root: str) -> DataFrame:
    """SRC-TEXTDIR: (book, path, text) of all .txt files below root; book is the first directory."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(root, wholetext=True)
    path = F.regexp_replace(F.input_file_name(), "^[a-z]+:/+", "/")
    inside = F.regexp_replace(path, f"^.*{root.rstrip('/').rsplit('/', 1)[-1]}/", "")
    return files.select(F.split(inside, "/")[0].alias("book"), inside.alias("path"), F.col("value").alias("text"))


def in_list(df: DataFrame, key: str | Column, ids: DataFrame, id_column: str = "id") -> DataFrame:
    """SRC-CHUNK-IN: rows whose key is among ids, as one semi-join instead of chunks of a list."""
    k = F.col(key) if isinstance(key, str) else key
    return df.join(ids.select(F.col(id_column).alias("__id")), k == F.col("__id"), "left_semi")


def numbered(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("row_no", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
