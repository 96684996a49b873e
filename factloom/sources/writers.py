"""Sinks: parquet, staged swaps, reports, digests and the graph as CSV (section 2.1 of the survey)."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """SNK-SQLITE: a parquet table."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def fingerprint(paths: list[str]) -> str:
    """Digest of names, sizes and times of all files below local paths."""
    h = hashlib.sha256()
    for p in sorted(f for root in paths for f in ([Path(root)] if Path(root).is_file() else Path(root).rglob("*")) if f.is_file()):
        h.update(f"{p}\x1f{p.stat().st_size}\x1f{p.stat().st_mtime_ns}\n".encode())
    return h.hexdigest()


def write_staged(df: DataFrame, path: str, inputs: list[str] | None = None) -> None:
    """SNK-ATOMIC: writes beside the target, sets the old one aside, renames and only then deletes the old one.

    Raises, leaving the target, if a local input changed meanwhile; if the new one can't be moved, the old one comes back.
    A crash between the two renames leaves both complete, as .staging and .before.
    """
    fs_path = df.sparkSession._jvm.org.apache.hadoop.fs.Path
    before = fingerprint(inputs or [])
    df.write.mode("overwrite").parquet(path + ".staging")
    if fingerprint(inputs or []) != before:
        raise RuntimeError("an input changed while the result was written")
    new, old = fs_path(path + ".staging"), fs_path(path)
    fs = new.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
    aside = fs_path(path + ".before")
    fs.delete(aside, True)
    had = fs.exists(old)
    if had and not fs.rename(old, aside):
        raise OSError(f"{path}: the old result can't be set aside")
    if not fs.rename(new, old):
        if had:
            fs.rename(aside, old)
        raise OSError(f"{path}: the staged result can't be moved")
    fs.delete(aside, True)


def row_digests(df: DataFrame) -> DataFrame:
    """SNK-DIGEST: SHA-256 of each row as JSON with its columns in name order."""
    return df.select(F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256).alias("digest"))


def digest_of(digests: DataFrame) -> DataFrame:
    """(digest) of rows' SHA-256 digests, whatever their order: each 8 hex digits are summed over all rows, and the sums
    with the number of rows hashed again. Sums combine before the shuffle, so no row list is ever gathered."""
    part = lambda i: F.sum(F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("decimal(20,0)"))
    sums = digests.agg(F.count("*").alias("n"), *(F.coalesce(part(i), F.lit(0)).cast("decimal(38,0)").alias(f"s{i}") for i in range(8)))
    return sums.select(F.sha2(F.concat_ws("|", F.col("n").cast("string"), *(F.col(f"s{i}").cast("string") for i in range(8))), 256).alias("digest"))


def table_digest(df: DataFrame) -> str:
    """One digest of a table whatever its row order and partitioning; repeated rows count as often as they stand."""
    return digest_of(row_digests(df)).first()["digest"]


def report(counts: dict[str, int], checks: dict[str, bool], path: str | None = None) -> dict:
    """SNK-JSON-REPORT: counts, checks and a status, also as a file."""
    out = {"counts": counts, "checks": checks, "status": "pass" if all(checks.values()) else "fail"}
    if path:
        Path(path).write_text(json.dumps(out, ensure_ascii=False, indent=1, sort_keys=True), encoding="utf-8")
    return out


def write_graph_csv(nodes: DataFrame, edges: DataFrame, path: str) -> dict[str, int]:
    """SNK-GRAPH-CSV: nodes(id, label, caption) and edges(src, dst, type) with typed headers; repeated ids and blank
    captions are errors, dangling edges are left out and counted (G-VERIFY)."""
    repeated = nodes.groupBy("id").count().filter("count > 1").limit(1).count()
    blank = nodes.filter(F.trim(F.coalesce("caption", F.lit(""))) == "").limit(1).count()
    if repeated or blank:
        raise ValueError("repeated node ids" if repeated else "blank captions")
    ids = nodes.select("id")
    kept = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    nodes.select(F.col("id").alias(":ID"), F.col("label").alias(":LABEL"), F.col("caption").alias("caption:string")).write.mode("overwrite").csv(f"{path}/nodes", header=True)
    kept.select(F.col("src").alias(":START_ID"), F.col("dst").alias(":END_ID"), F.col("type").alias(":TYPE")).write.mode("overwrite").csv(f"{path}/relationships", header=True)
    n = kept.count()
    return {"nodes": nodes.count(), "edges": n, "dangling": edges.count() - n}
