"""Runs a set of queries under a contract of required columns and reports counts, nulls and digests."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.sources.writers import report, table_digest


def run_contract(spark: SparkSession, sf_dir: str, queries: dict[str, Callable], required: dict[str, Iterable[str]], path: str | None = None) -> dict:
    """Each query must give its required columns, some rows, and no null in its first required column."""
    counts: dict[str, int] = {}
    checks: dict[str, bool] = {}
    details: dict[str, dict] = {}
    for name, columns in required.items():
        began, columns = time.perf_counter(), list(columns)
        df: DataFrame = queries[name](spark, sf_dir)
        checks[f"{name} columns"] = set(columns) <= set(df.columns)
        head = F.sum(F.col(columns[0]).isNull().cast("int")) if checks[f"{name} columns"] else F.lit(None)
        row = df.agg(F.count("*").alias("n"), head.alias("nulls")).first()
        counts[name] = row["n"]
        checks[f"{name} rows"], checks[f"{name} key"] = row["n"] > 0, not row["nulls"]
        details[name] = {"digest": table_digest(df), "seconds": round(time.perf_counter() - began, 3)}
    return report(counts, checks, path) | {"queries": details}
