from __future__ import annotations

import gzip
import json

import pytest

from factloom.sources import readers, writers
from factloom.streaming import tail


def test_csv_with_mark(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('﻿id,name\n1,"a, b"\n2,\n', encoding="utf-8")
    assert [tuple(r) for r in readers.read_csv(spark, str(p), "id int, name string").collect()] == [(1, "a, b"), (2, None)]


def test_jsonl(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"k":1}\n\n{"k":2}\n{"k":\n{"k":3}\n')
    assert sorted(r.k for r in readers.read_jsonl(spark, str(p), "k int").collect()) == [1, 2, 3]
    assert sorted(r.k for r in readers.read_jsonl_until_torn(spark, str(p), "k int").collect()) == [1, 2]


def test_last_line_wins(spark, tmp_path):
    p = tmp_path / "a.jsonl.gz"
    p.write_bytes(gzip.compress(b'{"k":"a","v":1}\n{"k":"b","v":1}\nbad\n{"k":"a","v":2}\n'))
    assert {(r.k, r.v) for r in readers.latest_by_key(spark, str(p), "k string, v int", "k").collect()} == {("a", 2), ("b", 1)}


def test_rules_tree_and_lists(spark, tmp_path, sf):
    pytest.importorskip("yaml")
    (tmp_path / "r.yaml").write_text("roles:\n- {code: led, role: leader}\n")
    assert [tuple(r) for r in readers.read_rules(spark, str(tmp_path / "r.yaml"), "roles", "code string, role string").collect()] == [("led", "leader")]
    (tmp_path / "l.yaml").write_text("- a\n")
    with pytest.raises(ValueError):
        readers.read_rules(spark, str(tmp_path / "l.yaml"), "roles", "code string")
    (tmp_path / "books" / "b1" / "x").mkdir(parents=True)
    (tmp_path / "books" / "b1" / "x" / "p1.txt").write_text("one\ntwo")
    assert [tuple(r) for r in readers.read_text_tree(spark, str(tmp_path / "books")).collect()] == [("b1", "b1/x/p1.txt", "one\ntwo")]
    ids = spark.createDataFrame([("a",), ("a",), (None,)], "id string")
    assert readers.in_list(spark.createDataFrame([("a",), ("b",), (None,)], "k string"), "k", ids).count() == 1
    assert readers.attach(spark, sf, ["region"], "t_") == ["t_region"] and spark.table("t_region").count() == 5


def test_staged_and_digest(spark, tmp_path):
    df, out = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string"), str(tmp_path / "t")
    writers.write_staged(df, out)
    writers.write_staged(df.limit(1), out)
    assert spark.read.parquet(out).count() == 1
    assert writers.table_digest(df) == writers.table_digest(df.select("v", "k").repartition(3)) != writers.table_digest(df.limit(1))
    assert writers.report({"n": 1}, {"x": True}, str(tmp_path / "r.json"))["status"] == "pass"
    assert json.loads((tmp_path / "r.json").read_text())["counts"] == {"n": 1}
    writers.write_table(df, str(tmp_path / "p"), ["k"])


def test_graph_csv(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "X", "A"), ("b", "X", "B")], "id string, label string, caption string")
    edges = spark.createDataFrame([("a", "b", "T"), ("a", "z", "T")], "src string, dst string, type string")
    assert writers.write_graph_csv(nodes, edges, str(tmp_path / "g")) == {"nodes": 2, "edges": 1, "dangling": 1}
    with pytest.raises(ValueError):
        writers.write_graph_csv(nodes.union(nodes), edges, str(tmp_path / "g"))


def test_streams(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    schema = "k string, s string, at timestamp"
    line = lambda k, s, h: json.dumps({"k": k, "s": s, "at": f"2024-01-01T{h:02d}:30:00Z"})
    (logs / "1.jsonl").write_text("\n".join([line("a", "x", 1), line("b", "y", 1), "torn {"]))
    target, ck = str(tmp_path / "t"), str(tmp_path / "c")
    tail.upsert_latest(tail.tail_log(spark, str(logs), schema), "k", "at", target, ck).awaitTermination()
    (logs / "2.jsonl").write_text(line("a", "z", 2))
    tail.upsert_latest(tail.tail_log(spark, str(logs), schema), "k", "at", target, ck).awaitTermination()
    assert {(r.k, r.s) for r in tail.current(spark, target).collect()} == {("a", "z"), ("b", "y")}
    q = tail.stratum_counts(tail.tail_log(spark, str(logs), schema), "s", "at").writeStream.outputMode("complete").format("memory").queryName("strata").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.s, r.n) for r in spark.table("strata").collect()} == {("x", 1), ("y", 1), ("z", 1)}
