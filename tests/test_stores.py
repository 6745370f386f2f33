"""Stores: replaced whole, read by id, reports without text, candidates and opinions that still count."""

import json

from pyspark.sql import functions as F

from cairn.sources import stores


def test_snapshots_are_replaced_whole(spark, tmp_path):
    path = f"file://{tmp_path}/snap"
    one, two = spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2,), (3,)], "a int")
    assert stores.write_snapshot(one, path) and stores.write_snapshot(two, path) and not stores.write_snapshot(one, path, complete=False)
    assert sorted(r.a for r in spark.read.parquet(path).collect()) == [2, 3]
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["snap"]


def test_sources_by_id(spark, tmp_path):
    rows = spark.createDataFrame([(f"s{i % 50}", f"f{i % 50}.py", "x") for i in range(100)], "source_id string, file_name string, content string")
    stores.write_sources(rows, f"file://{tmp_path}/store", 8)
    got = stores.read_sources(spark, f"file://{tmp_path}/store", ["s3", "s41", "none"], 8)
    assert sorted(r.file_name for r in got.collect()) == ["f3.py", "f41.py"]
    ids, own = spark.createDataFrame([("s1",), ("s2",)], "source_id string"), rows.where("source_id = 's1'").distinct()
    assert stores.with_origin(own, ids, rows.distinct()).count() == 2


def test_samples_and_json(spark):
    files = spark.createDataFrame([("d/b.py", "x\ny\n"), ("a.py", ""), ("d\\c.py", "x\r\ny")], "file_name string, content string")
    assert [tuple(r) for r in stores.samples(files).collect()] == [("a.py", 0, 0), ("b.py", 2, 4), ("c.py", 2, 4)]
    findings = spark.createDataFrame([("s", "RSA"), ("s", "RSA"), ("t", "DH")], "source_id string, algorithm string")
    got = stores.json_report(files, findings, "snippet", "t").collect()
    summary = json.loads(next(r.body for r in got if r.kind == "summary"))
    assert summary["algorithm_counts"] == {"DH": 1, "RSA": 2} and summary["finding_count"] == 3 and summary["source_count"] == 3
    assert not any("content" in r.body for r in got if r.kind == "source") and len(got) == 7


def test_candidates_and_opinions(spark):
    ops = spark.createDataFrame([("o1", {"A": "E3", "B": "E3"}), ("o2", {"A": "E3", "B": "E2"})], "operation_id string, levels map<string,string>")
    assert [r.operation_id for r in stores.open_candidates(ops, ops, F.col("levels")).collect()] == ["o2"]
    said = spark.createDataFrame([("c1", "d", "valid"), ("c2", "old", "valid"), ("c3", "d", "invalid")], "candidate_id string, digest string, citation_status string")
    now = spark.createDataFrame([("c1", "d"), ("c2", "new"), ("c3", "d")], "candidate_id string, digest string")
    assert [r.candidate_id for r in stores.reusable(said, now).collect()] == ["c1"]
