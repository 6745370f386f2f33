"""Streams of results: once each, whole files, an end that holds, versions that only rise."""

import json
import os

from cairn.streaming import publish
from cairn.streaming.scan import windowed_counts

SCHEMA = "task_id string, version long, state string"


def feed(folder, number, rows):
    folder.mkdir(exist_ok=True)
    (folder / f"{number}.json").write_text("\n".join(json.dumps(r) for r in rows))
    os.utime(folder / f"{number}.json", (1_700_000_000 + 10 * number,) * 2)  # read in this order


def test_states_freeze_at_the_end_and_never_go_back(spark, tmp_path):
    into, out, check = tmp_path / "in", f"file://{tmp_path}/out", f"file://{tmp_path}/check"
    updates = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(into))
    over = lambda df: df["state"].isin("done", "failed")

    def run():
        publish.task_states(updates(), out, check, over, SCHEMA).awaitTermination()
        return {(r.task_id, r.version, r.state) for r in publish.current(spark, out, SCHEMA).collect()}

    feed(into, 1, [{"task_id": "a", "version": 1, "state": "run"}, {"task_id": "b", "version": 3, "state": "run"}, {"task_id": "c", "version": 1, "state": "done"}, {"task_id": "c", "version": 2, "state": "run"}])
    assert run() == {("a", 1, "run"), ("b", 3, "run"), ("c", 1, "done")}
    feed(into, 2, [{"task_id": "a", "version": 2, "state": "failed"}, {"task_id": "b", "version": 2, "state": "old"}, {"task_id": "c", "version": 9, "state": "late"}])
    assert run() == {("a", 2, "failed"), ("b", 3, "run"), ("c", 1, "done")}
    feed(into, 3, [{"task_id": "a", "version": 3, "state": "late"}, {"task_id": "b", "version": 4, "state": "run"}])
    assert run() == {("a", 2, "failed"), ("b", 4, "run"), ("c", 1, "done")}
    assert run() == {("a", 2, "failed"), ("b", 4, "run"), ("c", 1, "done")}  # a restart repeats nothing


def test_a_batch_reads_the_state_of_its_own_tasks_alone(spark, tmp_path):
    into, out, check = tmp_path / "in", f"file://{tmp_path}/out", f"file://{tmp_path}/check"
    for n in range(4):
        feed(into, n, [{"task_id": f"t{n}-{i}", "version": 1, "state": "run"} for i in range(50)])
    feed(into, 9, [{"task_id": "t0-0", "version": 2, "state": "run"}])
    updates = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(into))
    q = publish.task_states(updates, out, check, lambda df: df["state"] == "done", SCHEMA)
    q.awaitTermination()
    changed = [p["stateOperators"][0]["numRowsUpdated"] for p in q.recentProgress if p["numInputRows"]]
    assert changed == [50, 50, 50, 50, 1] and publish.current(spark, out, SCHEMA).count() == 200


def test_results_are_published_once(spark, tmp_path):
    into = tmp_path / "in"
    feed(into, 1, [{"source_id": "s1", "seen_at": "2024-01-01T00:00:00"}, {"source_id": "s2", "seen_at": "2024-01-01T00:00:01"}])
    feed(into, 2, [{"source_id": "s1", "seen_at": "2024-01-01T00:00:05"}, {"source_id": "s3", "seen_at": "2024-01-01T00:00:06"}])
    stream = spark.readStream.schema("source_id string, seen_at timestamp").option("maxFilesPerTrigger", 1).json(str(into))
    publish.published_once(stream).writeStream.format("memory").queryName("once").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/c").start().awaitTermination()
    assert sorted(r.source_id for r in spark.table("once").collect()) == ["s1", "s2", "s3"]


def test_only_whole_files_stay(spark):
    rows = spark.createDataFrame([("a", 1, None), ("b", 1, None), ("b", 2, "analysis_limit"), ("c", 0, "unknown_pem_algorithm")], "source_id string, line int, diagnostic string")
    kept, reasons = publish.whole_files(rows)
    assert sorted(r.source_id for r in kept.collect()) == ["a", "c"] and [tuple(r) for r in reasons.collect()] == [("analysis_limit", 1)]


def test_windowed_counts(spark, tmp_path):
    """Windows come out once, when rows of them can't come any more; a row that is later than that is left out."""
    into = tmp_path / "in"
    feed(into, 1, [{"ts": "2024-01-01T00:10:00", "event_type": "x"}, {"ts": "2024-01-01T00:20:00", "event_type": "x"}, {"ts": "2024-01-01T03:00:00", "event_type": "y"}])
    feed(into, 2, [{"ts": "2024-01-01T05:00:00", "event_type": "y"}])
    feed(into, 3, [{"ts": "2024-01-01T00:30:00", "event_type": "x"}])
    stream = spark.readStream.schema("ts timestamp, event_type string").option("maxFilesPerTrigger", 1).json(str(into))
    windowed_counts(stream, late="1 hour").writeStream.format("memory").queryName("windows").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/w").start().awaitTermination()
    got = {(str(r.start), r.event_type): r.n for r in spark.table("windows").collect()}
    assert got[("2024-01-01 00:00:00", "x")] == 2 and ("2024-01-01 05:00:00", "y") not in got
