"""Parsers, archives and choices on small cases of their own."""

import io
import tarfile

import pytest
from pyspark.sql import functions as F

from cairn.functions.programs import config_scalars, node_calls
from cairn.operators import scanners
from cairn.operators import selection as sel
from cairn.sources import archives, sinks


def test_config_scalars():
    text = "tls:\n  alg: [RS256, 'ES256']\n  deep: {a: x, n: 1}\ntitle: y"
    assert list(config_scalars(text, False)) == [(2, "alg", "RS256"), (2, "alg", "ES256"), (3, "a", "x"), (4, "title", "y")]
    assert list(config_scalars("", False)) == []
    assert list(config_scalars('{"a": {"b": ["c"]}}', True)) == [(1, "b", "c")]


@pytest.mark.parametrize(("text", "strict"), [("{'a': 1}", True), ('{"a": NaN}', True), ("a: &x b\nc: *x", False), ("a: !python/object x", False), ("? [a]\n: b", False), ("a: [", False), ("[" * 80 + "]" * 80, False), ("a: 1\n---\nb: 2", False)])
def test_config_refusals(text, strict):
    with pytest.raises(ValueError):
        list(config_scalars(text, strict))


@pytest.mark.parametrize(
    ("source", "hits"),
    [
        ("import c from 'crypto'\nc.generateKeyPair('rsa', f)", [(2, "generateKeyPair", "rsa")]),
        ("const {generateKeyPairSync} = require('node:crypto'); generateKeyPairSync('ec')", [(1, "generateKeyPairSync", "ec")]),
        ("import {generateKeyPair as g} from 'crypto'\nconst f = (g) => { g('rsa') }", []),
        ("import c from 'crypto'\nc = x\nc.generateKeyPair('rsa', f)", []),
        ("import c from 'crypto'\nif (c == 1) c.generateKeyPair('rsa', f)", [(2, "generateKeyPair", "rsa")]),
        ("import c from 'other'\nc.generateKeyPair('rsa', f)", []),
        ("const c = require('crypto')\nx.c.generateKeyPair('rsa', f); '`c.generateKeyPair(\"rsa\")`'", []),
        ("", []),
        ("import", []),
    ],
)
def test_node_calls(source, hits):
    assert node_calls(source) == hits


def test_config_nodes_of_odd_files(spark):
    files = spark.createDataFrame([("a.json", '{"alg": "RS256"}'), ("b.yaml", None), ("c.json", "{"), ("d.yml", "jwt:\n  alg: ssh-rsa AAAA\n  note: RS256"), ("e.yaml", "alg: use RS256")], "file_name string, content string")
    rows = {(r.file_name, r.line, r.algorithm, r.diagnostic is not None) for r in scanners.scan_config_nodes(files).collect()}
    assert rows == {("a.json", 1, "RSA", False), ("c.json", None, None, True), ("d.yml", 2, "RSA", False)}


def tar(files, mode):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as t:
        for name, data in files:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def test_archives(spark):
    files = [("top/a.py", b"x = 1"), ("top/b.txt", b"\xff\xfe\xff"), ("top/c.exe", b"")]
    rows = [("z", archives.zip_bytes([("r/a.py", "x"), ("q/b.py", "")])), ("g", tar(files, "w:gz")), ("b", tar([*files, ("../evil.py", b"x")], "w:bz2")), ("broken", b"PK nothing"), ("xz", tar(files, "w:xz")), ("null", None), ("empty", b"")]
    out = archives.members(spark.createDataFrame(rows, "path string, content binary")).collect()
    said = {p: sorted((r.member, r.text, r.reason) for r in out if r.path == p) for p, _ in rows}
    inner = [("a.py", "x = 1", None), ("b.txt", None, "not_utf8"), ("c.exe", None, "unsupported_type")]
    assert said["z"] == [("q/b.py", "", None), ("r/a.py", "x", None)]
    assert said["g"] == inner
    assert said["b"] == [("", None, "unsafe_path"), *inner]
    assert said["broken"] == said["xz"] == said["empty"] == [("", None, "unreadable_archive")]
    assert said["null"] == []


@pytest.mark.parametrize("limit", [0, 1, 3, 10, 57, 1000])
def test_fair_shares(spark, limit):
    want = {"a": 5, "b": 0, "c": 40, "d": 7, "e": 40, "f": None}
    said = {r.k: r.allocated for r in sel.fair_shares(spark.createDataFrame(list(want.items()), "k string, n long"), "k", "n", limit).collect()}
    left, got = limit, dict.fromkeys(want, 0)
    while left and any(got[k] < (n or 0) for k, n in want.items()):  # a unit a turn to each that still wants one
        for k, n in want.items():
            if left and got[k] < (n or 0):
                got[k], left = got[k] + 1, left - 1
    assert said == got


def test_lanes(spark):
    rows = spark.createDataFrame([("u", 1), ("u", 2), ("u", 3), ("i", 4), ("r", 5), ("r", 6)], "lane string, id int")
    out = sel.lanes(rows, "lane", {"u": 2, "i": 1, "r": 1}, ["id"], 5)
    assert [r.id for r in out.orderBy("place").collect()] == [1, 2, 4, 5, 3]


def test_unique_match_uses_a_finding_once(spark):
    ops = spark.createDataFrame([(1, "k"), (2, "k"), (3, "m"), (4, None), (1, "x")], "op int, key string")
    found = spark.createDataFrame([(7, "k"), (8, "m"), (9, "m"), (5, None)], "f int, key string")
    said = {(r.op, r.key): r.matched for r in sel.unique_match(ops, "op", found, "f", ["key"]).collect()}
    assert said == {(1, "k"): 7, (2, "k"): None, (3, "m"): None, (4, None): None, (1, "x"): None}


def test_path_conflicts(spark):
    paths = spark.createDataFrame([("A/b",), ("a/B",), ("a",), ("c",), (None,)], "path string")
    said = {(r.folded, r.reason) for r in sel.path_conflicts(paths.where(F.col("path").isNotNull()), "path").collect()}
    assert said == {("a/b", "repeated"), ("a", "file_and_directory")}


def test_merged_values(spark):
    rows = spark.createDataFrame([("one", 1), ("one", 1), ("two", 2), ("two", 1), ("many", 1), ("many", 2), ("many", 3), ("many", 4), ("many", 5), ("null", None), ("null", 1)], "g string, v int")
    said = {r.g: (r.state, r.alternatives) for r in sel.merged_values(rows, ["g"], "v").collect()}
    assert said == {"one": ("known", "1"), "two": ("ambiguous", "1,2"), "many": ("unknown", None), "null": ("unknown", None)}


def test_reports_round_trip(spark, tmp_path):
    rows = [("s", "b.py", 2, 'say "x", y\nz'), ("s", "a.py", 10, "=1+1"), ("s", "a.py", 9, None)]
    found = spark.createDataFrame(rows, "source_id string, file_name string, line int, evidence string")
    sinks.write_csv(found, f"{tmp_path}/csv")
    back = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(f"{tmp_path}/csv")
    assert back.columns == [label for _, label in sinks.COLUMNS]
    assert sorted((r["文件"], r["行号"], r["证据"] or "") for r in back.collect()) == [("a.py", "10", "'=1+1"), ("a.py", "9", ""), ("b.py", "2", 'say "x", y\nz')]
    sinks.write_json(found.withColumn("content", F.lit("x")), f"{tmp_path}/json")
    assert sorted(spark.read.json(f"{tmp_path}/json").columns) == ["evidence", "file_name", "line", "source_id"]
    sinks.write_rows(sinks.html_rows(found), f"{tmp_path}/html")
    assert "<td>say &quot;x&quot;, y" in "".join(r.value for r in spark.read.text(f"{tmp_path}/html").collect())
    sinks.write_csv(found.limit(0), f"{tmp_path}/none")


def test_archives_of_a_large_brand(spark, tmp_path):
    """More parts in a brand than an archive may have members."""
    from cairn.plans import files

    spark.range(1, 6002).selectExpr("id AS p_partkey", "'Brand#11' AS p_brand").write.parquet(f"{tmp_path}/part.parquet")
    rows = files.archive_members(spark, str(tmp_path)).collect()
    assert len({r.member for r in rows}) == len(rows) == 6001 and {r.reason for r in rows} == {None, "unsupported_type"}


def test_batches_of_texts_are_bounded():
    """Members of an archive with much text come in several batches, each of little more than the bound."""
    import pyarrow as pa

    schema = pa.schema([("path", pa.string()), ("ordinal", pa.int32()), ("member", pa.string()), ("text", pa.string()), ("reason", pa.string())])
    content = archives.zip_bytes([(f"m{i}.py", "x" * 300_000) for i in range(20)] + [(f"n{i}.bin", "") for i in range(3000)])
    out = list(archives.in_batches((("p", *m) for m in archives.members_of(content)), schema))
    assert sum(b.num_rows for b in out) == 3020 and max(b.num_rows for b in out) <= archives.BATCH_ROWS
    assert max(b.nbytes for b in out) < 2 * archives.TEXT_CHARS
    assert [o for b in out for o in b.column(1).to_pylist()] == list(range(3020))
