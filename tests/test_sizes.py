"""How plans grow: what goes through one task or the driver, and how many rows are made on the way."""

import random

from pyspark.sql import functions as F

from cairn.operators import arguments, dispatch, keyflow, sequences, spans, views
from cairn.plans import choices  # noqa: F401 - it registers its queries
from cairn.plans.registry import QUERIES


def test_facts_are_read_by_many_tasks_and_never_sent_whole(spark):
    one_task = spark.range(40).select(F.format_string("p%d.py", "id").alias("path"), F.lit("def f(a): pass\nf(1)").alias("content")).coalesce(1)
    p = keyflow.program(one_task)
    assert p.flow.rdd.getNumPartitions() > 1 and p.flow.where("kind = 'call'").count() == 40
    calls = p.calls.where("target is not null").select("call", F.col("target").alias("function"))
    bound = arguments.bound_arguments(calls, p.arguments, p.parameters)
    plan = bound._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert bound.where("reason is null and origin = 'positional'").count() == 40


def test_few_sizes_of_blocks(spark):
    rows = spark.createDataFrame([(3, 999_999), (-70, 70), (5, 5), (0, 16)], "a long, b long")
    for r in rows.select("a", "b", spans.blocks_of(rows.a, rows.b, 4).alias("x")).collect():
        held = [p for x in r.x for p in range(x.block << x.level, (x.block + 1) << x.level)]
        assert sorted(held) == list(range(r.a, r.b)) and {x.level for x in r.x} <= {0, 4, 8, 12, 16}


def test_ranges_join_without_a_row_for_each_number(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), s := rng.randrange(300), s + rng.choice([-3, 0, 1, 4])) for _ in range(60)] + [("c", 1, 10**12), ("c", 10**12 + 1, 10**12 + 2), ("c", None, 3)]
    got = sorted(tuple(r) for r in sequences.joined_ranges(spark.createDataFrame(rows, "g string, low long, high long"), ["g"], "low", "high").collect())
    want = [("c", 1, 10**12 + 2, 10**12 + 2)]
    for g in "ab":
        held = sorted({n for h, a, b in rows if h == g for n in range(a, b + 1)})
        first = [n for n in held if n - 1 not in held]
        last = [n for n in held if n + 1 not in held]
        want += [(g, a, b, b - a + 1) for a, b in zip(first, last, strict=True)]
    assert got == sorted(want)


def test_islands_send_rows_once(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("a", 4), ("b", None), ("b", None), ("b", 7)], "g string, n long")
    out = sequences.islands(rows, ["g"], "n")
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, [("a", 1, 2, 2), ("a", 4, 4, 1), ("b", None, None, 1), ("b", 7, 7, 1)]))
    assert out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") <= 1


def test_names_are_tried_by_many_tasks(spark):
    names = spark.createDataFrame([("a.b.c",), ("a.x",), ("z",)], "n string").coalesce(1)
    out = sequences.longest_prefix(names, "n", spark.createDataFrame([("a",), ("a.b",)], "m string"), "m", ".")
    assert sorted(map(tuple, out.collect())) == [("a.b.c", "a.b"), ("a.x", "a")] and "REPARTITION_BY_NUM" in out._jdf.queryExecution().sparkPlan().toString()


def test_neighbours_over_repeated_edges_either_way(spark):
    edges = spark.createDataFrame([(1, 2), (1, 2), (3, 2), (2, 1), (4, 3), (9, 9)], "source int, target int")
    got = {r.node: r.distance for r in views.neighbourhood(edges, spark.createDataFrame([(1,)], "node int"), 2).collect()}
    assert got == {1: 0, 2: 1, 3: 2}


def test_calls_of_one_name_with_many_definitions(spark, tmp_path):
    # 3,000 definitions and as many calls of one name in one source: nine million pairs if each call met each definition
    spark.range(3000).select((F.col("id") * 97 + 5).alias("p_partkey"), F.lit(1).alias("p_size")).write.parquet(f"{tmp_path}/part.parquet")
    spark.range(3000).select((F.col("id") * 50).alias("o_orderkey"), F.lit(5).cast("long").alias("o_custkey")).write.parquet(f"{tmp_path}/orders.parquet")
    out = QUERIES["resolved_calls"](spark, str(tmp_path))
    assert out.count() == 0
    grouped = [n for n in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "p_partkey" in n and "Aggregate" in n]
    assert grouped


def test_files_are_scanned_by_many_tasks(spark):
    files = spark.range(40).select(F.format_string("p%d.py", "id").alias("file_name"), F.lit("x = 1").alias("content")).coalesce(1)
    assert dispatch.facts(files).rdd.getNumPartitions() > 1


def test_lines_are_masked_by_many_tasks(spark, tmp_path):
    spark.range(40).select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    assert QUERIES["redacted_lines"](spark, str(tmp_path)).rdd.getNumPartitions() > 1


def test_pairs_of_operations_are_windows_of_their_place(spark):
    """Findings are dealt by place once and by id once; those without an operation don't all meet in one task of nulls."""
    from cairn.operators import integration as itg

    levels = "map('ALGORITHM', 'E3', 'OPERATION_TYPE', 'E3', 'QUANTUM_CLASS', 'E3') levels"
    findings = spark.sql("SELECT * FROM VALUES ('f1', 's', 1, 'RSA', 'a'), ('f2', 's', 2, 'RSA', 'a'), ('f3', 's', 2, 'RSA', 'b'), ('f4', 's', 3, 'ECDSA', 'c'), ('f5', null, 4, 'RSA', 'a'), ('f6', 's', 1, 'ECDSA', 'a') AS t(finding_id, source_id, line, algorithm, resolved_api)")
    template = "'uninstantiated_template'"
    operations = spark.sql(f"SELECT *, 'sign' operation_type, {levels}, 'quantum_vulnerable' risk_category FROM VALUES ('o1', 's', 1, 'RSA', 'z', 'call'), ('o2', 's', 1, 'RSA', 'a', {template}), ('o3', 's', 2, 'RSA', 'a', {template}), ('o4', 's', 3, 'RSA', 'c', {template}), ('o5', null, 4, 'RSA', 'a', 'call') AS t(operation_id, source_id, line, algorithm, api, context_kind)")
    out = itg.integrate_operations(findings, operations)
    # o2 finds its place taken and joins the one left with its call; o3 can't tell f2 from f3; o4 has no finding of its algorithm; null keys meet nothing
    assert {(r.finding_id, r.operation_id) for r in out.collect() if r.origin != "cross_file"} == {("f1", "o1"), ("f2", None), ("f3", None), ("f4", "o4"), ("f5", None), ("f6", "o2")}
    assert {r.operation_id for r in out.collect() if r.origin == "cross_file"} == {"o3", "o5"}
    joins = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join LeftOuter" in x]
    assert joins and not any("operation_id" in x for x in joins)
