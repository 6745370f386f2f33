"""Spans, numbers, facts and candidates against plain loops."""

import random

import pytest

from cairn.operators import candidates, numbering, selection, spans


def test_blocks_make_up_the_span(spark):
    ends = [(0, 0), (5, 5), (7, 3), (0, 1), (0, 1_000_000), (3, 999_999), (123_456, 654_321), (-9, 8), (1, 2)]
    rows = spark.createDataFrame(ends, "a long, b long")
    for r in rows.select("a", "b", spans.blocks_of(rows.a, rows.b).alias("x")).collect():
        parts = sorted((x.block << x.level, (x.block + 1) << x.level) for x in r.x)
        assert len(parts) <= 42 and sum(y - x for x, y in parts) == max(0, r.b - r.a)
        if parts:
            assert parts[0][0] == r.a and parts[-1][1] == r.b and all(p[1] == q[0] for p, q in zip(parts, parts[1:], strict=False))


def test_holding_spans(spark):
    rng = random.Random(3)
    own = [(rng.choice("xy"), i, s := rng.randrange(-50, 5000), s + rng.choice([0, 1, 7, 300, 10**6, -5])) for i in range(120)]
    places = [(rng.choice("xyz"), rng.choice([rng.randrange(-60, 6000), 900_000])) for _ in range(300)]
    got = spans.holding_spans(spark.createDataFrame([*places, ("x", None)], "g string, at long"), spark.createDataFrame([*own, ("x", 999, None, 5)], "g string, i long, a long, b long"), "at", "a", "b", ["g"]).collect()
    assert sorted((r.g, r.at, r.i) for r in got) == sorted((g, p, i) for g, p in places for h, i, a, b in own if g == h and a <= p < b)


@pytest.mark.parametrize("parts", [1, 4])
def test_numbers(spark, parts):
    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", "b", None]), rng.random(), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, x double, i int").repartition(parts)
    order = sorted(rows, key=lambda r: r[1])
    assert {r.i: r.number for r in numbering.dense_numbers(df, ["x"]).collect()} == {r[2]: n for n, r in enumerate(order, 1)}
    seen: dict = {}
    want = {}
    for r in order:
        seen[r[0]] = seen.get(r[0], 0) + 1
        want[r[2]] = seen[r[0]]
    assert {r.i: r.ordinal for r in numbering.numbered(df, ["g"], ["x"]).collect()} == want


def test_numbering_has_no_window_over_all_rows(spark):
    plan = numbering.dense_numbers(spark.range(1000), ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SinglePartition") <= 1  # that of the table with a row for each range
    assert numbering.dense_numbers(spark.range(0), ["id"]).count() == 0


def merged(facts, most=4):
    values: dict = {}
    for state, alternatives, *_ in facts:
        for v, conditions in alternatives:
            values.setdefault(v, []).extend(c for c in conditions if c not in values[v]) if v in values else values.update({v: list(dict.fromkeys(conditions))})
    reasons = [f[2] for f in facts if f[0] == "unknown"]
    origin = {f[3:5] for f in facts}
    if len(values) > most:
        return "unknown", [], "value_limit", None, None
    state, reason = ("unknown", reasons[0] if len(set(reasons)) == 1 else "unknown_branch") if reasons else ("known", None) if len(values) == 1 else ("ambiguous", None) if values else ("unknown", "missing_value")
    return state, [(v, c[:16]) for v, c in values.items()], reason, *(next(iter(origin)) if len(origin) == 1 else (None, None))


@pytest.mark.parametrize("parts", [1, 5])
def test_facts_merge_alike_however_they_are_dealt(spark, parts):
    rng = random.Random(5)
    rows = []
    for g in range(60):
        for i in range(rng.randrange(1, 7)):
            state = rng.choice(["known", "known", "ambiguous", "unknown"])
            n = 1 if state == "known" else rng.randrange(0, 4)
            rows.append((g, i, state, [(str(rng.randrange(5)), [f"c{rng.randrange(30)}" for _ in range(rng.randrange(12))]) for _ in range(n)], rng.choice("pq") if state == "unknown" else None, rng.choice(["RSA", "RSA", None]), rng.choice(["o", "o", "o", "u"])))
    df = spark.createDataFrame(rows, "g int, i int, state string, alternatives array<struct<value:string,conditions:array<string>>>, reason string, key_type string, key_origin string").repartition(parts)
    for r in selection.merged_facts(df, ["g"], "i").collect():
        want = merged([x[2:] for x in rows if x[0] == r.g])
        got = (r.state, [(a.value, list(a.conditions)) for a in r.alternatives], r.reason, r.key_type, r.key_origin)
        assert got == want


def test_candidates_inherit(spark):
    rng = random.Random(6)
    items = [(i, "s", rng.randrange(6), rng.choice([None, None, "x", "y", "z"]), rng.choice("abc"), rng.choice([None, 1]), rng.choice([None, "f"])) for i in range(60)]
    state: dict = {}
    for i, source, line, context, lane, ref, fact in items:
        here = [k for k in state if k[0] == line and k[1] is not None]
        if context is None and here:
            to = here
        else:
            to = [(line, context)]
            old = state.pop((line, None), None) if context is not None else None
            new = state.setdefault((line, context), [[], 0, 0])
            if old:
                new[0], new[1], new[2] = new[0] + old[0], new[1] + old[1], new[2] + old[2]
        for k in to:
            if lane not in state[k][0]:
                state[k][0].append(lane)
            state[k][1] += ref is not None
            state[k][2] += fact is not None
    got = {(r.line, r.context): [r.lanes, r.refs, r.facts] for r in candidates.inherited_candidates(spark.createDataFrame(items, "item_id int, source_id string, line int, context string, lane string, ref int, fact string")).collect()}
    assert got == state
