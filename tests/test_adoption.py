"""Opinions taken in order against a loop that takes one after another."""

import random

import pytest

from cairn.operators import integration as itg

ROWS = "finding_id string, source_id string, line int, algorithm string, purpose_code string, verification_status string, origin string, operation_id string, context_id string"
OPINIONS = "opinion_id long, kind string, algorithm string, purpose string, refs array<string>, source_id string, line int, context_id string, conflict boolean, gaps int, valid boolean, anchored boolean, basis string, scope_reason string"


def loop(rows, opinions, sources):
    """finding_id -> algorithm, status, purpose, reasons in order."""
    state = {r[0]: {"place": r[1:3], "algorithm": r[3], "status": r[5], "pending": r[5] == "pending", "purpose": "unknown", "context": r[8], "reasons": []} for r in rows}
    for o in sorted(opinions):
        number, kind, algorithm, purpose, refs, source, line, context, conflict, gaps, valid, anchored, basis, scope = o
        if kind == "abstain" or (scope and not refs) or (kind == "new_candidate" and algorithm == "AES"):
            continue
        met = {x for x in refs if x in state and not x.startswith("candidate")}
        if not met:
            if source not in sources:
                continue
            at = [k for k, r in state.items() if r["pending"] and r["place"] == (source, line) and (not context or r["context"] == context)]
            if len(at) != 1:
                at = [f"candidate-{number}"]
                state[at[0]] = {"place": (source, line), "algorithm": itg.OPEN_ALGORITHM if algorithm == "unknown" else algorithm, "status": "pending", "pending": True, "purpose": "unknown", "context": context, "reasons": []}
            met = set(at)
        for k in met:
            r = state[k]
            known = r["algorithm"] not in ("unknown", itg.OPEN_ALGORITHM)
            reason = (
                scope or (("conflicting_evidence" if kind == "questions_static" or conflict or (known and algorithm not in ("unknown", r["algorithm"])) else "") or ("missing_implementation" if gaps else "") or ("algorithm_unknown" if algorithm == "unknown" else ""))
                or ("" if valid and anchored else "evidence_not_anchored") or ("" if basis == "known_api" else "insufficient_basis") or itg.ADOPTED
            )
            r["reasons"].append(reason)
            if reason == itg.ADOPTED:
                r["said"] = purpose
                if r["status"] != "confirmed":
                    r.update(status="ai_assessed", algorithm=algorithm, purpose=purpose)
    return {k: (r["algorithm"], r["status"], r["purpose"] if r["status"] == "ai_assessed" else r.get("said", "unknown"), r["context"], len(r["reasons"]), r["reasons"][-1] if r["reasons"] else None) for k, r in state.items()}


@pytest.mark.parametrize("seed", range(4))
def test_order(spark, seed):
    rng = random.Random(seed)
    rows = [(f"r{i}", rng.choice("st"), rng.randrange(4), rng.choice([itg.OPEN_ALGORITHM, "RSA", "unknown"]), "unknown", rng.choice(["pending", "pending", "confirmed"]), "cross_file", None, rng.choice([None, "c", "d"])) for i in range(9)]
    rows = [(*r[:3], "RSA" if r[5] == "confirmed" else r[3], *r[4:]) for r in rows]
    one = lambda i: (i, rng.choice(["new_candidate"] * 4 + ["supports_static", "questions_static", "abstain"]), rng.choice(["RSA", "ECC", "unknown", "AES"]), rng.choice(["sign", "key_exchange"]), rng.choice([[], [], [], [f"r{rng.randrange(9)}"], ["r1", "r2"], ["gone"]]), rng.choice("sstu"), rng.randrange(4), rng.choice([None, "c", "d", "e"]), rng.random() < 0.1, int(rng.random() < 0.1), rng.random() < 0.9, rng.random() < 0.9, rng.choice(["known_api"] * 5 + ["name"]), "algorithm_binding_missing" if rng.random() < 0.1 else "")
    opinions = [one(i) for i in range(120)]
    out = itg.attach_opinions(spark.createDataFrame(rows, ROWS), spark.createDataFrame(opinions, OPINIONS).repartition(3), sources=spark.createDataFrame([("s",), ("t",)], "source_id string"))
    got = {r.finding_id: (r.algorithm, r.verification_status, r.purpose_code, r.context_id, r.opinion_count, r.last_reason) for r in out.collect()}
    assert got == loop(rows, opinions, {"s", "t"})


def test_second_opinion_sees_what_the_first_one_set(spark):
    rows = spark.createDataFrame([("r", "s", 1, itg.OPEN_ALGORITHM, "unknown", "pending", "cross_file", None, None)], ROWS)
    say = lambda i, algorithm: (i, "new_candidate", algorithm, "sign", ["r"], "s", 1, None, False, 0, True, True, "known_api", "")
    row = itg.attach_opinions(rows, spark.createDataFrame([say(2, "ECC"), say(1, "RSA"), say(3, "RSA")], OPINIONS)).first()
    assert (row.algorithm, row.reasons, row.last_reason, row.review_required) == ("RSA", ["conflicting_evidence", itg.ADOPTED], itg.ADOPTED, True)


def test_policies_are_configurations(spark):
    findings = spark.createDataFrame([], "finding_id string, source_id string, line int, algorithm string, resolved_api string")
    levels = {"ALGORITHM": "E3", "OPERATION_TYPE": "E3", "QUANTUM_CLASS": "E3"}
    ops = spark.createDataFrame([("o", "s", 1, "RSA", "jwt.decode", "verify", levels, "quantum_vulnerable", "call", "x", "algorithm_policy")], "operation_id string, source_id string, line int, algorithm string, api string, operation_type string, levels map<string, string>, risk_category string, context_kind string, context_id string, evidence_scope string")
    row = itg.integrate_operations(findings, ops).first()
    assert (row.purpose_code, row.context_id, row.verification_status) == ("configuration", "x", "confirmed")
