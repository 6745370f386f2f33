"""Arguments, key types and call paths against Python itself and plain loops."""

import inspect
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cairn.functions.flow import flow_facts
from cairn.operators import arguments, contexts, keyflow

SIGNATURES = ["", "a", "a, b=1", "a, /, b, *, c", "a, b=2, /, c=3, *, d=4, e", "*, x", "a, *rest, k=1", "a, **more"]
CALLS = ["", "1", "1, 2", "1, 2, 3", "b=2", "1, b=2", "1, c=3", "a=1", "a=1, b=2", "*[1, 2], c=5", "1, **{'b': 2}", "1, **{'b': 2, 'c': 4}", "1, e=7", "1, 2, 3, e=1", "x=1", "1, a=2", "1, k=3"]


def facts(spark, source):
    rows = [tuple(f) for f in flow_facts(source)]
    return spark.createDataFrame(rows, "kind string, scope string, node string, place int, name string, value string, detail string")


def tables(spark, source, functions):
    f = facts(spark, source)
    args = f.where("kind = 'argument'").select(F.col("node").alias("call"), "place", F.col("name").alias("keyword"), "value", F.col("detail").isNotNull().alias("dynamic"))
    params = f.where("kind = 'parameter'").select(F.col("scope").alias("function"), "place", F.col("name").alias("parameter"), F.col("detail").alias("kind"), F.col("value").alias("default"))
    calls = f.where("kind = 'call'").select(F.col("node").alias("call"), F.col("name").alias("function")).where(F.col("function").isin(functions))
    text = {r.node: r.value for r in f.where("kind = 'constant'").collect()}
    return calls, args, params, text


def test_bindings_are_those_of_python(spark):
    pairs = [(s, c) for s in SIGNATURES for c in CALLS]
    source = "".join(f"def f{i}({s}): pass\nf{i}({c})\n" for i, (s, c) in enumerate(pairs))
    calls, args, params, text = tables(spark, source, [f"f{i}" for i in range(len(pairs))])
    got, reason = defaultdict(dict), {}
    for r in arguments.bound_arguments(calls, args, params).collect():
        got[int(r.function[1:])][r.parameter] = text.get(r.value)
    for r in arguments.binding_faults(calls, args, params).collect():
        reason[int(r.function[1:])] = r.reason
    for i, (s, c) in enumerate(pairs):
        space: dict = {}
        exec(f"def f({s}): pass\ndef g(*a, **k): return a, k\ngot = g({c})", space)
        sig = inspect.signature(space["f"])
        named = [p for p in sig.parameters.values() if p.kind not in (p.VAR_POSITIONAL, p.VAR_KEYWORD)]
        # * and ** parameters take nothing
        try:
            bound = sig.replace(parameters=named).bind(*space["got"][0], **space["got"][1])
            bound.apply_defaults()
            assert reason[i] is None and got[i] == {k: str(v) for k, v in bound.arguments.items()}, (s, c)
        except TypeError:
            assert reason[i] in ("invalid_argument_binding", "missing_argument") and set(got[i].values()) <= {None}, (s, c)


def test_reasons_and_conflict_sets(spark):
    many = ", ".join(f"p{i}" for i in range(70))
    source = f"""
def f(a, /, b, *, c): pass
def g({many}): pass
def h(*, x=1): pass
f(*z)
f(1, 2, 3, c=4)
f(1, 2, b=3, c=1)
f(a=1, b=2, c=3)
f(1, q=3, r=4)
f(1)
f(**z, b=1)
f(b=1, **{{'b': 2}})
g(1)
h({", ".join(["x"] * 65)})
f(b=1, **{{'b': 2}}, **z)
"""
    calls, args, params, _ = tables(spark, source, ["f", "g", "h"])
    got = {r.call.split(":")[0]: r for r in arguments.binding_faults(calls, args, params).collect()}
    assert [got[str(n)].reason for n in range(5, 16)] == ["dynamic_unpack", *["invalid_argument_binding"] * 4, "missing_argument", "dynamic_unpack", "invalid_argument_binding", "argument_limit", "argument_limit", "invalid_argument_binding"]
    assert got["6"].surplus == 1 and got["7"].twice == ["b"] and got["8"].positional_only == ["a"] and got["9"].unknown == ["q", "r"] and got["10"].missing == ["b", "c"]
    rows = arguments.bound_arguments(calls, args, params).where("function = 'g'").collect()
    assert len(rows) == 64 and {r.reason for r in rows} == {"argument_limit"}


KEYS = {
    "pkg/keys.py": """
from cryptography.hazmat.primitives.asymmetric import rsa, ec, x25519
from Crypto.PublicKey import RSA, ECC
from Crypto.Signature import pss, DSS
import ecdsa
def make(bits=2048):
    key = rsa.generate_private_key(65537, bits)
    return key
def loop(k, n=3):
    again = loop(k)
    return k
shared = ec.generate_private_key(ec.SECP256R1())
bad = rsa.generate_private_key()
mode = 'fips-186-3'
signer = pss.new(RSA.generate(2048))
dss = DSS.new(ECC.generate(curve='P-256'), mode)
wrong = DSS.new(ECC.generate(curve='P-256'), 'other')
mixed = pss.new(ECC.generate(curve='P-256'))
curve = ecdsa.SigningKey.generate(curve=ecdsa.NIST256p)
other = ecdsa.SigningKey.generate(curve=ecdsa.Mine)
""",
    "pkg/use.py": """
from pkg.keys import make, loop, shared, signer, dss, curve
def run(key):
    public = key.public_key()
    public.encrypt(b'', None)
    public.decrypt(b'', None)
    return public
k = make()
k = loop(k)
run(k)
run(key=k).verify(b'', b'', None, None)
shared.exchange(None, None)
shared.sign(b'')
signer.sign(b'')
dss.verify(b'', b'')
curve.get_verifying_key().verify(b'', b'')
k = None
k.sign(b'', None, None)
""",
    "pkg/odd.py": "def (:",
}


def test_keys_are_followed_across_files(spark):
    files = spark.createDataFrame(list(KEYS.items()), "path string, content string")
    p = keyflow.program(files)
    got = {(r.module, r.line, r.operation_type, r.algorithm, r.key_type, r.reason) for r in keyflow.operations(p).collect()}
    keys = {(line, t, reason) for m, line, _, _, t, reason in got if m == "pkg.keys"}
    assert keys == {(7, "RSA:private", None), (12, "EC:private", None), (13, "RSA:private", "missing_argument"), (15, "pycrypto:RSA:either", None), *[(n, "pycrypto:ECC:either", None) for n in (16, 17, 18)], (19, "ECDSA:private", None), (20, "ECDSA:private", "unsupported_ecdsa_curve")}
    assert {x[1:] for x in got if x[0] == "pkg.use"} == {
        (5, "encrypt", "RSA", "RSA:public", None), (11, "verify", "RSA", "RSA:public", None), (12, "key_exchange", "ECC", "EC:private", None), (13, "sign", "ECC", "EC:private", "missing_argument"),
        (14, "sign", "RSA", "signer:pss:RSA", None), (15, "verify", "ECC", "signer:DSS:ECC", None), (16, "verify", "ECDSA", "ECDSA:public", None),
    }


def test_types_reach_all_nodes_of_a_cyclic_graph(spark):
    rng = random.Random(2)
    edges = [(str(rng.randrange(60)), str(rng.randrange(60)), rng.choice([None, None, "public_key"])) for _ in range(110)]
    want = todo = {("0", "RSA:private", "o"), ("1", "EC:private", "p"), ("2", "DSA:x", "q")}
    while todo:
        new = {(t, k if rule is None else k.split(":")[0] + ":public", o) for n, k, o in todo for s, t, rule in edges if s == n and (rule is None or k.split(":")[0] in ("RSA", "EC"))}
        todo = new - want
        want = want | todo
    rules = spark.createDataFrame([("public_key", f, f + ":public") for f in ("RSA", "EC")], "rule string, head string, after string")
    sources = spark.createDataFrame([("0", "RSA:private", "o"), ("1", "EC:private", "p"), ("2", "DSA:x", "q")], "node string, key_type string, origin string")
    got = keyflow.propagate(sources, spark.createDataFrame(edges, "source string, target string, rule string"), rules)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def brute_paths(calls, sink, depth, limit):
    """Depth first, callers in order, at most `limit` paths."""
    incoming = defaultdict(list)
    for c, caller, callee in sorted(set(calls)):
        incoming[callee].append((c, caller))
    out, pending = [], [(sink, (), ())]
    while pending:
        at, chain, seen = pending.pop()
        if at.endswith(":<module>"):
            out.append((chain, None))
        elif at in seen:
            out.append((chain, "recursive_call"))
        elif not incoming[at]:
            out.append(((), "uninstantiated_template"))
        elif len(chain) >= depth:
            out.append((chain, "call_depth_limit"))
        else:
            for c, caller in reversed(incoming[at][: limit + 1]):
                pending.append((caller, (c, *chain), (*seen, at)))
        if len(out) >= limit:
            return out + ([((), "context_limit")] if pending else [])
    return out


@pytest.mark.parametrize(("seed", "depth", "limit"), [(1, 5, 64), (2, 3, 4), (3, 5, 8), (4, 1, 1)])
def test_paths_of_a_cyclic_call_graph(spark, seed, depth, limit):
    rng = random.Random(seed)
    name = lambda: "m:<module>" if rng.random() < 0.15 else f"m:f{rng.randrange(14)}"
    calls = [(f"c{i:03d}", name(), f"m:f{rng.randrange(14)}") for i in range(40)]
    sinks = [f"m:f{i}" for i in range(16)]
    got = defaultdict(list)
    rows = contexts.caller_paths(spark.createDataFrame(calls, "call string, caller string, callee string"), spark.createDataFrame([(s, s) for s in sinks], "sink string, function string"), depth, limit).collect()
    for r in rows:
        got[r.sink].append((tuple(r.path), r.reason))
    for s in sinks:
        assert sorted(got[s], key=str) == sorted(brute_paths(calls, s, depth, limit), key=str)


def test_nodes_with_one_edge_into_them_have_what_their_root_has(spark):
    """Types spelled out from roots are those of all nodes, with chains, circles, loops and keys made inside a chain; chains need no rounds of their own."""
    rng = random.Random(5)
    edges = [(f"c{i}", f"c{i + 1}", None) for i in range(200)] + [("x0", "x1", None), ("x1", "x2", None), ("x2", "x0", None), ("x2", "tail", None), ("s", "s", None), ("c150", "fork", None), ("c20", "fork", None), ("c30", "pub", "public_key"), ("pub", "after", None)]
    edges += [(str(rng.randrange(90)), str(rng.randrange(90)), rng.choice([None, None, None, "public_key"])) for _ in range(100)] + [("c200", "0", None), ("c200", "0", None)]
    sources = [("c0", "RSA:private", "o"), ("c100", "EC:private", "p"), ("1", "EC:private", "p"), ("2", "RSA:private", "q"), ("2", "RSA:private", "r")]
    want = todo = set(sources)
    while todo:
        new = {(t, k if rule is None else k.split(":")[0] + ":public", o) for n, k, o in todo for s, t, rule in edges if s == n}
        todo = new - want
        want = want | todo
    rules = spark.createDataFrame([("public_key", f, f + ":public") for f in ("RSA", "EC")], "rule string, head string, after string")
    made = spark.createDataFrame(sources, "node string, key_type string, origin string")
    between, up = keyflow.contracted(spark.createDataFrame(edges, "source string, target string, rule string"), made)
    assert between.where("source like 'c%' and target like 'c%'").count() == 1  # to c100, where a key is made
    assert {"x0", "x1", "x2", "tail", "s", "c0", "c100"}.isdisjoint(r.node for r in up.collect())
    got = keyflow.spelled_out(keyflow.propagate(made, between, rules), up)
    assert sorted(map(tuple, got.collect())) == sorted(want)
