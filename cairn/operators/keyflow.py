"""Types of keys carried through assignments, arguments, returns and methods: a fixpoint over tables of facts."""

from __future__ import annotations

import ast
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import keyrules
from cairn.functions.flow import flow_facts
from cairn.functions.names import module_of
from cairn.operators.arguments import binding_faults, bound_arguments
from cairn.operators.steps import settled, spread, stored
from cairn.operators.symbols import bindings, module_facts, resolve_calls

FLOW = "module string, kind string, scope string, node string, place int, name string, value string, detail string"
#: Facts of both kinds in one table: of symbols, place is the line and value the target.
BOTH = f"fact string, {FLOW}, path string, end_line int"


@dataclass
class Program:
    """The facts of many modules: flow (FLOW; nodes with their module), symbols, and calls with their targets."""

    flow: DataFrame
    symbols: DataFrame
    calls: DataFrame
    made: DataFrame | None = None

    @property
    def arguments(self) -> DataFrame:
        dynamic = F.col("detail").isNotNull()
        return self.flow.where("kind = 'argument'").select(F.col("node").alias("call"), "place", F.col("name").alias("keyword"), "value", dynamic.alias("dynamic"))

    @property
    def parameters(self) -> DataFrame:
        return self.flow.where("kind = 'parameter'").select(F.concat_ws(".", "module", "scope").alias("function"), "place", F.col("name").alias("parameter"), F.col("detail").alias("kind"), F.col("value").alias("default"))


def program(files: DataFrame) -> Program:
    """The facts of all files (path, content); files that can't be parsed have none."""
    heads = [c.split() for c in BOTH.split(", ")]
    fields = pa.schema([(name, {"string": pa.string(), "int": pa.int32()}[kind]) for name, kind in heads])

    def run(batches):
        for b in batches:
            out = []
            for path, module, source in zip(*(b[c].to_pylist() for c in ("path", "module", "content")), strict=True):
                try:
                    tree = ast.parse(source or "")
                except (SyntaxError, ValueError, RecursionError):
                    out.append(("symbol", module, "unparsed", "", None, 0, None, None, None, path, 0))
                    continue
                try:
                    for kind, scope, node, place, name, value, detail in flow_facts(tree):
                        out.append(("flow", module, kind, scope, node, place, name, value, detail, None, None))
                except (SyntaxError, ValueError, RecursionError):
                    pass
                try:
                    out += [("symbol", module, kind, scope, None, line, name, target, None, path, end) for scope, kind, name, target, line, end in module_facts(tree)]
                except (SyntaxError, ValueError, RecursionError):
                    out.append(("symbol", module, "unparsed", "", None, 0, None, None, None, path, 0))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), fields, strict=True)], schema=fields)

    facts = stored(spread(files.select("path", module_of(F.col("path")).alias("module"), "content")).mapInArrow(run, BOTH), "fact", "kind")
    prefixed = {c: F.concat(F.coalesce("module", F.lit("None")), F.lit("#"), c) for c in ("node", "value")}
    flow = facts.where("fact = 'flow'").withColumns(prefixed).select(*[c.split()[0] for c in FLOW.split(", ")])
    symbols = facts.where("fact = 'symbol'").select("path", "module", "scope", "kind", "name", F.col("value").alias("target"), F.col("place").alias("line"), "end_line")
    targets = resolve_calls(symbols).select("module", "scope", F.col("line").alias("place"), "name", "target")
    calls = flow.where("kind = 'call'").join(targets, ["module", "scope", "place", "name"], "left")
    return Program(flow, symbols, settled(calls.select(F.col("node").alias("call"), "module", "scope", F.col("place").alias("line"), "name", F.col("value").alias("receiver"), F.col("detail").alias("method"), "target")))


def name_edges(p: Program) -> DataFrame:
    """source and target: from what a name stands for to where it is used.

    In its own scope a use takes the latest assignment above it; else the
    nearest scope around that binds the name decides, by a parameter or a
    single assignment; an imported name takes its module's single assignment.
    """
    assigns, uses = (p.flow.where(F.col("kind") == k) for k in ("assign", "use"))
    above = Window.partitionBy("module", "scope", "name").orderBy("place", "is_assign").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # at one line uses come before the assignment, which reads them
    both = uses.select("module", "scope", "name", "place", F.lit(0).alias("is_assign"), "node", F.lit(None).cast("string").alias("value")).unionByName(assigns.select("module", "scope", "name", "place", F.lit(1).alias("is_assign"), "node", "value"))
    latest = both.withColumn("source", F.last("value", ignorenulls=True).over(above)).where("is_assign = 0")
    own = latest.where("source is not null").select("source", F.col("node").alias("target"))
    once = assigns.groupBy("module", "scope", "name").agg(F.count(F.lit(1)).alias("n"), F.first("value").alias("bound")).where("n = 1").drop("n")
    params = p.flow.where("kind = 'parameter'").select("module", "scope", "name", parameter_node().alias("bound"))
    ways = bindings(p.symbols).where("ways = 1").select("module", "scope", "name", "kind", F.col("target").alias("imported"))
    defs = ways.join(once.unionByName(params), ["module", "scope", "name"], "left")
    far = once.where("scope = ''").select(F.concat_ws(".", "module", "name").alias("imported"), F.col("bound").alias("far"))
    defs = defs.join(far, "imported", "left").select("module", F.col("scope").alias("at"), "name", F.coalesce("bound", "far").alias("bound"))
    parts = F.filter(F.split("scope", r"\."), lambda x: x != "")
    around = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))
    asked = latest.where("source is null").select("module", "name", "node", F.posexplode(around).alias("depth", "at"))
    outer = asked.join(defs, ["module", "at", "name"]).groupBy("node").agg(F.max_by("bound", "depth").alias("source")).where("source is not null")
    return own.unionByName(outer.select("source", F.col("node").alias("target")))


def parameter_node():
    return F.concat(F.col("module"), F.lit("#"), F.col("scope"), F.lit("#"), F.col("name"))


def call_edges(p: Program) -> DataFrame:
    """source and target: arguments to parameters, and returned values to calls, of the program's own functions."""
    own = p.flow.where("kind = 'parameter'").select(F.concat_ws(".", "module", "scope").alias("function"), F.col("name").alias("parameter"), parameter_node().alias("target"))
    calls = p.calls.where("target is not null").select("call", F.col("target").alias("function"))
    called = settled(calls.join(own.select("function").distinct(), "function", "left_semi").select("call", "function"))
    given = bound_arguments(called, arguments_of(p, called), p.parameters).where("value is not null")
    down = given.join(own, ["function", "parameter"]).select(F.col("value").alias("source"), "target")
    up = p.flow.where("kind = 'return'").select(F.concat_ws(".", "module", "scope").alias("function"), F.col("value").alias("source")).join(calls, "function")
    return down.unionByName(up.select("source", F.col("call").alias("target")))


def arguments_of(p: Program, calls: DataFrame) -> DataFrame:
    return settled(p.arguments.join(calls.select("call").distinct(), "call", "left_semi"))


def contracted(edges: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges between other nodes; node and root of all nodes that have what their root has).

    What a single edge without a rule leads to, and nothing else makes a key,
    has the types of where the edge comes from. Chains of such nodes are
    followed by doubling; what goes round in a circle of them has no types,
    and no root.
    """
    edges = settled(edges.distinct())
    into = edges.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.max("source").alias("root"), F.max("rule").alias("rule"))
    up = settled(into.where("n = 1 and rule is null and root != target").select(F.col("target").alias("node"), "root").join(sources.select("node"), "node", "left_anti"))
    left = None
    while True:
        up = settled(up.join(up.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("open")))
        before, left = left, up.where("open").count()
        if left in (0, before):
            break
        up = up.drop("open")
    up = up.where("not open").select("node", "root")
    own = edges.join(into.where("n = 1 and rule is null and root != target").select("target").join(sources.select(F.col("node").alias("target")), "target", "left_anti"), "target", "left_anti")
    moved = own.join(up.withColumnRenamed("node", "source"), "source", "left").select(F.coalesce("root", "source").alias("source"), "target", "rule")
    return moved, up


def propagate(sources: DataFrame, edges: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """node, key_type and origin of all nodes that types reach.

    sources has node, key_type and origin; edges source, target and rule,
    which is null where a value goes on unchanged; rules rule, head and after:
    the new type of keys whose type begins with head. Each round joins only
    what the last one found with the edges, and ends when nothing is new, so
    cycles do no harm. A round's rows are a checkpoint in the shared folder.
    """
    known = delta = settled(sources.select("node", "key_type", "origin").distinct())
    plain = settled(edges.where("rule is null").select(F.col("source").alias("node"), "target").distinct())
    ruled = settled(edges.where("rule is not null").join(F.broadcast(rules), "rule").select(F.col("source").alias("node"), "head", "target", "after").distinct()) if rules is not None else None
    rounds = 0
    while not delta.isEmpty():
        new = delta.join(plain, "node").select(F.col("target").alias("node"), "key_type", "origin")
        if ruled is not None:
            new = new.unionByName(delta.withColumn("head", head(F.col("key_type"))).join(ruled, ["node", "head"]).select(F.col("target").alias("node"), F.col("after").alias("key_type"), "origin"))
        delta = settled(new.distinct().join(known, ["node", "key_type", "origin"], "left_anti"))
        known, rounds = known.unionByName(delta), rounds + 1
        if rounds % 8 == 0:
            known = settled(known)
    return known


def head(key_type):
    """The family of a type; that of one library's keys with its algorithm."""
    return F.when(key_type.startswith("pycrypto:"), F.substring_index(key_type, ":", 2)).otherwise(F.substring_index(key_type, ":", 1))


def made_keys(p: Program) -> DataFrame:
    """call, target and key_type of calls that make keys, and reason where their arguments or curve don't allow it."""
    if p.made is None:
        p.made = settled(_made_keys(p))
    return p.made


def _made_keys(p: Program) -> DataFrame:
    spark = p.flow.sparkSession
    rules = F.broadcast(keyrules.constructors(spark))  # some twenty rows
    calls = settled(p.calls.join(rules, "target").select("call", "module", "scope", "line", "target", "operation", "algorithm", "key_type"))
    asked = calls.select("call", F.col("target").alias("function"))
    arguments = arguments_of(p, calls)
    faults = binding_faults(asked, arguments, keyrules.rule_parameters(spark)).select("call", "reason")
    if asked.where("function = 'ecdsa.SigningKey.generate'").isEmpty():
        return calls.join(faults, "call")  # no call has a curve to be looked up
    curve = bound_arguments(asked.where("function = 'ecdsa.SigningKey.generate'"), arguments, keyrules.rule_parameters(spark)).where("parameter = 'curve' and origin != 'default'").select("call", F.col("value").alias("node"))
    curve = settled(curve)
    refs = p.flow.where("kind in ('reference', 'use')").join(curve, "node").select("call", "module", "scope", F.col("place").alias("line"), "name")
    path = F.lit(None).cast("string").alias("path")
    as_calls = refs.select(path, "module", "scope", F.lit("call").alias("kind"), "name", F.lit(None).cast("string").alias("target"), "line", F.col("line").alias("end_line"))
    packages = p.symbols.select("module", F.coalesce(F.regexp_like("path", F.lit(r"(^|/)__init__\.py$")), F.lit(False)).alias("is_package")).distinct()
    found = resolve_calls(p.symbols.where("kind != 'call'").unionByName(as_calls), packages).select("module", "scope", "line", "name", F.col("target").alias("curve"))
    known = [prefix + c for prefix in ("ecdsa.", "ecdsa.curves.") for c in keyrules.CURVES]
    good = refs.join(found, ["module", "scope", "line", "name"]).where(F.col("curve").isin(known)).select("call").distinct()
    odd = curve.select("call").join(good, "call", "left_anti").withColumn("odd", F.lit("unsupported_ecdsa_curve"))
    return calls.join(faults, "call").join(odd, "call", "left").withColumn("reason", F.coalesce("reason", "odd")).drop("odd")


def rule_edges(p: Program, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges that change a key's type, and their rules: public keys of private ones, and signers made from keys."""
    spark = p.flow.sparkSession
    derived = keyrules.derivations(spark)
    deriving = p.calls.where("receiver is not null").join(F.broadcast(derived.select("method").distinct()), "method")
    public = deriving.join(p.arguments.select("call"), "call", "left_anti").select(F.col("receiver").alias("source"), F.col("call").alias("target"), F.col("method").alias("rule"))
    rules = derived.select(F.col("method").alias("rule"), F.col("family").alias("head"), F.concat("family", F.lit(":public")).alias("after"))
    table = F.broadcast(keyrules.signers(spark))
    calls = settled(p.calls.join(table, "target").select("call", F.col("target").alias("function"), "scheme", F.col("parameter").alias("key_parameter"), "modes"))
    if calls.isEmpty():
        return public, rules
    bound = settled(bound_arguments(calls.select("call", "function"), arguments_of(p, calls), keyrules.rule_parameters(spark)).where("reason is null").join(calls, ["call", "function"]))
    constants = p.flow.where("kind = 'constant' and name = 'str'").select("node", F.col("value").alias("key_type"), F.lit("").alias("origin"))
    constants = constants.withColumn("key_type", F.split_part("key_type", F.lit("#"), F.lit(-1)))
    modes = bound.where("parameter = 'mode'").select("call", "modes", F.col("value").alias("node"))
    allowed = F.explode("modes")
    known = propagate(constants.join(F.broadcast(table.select(allowed.alias("key_type")).distinct()), "key_type").select("node", "key_type", "origin"), edges)
    fits = modes.join(known, "node").where(F.array_contains("modes", F.col("key_type"))).select("call").distinct()
    keys = bound.where("parameter = key_parameter").join(modes.select("call").distinct().join(fits, "call", "left_anti"), "call", "left_anti")
    signers = keys.select(F.col("value").alias("source"), F.col("call").alias("target"), F.concat(F.lit("signer:"), "scheme").alias("rule"))
    each = keyrules.signers(spark).select("scheme", F.explode("families").alias("family"))
    rules = rules.unionByName(each.select(F.concat(F.lit("signer:"), "scheme").alias("rule"), F.concat(F.lit("pycrypto:"), "family").alias("head"), F.concat(F.lit("signer:"), "scheme", F.lit(":"), "family").alias("after")))
    return public.unionByName(signers), rules


def reached(p: Program) -> tuple[DataFrame, DataFrame]:
    """(node, key_type and origin of nodes that decide for themselves; node and root of those that have what their root has)."""
    made = made_keys(p).where("reason is null and key_type is not null")
    sources = made.select(F.col("call").alias("node"), "key_type", F.col("call").alias("origin"))
    edges = settled(name_edges(p).unionByName(call_edges(p)).withColumn("rule", F.lit(None).cast("string")))
    changing, rules = rule_edges(p, edges)
    between, up = contracted(edges.unionByName(changing), sources)
    return settled(propagate(sources, settled(between), rules)), up


def spelled_out(known: DataFrame, up: DataFrame) -> DataFrame:
    return known.unionByName(known.withColumnRenamed("node", "root").join(up, "root").select("node", "key_type", "origin"))


def key_types(p: Program) -> DataFrame:
    """node, key_type and origin (the call that made the key) of every expression and parameter that a key reaches.

    Types are followed between nodes that several edges lead to; the others are
    spelled out by the plan that is returned, so that a condition on nodes
    leaves the rest unmade.
    """
    return spelled_out(*reached(p))


def operations(p: Program, types: DataFrame | None = None) -> DataFrame:
    """call, module, scope, line, api, operation_type, algorithm, key_type, origin and reason: what calls do with keys.

    Calls that make keys, and methods of what types say is a key, with the
    parameters that the method needs; a reason says why a call isn't one.
    """
    spark = p.flow.sparkSession
    called = settled(p.calls.where("receiver is not null").join(F.broadcast(keyrules.methods(spark).select("method").distinct()), "method"))
    if types is None:
        known, up = reached(p)
        asked = called.select(F.col("receiver").alias("node")).distinct()
        types = spelled_out(known, up.join(asked, "node", "left_semi"))
    made = made_keys(p).where("key_type is not null").select("call", "module", "scope", "line", F.col("target").alias("api"), F.col("operation").alias("operation_type"), "algorithm", "key_type", F.col("call").alias("origin"), "reason")
    parts = F.split("key_type", ":")
    used = called.join(types.withColumnRenamed("node", "receiver"), "receiver")
    used = used.withColumns({"family": parts[0], "role": parts[1]}).join(F.broadcast(keyrules.methods(spark)), ["family", "method"]).where(F.array_contains("roles", F.col("role")) | F.array_contains("roles", F.lit("*")))
    used = settled(used)
    asked = settled(used.select("call", "function").distinct())
    faults = binding_faults(asked, arguments_of(p, asked), keyrules.method_parameters(spark)).select("call", "function", "reason")
    algorithm = F.when(F.col("family") == "signer", parts[2]).when(F.col("family") == "EC", "ECC").otherwise(F.col("family"))
    used = used.join(faults, ["call", "function"]).select("call", "module", "scope", "line", "function", "operation", algorithm.alias("algorithm"), "key_type", "origin", "reason")
    return made.unionByName(used.withColumnsRenamed({"function": "api", "operation": "operation_type"}))
