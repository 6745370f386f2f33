"""Symbols and calls of many Python files as fact tables: definitions, imports, writes and calls, resolved by joins."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.names import is_package, module_of
from cairn.functions.syntax import children, dotted, parameters
from cairn.operators.steps import measured_joins, spread

FACTS = "path string, module string, scope string, kind string, name string, target string, line int, end_line int"


def module_facts(source: str | ast.Module) -> Iterator[tuple[str, str, str, str | None, int, int]]:
    """(scope, kind, name, target, line, end line) of what a module, given as its text or parsed, defines, imports, writes and calls.

    Kinds are function, class, parameter, import, write and call. A scope is
    the dotted path of functions and classes around; calls in class bodies,
    lambdas and comprehensions aren't given, as no caller runs them as such.
    """
    tree = source if isinstance(source, ast.Module) else ast.parse(source)
    todo: list[tuple[ast.AST, str, bool]] = [(n, "", True) for n in tree.body]
    while todo:
        node, scope, runs = todo.pop()
        inner, inner_runs = scope, runs
        match node:
            case ast.FunctionDef() | ast.AsyncFunctionDef() | ast.ClassDef():
                is_class = isinstance(node, ast.ClassDef)
                yield scope, "class" if is_class else "function", node.name, None, node.lineno, node.end_lineno
                inner, inner_runs = f"{scope}.{node.name}" if scope else node.name, not is_class
                if not is_class:
                    for name in parameters(node.args):
                        yield inner, "parameter", name, None, node.lineno, node.lineno
                todo += [(n, inner, inner_runs) for n in node.body]
                continue
            case ast.Lambda() | ast.ListComp() | ast.SetComp() | ast.DictComp() | ast.GeneratorExp():
                inner_runs = False
            case ast.Import():
                for a in node.names:
                    yield scope, "import", a.asname or a.name.split(".")[0], a.name if a.asname else a.name.split(".")[0], node.lineno, node.lineno
            case ast.ImportFrom():
                base = "." * node.level + (node.module or "")
                for a in node.names:
                    yield scope, "import", a.asname or a.name, f"{base}{'' if base.endswith('.') else '.'}{a.name}", node.lineno, node.lineno
            case ast.Name(ctx=ast.Store() | ast.Del()):
                yield scope, "write", node.id, None, node.lineno, node.lineno
            case ast.Call() if runs and dotted(node.func):
                yield scope, "call", dotted(node.func), None, node.lineno, node.end_lineno
        todo += [(c, inner, inner_runs) for c in children(node)]


def symbol_facts(files: DataFrame) -> DataFrame:
    """The facts of all files (path, content); a file that can't be parsed has one row of kind `unparsed`."""
    heads = [c.split()[0] for c in FACTS.split(", ")]

    def run(batches):
        for b in batches:
            out = []
            for path, module, source in zip(b["path"], b["module"], b["content"], strict=True):
                try:
                    out += [(path, module, *fact) for fact in module_facts(source or "")]
                except (SyntaxError, ValueError, RecursionError):
                    out.append((path, module, "", "unparsed", None, None, 0, 0))
            yield pd.DataFrame(out, columns=heads)

    measured_joins(files.sparkSession)
    return spread(files.select("path", module_of(F.col("path")).alias("module"), "content")).mapInPandas(run, FACTS)


def bindings(facts: DataFrame) -> DataFrame:
    """(module, scope, name) with how many ways bind it, and target and kind where there is one alone."""
    bound = facts.where(F.col("kind").isin("function", "class", "parameter", "import", "write"))
    g = bound.groupBy("module", "scope", "name").agg(F.count(F.lit(1)).alias("ways"), F.first("kind").alias("kind"), F.first("target").alias("target"))
    return g.withColumns({"kind": F.when(F.col("ways") == 1, F.col("kind")), "target": F.when(F.col("ways") == 1, F.col("target"))})


def resolve_calls(facts: DataFrame, packages: DataFrame | None = None) -> DataFrame:
    """module, scope, line and name of every call, with its target and a reason where it has none.

    A call's root is looked up in the scopes around it, the nearest first: each
    call asks for all its scopes by a join, and the deepest answer counts. A
    name that several ways bind there is `ambiguous`, a parameter or a written
    name is `dynamic`, one that nothing binds is `unknown`. Functions and
    classes of the module are its own names; imports stand for their targets,
    relative ones for those that their module's place gives (packages: module,
    is_package).
    """
    calls = facts.where("kind = 'call'").select("module", "scope", "line", "name").distinct().withColumn("call", F.xxhash64("module", "scope", "line", "name"))
    parts = F.filter(F.split("scope", r"\."), lambda x: x != "")
    around = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))
    root, rest = F.split_part("name", F.lit("."), F.lit(1)), F.regexp_extract("name", r"^[^.]*(.*)$", 1)
    asked = calls.select("*", root.alias("root"), rest.alias("rest"), F.posexplode(around).alias("depth", "at"))
    found = bindings(facts).select("module", F.col("scope").alias("at"), F.col("name").alias("root"), "ways", F.col("kind").alias("bound"), "target")
    answers = asked.join(found, ["module", "at", "root"]).groupBy("call").agg(F.max_by(F.struct("ways", "bound", "target", "at", "root", "rest"), "depth").alias("x"))
    out = calls.join(answers, "call", "left")
    if packages is None:
        packages = facts.select("module", is_package(F.col("path")).alias("is_package")).distinct()
    out = out.join(packages, "module", "left")
    dots = F.length(F.regexp_extract("x.target", r"^(\.*)", 1))
    from_ = F.filter(F.split("module", r"\."), lambda x: x != "")
    keep = F.size(from_) - dots + F.when(F.coalesce("is_package", F.lit(False)), 1).otherwise(0)
    absolute = F.when(dots == 0, F.col("x.target")).when(keep >= 0, F.concat_ws(".", F.nullif(F.array_join(F.slice(from_, 1, F.greatest(keep, F.lit(0))), "."), F.lit("")), F.regexp_replace("x.target", r"^\.+", "")))
    own = F.concat_ws(".", "module", F.nullif(F.col("x.at"), F.lit("")), F.col("x.root"))
    target = F.when(F.col("x.bound") == "import", F.concat(absolute, F.col("x.rest"))).when(F.col("x.bound").isin("function", "class"), F.concat(own, F.col("x.rest")))
    reason = F.when(F.col("x").isNull(), "unknown").when(F.col("x.ways") > 1, "ambiguous").when(F.col("x.bound").isin("parameter", "write"), "dynamic").when(target.isNull(), "above_top")
    return out.select("module", "scope", "line", "name", target.alias("target"), reason.alias("reason"))


def module_edges(facts: DataFrame) -> DataFrame:
    """(source, target) of modules that import others of the same files, by the longest module that a target begins with."""
    modules = facts.select("module").distinct()
    imports = facts.where("kind = 'import' and not startswith(target, '.')").select(F.col("module").alias("source"), "target").distinct()
    parts = F.split("target", r"\.")
    prefixes = imports.select("source", "target", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))).alias("module"))
    best = prefixes.join(modules, "module").groupBy("source", "target").agg(F.max_by("module", F.length("module")).alias("to"))
    return best.where("source != to").select("source", F.col("to").alias("target")).distinct()


def sinks(resolved: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Calls of known targets with the code of their algorithm."""
    return resolved.join(F.broadcast(catalogue), "target").select("module", "scope", "line", "name", "target", "code")  # a fixed table of some forty rows


def import_after_use(facts: DataFrame, resolved: DataFrame) -> DataFrame:
    """Calls at the top of a module whose import comes only after them."""
    imports = facts.where("kind = 'import'").groupBy("module", "scope", F.col("name").alias("root")).agg(F.min("line").alias("imported"))
    calls = resolved.where("target is not null").withColumn("root", F.split_part("name", F.lit("."), F.lit(1)))
    return calls.join(imports, ["module", "scope", "root"]).where("imported > line").select("module", "scope", "line", "name")
