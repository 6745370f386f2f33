"""Facts about values in one Python module: calls with their arguments, parameters, assignments, returns and uses of names."""

from __future__ import annotations

import ast
from collections.abc import Iterator

from cairn.functions.syntax import children, dotted

#: kind, scope, node, place, name, value, detail
Fact = tuple[str, str, str | None, int, str | None, str | None, str | None]


def node_id(node: ast.AST) -> str:
    """Where an expression stands; a call and its receiver begin at the same place, so the end belongs to it."""
    return f"{node.lineno}:{node.col_offset}-{node.end_lineno}:{node.end_col_offset}"


def arguments(call: ast.Call) -> Iterator[tuple[str | None, ast.expr | None]]:
    """(keyword or None, value) in order, with literal * and ** spread out; what can't be spread has no value."""
    for a in call.args:
        if not isinstance(a, ast.Starred):
            yield None, a
        elif isinstance(a.value, ast.List | ast.Tuple) and not any(isinstance(x, ast.Starred) for x in a.value.elts):
            yield from ((None, x) for x in a.value.elts)
        else:
            yield None, None
    for k in call.keywords:
        if k.arg is not None:
            yield k.arg, k.value
        elif isinstance(k.value, ast.Dict) and all(isinstance(x, ast.Constant) and isinstance(x.value, str) for x in k.value.keys):
            yield from zip((x.value for x in k.value.keys), k.value.values, strict=True)
        else:
            yield "", None


def signature(args: ast.arguments) -> Iterator[tuple[str, str, ast.expr | None]]:
    """(kind, name, default) of each parameter in order, those of * and ** last."""
    plain = [*args.posonlyargs, *args.args]
    defaults = [None] * (len(plain) - len(args.defaults)) + args.defaults
    for i, (a, d) in enumerate(zip(plain, defaults, strict=True)):
        yield "positional_only" if i < len(args.posonlyargs) else "positional", a.arg, d
    yield from (("keyword_only", a.arg, d) for a, d in zip(args.kwonlyargs, args.kw_defaults, strict=True))
    yield from ((kind, a.arg, None) for kind, a in (("vararg", args.vararg), ("kwarg", args.kwarg)) if a)


def flow_facts(source: str | ast.Module) -> Iterator[Fact]:
    """All facts of a module, given as its text or parsed; scopes are dotted paths of functions and classes, and calls in lambdas and comprehensions have none of their own."""
    tree = source if isinstance(source, ast.Module) else ast.parse(source)
    todo: list[tuple[ast.AST, str]] = [(n, "") for n in reversed(tree.body)]
    while todo:
        node, scope = todo.pop()
        inner, below = scope, None
        match node:
            case ast.FunctionDef() | ast.AsyncFunctionDef():
                inner = f"{scope}.{node.name}" if scope else node.name
                for i, (kind, name, default) in enumerate(signature(node.args)):
                    yield "parameter", inner, None, i, name, default and node_id(default), kind
                todo += [(d, scope) for d in (*node.decorator_list, *node.args.defaults, *filter(None, node.args.kw_defaults))]
                below = node.body
            case ast.ClassDef():
                inner, below = f"{scope}.{node.name}" if scope else node.name, node.body
            case ast.Assign(targets=[ast.Name(id=name)], value=value) | ast.AnnAssign(target=ast.Name(id=name), value=ast.expr() as value):
                yield "assign", scope, node_id(value), node.lineno, name, node_id(value), None
            case ast.Return(value=ast.expr() as value):
                yield "return", scope, node_id(value), node.lineno, None, node_id(value), None
            case ast.Call():
                method = isinstance(node.func, ast.Attribute)
                yield "call", scope, node_id(node), node.lineno, dotted(node.func), node_id(node.func.value) if method else None, node.func.attr if method else None
                for i, (name, value) in enumerate(arguments(node)):
                    yield "argument", scope, node_id(node), i, name, value and node_id(value), None if value else "dynamic_unpack"
            case ast.Name(ctx=ast.Load()):
                yield "use", scope, node_id(node), node.lineno, node.id, None, None
            case ast.Attribute(ctx=ast.Load()) if dotted(node):
                yield "reference", scope, node_id(node), node.lineno, dotted(node), None, None
            case ast.Constant(value=str() | bool() | int() | float() | None as value):
                yield "constant", scope, node_id(node), node.lineno, type(value).__name__, str(value), None
        todo += [(c, inner) for c in reversed(children(node) if below is None else below)]
