"""Small parsers of one file each: configuration scalars and imported Node calls. Spark does the rest with their rows."""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections.abc import Iterator

try:
    import yaml
except ImportError:  # without it, each configuration file gets a diagnostic
    yaml = None

MOST_DEPTH = 64
MOST_NODES = 50_000
PLAIN_TAGS = {f"tag:yaml.org,2002:{t}" for t in ("str", "int", "float", "bool", "null", "seq", "map")}


def _refuse(constant: str) -> None:
    raise ValueError(f"not JSON: {constant}")


def config_scalars(source: str, strict_json: bool) -> Iterator[tuple[int, str, str]]:
    """(line, key, value) of each string below a key; a sequence passes its key on to its items.

    Raises ValueError for text that can't be parsed, aliases, anchors, tags of
    an application, keys that aren't scalars, several documents, and for too
    deep or too many nodes.
    """
    if strict_json:
        json.loads(source, parse_constant=_refuse)
    if yaml is None:
        raise ValueError("no YAML parser")
    try:
        yield from _walk(getattr(yaml, "CSafeLoader", yaml.SafeLoader)(source))
    except yaml.YAMLError as e:
        raise ValueError(str(e)) from e


def _walk(loader) -> Iterator[tuple[int, str, str]]:
    stack: list[list] = []  # [is a mapping, the key in force, a key comes next]
    nodes = documents = 0
    while loader.check_event():
        event = loader.get_event()
        nodes += 1
        documents += isinstance(event, yaml.DocumentStartEvent)
        if documents > 1 or nodes > MOST_NODES:
            raise ValueError("too many nodes or documents")
        if isinstance(event, yaml.AliasEvent) or getattr(event, "anchor", None):
            raise ValueError("alias or anchor")
        tag = getattr(event, "tag", None)
        if tag and tag != "!" and tag not in PLAIN_TAGS:
            raise ValueError("tag of an application")
        top = stack[-1] if stack else None
        as_key = bool(top and top[0] and top[2])
        if isinstance(event, yaml.CollectionStartEvent):
            if as_key:
                raise ValueError("key is not a scalar")
            if top and top[0]:
                top[2] = True
            is_map = isinstance(event, yaml.MappingStartEvent)
            stack.append([is_map, None if is_map or not top else top[1], is_map])
            if len(stack) > MOST_DEPTH:
                raise ValueError("too deep")
        elif isinstance(event, yaml.CollectionEndEvent):
            stack.pop()
        elif isinstance(event, yaml.ScalarEvent):
            if as_key:
                top[1], top[2] = event.value, False
                continue
            if top and top[0]:
                top[2] = True
            kind = tag or loader.resolve(yaml.ScalarNode, event.value, event.implicit)
            if top and top[1] is not None and kind in ("!", "tag:yaml.org,2002:str"):
                yield event.start_mark.line + 1, top[1], event.value


JS_TOKEN = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|'(?:\\.|[^'\\\n])*'|"(?:\\.|[^"\\\n])*"|`(?:\\.|[^`\\])*`|[A-Za-z_$][\w$]*|===?|=>|\S""", re.S)
MAKERS = ("generateKeyPair", "generateKeyPairSync")
MODULES = ("crypto", "node:crypto")


def node_calls(source: str) -> list[tuple[int, str, str]]:
    """(line, method, first argument) of key generation by an imported Node crypto module.

    Works on tokens: comments are left out, and a string or a template is one
    token. A name assigned again or taken as a parameter before the call no
    longer counts as the import.
    """
    tokens = [(m[0], m.start()) for m in JS_TOKEN.finditer(source) if not m[0].startswith(("//", "/*"))]
    words = [t for t, _ in tokens]
    newlines = [m.start() for m in re.finditer("\n", source)]
    places: dict[str, list[int]] = {}
    for i, w in enumerate(words):
        places.setdefault(w, []).append(i)
    taken = _parameters(words)
    out = []
    for name, method, since in _node_imports(words):
        whole = [name] if method else None
        at_name = places.get(name, [])
        for i in at_name[bisect_left(at_name, since) :]:
            if words[i - 1] == ".":
                continue
            if words[i + 1 : i + 2] == ["="] or i in taken:
                break
            at = i + 1 if whole else i + 3
            called = method or (words[i + 2] if words[i + 1 : i + 2] == ["."] and i + 2 < len(words) else "")
            if called in MAKERS and words[at : at + 1] == ["("] and words[at + 2 : at + 3] in ([","], [")"]) and words[at + 1][0] in "'\"":
                out.append((bisect_left(newlines, tokens[i][1]) + 1, called, words[at + 1][1:-1]))
    return sorted(out)


def _parameters(words: list[str]) -> set[int]:
    """Tokens that follow an opening parenthesis, if a body follows the next closing one; found in one pass."""
    out: set[int] = set()
    waiting: list[int] = []
    opened = False
    for i, w in enumerate(words):
        if w == ")":
            if words[i + 1 : i + 2] in (["=>"], ["{"]):
                out.update(waiting)
            waiting, opened = [], False
        elif w in ("(", ";", "{", "}"):
            opened = w == "("
        elif opened:
            waiting.append(i)
    return out


def _end_of_names(words: list[str], i: int, stop: str) -> int | None:
    """Where a list of names that begins at i ends with `stop`; none if something else comes before."""
    while i < len(words) and words[i] != stop and words[i] not in ("import", "const", "let", "var") and (words[i] in "{},*:" or words[i][0] in "_$" or words[i][0].isalpha()):
        i += 1
    return i if words[i : i + 1] == [stop] else None


def _node_imports(words: list[str]) -> Iterator[tuple[str, str, int]]:
    """(local name, method or "" for the whole module, index after the import)."""
    for i, w in enumerate(words):
        if w == "import":
            end = _end_of_names(words, i + 1, "from")
            if end and words[end + 1 : end + 2] and words[end + 1].strip("'\"") in MODULES:
                yield from _names(words[i + 1 : end], "as", end + 2)
        elif w in ("const", "let", "var"):
            end = _end_of_names(words, i + 1, "=")
            if end and words[end + 1 : end + 3] == ["require", "("] and words[end + 3 : end + 4] and words[end + 3].strip("'\"") in MODULES:
                yield from _names(words[i + 1 : end], ":", end + 5)


def _names(words: list[str], renamed: str, since: int) -> Iterator[tuple[str, str, int]]:
    if words[:1] != ["{"]:
        if words:
            yield words[-1], "", since
        return
    part: list[str] = []
    for w in [*words[1:-1], ","]:
        if w != ",":
            part.append(w)
            continue
        if part and part[0] in MAKERS:
            yield (part[2] if part[1:2] == [renamed] and len(part) > 2 else part[0]), part[0], since
        part = []
