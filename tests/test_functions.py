"""Functions and scanners on small cases of their own."""

import random

import pytest
from pyspark.sql import functions as F

from cairn.functions import rules, syntax, text
from cairn.operators import findings, sequences
from cairn.sources.readers import folder


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


def test_profiles(spark):
    assert rules.profiles(spark).count() == 11


def test_sensitive_names(spark):
    said = {n: one(spark, rules.sensitive(F.col("n")), n=n) for n in ("jwtAlg", "ssh-key", "title", "keyboard", "tls.version")}
    assert said == {"jwtAlg": True, "ssh-key": True, "title": False, "keyboard": False, "tls.version": True}


def test_escapes(spark):
    assert one(spark, text.csv_guard(F.col("v")), v=" =1+1") == "' =1+1"
    assert one(spark, text.csv_guard(F.col("v")), v="\t@x") == "'\t@x"
    assert one(spark, text.csv_guard(F.col("v")), v="a=1") == "a=1"
    assert one(spark, text.markdown_cell(F.col("v")), v="a|b\nc<") == "a\\|b ↵ c&lt;"
    assert one(spark, text.html_text(F.col("v")), v="<a b='c'>&") == "&lt;a b=&#x27;c&#x27;&gt;&amp;"
    assert one(spark, text.fence(F.col("v")), v="x ```` y") == "`````"
    assert one(spark, text.redact(F.col("v")), v='ftp://me:pw@host token = "abc"') == 'ftp://[REDACTED]@host token = "[REDACTED]"'


def test_imported_calls():
    head = "from cryptography.hazmat.primitives.asymmetric import rsa\n"
    calls = lambda source: [f for f in syntax.python_facts(source) if f[0] in ("call", "curved")]
    assert calls(head + "rsa.generate_private_key(65537, 2048)") == [("curved", 2, "rsa.generate_private_key", "cryptography.hazmat.primitives.asymmetric.rsa.generate_private_key")]
    assert calls(head + "rsa = None\nrsa.generate_private_key()") == []
    assert calls("service.rsa.generate_private_key()") == []
    assert calls("def broken(:") == []


def test_config_scan_of_empty_and_null(spark):
    text_ = "alg: 'RS256'; # ES256\r\nkeys: [RS256, ES256]\u2028tls-key = ES256\nnotes: RS256\ncipher: \"a # b\"\njwt: 'x' # RS256"
    src = spark.createDataFrame([("a.yaml", ""), ("b.yaml", None), ("c.yaml", text_)], "file_name string, content string")
    assert sorted((r.file_name, r.line, r.algorithm) for r in findings.scan_config(src).collect()) == [("c.yaml", 1, "RSA"), ("c.yaml", 3, "ECDSA")]


def test_budgets_differ(spark):
    rows = spark.createDataFrame([("g", i, n) for i, n in enumerate([5, 9, 3])], "g string, i int, n int")
    assert [r.i for r in sequences.within_budget(rows, "g", ["i"], "n", 10).orderBy("i").collect()] == [0]
    assert [r.i for r in sequences.greedy_budget(rows, "g", ["i"], "n", 10).orderBy("i").collect()] == [0, 2]


def test_greedy_budget_against_a_loop(spark):
    """Groups of all sizes, a null group, null sizes and repeated places, as one loop over each group would take them."""
    rng = random.Random(3)
    data = [(rng.choice(["a", "a", "a", "b", None]), i, rng.choice([None, 0, *range(1, 60)])) for i in range(400)]
    want: dict = {}
    for g, i, n in data:
        taken = want.setdefault(g, [0, []])
        if taken[0] + (n or 0) <= 200:
            taken[0] += n or 0
            taken[1].append(i)
    rows = spark.createDataFrame(data, "g string, i int, n int").repartition(5)
    got: dict = {}
    for r in sequences.greedy_budget(rows, "g", ["i"], "n", 200).collect():
        got.setdefault(r.g, []).append(r.i)
    assert {g: sorted(v) for g, v in got.items()} == {g: v for g, (_, v) in want.items()}


def test_folder(spark, tmp_path):
    (tmp_path / "a.py").write_text("x = 1")
    (tmp_path / "b.exe").write_bytes(b"\0")
    (tmp_path / "c.txt").write_bytes(b"\xff\xfe\xff")
    sources, skipped = folder(spark, str(tmp_path))
    assert [r.content for r in sources.collect()] == ["x = 1"]
    assert {r.reason: r.files for r in skipped.collect()} == {"unsupported_type": 1, "not_utf8": 1}


def test_long_lines_take_linear_time():
    """Names, tokens and secrets are read once: eight times the text takes about eight times as long."""
    import time

    from cairn.functions import programs, redaction, syntax

    def took(f, text):
        began = time.perf_counter()
        list(f(text))
        return time.perf_counter() - began

    chain = lambda n: "import a\n" + ".".join(["a"] * n)
    words = lambda n: "import * as c from 'crypto'\n" + "f(c " * n
    dashes = lambda n: "a-" * n + ' "' * n + "password = f(" + "alg = " * n
    for f, text in ((lambda t: syntax.text_facts(t, False, False), chain), (programs.node_calls, words), (redaction.masked_lines, dashes)):
        short, long = took(f, text(8000)), took(f, text(64_000))
        assert long < 2 and long < 14 * short + 0.1


@pytest.mark.parametrize(
    ("source", "found"),
    [
        ("import m as a\ndef f():\n    a.g()\nf()\na = 1", [("call", 3, "a.g", "m.g")]),
        ("import m as a\ndef f():\n    a.g()\na = 1", []),
        ("if x:\n    import m as a\nelse:\n    import n as a\na.g()", [("note", 5, None, "binding_unresolved")]),
        ("if x:\n    import m as a\n    def f():\n        a.g()\nelse:\n    a = 1", [("call", 4, "a.g", "m.g")]),
        ("import m as a\nif x:\n    a = 1\nelse:\n    a.g()\na.h()", [("call", 5, "a.g", "m.g"), ("note", 6, None, "binding_unresolved")]),
        ("import m as a\nclass c:\n    a = 1\n    a.g()\n    def f(self):\n        a.h()", [("call", 6, "a.h", "m.h")]),
        ("import m as a\ndef f(x):\n    [a for a in x]\n    a.g()\n    (lambda a: a.h())(1)", [("call", 4, "a.g", "m.g")]),
        ("import m as a\ndef f():\n    def g():\n        global a\n        a.h()\n    a = 1\n    g()", [("call", 5, "a.h", "m.h")]),
        ("import m as a\ndef f():\n    a.g()\n    if x:\n        a = 1", []),
        ("if not 0:\n    import m as a\nelse:\n    alg = 'RS256'\na.g(alg='ES256')", [("call", 5, "a.g", "m.g"), ("string", 5, "alg", "ES256")]),
    ],
)
def test_names_in_force(source, found):
    from cairn.functions import syntax

    assert syntax.python_facts(source) == found
