"""Scans of files of all kinds: lines and algorithms that have to be found, and decoys that mustn't."""

import pytest

from cairn.functions import syntax
from cairn.functions.catalogue import CALLS
from cairn.operators import dispatch

P = "cryptography.hazmat.primitives.asymmetric"
CASES = [
    ("broken.py", f"from {P} import ec as curves\nsignature = curves.ECDSA(", [(2, "ECDSA")], ["syntax_fallback"]),
    ("safe.py", "curve_helper.ECDH()\nservice.rsa.generate_private_key()\nSigningKey.generate()", [], []),
    ("modern.py", f"from {P} import x25519, ed25519\na = x25519.X25519PrivateKey.generate()\nb = ed25519.Ed25519PrivateKey.generate()", [(2, "X25519"), (3, "Ed25519")], []),
    ("protocol.py", 'jwt_algorithm = "RS256"\nssh_algorithm = "ssh-rsa"\necdsa_algorithm = "ecdsa-sha2-nistp256"', [(1, "RSA"), (2, "RSA"), (3, "ECDSA")], []),
    ("dict.py", 'config = {"jwt_algorithm": "RS256", "ssh_host_key": "ssh-ed25519"}', [(1, "Ed25519"), (1, "RSA")], []),
    ("Program.cs", "using System;\nvar rsa = RSA.Create();\nvar e = ECDsa.Create();\n// RSA.Create()\nvar s = \"RSA.Create()\";", [(2, "RSA"), (3, "ECDSA")], []),
    ("keys.pem", "-----BEGIN RSA PRIVATE KEY-----\n-----BEGIN EC PRIVATE KEY-----\n-----BEGIN DSA PRIVATE KEY-----", [(1, "RSA"), (2, "ECC"), (3, "DSA")], []),
    ("generic.pem", "-----BEGIN PRIVATE KEY-----\nx", [], ["unknown_pem_algorithm"]),
    ("literal.py", 'KEY = """-----BEGIN EC PRIVATE KEY-----\nx\n-----END EC PRIVATE KEY-----"""\ndef f():\n    """-----BEGIN RSA PRIVATE KEY-----\n-----END RSA PRIVATE KEY-----"""', [(1, "ECC")], []),
    ("literal.java", 'String k = "-----BEGIN RSA PRIVATE KEY-----\\nx\\n-----END RSA PRIVATE KEY-----";', [(1, "RSA")], []),
    ("prose.txt", "RSA and ECDSA are discussed here; RSA.generate() too", [], []),
    ("shadow.py", f"from {P} import rsa\nrsa = 1\nrsa.generate_private_key()\ndef f(rsa):\n    rsa.generate_private_key()\n[rsa.generate_private_key() for rsa in x]", [], []),
    ("branch.py", f"from {P} import rsa\nif flag:\n    rsa = None\nrsa.generate_private_key()", [], ["binding_unresolved"]),
    ("dead.py", f"from {P} import rsa\nif False:\n    rsa.generate_private_key()\nelse:\n    rsa.generate_private_key()", [(5, "RSA")], []),
    ("late.py", f"def f():\n    return rsa.generate_private_key()\nfrom {P} import rsa\nf()", [(2, "RSA")], []),
    ("early.py", f"def f():\n    return rsa.generate_private_key()\nrsa = 0\nf()\nfrom {P} import rsa", [], []),
    ("method.py", f"from {P} import rsa\nclass A:\n    rsa = 1\n    def f(self):\n        rsa.generate_private_key()", [(5, "RSA")], []),
    ("relative.py", "from .asymmetric import rsa\nrsa.generate_private_key()", [], []),
    ("function.py", f"from {P}.rsa import generate_private_key as make\nmake(65537)\nfrom Crypto.PublicKey import ECC\nECC.generate()", [(2, "RSA"), (4, "ECC")], []),
    ("dotted.py", f"import {P}.dh\n{P}.dh.generate_parameters()", [(2, "DH")], []),
    ("curve.py", "import ecdsa\necdsa.SigningKey.generate()\necdsa.SigningKey.generate(curve=c)\necdsa.SigningKey.generate(c)", [(2, "ECDSA")], []),
    ("list.yaml", "security:\n  algorithms:\n  - RS256\n  - ES256\nnotes: RS256", [(3, "RSA"), (4, "ECDSA")], []),
    ("bad.json", '{"alg": "RS256", "x": NaN}', [], ["config_parse_error"]),
    ("app.ini", "jwt_alg = RS256 ; \nother = RS256\nssl-key: 'ES256' # ES384\nkeys = RS256 RS512", [(1, "RSA"), (3, "ECDSA")], []),
    ("node.js", "const { generateKeyPairSync } = require('crypto');\n// generateKeyPairSync('ec')\ngenerateKeyPairSync('rsa', {});", [(3, "RSA")], []),
    ("long.js", "import { " + ", ".join(f"a{i}" for i in range(90)) + ", generateKeyPair as g } from 'node:crypto';\ng('ed25519', x);", [(2, "Ed25519")], []),
    ("template.ts", "const a = `RSA ${f(`x`)} '`;\nconst jwtAlg = 'x';", [], []),
    ("deep.py", "x = " + "[" * 70 + "]" * 70, [], ["analysis_limit"]),
    ("blank.py", None, [], []),
]


def test_files_of_all_kinds(spark):
    rows = dispatch.scan(spark.createDataFrame([(n, c) for n, c, *_ in CASES], "file_name string, content string")).collect()
    for name, _, found, notes in CASES:
        mine = [r for r in rows if r.file_name == name]
        assert sorted((r.line, r.algorithm) for r in mine if r.diagnostic is None) == sorted(found), name
        assert [r.diagnostic for r in mine if r.diagnostic] == notes, name
    at = {(r.file_name, r.line): r for r in rows}
    assert at["late.py", 2].resolved_api == f"{P}.rsa.generate_private_key" and at["late.py", 2].library == "cryptography"
    assert at["function.py", 4].library == "PyCryptodome" and at["protocol.py", 1].evidence == "算法标识: RS256"


def test_every_target_of_the_catalogue(spark):
    targets = [(f"{m}.{n}", code) for m, names, code in CALLS for n in names]
    files = [(f"f{i}.py", f"import {t.rsplit('.', 1)[0] if t.split('.')[-2][0].islower() else '.'.join(t.split('.')[:-2])}\n{t}()") for i, (t, _) in enumerate(targets)]
    got = {r.file_name: (r.resolved_api, r.line) for r in dispatch.scan(spark.createDataFrame(files, "file_name string, content string")).collect()}
    assert got == {f"f{i}.py": (t, 2) for i, (t, _) in enumerate(targets)}


def test_large_files_give_a_note_alone(spark):
    df = spark.createDataFrame([("a.py", "jwt_alg = 'RS256'\n" * 20)], "file_name string, content string")
    assert [r.diagnostic for r in dispatch.scan(df, most_bytes=100).collect()] == ["analysis_limit"]


@pytest.mark.parametrize("text", ['a "b" // c\n\'d\' /* e\n f */ g', 'x @"a""b" y', 'p """q " r""" s', "`a ${ {b: `c`} } d` e", "`open ${"])
def test_masks_keep_places(text):
    code, plain, spans = syntax.c_masked(text)
    assert len(code) == len(plain) == len(text) and all(code[i] == text[i] for i in range(len(text)) if code[i] not in " \n")
    assert all(0 <= a < b <= len(text) for a, b in spans)
