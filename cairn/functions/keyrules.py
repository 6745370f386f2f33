"""Tables of calls that make keys and of what methods of keys do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PRIMITIVES = "cryptography.hazmat.primitives."
# Call, library, operation, algorithm, type of the key, parameters, optional parameters, those by keyword only.
CONSTRUCTORS = [
    ("ecdsa.SigningKey.generate", "ecdsa", "key_generation", "ECDSA", "ECDSA:private", "", "curve entropy hashfunc", ""),
    (PRIMITIVES + "asymmetric.rsa.generate_private_key", "cryptography", "key_generation", "RSA", "RSA:private", "public_exponent key_size", "backend", ""),
    (PRIMITIVES + "asymmetric.ec.generate_private_key", "cryptography", "key_generation", "ECC", "EC:private", "curve", "backend", ""),
    (PRIMITIVES + "asymmetric.ed25519.Ed25519PrivateKey.generate", "cryptography", "key_generation", "Ed25519", "Ed25519:private", "", "backend", ""),
    (PRIMITIVES + "asymmetric.x25519.X25519PrivateKey.generate", "cryptography", "key_generation", "X25519", "X25519:private", "", "backend", ""),
    (PRIMITIVES + "asymmetric.ed25519.Ed25519PrivateKey.from_private_bytes", "cryptography", "key_import", "Ed25519", "Ed25519:private", "data", "", ""),
    (PRIMITIVES + "asymmetric.ed25519.Ed25519PublicKey.from_public_bytes", "cryptography", "key_import", "Ed25519", "Ed25519:public", "data", "", ""),
    (PRIMITIVES + "asymmetric.x25519.X25519PrivateKey.from_private_bytes", "cryptography", "key_import", "X25519", "X25519:private", "data", "", ""),
    (PRIMITIVES + "asymmetric.x25519.X25519PublicKey.from_public_bytes", "cryptography", "key_import", "X25519", "X25519:public", "data", "", ""),
    (PRIMITIVES + "serialization.load_pem_private_key", "cryptography", "key_import", None, "generic:private", "data password", "backend", ""),
    (PRIMITIVES + "serialization.load_pem_public_key", "cryptography", "key_import", None, "generic:public", "data", "backend", ""),
    ("Crypto.PublicKey.RSA.generate", "PyCryptodome", "key_generation", "RSA", "pycrypto:RSA:either", "bits", "randfunc e", ""),
    ("Crypto.PublicKey.RSA.import_key", "PyCryptodome", "key_import", "RSA", "pycrypto:RSA:either", "extern_key", "passphrase", ""),
    ("Crypto.PublicKey.RSA.importKey", "PyCryptodome", "key_import", "RSA", "pycrypto:RSA:either", "extern_key", "passphrase", ""),
    ("Crypto.PublicKey.ECC.generate", "PyCryptodome", "key_generation", "ECC", "pycrypto:ECC:either", "curve", "randfunc", "curve randfunc"),
    ("Crypto.PublicKey.ECC.import_key", "PyCryptodome", "key_import", "ECC", "pycrypto:ECC:either", "encoded", "passphrase curve_name", ""),
    ("Crypto.PublicKey.DSA.generate", "PyCryptodome", "key_generation", "DSA", "pycrypto:DSA:either", "bits", "randfunc domain", ""),
    ("Crypto.PublicKey.DSA.import_key", "PyCryptodome", "key_import", "DSA", "pycrypto:DSA:either", "extern_key", "passphrase", ""),
    ("Crypto.PublicKey.DSA.importKey", "PyCryptodome", "key_import", "DSA", "pycrypto:DSA:either", "extern_key", "passphrase", ""),
    ("Crypto.Signature.pkcs1_15.new", "PyCryptodome", "unknown", None, None, "rsa_key", "", ""),
    ("Crypto.Signature.pss.new", "PyCryptodome", "unknown", None, None, "rsa_key", "mask_func salt_bytes rand_func", "mask_func salt_bytes rand_func"),
    ("Crypto.Signature.DSS.new", "PyCryptodome", "unknown", None, None, "key mode", "encoding randfunc", ""),
]
# Call that makes a signer, its scheme, parameter of the key, families of keys that it takes, modes that it takes.
SIGNERS = [
    ("Crypto.Signature.pkcs1_15.new", "pkcs1_15", "rsa_key", ["RSA"], []),
    ("Crypto.Signature.pss.new", "pss", "rsa_key", ["RSA"], []),
    ("Crypto.Signature.DSS.new", "DSS", "key", ["DSA", "ECC"], ["fips-186-3", "deterministic-rfc6979"]),
]
# Method without arguments that gives the public key, families that have it.
DERIVATIONS = [
    ("public_key", ["RSA", "EC", "Ed25519", "X25519"]),
    ("publickey", ["RSA", "EC", "Ed25519", "X25519"]),
    ("get_verifying_key", ["ECDSA"]),
]
# Family, roles, method, operation, parameters.
METHODS = [
    ("signer", ["*"], "sign", "sign", "msg_hash"),
    ("signer", ["*"], "verify", "verify", "msg_hash signature"),
    ("X25519", ["private"], "exchange", "key_exchange", "peer_public_key"),
    ("EC", ["private"], "exchange", "key_exchange", "algorithm peer_public_key"),
    ("RSA", ["public"], "encrypt", "encrypt", "plaintext padding"),
    ("RSA", ["private"], "decrypt", "decrypt", "ciphertext padding"),
    ("RSA", ["private", "either"], "sign", "sign", "data padding algorithm"),
    ("RSA", ["public", "either"], "verify", "verify", "signature data padding algorithm"),
    ("EC", ["private", "either"], "sign", "sign", "data signature_algorithm"),
    ("EC", ["public", "either"], "verify", "verify", "signature data signature_algorithm"),
    ("Ed25519", ["private", "either"], "sign", "sign", "data"),
    ("Ed25519", ["public", "either"], "verify", "verify", "signature data"),
    ("ECDSA", ["private", "either"], "sign", "sign", "data"),
    ("ECDSA", ["public", "either"], "verify", "verify", "signature data"),
]
# Curves whose keys the ecdsa rule covers.
CURVES = ["NIST192p", "NIST224p", "NIST256p", "NIST384p", "NIST521p", "SECP256k1", "BRAINPOOLP256r1", "BRAINPOOLP384r1", "BRAINPOOLP512r1"]


def constructors(spark: SparkSession) -> DataFrame:
    """target, library, operation, algorithm and key_type of calls that make keys or signers."""
    return spark.createDataFrame([r[:5] for r in CONSTRUCTORS], "target string, library string, operation string, algorithm string, key_type string")


def rule_parameters(spark: SparkSession) -> DataFrame:
    """function, place, parameter, kind and default of those calls; what an optional one is without an argument isn't known."""
    rows = []
    for target, *_, needed, optional, by_keyword in CONSTRUCTORS:
        names = [n for n in (needed + " " + optional).split() if n not in by_keyword.split()] + by_keyword.split()
        rows += [(target, i, n, "keyword_only" if n in by_keyword.split() else "positional", "unspecified_api_parameter" if n in optional.split() and n not in needed.split() else None) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "function string, place int, parameter string, kind string, default string")


def methods(spark: SparkSession) -> DataFrame:
    """function (family and method), family, roles, method and operation."""
    return spark.createDataFrame([(f"{f}.{m}", f, roles, m, o) for f, roles, m, o, _ in METHODS], "function string, family string, roles array<string>, method string, operation string")


def method_parameters(spark: SparkSession) -> DataFrame:
    """function, place, parameter, kind and default of the methods of keys, all of which must be given."""
    return spark.createDataFrame([(f"{f}.{m}", i, n, "positional", None) for f, _, m, _, names in METHODS for i, n in enumerate(names.split())], "function string, place int, parameter string, kind string, default string")


def signers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SIGNERS, "target string, scheme string, parameter string, families array<string>, modes array<string>")


def derivations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DERIVATIONS, "method string, families array<string>").withColumn("family", F.explode("families")).drop("families")
