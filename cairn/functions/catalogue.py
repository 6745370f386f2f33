"""Small dimensions of scanning and reporting: library calls, JWT names, .NET calls, labels, purposes and directions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULES_VERSION = "crypto-rules-3"
ASYMMETRIC = "cryptography.hazmat.primitives.asymmetric."
# Module of a call, its names, profile code.
CALLS = [
    (ASYMMETRIC + "rsa", ["generate_private_key", "RSAPrivateNumbers", "RSAPublicNumbers"], "rsa"),
    (ASYMMETRIC + "dsa", ["generate_private_key", "DSAPrivateNumbers", "DSAPublicNumbers"], "dsa"),
    (ASYMMETRIC + "dh", ["generate_parameters", "DHPrivateNumbers", "DHPublicNumbers"], "dh"),
    (ASYMMETRIC + "ec", ["generate_private_key", "derive_private_key", "EllipticCurvePublicKey.from_encoded_point", "EllipticCurvePrivateNumbers", "EllipticCurvePublicNumbers"], "ecc"),
    (ASYMMETRIC + "ec", ["ECDH"], "ecdh"),
    (ASYMMETRIC + "ec", ["ECDSA"], "ecdsa"),
    (ASYMMETRIC + "x25519", ["X25519PrivateKey.generate", "X25519PrivateKey.from_private_bytes", "X25519PublicKey.from_public_bytes"], "x25519"),
    (ASYMMETRIC + "x448", ["X448PrivateKey.generate", "X448PrivateKey.from_private_bytes", "X448PublicKey.from_public_bytes"], "x448"),
    (ASYMMETRIC + "ed25519", ["Ed25519PrivateKey.generate", "Ed25519PrivateKey.from_private_bytes", "Ed25519PublicKey.from_public_bytes"], "ed25519"),
    (ASYMMETRIC + "ed448", ["Ed448PrivateKey.generate", "Ed448PrivateKey.from_private_bytes", "Ed448PublicKey.from_public_bytes"], "ed448"),
    ("Crypto.PublicKey.RSA", ["generate", "import_key", "importKey", "construct"], "rsa"),
    ("Crypto.PublicKey.DSA", ["generate", "import_key", "importKey", "construct"], "dsa"),
    ("Crypto.PublicKey.ECC", ["generate", "import_key", "construct"], "ecc"),
    ("ecdsa", ["SigningKey.generate"], "ecdsa"),
]
#: The one call whose explicit curve may select another algorithm.
CURVED = "ecdsa.SigningKey.generate"
# Profile code, pattern of a .NET call, evidence.
DOTNET = [
    ("rsa", r"\b(?:RSA\.Create|RSACryptoServiceProvider|RSAOpenSsl|RSACng)\s*\(", ".NET RSA API"),
    ("dsa", r"\b(?:DSA\.Create|DSACryptoServiceProvider|DSACng)\s*\(", ".NET DSA API"),
    ("ecdh", r"\b(?:ECDiffieHellman\.Create|ECDiffieHellmanCng|ECDiffieHellmanOpenSsl)\s*\(", ".NET ECDiffieHellman API"),
    ("ecdsa", r"\b(?:ECDsa\.Create|ECDsaCng|ECDsaOpenSsl)\s*\(", ".NET ECDsa API"),
]
# JWT names, family, risk class.
JWT = [
    (["RS256", "RS384", "RS512", "PS256", "PS384", "PS512"], "RSA", "quantum_vulnerable"),
    (["ES256", "ES384", "ES512", "ES256K"], "EC", "quantum_vulnerable"),
    (["HS256"], "HMAC-SHA256", "symmetric"),
    (["HS384"], "HMAC-SHA384", "symmetric"),
    (["HS512"], "HMAC-SHA512", "symmetric"),
    (["EdDSA"], "EdDSA", "quantum_vulnerable"),
]
# Names that stand for an algorithm.
ALIASES = {"ECC": ["EC"], "RSA": ["RS256", "RS384", "RS512", "PS256", "PS384", "PS512"], "ECDSA": ["ES256", "ES256K", "ES384", "ES512"]}
# How a finding was made, and its label.
METHODS = {"cross_file": "跨文件核验", "ai_candidate": "代码线索待复核", "ast_call": "AST 调用", "ast_config": "AST 配置", "text_call": "文本调用", "text_config": "文本配置", "pem_header": "PEM 头"}
NO_METHOD = "未记录"
# Purpose codes and labels.
PURPOSES = {"sign": "数字签名", "verify": "验签", "key_exchange": "密钥建立", "key_generation": "密钥生成", "key_import": "密钥导入", "configuration": "算法配置", "encrypt": "加密", "decrypt": "解密", "unknown": "用途待确认"}
# Algorithms that may sign, and that may establish keys.
MAY_SIGN = ["RSA", "ECC", "ECDSA", "DSA", "EdDSA", "Ed25519", "Ed448"]
MAY_EXCHANGE = ["RSA", "ECC", "ECDH", "DH", "X25519", "X448"]


def api_catalogue(spark: SparkSession) -> DataFrame:
    """target and code of every known call."""
    return spark.createDataFrame([(f"{module}.{name}", code) for module, names, code in CALLS for name in names], "target string, code string")


def jwt_catalogue(spark: SparkSession) -> DataFrame:
    """jwt, family and risk_class of every JWT signature name."""
    return spark.createDataFrame([(n, family, risk) for names, family, risk in JWT for n in names], "jwt string, family string, risk_class string")


def lookup(value: Column, pairs: dict[str, str], otherwise: Column) -> Column:
    """The value's entry in a small fixed map."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])[value], otherwise)


def canonical(algorithm: Column) -> Column:
    """The algorithm that a name stands for."""
    return lookup(algorithm, {a: name for name, names in ALIASES.items() for a in names}, algorithm)


def method_label(method: Column) -> Column:
    return lookup(method, METHODS, F.lit(NO_METHOD))


def purpose_label(code: Column) -> Column:
    return lookup(code, PURPOSES, F.lit(PURPOSES["unknown"]))


def library_of(target: Column) -> Column:
    """The library that a dotted call belongs to."""
    root = F.substring_index(target, ".", 1)
    return F.when(root == "Crypto", "PyCryptodome").otherwise(root)


def api_family(code: Column, target: Column) -> Column:
    """The algorithm family of a known call, as facts about operations name it."""
    names = {"ed25519": "Ed25519", "ed448": "Ed448", "eddsa": "EdDSA"}
    return F.when(code == "ecc", F.when(target.startswith("Crypto."), "ECC").otherwise("EC")).otherwise(lookup(code, names, F.upper(code)))


def direction_targets(code: Column) -> Column:
    """Targets of a known purpose; none where the purpose doesn't decide."""
    none = F.array().cast("array<string>")
    return F.when(code.isin("sign", "verify"), F.array(F.lit("ML-DSA"), F.lit("SLH-DSA"))).when(code == "key_exchange", F.array(F.lit("ML-KEM"))).otherwise(none)


def direction_references(algorithm: Column, code: Column) -> Column:
    """label, targets, kind and condition of what to look at for a purpose, or for each purpose that the algorithm may have."""

    def entry(label: str, targets: list[str], kind: str, condition: str) -> Column:
        return F.struct(F.lit(label).alias("label"), F.array(*map(F.lit, targets)).alias("targets"), F.lit(kind).alias("kind"), F.lit(condition).alias("condition"))

    known = "核对协议、格式及参与方兼容性"
    sign = entry("签名场景：ML-DSA / SLH-DSA", ["ML-DSA", "SLH-DSA"], "conditional", "仅在用于签名或验签时适用")
    exchange = entry("密钥建立场景：ML-KEM", ["ML-KEM"], "conditional", "需确认密钥建立或混合加密协议设计，不能直接替换加解密API")
    open_ = F.array_compact(F.array(F.when(algorithm.isin(MAY_SIGN), sign), F.when(algorithm.isin(MAY_EXCHANGE), exchange)))
    return (
        F.when(code.isin("sign", "verify"), F.array(entry("ML-DSA / SLH-DSA", ["ML-DSA", "SLH-DSA"], "purpose_reference", known)))
        .when(code == "key_exchange", F.array(entry("ML-KEM", ["ML-KEM"], "purpose_reference", known)))
        .otherwise(open_)
    )
