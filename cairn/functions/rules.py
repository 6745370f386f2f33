"""Algorithm profiles, identifier rules and migration directions as Spark columns and small dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Profile code, name, risk level, reason, recommendation.
PROFILES = [
    ("rsa", "RSA", "高风险", "RSA 依赖大整数分解，Shor 算法可在容错量子计算环境下高效破解。", "密钥建立迁移到 FIPS 203 ML-KEM；签名迁移到 FIPS 204 ML-DSA。"),
    ("dsa", "DSA", "高风险", "DSA 依赖离散对数难题，面向量子攻击时不再安全。", "使用 FIPS 204 ML-DSA 或其他后量子签名方案替代。"),
    ("dh", "DH", "高风险", "Diffie-Hellman 依赖离散对数难题，Shor 算法可显著削弱其安全性。", "密钥交换迁移到 FIPS 203 ML-KEM。"),
    ("ecdh", "ECDH", "高风险", "ECDH 建立在椭圆曲线离散对数问题之上，量子计算可高效求解。", "密钥交换迁移到 FIPS 203 ML-KEM。"),
    ("ecdsa", "ECDSA", "高风险", "ECDSA 的安全性依赖椭圆曲线离散对数问题，量子攻击下存在根本风险。", "签名迁移到 FIPS 204 ML-DSA。"),
    ("ecc", "ECC", "高风险", "ECC 家族依赖椭圆曲线离散对数问题，量子算法可系统性破坏其安全假设。", "按用途迁移到 FIPS 203 ML-KEM 或 FIPS 204 ML-DSA。"),
    ("x25519", "X25519", "高风险", "X25519 属于椭圆曲线 Diffie-Hellman 密钥交换，量子计算可高效求解其离散对数基础。", "密钥交换迁移到 FIPS 203 ML-KEM，或在过渡期使用经评估的混合密钥交换。"),
    ("x448", "X448", "高风险", "X448 属于椭圆曲线 Diffie-Hellman 密钥交换，量子计算可高效求解其离散对数基础。", "密钥交换迁移到 FIPS 203 ML-KEM，或在过渡期使用经评估的混合密钥交换。"),
    ("eddsa", "EdDSA", "高风险", "EdDSA 是椭圆曲线签名家族，曲线尚未确认（可为 Ed25519 或 Ed448）；量子攻击可破坏其离散对数基础。", "签名迁移到 FIPS 204 ML-DSA；长期归档可评估 FIPS 205 SLH-DSA。"),
    ("ed25519", "Ed25519", "高风险", "Ed25519 属于椭圆曲线签名算法，量子攻击下其离散对数安全假设不再成立。", "签名迁移到 FIPS 204 ML-DSA；长期归档或高安全等级场景可评估 FIPS 205 SLH-DSA。"),
    ("ed448", "Ed448", "高风险", "Ed448 属于椭圆曲线签名算法，量子攻击下其离散对数安全假设不再成立。", "签名迁移到 FIPS 204 ML-DSA；长期归档或高安全等级场景可评估 FIPS 205 SLH-DSA。"),
]
# Profile code and pattern of an algorithm identifier in a string.
IDENTIFIERS = [
    ("rsa", r"\b(?:RS(?:256|384|512)|PS(?:256|384|512)|ssh-rsa|rsa-sha2-\d+)\b"),
    ("dsa", r"\b(?:ssh-dss|DSA)\b"),
    ("ecdsa", r"\b(?:ES(?:256|384|512)|ecdsa-sha2-[A-Za-z0-9_-]+)\b"),
    ("eddsa", r"\bEdDSA\b"),
    ("ed25519", r"\b(?:Ed25519|ssh-ed25519)\b"),
    ("ed448", r"\b(?:Ed448)\b"),
    ("x25519", r"\b(?:X25519|x25519)\b"),
    ("x448", r"\b(?:X448|x448)\b"),
]
# Profile code and PEM header.
PEM_HEADERS = [
    ("rsa", r"^-----BEGIN RSA (?:PRIVATE|PUBLIC) KEY-----"),
    ("dsa", r"^-----BEGIN DSA (?:PRIVATE|PUBLIC) KEY-----"),
    ("ecc", r"^-----BEGIN EC (?:PRIVATE|PUBLIC) KEY-----"),
]
# Names of keys beside which an identifier counts.
SENSITIVE = r"(?i)(?:^|[_\-.])(?:algorithms?|alg|jwt|ssh|tls|ssl|ciphers?|signature|keys?|pem|cert|certificate)(?:$|[_\-.])"
# Purposes of algorithm names, and targets of purposes.
SIGNATURES = ["DSA", "ECDSA", "EdDSA", "Ed25519", "Ed448"]
EXCHANGES = ["DH", "ECDH", "X25519", "X448"]
SIGN, EXCHANGE, OPEN = "数字签名", "密钥建立", "用途待确认"
TARGETS = {SIGN: "ML-DSA,SLH-DSA", EXCHANGE: "ML-KEM", OPEN: "ML-KEM,ML-DSA,SLH-DSA"}

NAMES = {code: name for code, name, *_ in PROFILES}


def profiles(spark: SparkSession) -> DataFrame:
    """The profile dimension, eleven rows."""
    return spark.createDataFrame(PROFILES, "code string, algorithm string, risk_level string, reason string, recommendation string")


def sensitive(name: Column) -> Column:
    """Whether a key names cryptographic material, in snake, kebab, dotted or camel case."""
    split = F.regexp_replace(F.regexp_replace(name, "([A-Z]+)([A-Z][a-z])", "$1_$2"), "([a-z0-9])([A-Z])", "$1_$2")
    return split.rlike(SENSITIVE)


def identified(value: Column, rules: list[tuple[str, str]] = IDENTIFIERS) -> Column:
    """Names of the algorithms whose rule matches, one each. A projection, not a join of lines with rules."""
    return F.array_compact(F.array(*[F.when(value.rlike(p), F.lit(NAMES.get(code, code))) for code, p in rules]))


def purpose(algorithm: Column) -> Column:
    return F.when(algorithm.isin(SIGNATURES), SIGN).when(algorithm.isin(EXCHANGES), EXCHANGE).otherwise(OPEN)


def targets(purpose_: Column) -> Column:
    return F.when(purpose_ == SIGN, TARGETS[SIGN]).when(purpose_ == EXCHANGE, TARGETS[EXCHANGE]).otherwise(TARGETS[OPEN])
