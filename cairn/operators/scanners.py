"""Scanners that parse files in Arrow batches; rules are matched by Spark afterwards."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.programs import config_scalars, node_calls
from cairn.functions.rules import IDENTIFIERS, identified, sensitive

# Key types of Node's key generation and their algorithms.
NODE_TYPES = {"rsa": "RSA", "rsa-pss": "RSA", "dsa": "DSA", "dh": "DH", "ec": "ECC", "ed25519": "Ed25519", "ed448": "Ed448", "x25519": "X25519", "x448": "X448"}
# Beginnings after which an identifier needn't be the whole value.
KEY_BEGINNINGS = "^(?:ssh-|ecdsa-sha2-|rsa-sha2-)"


def parsed(files: DataFrame, name: str, content: str, parse: Callable[[str, str], Iterable[tuple]], columns: str) -> DataFrame:
    """name, the columns that `parse` gives, and a diagnostic: the rows of each file, or one row that says why there are none."""
    kind = files.schema[name].dataType.simpleString()
    heads = [c.strip().split(" ")[0] for c in columns.split(",")]

    def run(batches):
        for b in batches:
            out = []
            for n, text in zip(b[name], b[content], strict=True):
                try:
                    out += [(n, *row, None) for row in parse(str(n), text or "")]
                except (ValueError, RecursionError) as e:
                    out.append((n, *[None] * len(heads), type(e).__name__))
            yield pd.DataFrame(out, columns=[name, *heads, "diagnostic"])

    return files.select(name, content).mapInPandas(run, f"{name} {kind}, {columns}, diagnostic string")


def scan_config_nodes(files: DataFrame, name: str = "file_name", content: str = "content") -> DataFrame:
    """Identifiers in the strings of JSON and YAML whose own key is sensitive.

    A rule has to match the whole string, or its beginning if that is one of a
    key. Files that can't be read give one row with a diagnostic.
    """
    rows = parsed(files, name, content, lambda n, t: list(config_scalars(t, n.lower().endswith(".json"))), "line int, key string, value string")
    whole = identified(F.trim("value"), [(code, f"^(?:{p})$") for code, p in IDENTIFIERS])
    begun = F.when(F.col("value").rlike(KEY_BEGINNINGS), identified(F.col("value"), [(code, f"^(?:{p})") for code, p in IDENTIFIERS])).otherwise(F.array().cast("array<string>"))
    hits = rows.where("diagnostic is null").where(sensitive(F.col("key"))).select(name, "line", F.explode(F.array_union(whole, begun)).alias("algorithm"), F.lit(None).cast("string").alias("diagnostic"))
    return hits.unionByName(rows.where("diagnostic is not null").select(name, "line", F.lit(None).cast("string").alias("algorithm"), "diagnostic"))


def scan_node(files: DataFrame, name: str = "file_name", content: str = "content") -> DataFrame:
    """Key generation by imported Node crypto modules, with the algorithm of its key type."""
    rows = parsed(files, name, content, lambda _, t: node_calls(t), "line int, method string, argument string")
    algorithm = F.create_map(*[F.lit(x) for kv in NODE_TYPES.items() for x in kv])[F.col("argument")]
    return rows.select(name, "line", "method", algorithm.alias("algorithm")).where("algorithm is not null")
