"""Names of files, modules and numbers as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a name of cryptography holds.
CRYPTO_NAME = r"(?i)crypt|cipher|encrypt|decrypt|rsa|ecd[hs]a|ed25519|x25519|key_exchange|jwt|(?:^|[_.])(?:dsa|dh|sign|signing|signer|signature|verify|verifying|verification|kem)(?:$|[_.])"
# Bounds of a portable path, and names that a system keeps for itself.
PATH_BYTES, PATH_PARTS = 512, 20
RESERVED = r"^(?:CON|PRN|AUX|NUL|COM[1-9¹²³]|LPT[1-9¹²³])$"


def base_name(path: Column) -> Column:
    """The last part of a path with either kind of slash."""
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def module_of(path: Column) -> Column:
    """The dotted module of a Python file; a package's own file is the package."""
    return F.regexp_replace(F.replace(F.regexp_replace(path, r"\.pyw?$", ""), F.lit("/"), F.lit(".")), r"(?:^|\.)__init__$", "")


def is_package(path: Column) -> Column:
    return base_name(path) == "__init__.py"


def relative_base(module: Column, package: Column, level: Column) -> Column:
    """The module that a relative import of `level` dots starts from; null above the top."""
    parts = F.filter(F.split(module, r"\."), lambda x: x != "")
    keep = F.size(parts) - level + F.when(package, 1).otherwise(0)
    return F.when(keep >= 0, F.array_join(F.slice(parts, 1, F.greatest(keep, F.lit(0))), "."))


def crypto_named(name: Column, catalogue: list[str]) -> Column:
    """Whether a dotted name, in snake or camel case, is one of cryptography or has a part that the catalogue's targets have."""
    split = F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2")
    return split.rlike(CRYPTO_NAME) | F.arrays_overlap(F.split(F.lower(name), r"\."), F.array(*map(F.lit, catalogue)))


def catalogue_parts(targets: list[str]) -> list[str]:
    """Parts of targets beyond the library's first two and before the call."""
    return sorted({p.lower() for t in targets for p in t.split(".")[2:-1] if len(p) > 2})


def path_fault(path: Column) -> Column:
    """Why a path isn't portable; null for one that is. The path has to be composed Unicode."""
    parts = F.split(path, "/")
    bad = F.exists(parts, lambda p: p.isin("", ".", "..") | p.rlike(r"[. ]$") | p.rlike(r'[<>"|?*]') | F.upper(F.rtrim(F.split_part(p, F.lit("."), F.lit(1)))).rlike(RESERVED))
    return F.when((F.coalesce(path, F.lit("")) == "") | (F.octet_length(path) > PATH_BYTES) | (F.size(parts) > PATH_PARTS) | path.rlike(r"[\\:]|\p{C}"), "format").when(bad, "part")


def short_count(number: Column) -> Column:
    """1234 as 1.2k; numbers below a thousand stay."""
    return F.when(number < 1000, number.cast("string")).otherwise(F.concat(F.format_string("%.1f", F.round(number / 1000, 1)), F.lit("k")))


def byte_slice(text: Column, start: Column, end: Column) -> Column:
    """The part of a line between two UTF-8 byte columns."""
    return F.decode(F.substr(F.encode(text, "UTF-8"), start + 1, end - start), "UTF-8")


def beijing(moment: Column) -> Column:
    """ISO text of a moment at UTC+8, whatever the session's time zone."""
    return F.concat(F.date_format(F.convert_timezone(F.lit("UTC"), F.lit("+08:00"), F.to_utc_timestamp(moment, F.current_timezone()).cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+08:00"))


def elapsed(seconds: Column) -> Column:
    """Seconds as minutes and seconds, or hours, minutes and seconds."""
    h, m, s = F.floor(seconds / 3600), F.floor(seconds / 60) % 60, F.floor(seconds) % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%d:%02d", m, s))


def canonical_digest(**columns: Column) -> Column:
    """SHA-256 of a row as JSON with sorted keys and without spaces; nulls stay."""
    fields = [F.concat(F.lit(f'"{k}":'), F.coalesce(F.to_json(F.struct(v.alias("v"))), F.lit(""))) for k, v in sorted(columns.items())]
    body = [F.regexp_replace(F.regexp_replace(f, r'^("[^"]*":)\{"v":(.*)\}$', "$1$2"), r'^("[^"]*":)(?:\{\})?$', "$1null") for f in fields]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *body), F.lit("}")), 256)


def add_counts(a: Column, b: Column) -> Column:
    """Two maps of counts as one; a key that one lacks counts as 0 there."""
    empty = F.create_map().cast("map<string,bigint>")
    return F.map_zip_with(F.coalesce(a, empty), F.coalesce(b, empty), lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))
