"""Escapes, redaction and other text functions of reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def source_id(name: Column, content: Column) -> Column:
    return F.concat(F.lit("src_"), F.substring(F.sha2(F.concat(name, F.lit("\0"), content), 256), 1, 12))


def csv_guard(value: Column) -> Column:
    """Puts an apostrophe before text that a spreadsheet would run as a formula, also after white space."""
    return F.when(value.rlike(r"(?U)^\s*[=+\-@]|^[\t\r\n]"), F.concat(F.lit("'"), value)).otherwise(value)


def markdown_cell(value: Column) -> Column:
    """Text of one cell of a Markdown table: no markup, no cell borders, line breaks as a sign."""
    out = value
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("|", "\\|"), ("\n", " ↵ ")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def html_text(value: Column) -> Column:
    out = value
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def fence(value: Column) -> Column:
    """A code fence longer than any run of backticks in the text, three at least."""
    runs = F.transform(F.regexp_extract_all(value, F.lit("(`+)")), F.length)
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))


def redact(value: Column) -> Column:
    """Masks credentials in addresses and values of secret-like assignments; line breaks stay."""
    hidden = F.regexp_replace(value, r"([a-zA-Z][a-zA-Z0-9+.-]*://)[^/\s:@]+:[^/\s@]+@", "$1[REDACTED]@")
    return F.regexp_replace(hidden, r'(?i)((?:password|secret|token|api_key)\s*[=:]\s*)"[^"\n]*"', '$1"[REDACTED]"')
