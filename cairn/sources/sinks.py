"""Reports of findings as CSV, JSON, Markdown and HTML, written by all tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.catalogue import method_label
from cairn.functions.text import csv_guard, html_text, markdown_cell

# Columns of a report and their headings.
COLUMNS = [
    ("source_id", "文件身份"),
    ("file_name", "文件"),
    ("line", "行号"),
    ("algorithm", "算法"),
    ("risk_level", "风险等级"),
    ("detection_method", "识别方式"),
    ("library", "密码库"),
    ("resolved_api", "完整 API"),
    ("evidence", "证据"),
    ("reason", "原因"),
    ("recommendation", "迁移建议"),
]


def cells(findings: DataFrame) -> dict[str, Column]:
    """Each report column as text; empty where a finding has no such column or no value."""
    out = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in findings.columns else F.lit("") for c, _ in COLUMNS}
    return out | {"detection_method": method_label(out["detection_method"])}


def csv_rows(findings: DataFrame) -> DataFrame:
    """The columns of the CSV report, none of which a spreadsheet would run as a formula."""
    return findings.select(*[csv_guard(v).alias(c) for c, v in cells(findings).items()])


def markdown_rows(findings: DataFrame) -> DataFrame:
    """file_name, line and the table row of each finding."""
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *[markdown_cell(v) for v in cells(findings).values()]), F.lit(" |"))
    return findings.select("file_name", "line", row.alias("row"))


def html_rows(findings: DataFrame) -> DataFrame:
    """file_name, line and the table row of each finding, escaped."""
    row = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), html_text(v), F.lit("</td>")) for v in cells(findings).values()], F.lit("</tr>"))
    return findings.select("file_name", "line", row.alias("row"))


def write_csv(findings: DataFrame, path: str) -> None:
    """A folder of CSV files, each with the headings after a byte order mark."""
    labels = [label for _, label in COLUMNS]
    named = csv_rows(findings).toDF("\ufeff" + labels[0], *labels[1:])
    named.write.mode("overwrite").option("header", "true").option("escape", '"').option("emptyValue", "").csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    """A folder of JSON lines; the text of sources stays out."""
    rows.drop("content").write.mode("overwrite").json(path)


def write_rows(rows: DataFrame, path: str) -> None:
    """Rows of markdown_rows() or html_rows() as text files, sorted over all of them by file and line."""
    rows.repartitionByRange("file_name", "line", "row").sortWithinPartitions("file_name", "line", "row").select("row").write.mode("overwrite").text(path)
