"""Whole reports as Markdown and HTML: each section is a table of lines in order, made from aggregates of the findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.catalogue import NO_METHOD, method_label
from cairn.functions.rules import OPEN, SIGN, EXCHANGE, purpose, targets
from cairn.functions.text import fence, html_text, markdown_cell
from cairn.operators.findings import score

# Headings, labels and texts of a report.
TITLE, NOTHING = "抗量子密码风险检测与迁移辅助软件 扫描报告", "未发现已知量子脆弱公钥算法用法。"
SECTIONS = ["摘要与关键结论", "扫描范围", "主要统计", "密码资产清单", "发现明细", "迁移待办", "附录"]
SOURCES = {"snippet": "代码片段", "manual_upload": "文件上传", "github_repository": "GitHub 仓库", "pypi_package": "PyPI 包"}
BOUNDARIES = [
    "迁移评分是启发式优先级，不代表风险概率。高风险项 × 25 + 受影响文件 × 10 + 算法种类 × 10，上限 100。",
    "扫描仅覆盖本次输入与当前规则；零发现不能证明安全。资产清单不是完整供应链或标准化 CBOM，报告不附完整源码。",
    "识别方式表示证据来源，不是置信度。用途与迁移方案需人工复核；ML-KEM 用于密钥封装，ML-DSA、SLH-DSA 用于数字签名，不能直接替换任意 API。",
]
MOST_FILES = 8


def _line(section: int, *order: Column | int, text: Column) -> list[Column]:
    """A line's place: its section, then up to four parts of an order within it."""
    parts = [F.lit(o) if isinstance(o, int) else o for o in order]
    parts += [F.lit(0)] * (4 - len(parts))
    return [F.lit(section).alias("section"), *[p.cast("string").alias(f"o{i}") if i in (1, 2) else p.cast("long").alias(f"o{i}") for i, p in enumerate(parts)], text.alias("text")]


def _row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[markdown_cell(F.coalesce(c.cast("string"), F.lit(""))) for c in cells]), F.lit(" |"))


def _head(df: DataFrame, section: int, at: int, *lines: str) -> DataFrame:
    """Fixed lines, one below the other, at a place of a section."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(x).alias("x")) for i, x in enumerate(lines)]))
    one = df.sparkSession.range(1).select(each.alias("l"))
    return one.select(*_line(section, at, 0, 0, F.col("l.i"), text=F.col("l.x")))


def _table(headers: list[str]) -> tuple[str, str]:
    return "| " + " | ".join(headers) + " |", "| " + " | ".join("---" for _ in headers) + " |"


def _or(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", NO_METHOD).otherwise(c)


def _counts(findings: DataFrame, key: Column) -> DataFrame:
    return findings.groupBy(key.alias("label")).agg(F.count(F.lit(1)).alias("n"))


def report_assets(findings: DataFrame) -> DataFrame:
    """One row for each source and algorithm, with methods, libraries and calls in the order of their lines."""
    seen = lambda c: F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct(F.col("line"), F.col("evidence"), c.alias("v"))))), lambda x: x["v"])), " / ")
    g = findings.groupBy("file_name", "source_id", "algorithm").agg(F.count(F.lit(1)).alias("n"), seen(method_label(F.col("detection_method"))).alias("methods"), seen(F.col("library")).alias("libraries"), seen(F.col("resolved_api")).alias("apis"))
    return g.withColumn("purpose", purpose(F.col("algorithm"))).withColumn("targets", F.replace(targets(F.col("purpose")), F.lit(","), F.lit(" / ")))


def markdown_document(sources: DataFrame, findings: DataFrame, source_type: str, scanned_at: str, coverage: dict[str, int] | None = None) -> DataFrame:
    """section, o0 to o3 and text: the lines of a report of seven sections, to be sorted by all but text.

    findings has source_id, file_name, line, algorithm, risk_level,
    detection_method, library, resolved_api, evidence, reason and
    recommendation; sources has source_id. Findings and assets are never
    collected: their lines are made where they are, and write_document() sorts
    the whole over all tasks. Without findings each section says so.
    """
    one = score(findings.withColumn("_all", F.lit(1)), ["_all"], F.contains("risk_level", F.lit("高"))).select("score", "source_count", "algorithm_count", "level")
    zero = findings.sparkSession.range(1).select(F.lit(0).alias("_z"))
    s = zero.join(one, F.lit(True), "left").crossJoin(sources.agg(F.count(F.lit(1)).alias("sources"))).crossJoin(findings.agg(F.count(F.lit(1)).alias("findings")))  # tables of one row
    value = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    priority = F.when(F.col("level") == "高", "立即规划迁移").when(F.col("level") == "中", "纳入迁移排期").otherwise("持续观察")
    head = [
        F.lit(f"# {TITLE}"), F.lit(""), F.concat(markdown_cell(F.lit(SOURCES.get(source_type, source_type))), F.lit(f" · {scanned_at}（北京时间）")), F.lit(""), F.lit(f"## {SECTIONS[0]}"), F.lit(""),
        F.concat(F.lit("- 风险发现总数："), value("findings"), F.lit(" · 受影响文件："), value("source_count")), F.concat(F.lit("- 文件数量："), value("sources"), F.lit(" · 算法种类："), value("algorithm_count")),
        F.concat(F.lit("- 迁移评分："), value("score"), F.lit("/100 · 迁移优先级："), priority),
    ]
    lines = F.posexplode(F.array(*head)).alias("i", "x")
    parts = [s.select(lines).select(*_line(1, 0, 0, 0, F.col("i"), text=F.col("x")))]
    algorithms, files = _counts(findings, F.col("algorithm")), findings.groupBy("source_id", "file_name").agg(F.count(F.lit(1)).alias("n"))
    top = algorithms.orderBy(F.desc("n"), "label").limit(1)
    parts.append(top.select(*_line(1, 1, text=F.concat(F.lit("- 主要算法："), F.col("label"), F.lit(" · "), F.col("n").cast("string"), F.lit(" 项发现。")))))
    most = files.orderBy(F.desc("n"), "file_name", "source_id").limit(MOST_FILES)
    parts.append(files.orderBy(F.desc("n"), "file_name", "source_id").limit(1).select(*_line(1, 2, text=F.concat(F.lit("- 命中最多："), markdown_cell(F.col("file_name")), F.lit(" · "), F.col("n").cast("string"), F.lit(" 项发现。")))))
    open_ = findings.agg(F.count_if(purpose(F.col("algorithm")) == OPEN).alias("n")).where("n > 0")
    parts.append(open_.select(*_line(1, 3, text=F.concat(F.lit("- 用途待确认："), F.col("n").cast("string"), F.lit(" 项，需结合调用上下文复核。")))))
    scope = [*_table(["项目", "本次数据"]), *[f"| {k} | {v} |" for k, v in coverage.items()]] if coverage else ["扫描范围未知。"]
    parts.append(_head(findings, 2, 0, "", f"## {SECTIONS[1]}", "", *scope, ""))
    parts.append(_head(findings, 3, 0, f"## {SECTIONS[2]}", ""))
    parts.append(findings.agg(F.count(F.lit(1)).alias("n")).select(*_line(3, 1, text=F.concat(F.lit("统计分母：本次全部 "), F.col("n").cast("string"), F.lit(" 项发现。")))))
    purposes = findings.sparkSession.createDataFrame([(i, p) for i, p in enumerate((SIGN, EXCHANGE, OPEN))], "i int, label string").join(_counts(findings, purpose(F.col("algorithm"))), "label", "left")
    tables = [
        ("算法", algorithms.select((-F.col("n")).alias("by"), F.col("label").alias("name"), F.lit("").alias("more"), F.col("label").alias("shown"), "n")),
        ("受影响文件 Top 8", most.select((-F.col("n")).alias("by"), F.col("file_name").alias("name"), F.col("source_id").alias("more"), F.concat("file_name", F.lit(" ("), "source_id", F.lit(")")).alias("shown"), "n")),
        ("用途", purposes.select(F.col("i").alias("by"), F.lit("").alias("name"), F.lit("").alias("more"), F.col("label").alias("shown"), F.coalesce("n", F.lit(0)).alias("n"))),
    ]
    for k, (title, rows) in enumerate(tables):
        parts.append(_head(findings, 3, 10 * k + 2, "", f"### {title}", "", *_table(["项目", "发现数"])))
        # the order of a table goes before its text: counts first, as one number, then names
        parts.append(rows.select(*_line(3, 10 * k + 3, F.format_string("%020d", F.col("by") + F.lit(10**18)), F.concat_ws("\0", "name", "more"), text=_row(F.col("shown"), F.col("n")))))
    parts.append(_head(findings, 4, 0, "", f"## {SECTIONS[3]}", "", *_table(["文件（身份）", "算法 / 用途", "命中", "识别方式", "密码库", "完整 API", "迁移参考"])))
    a = report_assets(findings)
    parts.append(a.select(*_line(4, 1, F.concat_ws("\0", "file_name", "source_id"), F.col("algorithm"), text=_row(F.concat("file_name", F.lit(" ("), "source_id", F.lit(")")), F.concat("algorithm", F.lit(" / "), "purpose"), F.col("n"), F.col("methods"), _or(F.col("libraries")), _or(F.col("apis")), F.col("targets")))))
    parts.append(_head(findings, 5, 0, "", f"## {SECTIONS[4]}", ""))
    mark = fence(F.col("evidence"))
    cell = lambda c: markdown_cell(F.coalesce(F.col(c).cast("string"), F.lit("")))
    block = F.array(
        F.concat(F.lit("### "), cell("algorithm"), F.lit(" · 第 "), cell("line"), F.lit(" 行 · "), cell("risk_level")), F.lit(""), F.concat(F.lit("文件："), cell("file_name")), F.lit(""), F.concat(mark, F.lit("text")), F.col("evidence"), mark, F.lit(""),
        F.concat(F.lit("- 文件身份："), cell("source_id")), F.concat(F.lit("- 识别方式："), markdown_cell(method_label(F.col("detection_method"))), F.lit(" · 密码库："), markdown_cell(_or(F.col("library")))), F.concat(F.lit("- 完整 API："), markdown_cell(_or(F.col("resolved_api")))), F.lit(""),
        F.concat(F.lit("原因："), cell("reason")), F.lit(""), F.concat(F.lit("迁移参考："), cell("recommendation")), F.lit(""),
    )
    place = F.format_string("%s\0%s\0%012d", F.col("file_name"), F.col("source_id"), F.col("line"))
    blocks = findings.select(place.alias("place"), "algorithm", F.posexplode(block).alias("i", "x"))
    parts.append(blocks.select(*_line(5, 1, F.col("place"), F.col("algorithm"), F.col("i"), text=F.col("x"))))
    parts.append(findings.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(*_line(5, 2, text=F.lit(NOTHING))))
    parts.append(_head(findings, 6, 0, f"## {SECTIONS[5]}", "", *_table(["算法", "用途", "影响文件", "发现数", "候选方案"])))
    m = findings.groupBy("algorithm").agg(F.countDistinct("source_id").alias("files"), F.count(F.lit(1)).alias("n")).withColumn("purpose", purpose(F.col("algorithm")))
    rank = F.format_string("%020d%020d", F.lit(10**18) - F.col("files"), F.lit(10**18) - F.col("n"))
    parts.append(m.select(*_line(6, 1, rank, F.col("algorithm"), text=_row(F.col("algorithm"), F.col("purpose"), F.col("files"), F.col("n"), F.replace(targets(F.col("purpose")), F.lit(","), F.lit(" / "))))))
    parts.append(_head(findings, 7, 0, "", f"## {SECTIONS[6]}", "", "### 评分与能力边界", "", *[f"- {b}" for b in BOUNDARIES], "", "### 识别依据", "", *_table(["识别方式", "发现数"])))
    methods = _counts(findings, F.coalesce("detection_method", F.lit("unknown")))
    parts.append(methods.select(*_line(7, 1, F.format_string("%020d", F.lit(10**18) - F.col("n")), F.col("label"), text=_row(method_label(F.col("label")), F.col("n")))))
    return reduce(DataFrame.unionByName, parts)


ORDER = ["section", "o0", "o1", "o2", "o3"]


def html_document(lines: DataFrame) -> DataFrame:
    """The lines of a Markdown report as those of an HTML page without scripts: headings, tables, lists and blocks, all text escaped.

    A line's element depends on the line alone, so the page needs no state
    from line to line; tables are rows of one table element each.
    """
    t = F.col("text")
    safe = html_text(F.regexp_replace(F.regexp_replace(t, r"^(?:#+|-) ", ""), r"&(amp|lt|gt);", "\0$1;"))
    safe = F.regexp_replace(safe, "\0(amp|lt|gt);", "&$1;")
    level = F.length(F.regexp_extract(t, "^(#+) ", 1)).cast("string")
    cells = F.transform(F.split(F.regexp_replace(F.regexp_replace(t, r"^\| | \|$", ""), r"\\\|", "\0"), r" \| ", -1), lambda c: F.concat(F.lit("<td>"), F.regexp_replace(F.regexp_replace(html_text(F.regexp_replace(c, r"&(amp|lt|gt);", "\x01$1;")), "\x01", "&"), "\0", "|"), F.lit("</td>")))
    body = (
        F.when(t.rlike("^#+ "), F.concat(F.lit("<h"), level, F.lit(">"), safe, F.lit("</h"), level, F.lit(">"))).when(t.rlike(r"^\| ---"), "").when(t.startswith("| "), F.concat(F.lit("<table><tr>"), F.array_join(cells, ""), F.lit("</tr></table>")))
        .when(t.startswith("- "), F.concat(F.lit("<li>"), safe, F.lit("</li>"))).when((F.col("section") == 5) & (F.col("o3") == 5), F.concat(F.lit("<pre>"), html_text(t), F.lit("</pre>"))).when((F.col("section") == 5) & F.col("o3").isin(4, 6), "").when(t == "", "").otherwise(F.concat(F.lit("<p>"), safe, F.lit("</p>")))
    )
    return lines.withColumn("text", body).where("text <> ''")


def write_document(lines: DataFrame, path: str) -> None:
    """A folder of text files that are the report in the order of their names."""
    lines.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).select(F.replace(F.col("text"), F.lit("\0"), F.lit(" ")).alias("text")).write.mode("overwrite").text(path)
