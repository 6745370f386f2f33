"""Whole reports: all sections in order, escaped, with fences longer than any in the evidence."""

from cairn.sources import documents

SCHEMA = "source_id string, file_name string, line int, algorithm string, risk_level string, detection_method string, library string, resolved_api string, evidence string, reason string, recommendation string"
ROWS = [
    ("s2", "b.py", 10, "RSA", "高风险", "ast_call", "cryptography", "c.rsa.generate", "x ``` y\n<script>", "r|1", "m"),
    ("s1", "a|<b>.py", 2, "RSA", "高风险", "text_config", None, None, "算法标识: RS256", "r", "m"),
    ("s1", "a|<b>.py", 9, "ECDSA", "高风险", "text_config", None, None, "e & f", "r", "m"),
    ("s1", "a|<b>.py", 3, "RSA", "高风险", "ast_call", "PyCryptodome", "Crypto.PublicKey.RSA.generate", "g", "r", "m"),
]


def ordered(df):
    return [r.text for r in df.orderBy(*documents.ORDER).collect()]


def test_markdown_and_html(spark):
    findings, sources = spark.createDataFrame(ROWS, SCHEMA), spark.createDataFrame([("s1",), ("s2",), ("s3",)], "source_id string")
    lines = documents.markdown_document(sources, findings, "snippet", "2024-01-01T00:00:00+08:00", {"已分析文件": 3}).cache()
    text = ordered(lines)
    assert [x[3:] for x in text if x.startswith("## ")] == documents.SECTIONS
    for line in ("- 风险发现总数：4 · 受影响文件：2", "- 文件数量：3 · 算法种类：2", "- 迁移评分：100/100 · 迁移优先级：立即规划迁移", "- 主要算法：RSA · 3 项发现。", "- 命中最多：a\\|&lt;b&gt;.py · 3 项发现。", "- 用途待确认：3 项，需结合调用上下文复核。", "| 已分析文件 | 3 |", "| 密钥建立 | 0 |"):
        assert line in text, line
    at = text.index("### 算法")
    assert text[at + 4 : at + 6] == ["| RSA | 3 |", "| ECDSA | 1 |"]
    assert "| a\\|&lt;b&gt;.py (s1) | RSA / 用途待确认 | 2 | 文本配置 / AST 调用 | PyCryptodome | Crypto.PublicKey.RSA.generate | ML-KEM / ML-DSA / SLH-DSA |" in text
    k = text.index("### RSA · 第 10 行 · 高风险")
    assert text[k + 4 : k + 7] == ["````text", "x ``` y\n<script>", "````"] and text[k + 12] == "原因：r\\|1"
    assert [x for x in text if x.startswith("### RSA · 第")] == ["### RSA · 第 2 行 · 高风险", "### RSA · 第 3 行 · 高风险", "### RSA · 第 10 行 · 高风险"]
    assert text.index("| RSA | 用途待确认 | 2 | 3 | ML-KEM / ML-DSA / SLH-DSA |") < text.index("| ECDSA | 数字签名 | 1 | 1 | ML-DSA / SLH-DSA |")
    page = ordered(documents.html_document(lines))
    assert "<pre>x ``` y\n&lt;script&gt;</pre>" in page and "<h2>附录</h2>" in page and not any("<script" in x for x in page)
    assert any(x.startswith("<table><tr><td>a|&lt;b&gt;.py (s1)</td>") for x in page)


def test_a_report_without_findings(spark, tmp_path):
    lines = documents.markdown_document(spark.createDataFrame([], "source_id string"), spark.createDataFrame([], SCHEMA), "pypi_package", "t")
    text = ordered(lines)
    assert documents.NOTHING in text and "- 迁移评分：0/100 · 迁移优先级：持续观察" in text and "扫描范围未知。" in text
    documents.write_document(lines, f"{tmp_path}/report")
    written = "".join(f.read_text() for f in sorted((tmp_path / "report").glob("part-*")))
    assert written.splitlines() == text
