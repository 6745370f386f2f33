"""ZIP and TAR archives as rows of members."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.sources.readers import MOST_BYTES, SUFFIXES

MOST_MEMBERS = 5000
MOST_EXPANDED = 100 * 1024 * 1024
#: Rows and bytes of the batches that a worker holds: archives are long rows, and a few thousand of them members enough for a batch of texts.
BATCH_ROWS, BATCH_BYTES, TEXT_CHARS = 1000, "32mb", 1 << 20


def zip_bytes(files: list[tuple[str, str]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files:
            z.writestr(name, text)
    return out.getvalue()


def safe_name(name: str) -> str:
    """The member's path with forward slashes; empty for paths that leave the archive or name a drive."""
    path = name.replace("\\", "/")
    parts = [p for p in path.split("/") if p not in ("", ".")]
    return "" if path.startswith("/") or ".." in parts or ":" in path or "\0" in path else "/".join(parts)


def _entries(content: bytes) -> Iterator[tuple[str, int, bool, object]]:
    """(name, size, is a regular file, function that reads at most n bytes)."""
    if content[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for i in z.infolist():
                regular = not i.is_dir() and (i.external_attr >> 16) & 0o170000 in (0, 0o100000) and not i.flag_bits & 1
                yield i.filename, i.file_size, regular, lambda n, i=i: z.open(i).read(n)
    else:
        mode = "r|gz" if content[:2] == b"\x1f\x8b" else "r|bz2" if content[:3] == b"BZh" else "r|"
        with tarfile.open(fileobj=io.BytesIO(content), mode=mode) as t:
            for m in t:
                yield m.name, m.size, m.isreg(), lambda n, m=m: t.extractfile(m).read(n)


def members_of(content: bytes) -> Iterator[tuple[int, str, str | None, str | None]]:
    """(ordinal, member, text, reason why there is no text). Ends at the bounds, which also get a row."""
    total = ordinal = 0
    try:
        for ordinal, (name, size, regular, read) in enumerate(_entries(content)):
            if ordinal >= MOST_MEMBERS:
                yield ordinal, "", None, "too_many_members"
                return
            path, text, why = safe_name(name), None, None
            if not regular:
                why = "not_a_file"
            elif not path:
                why = "unsafe_path"
            elif not path.lower().endswith(tuple(SUFFIXES)):
                why = "unsupported_type"
            elif size > MOST_BYTES:
                why = "too_large"
            else:
                data = read(MOST_BYTES + 1)
                total += len(data)
                if total > MOST_EXPANDED:
                    yield ordinal, path, None, "text_budget"
                    return
                try:
                    text = data.decode("utf-8-sig") if len(data) <= MOST_BYTES else None
                    why = None if text is not None else "too_large"
                except UnicodeDecodeError:
                    why = "not_utf8"
            yield ordinal, path, text, why
    except (zipfile.BadZipFile, tarfile.TarError, EOFError, OSError, RuntimeError, NotImplementedError):
        yield ordinal, "", None, "unreadable_archive"


def in_batches(rows: Iterator[tuple], schema) -> Iterator:
    """Record batches of at most BATCH_ROWS rows (path, ordinal, member, text, reason) that end once they have TEXT_CHARS of text."""
    import pyarrow as pa

    held, chars = [], 0
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
    for row in rows:
        held.append(row)
        chars += len(row[3] or "")
        if len(held) >= BATCH_ROWS or chars >= TEXT_CHARS:
            yield batch()
            held, chars = [], 0
    if held:
        yield batch()


def members(archives: DataFrame, name: str = "path", content: str = "content") -> DataFrame:
    """One row for each member. A directory that all safe files of an archive share is taken off their paths.

    An archive is one task's work; its members, their sizes and the total are
    bounded, and a worker holds one archive and a batch of texts at a time.
    Null archives have no members.
    """
    kind = archives.schema[name].dataType.simpleString()
    archives.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    archives.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            schema = pa.schema([(name, b.schema.field(0).type), ("ordinal", pa.int32()), ("member", pa.string()), ("text", pa.string()), ("reason", pa.string())])
            listed = ((n.as_py(), *m) for n, data in zip(b.column(0), b.column(1), strict=True) if data.is_valid for m in members_of(data.as_py()))
            yield from in_batches(listed, schema)

    rows = archives.select(name, content).mapInArrow(run, f"{name} {kind}, ordinal int, member string, text string, reason string")
    safe = F.col("member") != ""
    root = F.when(safe, F.element_at(F.split("member", "/"), 1))
    tops = rows.groupBy(name).agg((F.min(F.when(safe, F.contains("member", F.lit("/")))) & (F.min(root) == F.max(root))).alias("_one"))
    inner = F.when(F.col("_one") & F.col("member").contains("/"), F.regexp_replace("member", "^[^/]*/", "")).otherwise(F.col("member"))
    return rows.join(tops, name).withColumn("member", inner).drop("_one")


def archive_folder(spark: SparkSession, path: str) -> DataFrame:
    """Members of all archives below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return members(files.where(F.lower("path").rlike(r"\.(zip|tar|tgz|tar\.gz|tar\.bz2)$")).select("path", "content"))
