"""Publishing a stream of results: each once, only whole files, nothing after a task's end, versions that never go back."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout


def published_once(results: DataFrame, key: str = "source_id", seen_at: str = "seen_at", late: str = "10 minutes") -> DataFrame:
    """A stream's rows, each key once; keys are remembered as long as rows may be late, so the state is bounded."""
    return results.withWatermark(seen_at, late).dropDuplicatesWithinWatermark([key])


def whole_files(results: DataFrame, key: str = "source_id", failed: str = "diagnostic", stops: tuple[str, ...] = ("analysis_limit", "config_parse_error", "analysis_interrupted")) -> tuple[DataFrame, DataFrame]:
    """(rows of files that were analysed whole, reasons with the number of files that weren't)."""
    broken = results.where(F.col(failed).isin(*stops))
    reasons = broken.groupBy(F.col(failed).alias("reason")).agg(F.countDistinct(key).alias("files"))
    return results.join(broken.select(key).distinct(), key, "left_anti"), reasons


def task_states(updates: DataFrame, folder: str, checkpoint: str, terminal: Callable[[DataFrame], Column], schema: str, key: str = "task_id", version: str = "version", forget: str | None = None) -> StreamingQuery:
    """Appends a stream's updates that still count to a table in folder.

    Updates after the one that ended their task are late and left out, and so
    are those of a version that is not above the last one written; of equal
    versions one counts. What is known of a task, its last version and whether
    it is over, is keyed state of the stream: a micro-batch reads and writes
    the state of its own tasks alone, however many came before. Tasks without
    an update for the interval `forget` are forgotten by a timer, and the
    stream runs until it is stopped; without it none are, and it ends when
    all that is there has been read. The table's log makes a restart repeat nothing. `schema` is that
    of the updates.
    """
    fields = updates.sparkSession.createDataFrame([], schema).schema
    wait = None if forget is None else int(pd.Timedelta(forget) / pd.Timedelta("1ms"))

    def judge(_, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, over = state.get if state.exists else (None, False)
        rows = pd.concat(list(frames), ignore_index=True).sort_values(version, kind="stable").drop_duplicates(version)
        rows = rows if last is None else rows[rows[version] > last]
        ends = rows[version][rows["_over"]]
        kept = rows.iloc[:0] if over else rows[rows[version] <= ends.min()] if len(ends) else rows
        if len(kept):
            state.update((int(kept[version].max()), bool(over or len(ends))))
        if wait:
            state.setTimeoutDuration(wait)
        yield kept[fields.names]

    marked = updates.withColumn("_over", F.coalesce(terminal(updates), F.lit(False))).where(F.col(version).isNotNull())
    timeout = GroupStateTimeout.ProcessingTimeTimeout if wait else GroupStateTimeout.NoTimeout
    kept = marked.groupBy(key).applyInPandasWithState(judge, fields, "last long, over boolean", "append", timeout)
    return kept.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(**({"processingTime": "1 second"} if wait else {"availableNow": True})).start()


def current(spark: SparkSession, folder: str, schema: str, key: str = "task_id", version: str = "version") -> DataFrame:
    """The last state of each task."""
    rows = spark.read.schema(schema).parquet(folder)
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), version).alias("_r")).select(key, "_r.*")
