"""Steps of long plans: rows dealt to all cores, joins chosen by measured sizes, results kept in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: tasks for each core over which parsers deal their files.
TASKS = 4

_ready: set[str] = set()


def measured_joins(spark: SparkSession) -> None:
    """A table is sent whole to all executors only after its rows were measured, or where a join says so; the values hold for the session.

    Spark's estimate of what parsers and checkpoints give is a share of the
    size of the files behind them, whatever is made of their rows: facts of
    gigabytes passed for less than 10 MB, and went through the driver.
    """
    most = "10MB"  # Spark's own default
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", most)


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt evenly to some tasks for each core: a small file of them is one task, however long what is made of each takes."""
    # by a number of the row: dealing in turn sorts all rows of the one task before
    return rows.repartition(TASKS * rows.sparkSession.sparkContext.defaultParallelism, F.monotonically_increasing_id())


def kept_in(spark: SparkSession) -> str:
    """The folder below spark.checkpoint.dir for steps, which Spark's checkpoints use too."""
    app = spark.sparkContext.applicationId
    if app not in _ready:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            base = tempfile.mkdtemp(prefix="cairn-steps-")
        spark.sparkContext.setCheckpointDir(f"{base.rstrip('/')}/steps")
        _ready.add(app)
    return spark.sparkContext.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """df as a checkpoint below spark.checkpoint.dir: later steps read it instead of computing it again, also after an executor is lost."""
    measured_joins(df.sparkSession)
    kept_in(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, *by: str) -> DataFrame:
    """df as Parquet below spark.checkpoint.dir, in parts by the columns `by`: a later step reads only the parts and columns that it needs."""
    spark = df.sparkSession
    measured_joins(spark)
    path = f"{kept_in(spark)}/table-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
