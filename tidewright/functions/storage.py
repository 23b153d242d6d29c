"""Shared storage of a session: the folder the cluster names for checkpoints; where none is named, the warehouse, or a temporary
folder if Spark runs on this machine alone."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named and not sc.master.startswith("local"):
        named = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_tidewright"
    if not named:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidewright-shared-"))
        named = sc.getCheckpointDir()
    return f"{named.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def landed(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read again: what is read several times is worked out once, and the plan of a round
    does not grow with those before."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_shuffle(df: DataFrame) -> DataFrame:
    """df, whose joins are sorted merges: compressed files are small where the driver's memory for their rows is not, so what grows
    with the input is never sent to all tasks."""
    return df.hint("merge")


def tasks(df: DataFrame) -> int:
    """Tasks for work that is long beside the bytes it reads, so that no few partitions keep it."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


#: A batch handed to Python holds at most this many rows and about this many bytes; rows that come back leave in runs of PIECE texts.
BATCH_ROWS, BATCH_BYTES, PIECE = 1000, 16 << 20, 100


def small_batches(df: DataFrame) -> DataFrame:
    """df, whose session hands its texts to Python in batches of bounded size, so that a worker's memory does not follow its partition."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    try:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    except Exception as e:  # an older Spark without the setting
        if "CONFIG" not in str(e).upper():
            raise
    return df
