"""Helpers shared by the corpus operators: shared staging, shipping the package, Arrow batch bounds."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PACKAGE = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()

#: A batch handed to Python holds at most this many rows and about this many bytes.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20

#: Characters that Python, Java and the contracts all call white space: [\x20\x09-\x0D].
BLANK = r"\x20\x09-\x0D"
NOT_BLANK = r"[^\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> SparkSession:
    """Make the package importable on executors and bound the Arrow batches; cheap to call again."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        target = Path(tempfile.mkdtemp(prefix="tidewright-")) / "tidewright_src.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(_PACKAGE.rglob("*.py")):
                z.write(p, p.relative_to(_PACKAGE.parent))
        sc.addPyFile(str(target))
        _shipped.add(sc.applicationId)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    except Exception as e:  # an older Spark without the setting
        if "CONFIG" not in str(e).upper():
            raise
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, read by Spark alone so that any store works."""
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where none is named, the warehouse, or a temporary folder if
    Spark runs on this machine alone."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named and not sc.master.startswith("local"):
        return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_tidewright"
    if not named:
        named = tempfile.mkdtemp(prefix="tidewright-shared-")
        sc.setCheckpointDir(named)
        named = sc.getCheckpointDir()
    return named.rstrip("/")


def stage(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write df as Parquet to the shared folder and read it back: lineage is cut, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def staged(df: DataFrame, label: str) -> DataFrame:
    return stage(df, label)[0]


def unstage(spark: SparkSession, path: str) -> None:
    """Remove a staged table that no later plan reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def word_count(text) -> F.Column:
    """Number of maximal runs of non-blank characters, JVM-side; null text counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(NOT_BLANK)), F.lit(0)).cast("long")


def keyed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, th): each row of docs as a struct, whatever its columns are called, with its id and a hash of its text."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(row, F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("th"))


def unwrapped(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs again."""
    return rows.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def without(docs: DataFrame, gone: DataFrame, few: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of keyed_rows(docs) whose id and text are not in gone (doc_id, th); gone is sent to all tasks if it has at
    most `few` rows."""
    right = gone.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"))
    right = F.broadcast(right) if gone.count() <= few else right
    left = keyed_rows(docs, id_col, text_col)
    return left.join(right, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left_anti")


def once(rows: DataFrame, twice: DataFrame) -> DataFrame:
    """rows (row, doc_id, th) with one row of each id and text of twice (doc_id, th); ids are not null."""
    if not twice.take(1):  # repeated rows are rare, so only then are whole rows dealt by id
        return rows
    right = twice.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), F.lit(True).alias("_twice"))
    both = rows.join(right, (F.col("doc_id") == F.col("_id")) & (F.col("th") == F.col("_th")), "left").select("row", "doc_id", "th", F.col("_twice").isNotNull().alias("_twice"))
    again = both.where("_twice").dropDuplicates(["doc_id", "th"])
    return both.where("not _twice").unionByName(again).drop("_twice")
