"""What the operators share: tables, stored steps, words and hashed numbers."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions.text import let
from wardline.llm.batches import SLICE_BYTES
from wardline.session import with_checkpoints

#: The white space that ends a word: the blank and the characters 9 to 13.
BLANKS = " \t\n\x0b\f\r"
HASH_DIGITS = 13
_SHIPPED: set[str] = set()
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this library to the Python workers of the session, once.

    Arrow batches between Spark and the workers get the size of a slice, where the session has
    no setting of its own: by default each task holds up to 64 MB in either process.
    """
    if BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(BATCH_SETTING, SLICE_BYTES)
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent.parent
    path = f"{tempfile.mkdtemp()}/wardline-{uuid.uuid4().hex}.zip"
    with zipfile.ZipFile(path, "w") as target:
        for source in sorted(package.rglob("*.py")):
            target.write(source, str(source.relative_to(package.parent)))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the checkpoint folder that all executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        context = spark.sparkContext
        if context.getCheckpointDir() is None:
            with_checkpoints(spark)
        folder = context.getCheckpointDir()
    if folder is None:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{folder.rstrip('/')}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The table written once to the shared folder and read back, which cuts its lineage."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def freed(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more, and files of shuffles that are over.

    Spark drops the files of a shuffle once the driver's JVM has collected its plan, which an
    idle heap puts off for up to half an hour.
    """
    jvm = spark.sparkContext._jvm
    for table in tables:
        path = jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    jvm.System.gc()


def words(text: Column) -> Column:
    """The words of a text, an empty array for a null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"),
                    lambda w: w != "")


def count_words(text: Column) -> Column:
    """The number of words; the pieces of a split are empty only at the two ends."""
    pieces = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")
    return let(pieces, lambda p: F.size(p)
               - F.when(F.element_at(p, 1) == "", 1).otherwise(0)
               - F.when((F.size(p) > 1) & (F.element_at(p, -1) == ""), 1).otherwise(0)
               ).cast("long")


def share(key: Column) -> Column:
    """A number from 0 to 1 that only depends on the key; the same in any engine with md5."""
    digits = F.conv(F.substring(F.md5(key), 1, HASH_DIGITS), 16, 10).cast("double")
    return digits / float(16 ** HASH_DIGITS)


def fits(df: DataFrame, rows: int) -> bool:
    """Whether a table has at most so many rows; reads no more than that."""
    return df.limit(rows + 1).count() <= rows


def join_bounded(big: DataFrame, small: DataFrame, condition: Callable[[DataFrame], Column],
                 rows: int = 10_000, how: str = "left") -> DataFrame:
    """Broadcast a stored table whose checked size is small, or else let Spark shuffle."""
    side = F.broadcast(small) if fits(small, rows) else small
    return big.join(side, condition(side), how)
