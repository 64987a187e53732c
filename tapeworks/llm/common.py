"""What the operators of this subpackage share: tables, scratch storage, stable folds."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of shingles and of quality rules: runs of anything but the six ASCII white-space characters.
SPACE_CLASS = r"[\x20\x09-\x0D]+"

#: Stands for a null doc_id in keys of joins; real ids are never this small.
NULL_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where neither the setting nor a checkpoint folder is given, a session on one machine (tests)
    gets a temporary folder, and one on a cluster an error: its executors would not see that folder.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="tapeworks-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


#: With this setting Spark removes a query's shuffle files, on all executors, as soon as the query has ended.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(df: DataFrame, what: str, free_shuffles: bool = False) -> DataFrame:
    """df written as Parquet under the shared folder and read again.

    Cuts the lineage and keeps what several later steps read. Executors may be lost at any
    time after it, as the files are not theirs. The files stay until `discard`, or until the
    folder is cleared: the returned frame, which is lazy, still reads them.

    Shuffle files of the write stay until the driver's JVM happens to collect its plan; with
    free_shuffles they go when the write ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}/{what}"
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    if free_shuffles:
        spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if free_shuffles:
            spark.conf.set(SHUFFLE_CLEANUP, before) if before is not None else spark.conf.unset(SHUFFLE_CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Deletes the files of frames that `scratch` returned and that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if "/scratch-" in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def boxed(docs: DataFrame) -> DataFrame:
    """docs as one column, `row`, so that no name of an operator can clash with one of docs; select("row.*") opens it."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))


def inside(column: str) -> Column:
    """A column of a boxed row."""
    return F.col("row").getField(column)


def fold(id_column: str | Column, parts: int) -> Column:
    """crc32 of the id's decimal text, modulo parts; 0 for a null id."""
    text = (F.col(id_column) if isinstance(id_column, str) else id_column).cast("string")
    return F.coalesce(F.crc32(text.cast("binary")) % parts, F.lit(0))


def id_key(id_column: str | Column) -> Column:
    """The id with null replaced, for joins in which a null id must find itself."""
    return F.coalesce((F.col(id_column) if isinstance(id_column, str) else id_column).cast("long"), F.lit(NULL_ID))


def from_key(key: str) -> Column:
    """The id that `id_key` replaced."""
    return F.when(F.col(key) != NULL_ID, F.col(key))


def runs_of_chars(lengths: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges [a, b) of consecutive texts that together stay under limit characters, one text at least."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


