"""The folder that all machines share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from windrift.sources.files import scratch_folder

_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster names in spark.checkpoint.dir.

    Where that is unset a folder is made for a local master, as in tests; on a cluster it is an error.
    """
    return scratch_folder(spark, name)


def stored(df: DataFrame, name: str, paths: list[str] | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again: what is used several times is computed once, and its size is known.

    The table's path is added to ``paths``, for ``removed`` when nothing reads it any more.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    if paths is not None:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, *paths: str) -> None:
    """Take scratch tables away that nothing reads any more."""
    jvm = spark._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Tables:
    """Scratch tables of one job, each by a name: a new table of a name takes the place of the old one, whose files go.

    ``rows`` is how many rows the smallest tables have; they get a file for ``EACH`` rows, so that many small tables are not many files.
    """

    EACH = 1 << 15

    def __init__(self, spark: SparkSession, rows: int = 0):
        self.spark, self.files, self.paths = spark, max(spark.sparkContext.defaultParallelism, rows // self.EACH), {}

    def keep(self, df: DataFrame, name: str, times: int = 1) -> DataFrame:
        """``df`` as a table of at most ``times`` the usual files."""
        paths: list[str] = []
        out = stored(df.coalesce(self.files * times), name, paths)
        self.drop(name)
        self.paths[name] = paths[0]
        return out

    def drop(self, *names: str) -> None:
        removed(self.spark, *[self.paths.pop(n) for n in names if n in self.paths])

    def clear(self) -> None:
        self.drop(*list(self.paths))


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What is shuffled inside leaves the disk when its job has ended; a job that needs it again makes it again."""
    before = spark.conf.get(_FREED)
    spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREED, before)


def settle(df: DataFrame) -> DataFrame:
    """``df`` from a checkpoint in the shared folder: its lineage is cut, and it survives lost executors."""
    if not df.sparkSession.sparkContext.getCheckpointDir():
        shared_folder(df.sparkSession, "checkpoint")
    return df.checkpoint()


def aside(docs: DataFrame, *used: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with its other columns under names that clash with nothing, and what gives them their names back."""
    names = [c if c in used else f"_aside{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), lambda df: df.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])


def wider(df: DataFrame, *columns: str) -> StructType:
    """The schema of ``df`` with more columns, each as "name type"."""
    return StructType([*df.schema.fields, *StructType.fromDDL(", ".join(columns)).fields])
