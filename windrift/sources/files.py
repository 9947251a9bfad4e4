"""Files in and out: session logs, results, manifests and assets."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all machines share (spark.checkpoint.dir).

    Where that is unset a folder is made for a local master, as in tests; on a cluster it is an error.
    """
    context = spark.sparkContext
    if not (top := context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir")):
        if context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir is not set: scratch tables need a folder that all machines share")
        context.setCheckpointDir(f"/tmp/checkpoints/{uuid.uuid4().hex}")
        top = context.getCheckpointDir()
    return f"{top}/{name}-{uuid.uuid4().hex}"


def write_logs(lines: DataFrame, path: str) -> None:
    """Session logs as text: a file for each session_id, its lines in order of line_no, in a folder named session_id=..."""
    ordered = lines.repartition("session_id").sortWithinPartitions("session_id", "line_no")
    ordered.select("session_id", "line").write.partitionBy("session_id").text(path)


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """(session_id, line_no, line) of text files, one session a file named after it (or after its folder, as ``write_logs`` has it); blank lines go but count.

    A file is read whole, so its lines keep their order.
    """
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    name = F.input_file_name()
    folder = F.regexp_extract(name, r"session_id=([^/]+)/[^/]*$", 1)
    files = files.select(F.when(folder != "", folder).otherwise(F.element_at(F.split(name, "/"), -1)).alias("session_id"), F.split("value", "\r?\n").alias("lines"))
    rows = files.select("session_id", F.posexplode("lines").alias("line_no", "line"))
    return rows.withColumn("line", F.trim("line")).where("line <> ''")


def read_metrics(spark: SparkSession, path: str, strategy: str = "E") -> DataFrame:
    """Stored measures of one strategy, a column a metric; only its partition is read."""
    rows = spark.read.parquet(path).where(F.col("strategy") == strategy)
    return rows.groupBy("session_id").pivot("metric").agg(F.first("value"))


def write_metrics(metrics: DataFrame, path: str) -> None:
    """The long table of measures, partitioned by strategy."""
    metrics.write.mode("overwrite").partitionBy("strategy").parquet(path)


def write_results(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as Parquet under its name, by venue where it has one, and as JSON lines beside it."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        (writer.partitionBy("venue") if "venue" in df.columns else writer).parquet(f"{path}/{name}")
        df.write.mode("overwrite").json(f"{path}/{name}.json")


def read_manifest(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A row for each chapter of JSON manifests (version, chapters[]); with ``lines`` a manifest is a line of a file, else a file."""
    return spark.read.json(path, multiLine=not lines).select("version", F.inline("chapters"))


def read_tracks(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A row for each track of JSON audio manifests (version, tracks[]); with ``lines`` a manifest is a line of a file, else a file."""
    return spark.read.json(path, multiLine=not lines).select(F.col("version").alias("audio_version"), F.inline("tracks"))


def asset_check(expected: DataFrame, path: str) -> DataFrame:
    """``expected`` (name) with ``exists`` and ``bytes`` of the files under ``path``; their content is not read.

    The part files of a folder that Spark wrote are one asset with the folder's name.
    """
    spark = expected.sparkSession
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.regexp_extract("path", r"([^/]+?)(?:/part-[^/]*)?$", 1).alias("name"), "length")
    found = listed.groupBy("name").agg(F.sum("length").alias("bytes"))
    return expected.join(found, "name", "left").select("name", F.col("bytes").isNotNull().alias("exists"), "bytes")
