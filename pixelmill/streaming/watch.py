"""Watching a folder: new raw files as a stream, classified and decoded as they come."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from pixelmill.functions.binary import extension
from pixelmill.operators.images import decoded

_FILES = "path string, modificationTime timestamp, length long, content binary"


def new_files(spark: SparkSession, folder: str, most_per_trigger: int = 1000, times: bool = False) -> DataFrame:
    """Files that appear in ``folder``, in the shape of ``sources.raw.raw_files``; with ``times`` when they were ``modified``, too."""
    got = spark.readStream.format("binaryFile").schema(_FILES).option("maxFilesPerTrigger", most_per_trigger).load(folder).where("length > 0")
    name = F.element_at(F.split("path", "/"), -1)
    columns = ["path", name.alias("name"), extension(name).alias("ext"), F.col("length").alias("size"), "content"]
    return got.select(*columns, *([F.col("modificationTime").alias("modified")] if times else [])).where(~F.col("name").startswith("."))


def new_images(spark: SparkSession, folder: str) -> DataFrame:
    return decoded(new_files(spark, folder))


_IMPORTED = "path string, name string, ext string, size long, digest string"


def seen(spark: SparkSession, table: str) -> DataFrame:
    """What ``import_once`` has written to ``table``: a row for each content, with the path it was met at first."""
    reader = spark.read.schema(f"{_IMPORTED}, batch_id long")
    try:
        return reader.parquet(table)
    except AnalysisException:
        return spark.createDataFrame([], f"{_IMPORTED}, batch_id long")


def keep_new(batch: DataFrame, batch_id: int, table: str) -> None:
    """Writes the files of a trigger whose content no other trigger wrote, each content once: the same again if it runs again."""
    spark = batch.sparkSession
    known = seen(spark, table).where(F.col("batch_id") != batch_id).select("digest")
    first = batch.groupBy("digest").agg(F.min(F.struct("path", "name", "ext", "size")).alias("at")).select("at.*", "digest")
    first.join(known, "digest", "left_anti").select(*[c.split()[0] for c in _IMPORTED.split(", ")]).write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")


def import_once(files: DataFrame, table: str, checkpoint: str, within: str = "1 day") -> DataStreamWriter:
    """A stream of ``new_files`` to a table with one row for each content, however often and wherever a file appears.

    Contents met again within ``within`` of their files' times are dropped by the stream's state, which forgets them then;
    older ones by the table. A trigger that runs again after a loss replaces what it wrote.
    """
    known = files.withColumn("digest", F.sha2("content", 256)).drop("content").withWatermark("modified", within).dropDuplicatesWithinWatermark(["digest"])
    return known.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, k: keep_new(batch, k, table))
