"""Raw files: a binary scan with the size test pushed down and hidden files left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelmill.functions.binary import extension


def raw_files(spark: SparkSession, *paths: str, pattern: str | None = None) -> DataFrame:
    """``path, name, ext, size, content`` of all regular, visible files below ``paths`` that are not empty.

    Without ``content`` in what follows, no file's bytes are read.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    name = F.element_at(F.split("path", "/"), -1)
    files = reader.load(list(paths)).where("length > 0")
    return files.select("path", name.alias("name"), extension(name).alias("ext"), F.col("length").alias("size"), "content").where(~F.col("name").startswith("."))


def modern_images(spark: SparkSession, *paths: str) -> DataFrame:
    """``path, width, height, channels, pixels`` (grey, BGR or BGRA) by the built-in image source: PNG, JPEG, GIF, BMP."""
    got = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(list(paths))
    return got.select(F.col("image.origin").alias("path"), F.col("image.width").alias("width"), F.col("image.height").alias("height"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("pixels"))
