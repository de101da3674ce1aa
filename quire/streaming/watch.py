"""Arriving files as a stream: the batch scan over new files, failures counted by window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import scan

BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, path: str, *, files_per_trigger: int = 1000) -> DataFrame:
    """(file_id, arrived, content) of files that appear below a path."""
    stream = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("recursiveFileLookup", "true")
    found = stream.option("pathGlobFilter", "*.[pP][dD][fF]").option("maxFilesPerTrigger", files_per_trigger).load(path)
    return found.select(F.col("path").alias("file_id"), F.col("modificationTime").alias("arrived"), "content")


def headers(stream: DataFrame) -> DataFrame:
    """Headers of arriving files; malformed ones give no row."""
    return scan.headers(stream.select("file_id", "content"))


def outcomes(stream: DataFrame, *, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Files and failures in windows of arrival, with a watermark for late files."""
    from ..sources.arrow import map_rows
    from ..kernel import survey

    def work(file_id, arrived, content):
        yield file_id, arrived, survey.try_parse(bytes(content or b""))[1] is None

    judged = map_rows(stream.select("file_id", "arrived", "content"), "file_id string, arrived timestamp, ok boolean", work)
    counted = judged.withWatermark("arrived", late).groupBy(F.window("arrived", window))
    return counted.agg(F.count(F.lit(1)).alias("n_files"), F.sum(F.when(F.col("ok"), 0).otherwise(1)).alias("n_failed"))
