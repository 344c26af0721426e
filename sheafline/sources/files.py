"""Files as rows (path, name, length, modified, content), in batch and as a stream, and rows as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafline.functions import text as X

SCHEMA = T.StructType(
    [T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())]
)


def _named(df: DataFrame) -> DataFrame:
    return df.select("path", X.file_name("path").alias("name"), "length", F.col("modificationTime").alias("modified"), "content")


def read(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """Whole files, one a row; content is only read where it is used."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return _named((reader.option("pathGlobFilter", glob) if glob else reader).load(path))


def stream(spark: SparkSession, path: str, glob: str | None = None, files_per_trigger: int = 1000) -> DataFrame:
    """New files of a folder as they arrive; the schema must be named for a stream."""
    reader = spark.readStream.format("binaryFile").schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger)
    return _named((reader.option("pathGlobFilter", glob) if glob else reader).load(path))


def lines(df: DataFrame, path: str, line: str = "line", mode: str = "errorifexists") -> None:
    """Writes one text line a row; lines may hold any line ends of their own."""
    df.select(line).write.mode(mode).text(path)
