"""Tables in the shared folder, and row numbers over whole tables without a single-task sort."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def shared_dir(spark: SparkSession) -> str:
    """The folder spark.checkpoint.dir names; where that is unset, one of our own if the whole of Spark runs in this process,
    and on a cluster an error: its machines' temporary folders are not one folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (base or f"file://{tempfile.gettempdir()}/sheafline-shared").rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/sheafline/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, *order: Column | str, name: str = "pos") -> DataFrame:
    """df with its 1-based row number in the given order.

    Rows are dealt out by ranges of the order and sorted there; what comes before a range is a sum over one count a range.
    """
    part = f"__{name}_part"
    ranged = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(part, F.spark_partition_id()), "ranges")
    counts = ranged.groupBy(part).agg(F.count("*").alias("__n"))
    ahead = counts.select(part, (F.sum("__n").over(W.partitionBy().orderBy(part)) - F.col("__n")).alias("__ahead"))
    inside = F.row_number().over(W.partitionBy(part).orderBy(*order))
    return ranged.join(F.broadcast(ahead), part).withColumn(name, (F.col("__ahead") + inside).cast("long")).drop(part, "__ahead")
