"""Tables of a folder, as batches or as a stream, and the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int = 1000) -> DataFrame:
    """The table as a stream: the files there are first, then those that come; a batch admits so many files at most."""
    path = f"{sf_dir}/{name}.parque[t]"  # as a pattern, it may be a folder or one file; a plain path must be a folder
    return spark.readStream.schema(table(spark, sf_dir, name).schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, which spark.checkpoint.dir names; where all run in one process, it may be one of our own."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: evaluated once, and its lineage ends there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str, order: list[str], groups: list[str] | None = None) -> DataFrame:
    """df with `name`, each row's number from 0 in the order of the columns, within groups if any are named.

    Rows are ranged and numbered in their range, and ranges are counted before
    them, so that no task holds a large group. Ties stand by a hash of the whole
    row, so that many of them are in several ranges; equal rows are in one.
    """
    groups = groups or []
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tied = df.withColumn("__tie", F.xxhash64(*df.columns))
    ranged = saved(tied.repartitionByRange(n, *groups, *order, "__tie").withColumn("__part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("__part", *groups).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*groups).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range at most
    starts = counts.select("__part", *[F.col(g).alias(f"__{g}") for g in groups], F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inner = F.row_number().over(Window.partitionBy("__part", *groups).orderBy(*order, "__tie"))
    same = reduce(and_, [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in groups], F.col("p.__part") == F.col("s.__part"))
    joined = ranged.withColumn("__rn", inner).alias("p").join(starts.alias("s"), same)
    return joined.select(*[F.col(f"p.`{c}`") for c in df.columns], (F.col("__before") + F.col("__rn") - 1).alias(name))
