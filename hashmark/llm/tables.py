"""Tables that the operators write between steps, in the folder the cluster shares."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

import hashmark
from hashmark.session import scratch_path

#: ``[\x20\x09-\x0D]``: what separates words.
BLANKS = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """The frame as a table in the shared folder: computed once, there after an executor is lost.

    The shuffle files of the job are of no further use and go when it ends, so that a chain of such steps needs the disk of
    its largest step.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def word_array(text: Column) -> Column:
    """Words of a text, in order; none for NULL and blank texts."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), "")


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each context, as they may not have it installed."""
    context = spark.sparkContext
    if getattr(context, "hashmark_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(hashmark.__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-"), "hashmark.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, files in os.walk(top):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(top)))
    context.addPyFile(archive)
    context.hashmark_shipped = True


def arrow_map(df: DataFrame, run: Callable, schema: StructType | str) -> DataFrame:
    """``mapInArrow`` with this package at hand in the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)
