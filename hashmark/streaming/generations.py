"""Change tables in generations: batches as they come, folded into current rows from time to time.

A table has folders ``batch=<id>`` and ``fold=<id>``.  A fold holds the current rows after that batch and is complete once
Spark has marked it as such; readers take the newest complete fold and the batches after it.  A fold is a function of batches
and an earlier fold that are all still there when it is made, so a replayed batch makes the same one.  What the last but one
fold has made superfluous goes when the next is complete; readers of the newest fold never lose a file.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def _folders(spark: SparkSession, path: str, kind: str) -> dict[int, object]:
    """Complete folders of a kind by number, listed through the file system that the path names."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(top):
        return {}
    found = {}
    for status in system.listStatus(top):
        name = status.getPath().getName()
        if name.startswith(f"{kind}=") and system.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            found[int(name.split("=", 1)[1])] = status.getPath()
    return found


def newest_generation(spark: SparkSession, path: str, schema: T.StructType | None = None, upto: int | None = None) -> DataFrame:
    """The newest complete fold (at most ``upto``) and the batches after it, with the number of the batch as ``batch``."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    batches, folds = _folders(spark, path, "batch"), _folders(spark, path, "fold")
    last = max((n for n in folds if upto is None or n <= upto), default=None)
    chosen = [batches[n].toString() for n in sorted(batches) if (last is None or n > last) and (upto is None or n <= upto)]
    parts = []
    if last is not None:
        parts.append(reader.parquet(folds[last].toString()).withColumn("batch", F.lit(last).cast("long")))
    if chosen:
        parts.append(reader.option("basePath", path).parquet(*chosen).withColumn("batch", F.col("batch").cast("long")))
    if not parts:
        raise FileNotFoundError(f"no complete batch in {path}")
    return reduce(DataFrame.unionByName, parts)


def start_change_table(
    updates: DataFrame, path: str, checkpoint: str, trigger: dict, fold: Callable[[DataFrame], DataFrame], every: int
) -> StreamingQuery:
    """Write each batch of an update-mode stream; after ``every`` batches (0: never) fold them by ``fold``."""

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        if every and (batch_id + 1) % every == 0:
            before = newest_generation(spark, path, upto=batch_id)
            if batch_id not in _folders(spark, path, "fold"):
                fold(before).write.mode("overwrite").parquet(f"{path}/fold={batch_id}")
            _forget(spark, path, batch_id - every)

    query = updates.writeStream.outputMode("update").foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    return query.trigger(**trigger).start()


def _forget(spark: SparkSession, path: str, upto: int) -> None:
    """Remove the batches that the fold ``upto`` contains, and folds before it."""
    system = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if upto not in _folders(spark, path, "fold"):
        return
    gone = [p for n, p in _folders(spark, path, "batch").items() if n <= upto] + [p for n, p in _folders(spark, path, "fold").items() if n < upto]
    for folder in gone:
        system.delete(folder, True)
