"""Loops and orders over whole tables: lineage is cut in the folder that the cluster shares, and positions and running
sums come from parts and their totals, so that no task holds a whole table."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset and all
    runs on one machine."""
    sc = spark.sparkContext
    found, named = sc._jsc.sc().getCheckpointDir(), spark.conf.get("spark.checkpoint.dir", None)
    if not named and not found.isDefined() and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not found.isDefined():
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="loomgraph-"))
    return named or sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of a table through the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def free(spark: SparkSession) -> None:
    """Shuffle files of finished steps, and checkpoints where Spark cleans them, stay until the driver collects its
    garbage; it does so now. What is still referred to stays."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def numbered(df: DataFrame, key: str, name: str) -> DataFrame:
    """df's distinct values of `key`, with their positions in its order, from 0."""
    dealt = df.select(key).distinct().repartitionByRange(key).sortWithinPartitions(key)
    place = F.monotonically_increasing_id()
    fixed = checkpoint(dealt.select(key, F.shiftright(place, 33).alias("_part"), place.bitwiseAND((1 << 33) - 1).alias("_place")))
    sizes = fixed.groupBy("_part").count()  # one row for each partition
    before = sizes.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))
    return fixed.join(before, "_part").select(key, (F.col("_before") + F.col("_place")).cast("long").alias(name))


def running_sum(df: DataFrame, order: str, value: str, name: str, bucket: int = 10_000) -> DataFrame:
    """df with the sum of `value` up to each row in the order of the whole number `order`, which is unique."""
    cut = df.withColumn("_bucket", F.floor(F.col(order) / bucket))
    totals = cut.groupBy("_bucket").agg(F.sum(value).alias("_total"))
    before = totals.select("_bucket", (F.sum("_total").over(Window.orderBy("_bucket")) - F.col("_total")).alias("_before"))
    own = F.sum(value).over(Window.partitionBy("_bucket").orderBy(order))
    return cut.withColumn("_own", own).join(before, "_bucket").withColumn(name, F.col("_before") + F.col("_own")).drop("_bucket", "_own", "_before")
