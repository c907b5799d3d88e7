"""What the jobs share: config, command line and tables that may not be there yet."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, empty where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def overwrite(df: DataFrame, path: str, *partitions: str) -> None:
    """Replace the partitions that df has rows of, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def settings(given: dict[str, Any] | None, defaults: dict[str, Any]) -> dict[str, Any]:
    """The defaults with what is given over them; an unknown name is an error."""
    unknown = sorted(set(given or {}) - set(defaults))
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return defaults | (given or {})


def command(run: Callable[..., dict[str, int]], doc: str, paths: tuple[str, ...], config: str, argv: list[str] | None = None) -> int:
    """Parse path arguments and a config file, and run the job in a session of its own."""
    parser = argparse.ArgumentParser(description=doc, formatter_class=argparse.RawDescriptionHelpFormatter)
    for p in paths:
        parser.add_argument(p)
    parser.add_argument("--config", default=config, help="JSON file with the job's settings")
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    with open(args.config) as f:
        given = json.load(f)
    spark = SparkSession.builder.appName(run.__module__).getOrCreate()
    try:
        done = run(spark, *[getattr(args, p) for p in paths], given)
        logging.getLogger("jobs").info("done: %s", done)
    finally:
        spark.stop()
    return 0
