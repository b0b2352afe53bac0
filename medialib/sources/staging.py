"""Tables between steps, in the folder that driver and executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """A new path in spark.checkpoint.dir; where that is unset, a folder of our own, which only one machine alone can share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir')}/medialib-staged"
    return f"{base.rstrip('/')}/medialib-staged-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def staged(df: DataFrame, within: str = "") -> DataFrame:
    """df written and read back: its lineage ends here, and what is read again is the same rows.

    The shuffle files behind it are of no more use then, so Spark is told to
    remove them. within is a scratch()'s folder, for what goes with that.
    """
    spark = df.sparkSession
    path = f"{within}/{uuid.uuid4().hex}" if within else shared_dir(spark)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder for staged() that is removed at the end of the block; what is lazy may not read from it any more."""
    folder = shared_dir(spark)
    try:
        yield folder
    finally:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
