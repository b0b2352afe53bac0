"""Incremental passes with Structured Streaming; each has a batch twin in the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import similarity

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read(spark: SparkSession, path: str, schema, per_trigger: int | None = None) -> DataFrame:
    """A folder of Parquet files as a stream."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).parquet(path)


class Unseen(StatefulProcessor):
    """The first row by pos of each post in the first batch that has it; later ones add nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if not self.seen.exists():
            first = pd.concat(list(rows)).sort_values("pos").iloc[:1]
            self.seen.update((True,))
            yield first[["pk", "collection_pk", "pos"]]


def stream_feed(feed: DataFrame, target: str, checkpoint: str, judge: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """New posts of a feed (collection_pk, pos, pk) judged and appended to target, each pk once; a batch that is run again writes nothing twice.

    Which posts are known is kept in the stream's own state, so a batch reads
    nothing of target. judge adds columns to the new posts of a batch:
    rules.classify, say, joined by pk.
    """
    feed.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    new = feed.where("pk <> ''").select("pk", "collection_pk", F.col("pos").cast("long").alias("pos")).groupBy("pk")
    new = new.transformWithStateInPandas(Unseen(), "pk string, collection_pk string, pos long", "Append", "none")

    def append(batch: DataFrame, number: int) -> None:
        rows = judge(batch) if judge else batch
        rows.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(target)

    new.writeStream.outputMode("append").foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


class Failures(StatefulProcessor):
    """Attempts of a post since its last success or retry, in the order of seq within each batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "attempts long, error string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        attempts, error = self.state.get() if self.state.exists() else (0, "")
        for row in pd.concat(list(rows)).sort_values("seq").itertuples():
            attempts, error = (attempts + 1, (row.error or "")[:300]) if row.event == "fail" else (0, "")
        self.state.update((attempts, error))
        yield pd.DataFrame({"pk": [key[0]], "attempts": [attempts], "last_error": [error]})


def stream_failures(log: DataFrame) -> DataFrame:
    """pk, attempts, last_error after each batch of a failure log."""
    log.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return log.groupBy("pk").transformWithStateInPandas(Failures(), "pk string, attempts long, last_error string", "Update", "none")


def stream_candidates(tags: DataFrame) -> DataFrame:
    """Running hits of each rejected tag."""
    return tags.groupBy("tag").agg(F.count(F.lit(1)).alias("hits"))


def stream_dupes(prints: DataFrame, known: DataFrame, target: str, checkpoint: str) -> None:
    """New fingerprints against the index of the known ones, which is written once; finds are appended, a batch at a time."""
    index = similarity.index_of(known, write=True)

    def search(batch: DataFrame, number: int) -> None:
        found = similarity.similar_posts(batch, index).withColumn("batch", F.lit(number))
        found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(target)

    prints.writeStream.foreachBatch(search).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
