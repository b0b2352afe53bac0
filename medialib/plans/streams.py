"""Queries that run their inputs through Structured Streaming to the end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rules, similarity
from ..sources.staging import shared_dir
from ..streaming import jobs
from .query import query
from .similarity import COPIES, SIMILAR, UNCHANGED
from .tagging import CLASSIFY


def folder(v) -> str:
    """A new folder that driver and executors share."""
    return shared_dir(v.spark)


def staged(v, df, by: str, key: str, batches: int = 4):
    """df as files of a folder, and that folder as a stream of about so many batches, which come in the order of a numeric by.

    A batch's rows are dealt out by key over as many files as the session has
    shuffle partitions. Rows of one key are in one file of a batch, so they keep
    their order wherever the stream cuts the files.
    """
    path, files = f"{folder(v)}/in", int(v.spark.conf.get("spark.sql.shuffle.partitions"))
    if dict(df.dtypes)[by] == "string":
        df.repartition(batches * files, key).write.parquet(path)
    else:
        edges = df.approxQuantile(by, [k / batches for k in range(1, batches)], 0.01)
        low = F.lit(True)
        for edge in [*edges, None]:
            part = low if edge is None else low & (F.col(by) < edge)
            df.where(part).repartition(files, key).write.mode("append").parquet(path)
            low = F.col(by) >= edge if edge is not None else low
    return jobs.read(v.spark, path, df.schema, files)


def last(v, stream, mode: str):
    """The rows that a stream comes to: those of the last batch that each key was in."""
    out = folder(v)

    def keep(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{out}/out")

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return v.spark.read.parquet(f"{out}/out")


@query(f"WITH {CLASSIFY} SELECT DISTINCT pk, coalesce(decision, 'review') AS decision FROM feed LEFT JOIN r USING (pk) WHERE pk <> ''")
def stream_feed(v):
    """New posts are judged by the text rules as they come; those without a text are for review."""
    out, known = folder(v), v.media.withColumn("full_name", F.lit(""))

    def judge(new):
        rows = new.join(known.drop("k"), "pk", "left")
        return new.join(rules.classify(rows, ["myfriend"], ["Bob"], 30.0).select("pk", "decision"), "pk")

    jobs.stream_feed(staged(v, v.feed.select("collection_pk", "pos", "pk", "event_id"), "event_id", "pk"), f"{out}/posts", f"{out}/checkpoint", judge)
    return v.spark.read.parquet(f"{out}/posts").select("pk", "decision")


@query("""SELECT tag, count(*) AS hits FROM (SELECT unnest(string_split(tags, chr(10))) AS tag FROM ai_meta) GROUP BY tag""")
def stream_candidates(v):
    tags = v.ai_meta.select("k", F.explode(F.split("tags", "\n")).alias("tag"))
    return last(v, jobs.stream_candidates(staged(v, tags, "k", "tag")), "update").groupBy("tag").agg(F.max("hits").alias("hits"))


@query("""SELECT pk, count(*) FILTER (event = 'fail' AND seq > coalesce(r, -1)) AS attempts FROM failure_log
          LEFT JOIN (SELECT pk, max(seq) AS r FROM failure_log WHERE event <> 'fail' GROUP BY pk) USING (pk) GROUP BY pk""")
def stream_failures(v):
    rows = last(v, jobs.stream_failures(staged(v, v.failure_log, "seq", "pk")), "update")
    return rows.groupBy("pk").agg(F.max_by("attempts", "batch").alias("attempts"))


@query(f"{SIMILAR.replace(COPIES, UNCHANGED)} SELECT * FROM r")
def stream_dupes(v):
    """Copies of all posts, searched a batch at a time."""
    prints = similarity.fingerprints(v.embeddings)
    known = prints.select(F.col("media_pk").alias("pk"), "hash")
    asked = prints.select(F.concat(F.lit("1"), "media_pk").alias("pk"), "hash")
    out = folder(v)
    jobs.stream_dupes(staged(v, asked, "pk", "pk"), known, f"{out}/found", f"{out}/checkpoint")
    return v.spark.read.parquet(f"{out}/found").select("pk", "known_pk", "distance", "hits")
