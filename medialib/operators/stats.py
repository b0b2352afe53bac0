"""What the jobs of the library come to: one row of counters from the manifest of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def _counted(**conditions) -> list:
    return [F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in conditions.items()]


def refresh_stats(plan: DataFrame) -> DataFrame:
    """seen, renamed, tagged, skipped, failed of a plan of names and tags (path, target, tagged, failed).

    A failed file is neither renamed nor skipped nor tagged; a null target is as its path. An empty plan gives zeros.
    """
    moved, failed = F.coalesce(F.col("target") != F.col("path"), F.lit(False)), F.coalesce("failed", F.lit(False))
    return plan.agg(F.count(F.lit(1)).alias("seen"), *_counted(renamed=moved & ~failed, tagged=F.col("tagged") & ~failed, skipped=~moved & ~failed, failed=failed))


def push_stats(files: DataFrame, disk: DataFrame, review: DataFrame, present: DataFrame, refused: DataFrame) -> DataFrame:
    """sent, already, missing, failed of a push of files (media_pk, path) to the library.

    already counts posts that it has (present: pk, present); the files of others are missing
    where the disk lacks them, failed in a batch that was refused (media_pk), else sent. Posts
    that wait for review count nowhere.
    """
    waiting = review.where("decided is null").select("media_pk")
    own = files.join(waiting, "media_pk", "left_anti").join(present.select(F.col("pk").alias("media_pk"), "present"), "media_pk", "left").withColumn("present", F.coalesce("present", F.lit(False)))
    there = disk.select("path").distinct().withColumn("_disk", F.lit(True))
    bad = refused.select("media_pk").distinct().withColumn("_bad", F.lit(True))
    new = own.where("not present").join(there, "path", "left").join(bad, "media_pk", "left")
    on_disk, failed = F.col("_disk").isNotNull(), F.col("_bad").isNotNull()
    counts = new.agg(*_counted(sent=on_disk & ~failed, missing=~on_disk, failed=on_disk & failed))
    return counts.join(own.where("present").agg(F.countDistinct("media_pk").alias("already")))  # one row each


def normalize_stats(rows: DataFrame, changes: DataFrame, items: DataFrame) -> DataFrame:
    """rows, changed, updated, missing: all described rows, those whose tags change, and how many items (id) these have and lack.

    changes: id, item_id, a row for each item of a changed row, one with a null or an unknown item for a row that has none.
    """
    found = changes.join(items.select(F.col("id").alias("item_id")).distinct().withColumn("_there", F.lit(True)), "item_id", "left")
    there = F.col("_there").isNotNull()
    counts = found.agg(F.countDistinct("id").alias("changed"), *_counted(updated=there, missing=~there))
    return rows.agg(F.count(F.lit(1)).alias("rows")).join(counts)  # one row each


def cleanup_stats(files: DataFrame, disk: DataFrame, refused: DataFrame) -> DataFrame:
    """posts, files, bytes, missing, failed of the removal of tracked files (media_pk, path): bytes of those removed, by the disk (path, size)."""
    bad = refused.select("path").distinct().withColumn("_bad", F.lit(True))
    rows = files.join(disk.select("path", "size", F.lit(True).alias("_disk")), "path", "left").join(bad, "path", "left")
    there, failed = F.col("_disk").isNotNull(), F.col("_bad").isNotNull()
    removed = F.coalesce(F.sum(F.when(there & ~failed, F.col("size"))), F.lit(0)).alias("bytes")
    return rows.agg(F.countDistinct("media_pk").alias("posts"), removed, *_counted(files=there & ~failed, missing=~there, failed=there & failed))


RUN = ("scanned", "downloaded", "files", "bytes", "skipped", "failed", "added", "filtered", "to_review")


def run_counters(manifest: DataFrame, path: str) -> DataFrame:
    """Writes a run's manifest and gives its counters: a row, in the columns of RUN, counted while the job writes.

    manifest: pk, outcome (downloaded, skipped, filtered, failed), files, bytes,
    added, held of each post that the run has scanned. filtered are those that a
    rule or a repost's mark kept out; files and bytes are those of downloads.
    """
    is_ = lambda name: F.col("outcome") == name
    total = lambda name: F.coalesce(F.sum(F.when(is_("downloaded"), F.col(name))), F.lit(0)).cast("long").alias(name)
    seen = Observation()
    manifest.observe(
        seen, F.count(F.lit(1)).alias("scanned"), total("files"), total("bytes"),
        *_counted(downloaded=is_("downloaded"), skipped=is_("skipped"), failed=is_("failed"), filtered=is_("filtered"), added=F.col("added"), to_review=F.col("held")),
    ).write.parquet(path)
    return manifest.sparkSession.createDataFrame([tuple(seen.get[c] for c in RUN)], ", ".join(f"{c} long" for c in RUN))
