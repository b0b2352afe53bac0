"""Projections and predicates of posts and their assets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.wordlists import MARKER, RATE_MARKS, SESSION_MARKS


def post_kind(media_type: Column, product_type: Column, other: str = "post") -> Column:
    """carousel, reel, video or photo; other for the rest ('post' in the table, 'photo' in a feed)."""
    video = F.when(F.coalesce(product_type, F.lit("")).isin("clips", "reel"), "reel").otherwise("video")
    return F.when(media_type == 8, "carousel").when(media_type == 2, video).when(media_type == 1, "photo").otherwise(other)


def tag_mode(path_or_kind: Column) -> Column:
    low = F.lower(path_or_kind)
    return F.when(low.rlike(r"\.(mp4|m4v|mov|webm|mkv|gif)$") | low.isin("reel", "video", "clips"), "video").otherwise("image")


def post_url(code: Column) -> Column:
    return F.when(F.coalesce(code, F.lit("")) == "", "").otherwise(F.concat(F.lit("https://example.test/p/"), code, F.lit("/")))


def url_key(url: Column) -> Column:
    return F.regexp_replace(F.coalesce(url, F.lit("")), "/+$", "")


def explode_assets(posts: DataFrame, videos=True, photos=True, thumbs=False) -> DataFrame:
    """pk, kind, idx, url: a row per asset of posts (pk, media_type, video_url, thumbnail_url, resources).

    Slides of a carousel count from 1; a slide of no type is a photo, one of
    another type is left out; assets without a url are none.
    """
    one = F.struct("media_type", "video_url", "thumbnail_url")
    slides = posts.where("media_type = 8").select("pk", F.posexplode("resources").alias("at", "r")).select("pk", (F.col("at") + 1).cast("long").alias("idx"), "r")
    single = posts.where("coalesce(media_type, 0) <> 8").select("pk", F.lit(None).cast("long").alias("idx"), one.alias("r"))
    kind = F.coalesce(F.col("r.media_type"), F.lit(1))
    both = slides.unionByName(single).withColumn("t", F.when(F.col("idx").isNull() & ~kind.isin(1, 2), 1).otherwise(kind))
    rows = both.select(
        "pk", "idx",
        F.explode(F.array(
            F.struct(F.lit("video").alias("kind"), F.when((F.col("t") == 2) & F.lit(videos), F.col("r.video_url")).alias("url")),
            F.struct(F.lit("thumb").alias("kind"), F.when((F.col("t") == 2) & F.lit(videos and thumbs), F.col("r.thumbnail_url")).alias("url")),
            F.struct(F.lit("photo").alias("kind"), F.when((F.col("t") == 1) & F.lit(photos), F.col("r.thumbnail_url")).alias("url")),
        )).alias("a"),
    )
    return rows.where("coalesce(a.url, '') <> ''").select("pk", "idx", "a.kind", "a.url")


def wants_type(media_type: Column, videos: bool, photos: bool) -> Column:
    return F.when(media_type == 8, F.lit(videos or photos)).when(media_type == 2, F.lit(videos)).otherwise(F.lit(photos))


def pick_collections(collections: DataFrame, named: list[str] | None = None, all_saved=False, liked=False, everything=True, enabled: list[str] = ()) -> DataFrame:
    """The named collections; else each by its own switch: all_saved and liked for the two pseudo-collections, and for the others everything, or being among the enabled."""
    if named:
        return collections.where(F.col("pk").isin([str(x) for x in named]))
    return collections.where(F.when(F.col("pk") == "all_saved", all_saved).when(F.col("pk") == "liked", liked).otherwise(F.lit(everything) | F.col("pk").isin([str(x) for x in enabled])))


def error_class(error: Column) -> Column:
    low = F.lower(F.coalesce(error, F.lit("")))

    def any_of(marks: list[str]) -> Column:
        out = F.lit(False)
        for mark in marks:
            out = out | low.contains(mark)
        return out

    return F.when(any_of(RATE_MARKS), "rate_limited").when(any_of(SESSION_MARKS), "session_dead").otherwise("other")


def described(annotation: Column) -> Column:
    note = F.coalesce(annotation, F.lit(""))
    return note.contains("Visual summary:") | note.contains("Опис:")


def has_text(description: Column, summary: Column, tags: Column) -> Column:
    some = F.coalesce(F.exists(tags, lambda t: ~t.isin("", MARKER)), F.lit(False))
    return (F.trim(F.coalesce(description, F.lit(""))) != "") | (F.trim(F.coalesce(summary, F.lit(""))) != "") | some


def known_posts(media: DataFrame, files: DataFrame, disk: DataFrame) -> DataFrame:
    """pk, known: archived and given-up posts; done ones with files of which all are on disk."""
    there = files_exist(files.where("kind in ('video', 'photo')"), disk)
    return (
        media.select("pk", "status").join(there.withColumnRenamed("media_pk", "pk"), "pk", "left")
        .select("pk", F.when(F.col("status").isin("archived", "gave_up"), True).when(F.col("status") == "done", F.coalesce("all_there", F.lit(False))).otherwise(False).alias("known"))
    )


def files_exist(files: DataFrame, disk: DataFrame) -> DataFrame:
    """media_pk, n_files, all_there."""
    return (
        files.join(disk.select("path", F.lit(True).alias("there")), "path", "left").groupBy("media_pk")
        .agg(F.count(F.lit(1)).alias("n_files"), F.every(F.coalesce("there", F.lit(False))).alias("all_there"))
    )
