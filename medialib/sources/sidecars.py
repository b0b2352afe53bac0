"""Sidecar records: what is known of a post, as JSON beside its files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "pk string, code string, url string, media_type int, product_type string, taken_at string, author struct<username string, full_name string, pk string>, caption string, "
    "like_count long, view_count long, play_count long, comment_count long, video_duration double, music struct<title string, artist string>, collections array<string>"
)


def records(posts: DataFrame, collections: DataFrame) -> DataFrame:
    """One record a post, in the columns of SCHEMA; what posts lack is null, texts and collections (media_pk, collections) are empty.

    music is null without a title and an artist. Posts with equal pk have a record each.
    """
    have = set(posts.columns)
    raw = lambda name, kind: (F.col(name) if name in have else F.lit(None)).cast(kind)
    some = lambda name: F.coalesce(raw(name, "string"), F.lit(""))
    rows = posts.join(collections.select(F.col("media_pk").alias("pk"), F.col("collections").alias("_collections")), "pk", "left")
    track = F.struct(raw("music_title", "string").alias("title"), raw("music_artist", "string").alias("artist"))
    return rows.select(
        some("pk").alias("pk"), some("code").alias("code"), some("url").alias("url"), F.coalesce(raw("media_type", "int"), F.lit(0)).alias("media_type"),
        some("product_type").alias("product_type"), F.date_format(raw("taken_at", "timestamp"), "yyyy-MM-dd'T'HH:mm:ss").alias("taken_at"),
        F.struct(raw("username", "string").alias("username"), raw("full_name", "string").alias("full_name"), raw("user_pk", "string").alias("pk")).alias("author"), some("caption").alias("caption"),
        *[raw(c, "long").alias(c) for c in ("like_count", "view_count", "play_count", "comment_count")], raw("duration", "double").alias("video_duration"),
        F.when(track["title"].isNotNull() | track["artist"].isNotNull(), track).alias("music"), F.coalesce("_collections", F.array().cast("array<string>")).alias("collections"),
    )


def write(posts: DataFrame, collections: DataFrame, path: str) -> None:
    """The records as JSON lines in a folder; nulls are written, so that each has all its keys."""
    records(posts, collections).write.option("ignoreNullFields", False).json(path)


def _parsed(texts: DataFrame, *columns) -> DataFrame:
    """The records in texts (value); a text that isn't one has no row."""
    record = F.from_json("value", f"{SCHEMA}, _broken string", {"columnNameOfCorruptRecord": "_broken"})
    return texts.select(record.alias("r"), *columns).where("r is not null and r._broken is null").select("r.*", *columns).drop("_broken")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of JSON lines; what isn't a record is left out."""
    return _parsed(spark.read.text(path))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """A record for each JSON file of a folder, over several lines or not, with stem, its file's name; broken files are left out.

    Without a pk the stem stands for it.
    """
    files = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True)
    stem = F.regexp_replace(F.url_decode(F.col("_metadata.file_name")), r"\.json$", "")
    rows = _parsed(files.select("value", stem.alias("stem")), "stem")
    return rows.withColumn("pk", F.coalesce(F.nullif("pk", F.lit("")), "stem"))
