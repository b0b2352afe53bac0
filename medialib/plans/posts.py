"""Queries on posts: kinds, modes, assets and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.wordlists import RATE_MARKS, SESSION_MARKS
from ..operators import posts
from .query import query

KIND = "CASE WHEN media_type = 8 THEN 'carousel' WHEN media_type = 2 THEN CASE WHEN product_type IN ('clips', 'reel') THEN 'reel' ELSE 'video' END WHEN media_type = 1 THEN 'photo' ELSE '{}' END"


@query(f"SELECT pk, {KIND.format('post')} AS kind, {KIND.format('photo')} AS feed_kind FROM media")
def post_kind(v):
    kind = F.col("media_type"), F.col("product_type")
    return v.media.select("pk", posts.post_kind(*kind).alias("kind"), posts.post_kind(*kind, "photo").alias("feed_kind"))


@query(r"SELECT path, CASE WHEN regexp_matches(lower(path), '\.(mp4|m4v|mov|webm|mkv|gif)$') THEN 'video' ELSE 'image' END AS mode FROM files")
def tag_mode(v):
    return v.files.select("path", posts.tag_mode(F.col("path")).alias("mode"))


def with_resources(v):
    """Posts with urls, and slides of types 1, 2, none and 9 by turns."""
    def one(t, n):
        return F.struct(F.lit(t).cast("int").alias("media_type"), F.concat(F.lit(f"v{n}/"), "pk").alias("video_url"), F.concat(F.lit(f"t{n}/"), "pk").alias("thumbnail_url"))

    return v.media.select("pk", "media_type", F.concat(F.lit("v/"), "pk").alias("video_url"), F.when(F.col("k") % 5 == 0, "").otherwise(F.concat(F.lit("t/"), "pk")).alias("thumbnail_url"), F.array(one(1, 1), one(2, 2), one(None, 3), one(9, 4)).alias("resources"))


@query("""SELECT pk, s AS idx, kind, u || '/' || pk AS url FROM media,
            (VALUES (1, 'photo', 't1'), (2, 'video', 'v2'), (2, 'thumb', 't2'), (3, 'photo', 't3')) AS r(s, kind, u) WHERE media_type = 8
          UNION ALL SELECT pk, NULL, 'video', 'v/' || pk FROM media WHERE media_type = 2
          UNION ALL SELECT pk, NULL, 'thumb', 't/' || pk FROM media WHERE media_type = 2 AND k % 5 <> 0
          UNION ALL SELECT pk, NULL, 'photo', 't/' || pk FROM media WHERE media_type = 1 AND k % 5 <> 0""")
def explode_assets(v):
    return posts.explode_assets(with_resources(v), thumbs=True)


@query("SELECT pk, media_type IN (2, 8) AS wanted FROM media")
def wants_type(v):
    return v.media.select("pk", posts.wants_type(F.col("media_type"), True, False).alias("wanted"))


@query("SELECT pk, 'https://example.test/p/' || code || '/' AS made, regexp_replace(url, '/+$', '') AS key FROM media")
def post_url(v):
    return v.media.select("pk", posts.post_url(F.col("code")).alias("made"), posts.url_key(F.col("url")).alias("key"))


@query("SELECT c.pk, c.name, count(*) AS members FROM collections c JOIN membership m ON m.collection_pk = c.pk WHERE c.pk IN ('col1', 'col3') GROUP BY c.pk, c.name")
def pick_collections(v):
    chosen = posts.pick_collections(v.collections, ["col1", "col3"])
    return v.membership.join(chosen.withColumnRenamed("pk", "collection_pk"), "collection_pk").groupBy(F.col("collection_pk").alias("pk"), "name").agg(F.count(F.lit(1)).alias("members"))


@query("SELECT pk, name FROM collections WHERE pk IN ('col0', 'col2', 'col4')")
def pick_by_switches(v):
    """Each collection by its own switch: the liked one (col0 here) is on, all saved (col1) off, of the others two are enabled."""
    own = F.when(F.col("pk") == "col0", "liked").when(F.col("pk") == "col1", "all_saved").otherwise(F.col("pk"))
    chosen = posts.pick_collections(v.collections.withColumn("pk", own), liked=True, everything=False, enabled=["col2", "col4"])
    return chosen.select(F.when(F.col("pk") == "liked", "col0").otherwise(F.col("pk")).alias("pk"), "name")


@query("""SELECT pk, CASE WHEN status IN ('archived', 'gave_up') THEN true WHEN status = 'done' THEN coalesce(ok, false) ELSE false END AS known
          FROM media LEFT JOIN (SELECT media_pk, bool_and(d.path IS NOT NULL) AS ok FROM files f LEFT JOIN disk_inventory d USING (path) WHERE kind <> 'thumb' GROUP BY media_pk) ON media_pk = pk""")
def is_known(v):
    return posts.known_posts(v.media, v.files, v.disk_inventory)


@query("SELECT media_pk, decided IS NULL AS pending FROM review")
def pending_review_pred(v):
    return v.review.select("media_pk", F.col("decided").isNull().alias("pending"))


def _any(marks):
    return " OR ".join(f"contains(lower(error), '{m}')" for m in marks)


ERROR_CLASS = f"CASE WHEN {_any(RATE_MARKS)} THEN 'rate_limited' WHEN {_any(SESSION_MARKS)} THEN 'session_dead' ELSE 'other' END"


@query(f"SELECT {ERROR_CLASS} AS class, count(*) AS n FROM failure_log GROUP BY 1")
def triage_errors(v):
    return v.failure_log.groupBy(posts.error_class(F.col("error")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT id, contains(annotation, 'Visual summary:') AS described FROM library_items")
def described_already(v):
    return v.library_items.select("id", posts.described(F.col("annotation")).alias("described"))


@query("""SELECT media_pk, idx::BIGINT AS idx, description <> '' OR summary <> '' OR len(list_filter(string_split(tags, chr(10)), lambda t: t NOT IN ('', 'autotagged'))) > 0 AS has_text FROM ai_meta""")
def has_text(v):
    return v.ai_meta.select("media_pk", F.col("idx").cast("long").alias("idx"), posts.has_text(F.col("description"), F.col("summary"), F.split("tags", "\n")).alias("has_text"))


@query(f"SELECT pk, username AS author, {KIND.format('post')} AS kind, coalesce(duration, 0) AS duration, concat(username, '/', code) AS ref FROM media")
def flat_post(v):
    nested = v.media.select("pk", F.struct("username", "code").alias("user"), "media_type", "product_type", "duration")
    return nested.select("pk", F.col("user.username").alias("author"), posts.post_kind(F.col("media_type"), F.col("product_type")).alias("kind"), F.coalesce("duration", F.lit(0.0)).alias("duration"), F.concat_ws("/", "user.username", "user.code").alias("ref"))
