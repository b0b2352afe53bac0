"""Counts and reports over the library's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import feed, library, stats
from ..operators import tags as tag_ops
from ..sources import readers
from ..sources.staging import shared_dir
from .library import PRESENT
from .query import query
from .tagging import CHANGED, ITEMS, NORMAL, items_of_posts, renormal


def n_rows():
    """The number of rows."""
    return F.count(F.lit(1))


@query("SELECT count(*) AS posts, (SELECT count(*) FROM files) AS files, (SELECT coalesce(sum(bytes), 0)::BIGINT FROM files) AS bytes FROM media WHERE status IN ('done', 'archived')")
def totals(v):
    own = v.media.where("status in ('done', 'archived')").agg(n_rows().alias("posts"))
    return own.join(v.files.agg(n_rows().alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")))  # one row each


@query("""SELECT c.pk, media_count, count(m.pk) FILTER (status IN ('done', 'archived')) AS done FROM collections c
          LEFT JOIN membership b ON b.collection_pk = c.pk LEFT JOIN media m ON m.pk = b.media_pk GROUP BY c.pk, media_count""")
def collection_progress(v):
    done = v.membership.join(v.media.where("status in ('done', 'archived')").select(F.col("pk").alias("media_pk")), "media_pk").groupBy(F.col("collection_pk").alias("pk")).agg(n_rows().alias("done"))
    return v.collections.join(done, "pk", "left").select("pk", "media_count", F.coalesce("done", F.lit(0)).alias("done"))


@query("""SELECT category, t AS total, a AS agreed, (100 * a // t)::BIGINT AS percent FROM (
            SELECT coalesce(CASE WHEN category = '' THEN '?' ELSE category END, 'all') AS category, count(*) AS t, count(*) FILTER ((proposed = 'download') = (decided = 'kept')) AS a
            FROM agreement GROUP BY ROLLUP (CASE WHEN category = '' THEN '?' ELSE category END))""")
def agreement_stats(v):
    rows = v.agreement.withColumn("category", F.coalesce(F.nullif("category", F.lit("")), F.lit("?")))
    same = (F.col("proposed") == "download") == (F.col("decided") == "kept")
    out = rows.rollup("category").agg(n_rows().alias("total"), F.count_if(same).alias("agreed"))
    return out.select(F.coalesce("category", F.lit("all")).alias("category"), "total", "agreed", F.floor(100 * F.col("agreed") / F.col("total")).cast("long").alias("percent"))


FREQ = "SELECT tag, count(*) AS n FROM (SELECT unnest(list_distinct(list_filter(string_split(tags, chr(10)), lambda t: t <> 'autotagged'))) AS tag FROM ai_meta) GROUP BY tag"


@query(FREQ)
def tag_frequency(v):
    return tag_ops.tag_frequency(v.ai_meta)


@query("SELECT media_pk, count(*) AS copies FROM imports GROUP BY media_pk HAVING count(*) > 1")
def eagle_duplicates(v):
    return v.imports.groupBy("media_pk").agg(n_rows().alias("copies")).where("copies > 1")


#: The library's folders: the app's with one below it, a folder below that, and another's.
FOLDERS = [("fld0", " Saved POSTS ", None), ("fld1", "Liked", "fld0"), ("fld2", "Older", "fld1"), ("fld3", "saved posts", "fld4"), ("fld4", "Other", None)]


@query("""SELECT id, key, name, ((row_number() OVER (ORDER BY key, name, id) - 1) // 50)::BIGINT AS chunk FROM (
            SELECT *, row_number() OVER (PARTITION BY key, name ORDER BY modification_time, id) AS n FROM (SELECT *, regexp_replace(url, '/+$', '') AS key FROM library_items WHERE list_has_any(string_split(folders, '|'), ['fld0', 'fld1']))
            WHERE key <> '') WHERE n > 1""")
def library_duplicates(v):
    """Later items of one (url, name) in the app's folder and those right below it; the oldest stays."""
    tree = readers.scan_folders(v.spark.createDataFrame(FOLDERS, "id string, name string, parent string"))
    items = v.library_items.withColumn("folders", F.split("folders", r"\|"))
    return library.duplicates(items, readers.app_folders(tree, "Saved posts"))


@query("""SELECT tag, hits FROM (SELECT unnest(string_split(tags, chr(10))) AS tag, count(*) AS hits, max(k) AS last_seen FROM ai_meta GROUP BY 1) WHERE hits >= 5 AND length(tag) % 3 = 2
          ORDER BY hits DESC, last_seen DESC, tag LIMIT 60""")
def candidate_report(v):
    """New candidates of the candidate table, the most and the latest met first."""
    seen = v.ai_meta.select(F.explode(F.split("tags", "\n")).alias("tag"), "k").groupBy("tag").agg(n_rows().alias("hits"), F.max("k").alias("last_seen"))
    n = F.length("tag") % 3
    table = seen.withColumn("state", F.when(n == 0, "added").when(n == 1, "ignored").otherwise("new"))
    return table.where("state = 'new' and hits >= 5").orderBy(F.desc("hits"), F.desc("last_seen"), "tag").limit(60).select("tag", "hits")


@query("SELECT coalesce(source, 'rules') AS source, count(*) AS pending FROM review WHERE decided IS NULL GROUP BY 1")
def review_counts(v):
    return v.review.where("decided is null").groupBy(F.coalesce("source", F.lit("rules")).alias("source")).agg(n_rows().alias("pending"))


@query("""WITH f AS (SELECT media_pk, count(*) AS n, sum(bytes) AS bytes FROM files GROUP BY media_pk)
  SELECT count(*) AS scanned, count(*) FILTER (status = 'done') AS downloaded, coalesce(sum(n) FILTER (status = 'done'), 0)::BIGINT AS files, coalesce(sum(bytes) FILTER (status = 'done'), 0)::BIGINT AS bytes,
    count(*) FILTER (status IN ('pending', 'archived')) AS skipped, count(*) FILTER (status IN ('failed', 'gave_up')) AS failed, count(*) FILTER (pk IN (SELECT media_pk FROM imports)) AS added,
    count(*) FILTER (status = 'skipped') AS filtered, count(*) FILTER (pk IN (SELECT media_pk FROM review WHERE decided IS NULL)) AS to_review
  FROM media LEFT JOIN f ON media_pk = pk WHERE year(first_seen) = 1995""")
def run_stats(v):
    """The counters of a run over the posts first seen in a year, taken while its manifest is written."""
    own = v.files.groupBy(F.col("media_pk").alias("pk")).agg(n_rows().alias("files"), F.sum("bytes").alias("bytes"))
    flag = lambda rows, name: rows.select(F.col("media_pk").alias("pk")).distinct().withColumn(name, F.lit(True))
    outcome = F.when(F.col("status") == "done", "downloaded").when(F.col("status").isin("failed", "gave_up"), "failed").when(F.col("status") == "skipped", "filtered").otherwise("skipped")
    rows = v.media.where(F.year("first_seen") == 1995).select("pk", outcome.alias("outcome")).join(own, "pk", "left").join(flag(v.imports, "added"), "pk", "left").join(flag(v.review.where("decided is null"), "held"), "pk", "left")
    return stats.run_counters(rows, shared_dir(v.spark))


@query("SELECT model, round(avg(seconds) FILTER (ok), 6) AS mean, round(median(seconds) FILTER (ok), 6) AS median, count(*) FILTER (NOT ok) AS failures FROM latencies GROUP BY model")
def model_benchmark(v):
    good = F.when(F.col("ok"), F.col("seconds"))
    return v.latencies.groupBy("model").agg(F.round(F.avg(good), 6).alias("mean"), F.round(F.median(good), 6).alias("median"), F.count_if(~F.col("ok")).alias("failures"))


@query("""SELECT count(*) AS images, count(*) FILTER (c = 1) AS agreed, round(count(*) FILTER (c = 1) / count(*), 6) AS share FROM (
            SELECT image, count(DISTINCT category) AS c FROM latencies GROUP BY image HAVING count(*) = (SELECT count(DISTINCT model) FROM latencies) AND bool_and(ok))""")
def model_agreement(v):
    models = v.latencies.agg(F.countDistinct("model")).first()[0]
    images = v.latencies.groupBy("image").agg(n_rows().alias("n"), F.every("ok").alias("ok"), F.countDistinct("category").alias("c")).where((F.col("n") == models) & F.col("ok"))
    return images.agg(n_rows().alias("images"), F.count_if(F.col("c") == 1).alias("agreed"), F.round(F.count_if(F.col("c") == 1) / F.count(F.lit(1)), 6).alias("share"))


@query("""SELECT count(*) AS done, count(*) FILTER (d.path IS NULL) AS missing, sum(bytes)::BIGINT AS bytes FROM files LEFT JOIN disk_inventory d USING (path)""")
def job_stats(v):
    rows = v.files.join(v.disk_inventory, "path", "left")
    return rows.agg(n_rows().alias("done"), F.count_if(F.col("size").isNull()).alias("missing"), F.sum("bytes").alias("bytes"))


#: Files with the name that they are to have, whether their tags could be written, and whether they failed.
PLAN = "SELECT path, CASE WHEN k % 4 = 0 THEN concat(path, '.new') ELSE path END AS target, k % 6 <> 0 AS tagged, (k + idx) % 31 = 0 AS failed FROM files WHERE kind IN ('video', 'photo')"


@query(f"""SELECT count(*) AS seen, count(*) FILTER (target <> path AND NOT failed) AS renamed, count(*) FILTER (tagged AND NOT failed) AS tagged,
           count(*) FILTER (target = path AND NOT failed) AS skipped, count(*) FILTER (failed) AS failed FROM ({PLAN})""")
def refresh_stats(v):
    files = v.files.where("kind in ('video', 'photo')")
    target = F.when(F.col("k") % 4 == 0, F.concat("path", F.lit(".new"))).otherwise(F.col("path"))
    return stats.refresh_stats(files.select("path", target.alias("target"), (F.col("k") % 6 != 0).alias("tagged"), ((F.col("k") + F.col("idx")) % 31 == 0).alias("failed")))


@query(f"""WITH own AS (SELECT f.media_pk, path, f.k, coalesce(present, false) AS present FROM files f LEFT JOIN ({PRESENT}) p ON p.pk = f.media_pk
           WHERE kind IN ('video', 'photo') AND f.media_pk NOT IN (SELECT media_pk FROM review WHERE decided IS NULL))
  SELECT count(*) FILTER (NOT present AND d.path IS NOT NULL AND k % 29 <> 0) AS sent, count(DISTINCT media_pk) FILTER (present) AS already, count(*) FILTER (NOT present AND d.path IS NULL) AS missing,
         count(*) FILTER (NOT present AND d.path IS NOT NULL AND k % 29 = 0) AS failed FROM own LEFT JOIN disk_inventory d USING (path)""")
def push_stats(v):
    present = library.in_library(v.media, library.library_snapshot(v.library_items), v.imports)
    files = v.files.where("kind in ('video', 'photo')").select("media_pk", "path")
    return stats.push_stats(files, v.disk_inventory, v.review, present, v.media.where("k % 29 = 0").select(F.col("pk").alias("media_pk")))


@query(f"""WITH RECURSIVE {NORMAL}, {CHANGED}, {ITEMS}, i AS (SELECT media_pk, count(*) AS items FROM own GROUP BY media_pk)
  SELECT (SELECT count(*) FROM ai_meta) AS rows, count(*) AS changed, coalesce(sum(items), 0)::BIGINT AS updated, count(*) FILTER (items IS NULL) AS missing FROM c LEFT JOIN i USING (media_pk)""")
def normalize_stats(v):
    items = items_of_posts(v).select("media_pk", F.col("id").alias("item_id"))
    return stats.normalize_stats(v.ai_meta, renormal(v).select("id", "media_pk").join(items, "media_pk", "left"), v.library_items)


@query("""SELECT count(DISTINCT media_pk) AS posts, count(*) FILTER (d.path IS NOT NULL AND f.k % 37 <> 0) AS files, (coalesce(sum(size) FILTER (f.k % 37 <> 0), 0))::BIGINT AS bytes,
           count(*) FILTER (d.path IS NULL) AS missing, count(*) FILTER (d.path IS NOT NULL AND f.k % 37 = 0) AS failed FROM files f LEFT JOIN disk_inventory d USING (path)""")
def cleanup_stats(v):
    return stats.cleanup_stats(v.files.select("media_pk", "path"), v.disk_inventory, v.files.where("k % 37 = 0").select("path"))


@query("""SELECT pk, attempts::BIGINT AS attempts, last_error, greatest(0, (SELECT count(*) FROM media WHERE status = 'gave_up') - 10)::BIGINT AS more
          FROM media WHERE status = 'gave_up' ORDER BY first_seen DESC, pk LIMIT 10""")
def account_stats(v):
    """Ten posts that were given up, the newest, and how many more there are."""
    rows = v.media.where("status = 'gave_up'")
    more = rows.agg(F.greatest(n_rows() - 10, F.lit(0)).cast("long").alias("more"))
    shown = rows.orderBy(F.desc("first_seen"), "pk").limit(10).select("pk", F.col("attempts").cast("long").alias("attempts"), "last_error")
    return shown.join(more)  # one row


@query("SELECT count(*) AS rows, count(*) FILTER (description <> '') AS described, (SELECT count(*) FROM files WHERE kind <> 'thumb') AS files FROM ai_meta")
def described_coverage(v):
    own = v.ai_meta.agg(n_rows().alias("rows"), F.count_if(F.col("description") != "").alias("described"))
    return own.join(v.files.where("kind <> 'thumb'").agg(n_rows().alias("files")))  # one row each


@query("""SELECT media_pk, source, verdict FROM review WHERE decided IS NULL ORDER BY verdict = 'skip' DESC, added_at DESC, media_pk LIMIT 60""")
def review_queue(v):
    return v.review.where("decided is null").orderBy(F.expr("verdict = 'skip'").desc(), F.desc("added_at"), "media_pk").limit(60).select("media_pk", "source", "verdict")


@query("SELECT id, strftime(started_at, '%Y-%m-%d %H:%M:%S') AS started_at FROM runs ORDER BY id DESC LIMIT 5")
def last_runs(v):
    return v.runs.orderBy(F.desc("id")).limit(5).select(F.col("id").cast("long").alias("id"), F.date_format("started_at", "yyyy-MM-dd HH:mm:ss").alias("started_at"))


@query("SELECT media_pk, string_agg(path, '|' ORDER BY idx, path) AS paths FROM files WHERE kind IN ('video', 'photo') GROUP BY media_pk")
def media_files(v):
    own = v.files.where("kind in ('video', 'photo')").groupBy("media_pk").agg(F.array_sort(F.collect_list(F.struct("idx", "path")))["path"].alias("paths"))
    return own.withColumn("paths", F.array_join("paths", "|"))


@query("SELECT media_pk, idx::BIGINT AS idx, description FROM ai_meta WHERE description <> '' ORDER BY k DESC, idx DESC LIMIT 3")
def latest_exemplars(v):
    return v.ai_meta.where("description <> ''").orderBy(F.desc("k"), F.desc("idx")).limit(3).select("media_pk", F.col("idx").cast("long").alias("idx"), "description")


@query("""SELECT id, CASE WHEN b IS NULL THEN 0 ELSE greatest(0, 3600 - (floor(epoch(started_at)) - floor(epoch(b)))) END::BIGINT AS wait FROM (
            SELECT id, started_at, max(finished_at) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM runs)""")
def run_gaps(v):
    return feed.run_gaps(v.runs)
