"""Queries on the order of feeds, runs, failures and frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import feed
from .query import query


#: The feeds of a run in their order, and how many downloads it stops at.
ORDER, MOST = ["liked", "saved", "shelf"], 300


def feeds(v):
    """The feeds with what processing their posts comes to; a third one has every third post of both."""
    shelf = v.feed.where("event_id % 3 = 0").select(F.lit("shelf").alias("collection_pk"), (F.col("pos") * 2 + (F.col("collection_pk") == "saved").cast("int")).alias("pos"), "pk", "event_id")
    outcome = F.when(F.col("event_id") % 10 == 3, "skipped").when(F.col("event_id") % 10 == 7, "failed").otherwise("downloaded")
    return v.feed.select("collection_pk", "pos", "pk", "event_id").unionByName(shelf).withColumn("outcome", outcome)


def walk(v):
    known = v.media.where("k % 3 <> 1").select("pk")
    cursor = v.feed.where("collection_pk = 'liked' and pos = 700").select("collection_pk", F.col("pk").alias("cursor"))
    order = v.spark.createDataFrame(list(zip(ORDER, range(len(ORDER)))), "collection_pk string, place int")
    return feed.feed_walk(feeds(v), known, cursor, order=order, max_items=MOST)


def _walk_sql(no: int) -> str:
    """CTEs of the walk of one feed, up to w<no>: the ones before it are walked to their ends."""
    name = ORDER[no]
    earlier = " UNION ALL ".join(f"SELECT pk, new, outcome FROM w{k}" for k in range(no))
    seen = f" OR b.pk IN (SELECT pk FROM ({earlier}) WHERE new AND outcome <> 'failed')" if no else ""
    got = f"(SELECT count(*) FROM ({earlier}) WHERE new AND outcome = 'downloaded')" if no else "0"
    stop = "pk = (SELECT min(cursor) FROM c) OR seen > CASE WHEN EXISTS (SELECT 1 FROM c) THEN 1000 ELSE 50 END" if name == "liked" else "false"
    return f"""r{no} AS (SELECT b.*, CASE WHEN pk = '' THEN NULL ELSE base OR coalesce(own < pos, false){seen} END AS known FROM b WHERE collection_pk = '{name}'),
s{no} AS (SELECT *, row_number() OVER (ORDER BY pos) AS seen, count(*) FILTER (NOT known) OVER (ORDER BY pos) AS island, {got} + count(*) FILTER (NOT known AND outcome = 'downloaded') OVER (ORDER BY pos) AS got FROM r{no}),
t{no} AS (SELECT *, count(*) FILTER (known) OVER (PARTITION BY island ORDER BY pos) AS streak, coalesce({stop}, false) AS stop FROM s{no}),
e{no} AS (SELECT min(pos) FILTER (stop) AS b, min(pos) FILTER ((known AND streak >= 40) OR (NOT known AND outcome <> 'skipped' AND got >= {MOST})) AS a FROM t{no}),
w{no} AS (SELECT collection_pk, pos, pk, coalesce(NOT known, false) AS new, outcome FROM t{no}, e{no} WHERE (b IS NULL OR pos < b) AND (a IS NULL OR pos <= a))"""


WALK = f"""src AS (SELECT collection_pk, pos, pk, event_id FROM feed UNION ALL SELECT 'shelf', pos * 2 + (collection_pk = 'saved')::INT, pk, event_id FROM feed WHERE event_id % 3 = 0),
o AS (SELECT *, CASE event_id % 10 WHEN 3 THEN 'skipped' WHEN 7 THEN 'failed' ELSE 'downloaded' END AS outcome FROM src),
b AS (SELECT o.*, coalesce(m.k % 3 <> 1, false) AS base, min(pos) FILTER (outcome <> 'failed') OVER (PARTITION BY collection_pk, o.pk) AS own FROM o LEFT JOIN media m ON m.pk = o.pk),
c AS (SELECT pk AS cursor FROM feed WHERE collection_pk = 'liked' AND pos = 700),
{", ".join(_walk_sql(no) for no in range(len(ORDER)))}, w AS ({" UNION ALL ".join(f"SELECT collection_pk, pos, pk, new FROM w{no}" for no in range(len(ORDER)))})"""


@query(f"WITH {WALK} SELECT * FROM w")
def feed_walk(v):
    return walk(v).withColumn("pos", F.col("pos").cast("long"))


@query(f"WITH {WALK} SELECT collection_pk, arg_min(pk, pos) AS cursor FROM w WHERE pk <> '' GROUP BY collection_pk")
def liked_cursor(v):
    return feed.liked_cursor(walk(v))


@query("""SELECT pk, coalesce(n, 0) AS attempts, coalesce(n, 0) >= 3 AND NOT done AS gave_up, coalesce(e, '') AS last_error FROM (SELECT pk, bool_or(event = 'success') AS done FROM failure_log GROUP BY pk) LEFT JOIN (
            SELECT pk, count(*) AS n, arg_max(error, seq) AS e FROM failure_log f WHERE event = 'fail' AND seq > coalesce((SELECT max(seq) FROM failure_log g WHERE g.pk = f.pk AND event <> 'fail'), -1) GROUP BY pk) USING (pk)""")
def failure_lifecycle(v):
    return feed.failure_lifecycle(v.failure_log)


@query("""WITH RECURSIVE o AS (SELECT pk, event, row_number() OVER (PARTITION BY pk ORDER BY seq) AS n FROM failure_log),
g AS (SELECT pk, 'pending' AS status, 0 AS attempts, 0::BIGINT AS n FROM (SELECT DISTINCT pk FROM failure_log) UNION ALL
      SELECT g.pk, CASE WHEN event = 'success' THEN 'done' WHEN event = 'retry' AND status = 'gave_up' THEN 'pending' WHEN event = 'fail' AND status NOT IN ('done', 'archived') THEN CASE WHEN attempts + 1 >= 3 THEN 'gave_up' ELSE 'failed' END ELSE status END,
             CASE WHEN event = 'fail' THEN attempts + 1 ELSE 0 END, o.n FROM g JOIN o ON o.pk = g.pk AND o.n = g.n + 1)
SELECT pk, arg_max(status, n) AS status FROM g GROUP BY pk""")
def status_lifecycle(v):
    return feed.status_lifecycle(v.failure_log)


CUTS = """d AS (SELECT media_pk, frame_no, luma, list_transform(embedding, lambda x: abs(x)::DOUBLE) AS h FROM frame_features),
l AS (SELECT *, lag(h) OVER (PARTITION BY media_pk ORDER BY frame_no) AS b FROM d),
f AS (SELECT media_pk, frame_no, luma, CASE WHEN b IS NOT NULL THEN list_sum(list_transform(list_zip(h, b), lambda z: abs(z[1] - z[2]))) END AS diff FROM l),
m AS (SELECT media_pk, median(diff) AS mid FROM f GROUP BY media_pk),
a AS (SELECT media_pk, mid, median(abs(diff - mid)) AS mad FROM f JOIN m USING (media_pk) GROUP BY media_pk, mid),
x AS (SELECT media_pk, frame_no, luma, diff, coalesce(diff > mid + 4 * CASE WHEN mad = 0 THEN 1e-6 ELSE mad END AND diff > 0.3, false) AS cut FROM f JOIN a USING (media_pk))"""


def frames(v):
    return v.frame_features.select("media_pk", F.col("frame_no").cast("long").alias("frame_no"), "luma", F.transform("embedding", lambda x: F.abs(x).cast("double")).alias("hist"))


@query(f"WITH {CUTS} SELECT media_pk, frame_no, round(diff, 6) AS diff, cut FROM x")
def scene_cuts(v):
    return feed.scene_cuts(frames(v)).select("media_pk", "frame_no", F.round("diff", 6).alias("diff"), "cut")


@query(f"""WITH {CUTS}, s AS (SELECT *, sum(cut::INT) OVER (PARTITION BY media_pk ORDER BY frame_no) AS scene FROM x),
g AS (SELECT media_pk, scene, list(frame_no ORDER BY frame_no) AS f FROM s WHERE luma >= 14 GROUP BY ALL),
o AS (SELECT media_pk, scene, len(f) AS n, 0 AS step, f[floor(len(f) * 0.5)::INT + 1] AS frame_no FROM g UNION ALL SELECT media_pk, scene, len(f), 1, f[floor(len(f) * 0.25)::INT + 1] FROM g WHERE len(f) >= 3
      UNION ALL SELECT media_pk, scene, len(f), 2, f[floor(len(f) * 0.75)::INT + 1] FROM g WHERE len(f) >= 3),
r AS (SELECT *, row_number() OVER (PARTITION BY media_pk, frame_no ORDER BY step > 0, n DESC, scene, step) AS q FROM o),
z AS (SELECT media_pk, frame_no, row_number() OVER (PARTITION BY media_pk ORDER BY step > 0, n DESC, scene, step) AS p FROM r WHERE q = 1)
SELECT media_pk, frame_no FROM z WHERE p <= 6""")
def scene_frames(v):
    return feed.scene_frames(feed.scene_cuts(frames(v)))


@query("SELECT media_pk, frame_no FROM frame_features WHERE luma < 14")
def dark_frames(v):
    return v.frame_features.where("luma < 14").select("media_pk", F.col("frame_no").cast("long").alias("frame_no"))


@query("""SELECT media_pk, frame_no FROM frame_features JOIN (SELECT media_pk, count(*) AS n FROM frame_features GROUP BY media_pk) USING (media_pk)
          WHERE n >= 12 AND (frame_no - 1) % greatest(1, n // 240) = 0 AND (n <= 30 OR (frame_no - 1 >= floor(n * 0.04) AND frame_no - 1 < n - floor(n * 0.04)))""")
def scene_samples(v):
    n = v.frame_features.groupBy("media_pk").agg(F.count(F.lit(1)).alias("n")).where("n >= 12")
    at, edge = F.col("frame_no") - 1, F.floor(F.col("n") * 0.04)
    rows = v.frame_features.join(n, "media_pk").where(at % F.greatest(F.lit(1), F.floor(F.col("n") / 240)) == 0)
    return rows.where((F.col("n") <= 30) | ((at >= edge) & (at < F.col("n") - edge))).select("media_pk", F.col("frame_no").cast("long").alias("frame_no"))
