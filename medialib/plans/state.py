"""Queries on the state tables: upserts, deletes and decisions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions.wordlists import CATEGORIES
from ..operators import library, merge, similarity
from ..sources import sidecars
from .query import query


def stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@query("""SELECT count(*) AS recorded, count(d.path) AS existing, coalesce(sum(coalesce(d.size, f.bytes)), 0)::BIGINT AS bytes
          FROM files f LEFT JOIN disk_inventory d USING (path)""")
def scan_disk(v):
    rows = v.files.join(v.disk_inventory, "path", "left")
    return rows.agg(F.count(F.lit(1)).alias("recorded"), F.count("size").alias("existing"), F.coalesce(F.sum(F.coalesce("size", "bytes")), F.lit(0)).alias("bytes"))


def changes(v):
    """Posts seen again: every seventh one, some twice, the later time last."""
    seen = v.media.where("k % 7 = 0").withColumn("n", F.explode(F.when(F.col("k") % 2 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    return seen.select("pk", F.concat("caption", F.lit(" v"), "n").alias("caption"), F.lit("pending").alias("status"), F.col("first_seen").alias("first_seen"), (F.col("k") * 10 + F.col("n")).alias("seq"))


@query("""SELECT pk, CASE WHEN k % 7 = 0 THEN caption || ' v' || (CASE WHEN k % 2 = 0 THEN '2' ELSE '1' END) ELSE caption END AS caption, status,
          strftime(first_seen, '%Y-%m-%d %H:%M:%S') AS first_seen FROM media""")
def upsert_media(v):
    base = v.media.select("pk", "caption", "status", "first_seen")
    return merge.upsert_keep(base, changes(v), ["pk"], ["status", "first_seen"]).withColumn("first_seen", stamp("first_seen"))


@query("""SELECT media_pk, collection_pk, folder_id, CASE WHEN k % 6 = 0 THEN NULL ELSE item_id END AS item_id FROM imports""")
def upsert_replace(v):
    base = v.imports.select("media_pk", "collection_pk", "folder_id", "item_id")
    again = v.imports.where("k % 6 = 0").select("media_pk", "collection_pk", "folder_id", F.col("k").alias("seq"))
    return merge.upsert_replace(base, again, ["media_pk", "collection_pk"])


@query("""SELECT DISTINCT media_pk, idx, hash FROM (
            SELECT (vec_id // 5)::VARCHAR AS media_pk, vec_id % 5 AS idx, h AS hash FROM (SELECT vec_id, {bits}::BIGINT AS h FROM embeddings)
            WHERE bit_count(h) BETWEEN 12 AND 52)""".replace("{bits}", similarity.BITS_SQL))
def insert_fingerprints(v):
    prints = similarity.fingerprints(v.embeddings).where(similarity.informative(F.col("hash")))
    return merge.insert_ignore(prints.where("idx < 2"), prints.unionByName(prints), ["media_pk", "idx", "hash"])


def dropped_tags(v):
    return v.ai_meta.select(F.explode(F.split("tags", "\n")).alias("tag"), F.lit("2024-01-02").alias("seen_at"))


@query(f"""SELECT tag, count(*) * 2 AS hits, '2024-01-01' AS first_seen, '2024-01-02' AS last_seen, 'added' AS state
           FROM (SELECT unnest(string_split(tags, chr(10))) AS tag FROM ai_meta) WHERE tag NOT IN ({', '.join(f"'{c}'" for c in CATEGORIES)}) GROUP BY tag""")
def count_candidates(v):
    base = (
        dropped_tags(v).where(~F.col("tag").isin(CATEGORIES)).groupBy("tag").agg(F.count(F.lit(1)).alias("hits"))
        .select("tag", "hits", F.lit("2024-01-01").alias("first_seen"), F.lit("2024-01-01").alias("last_seen"), F.lit("added").alias("state"))
    )
    return merge.count_candidates(base, dropped_tags(v), CATEGORIES)


@query("""SELECT media_pk, collection_pk, CASE WHEN item_id = '' AND k % 9 = 0 THEN 'itm' || media_pk ELSE item_id END AS item_id FROM imports""")
def set_item_id(v):
    found = v.imports.where("k % 9 = 0").select("media_pk", "collection_pk", F.concat(F.lit("itm"), "media_pk").alias("item_id"))
    return merge.set_item_id(v.imports.select("media_pk", "collection_pk", "item_id"), found, ["media_pk", "collection_pk"])


@query("""SELECT media_pk, idx::BIGINT AS idx, CASE WHEN k % 10 = 0 THEN 'edited' ELSE description END AS description,
          CASE WHEN k % 10 = 0 THEN 'new-tag' || (CASE WHEN list_contains(string_split(tags, chr(10)), 'autotagged') THEN chr(10) || 'autotagged' ELSE '' END) ELSE tags END AS tags FROM ai_meta""")
def edit_ai_text(v):
    from ..functions.text import clean_token

    edit = F.col("k") % 10 == 0
    marked = F.array_contains(F.split("tags", "\n"), "autotagged")
    new = F.concat(clean_token(F.lit(" #New Tag ")), F.when(marked, "\nautotagged").otherwise(""))
    return v.ai_meta.select("media_pk", F.col("idx").cast("long").alias("idx"), F.when(edit, "edited").otherwise(F.col("description")).alias("description"), F.when(edit, new).otherwise(F.col("tags")).alias("tags"))


_KEPT = " UNION ALL ".join(f"SELECT '{name}', count(*) FROM {name} WHERE k % 4 <> 0" for name in ("files", "ai_meta", "review", "imports", "membership"))


@query(f"""SELECT 'media' AS name, count(*) AS n FROM media WHERE k % 4 <> 0 UNION ALL {_KEPT} UNION ALL SELECT 'exemplars', count(*) FROM ai_meta WHERE idx = 1 AND k % 4 <> 0
  UNION ALL SELECT 'fingerprints', count(*) FROM embeddings WHERE vec_id // 5 NOT IN (SELECT k FROM media WHERE k % 4 = 0)""")
def forget_media(v):
    """Rows that each of the eight tables keeps, counted in one pass over all of them."""
    gone = v.media.where("k % 4 = 0").select(F.col("pk").alias("media_pk"))
    prints = similarity.fingerprints(v.embeddings).withColumn("media_pk", F.lpad("media_pk", 9, "0"))
    tables = {name: getattr(v, name) for name in ("media", "files", "ai_meta", "review", "imports", "membership")} | {"fingerprints": prints, "exemplars": v.ai_meta.where("idx = 1")}
    left = [table.select(F.lit(name).alias("name")) for name, table in merge.forget(tables, gone).items()]
    names = v.spark.createDataFrame([(name,) for name in tables], "name string")
    return names.join(reduce(lambda a, b: a.unionByName(b), left).groupBy("name").agg(F.count(F.lit(1)).alias("n")), "name", "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query("""SELECT CASE WHEN k % 5 = 0 THEN '/new' || path ELSE path END AS path, media_pk FROM files""")
def move_paths(v):
    moves = v.files.where("k % 5 = 0").select(F.col("path").alias("old"), F.concat(F.lit("/new"), "path").alias("new"))
    return merge.mapped(v.files.select("path", "media_pk"), moves, "path")


@query("""SELECT tag, CASE WHEN length(tag) % 3 = 0 THEN 'added' WHEN length(tag) % 3 = 1 THEN 'ignored' ELSE 'new' END AS state
          FROM (SELECT DISTINCT unnest(string_split(tags, chr(10))) AS tag FROM ai_meta)""")
def resolve_candidates(v):
    tags = dropped_tags(v).select("tag").distinct()
    n = F.length("tag") % 3
    settled = tags.where(n < 2).select("tag", F.when(n == 0, "added").otherwise("ignored").alias("to_state"))
    return tags.join(settled, "tag", "left").select("tag", F.coalesce("to_state", F.lit("new")).alias("state"))


@query("""SELECT media_pk, coalesce(decided, CASE WHEN k % 3 = 0 THEN 'dropped' END) AS decided, decided IS NULL AND k % 3 = 0 AS closed FROM review""")
def decide_review(v):
    return merge.decide_review(v.review, v.review.where("k % 3 = 0"), "dropped").select("media_pk", "decided", "closed")


@query("""SELECT count(*) FILTER (decided IS NULL AND coalesce(source, 'rules') = 'rules') AS closed FROM review""")
def clear_review(v):
    return merge.decide_review(v.review, None, "skipped", "rules").agg(F.count_if("closed").alias("closed"))


@query("""WITH p AS (SELECT vec_id, {bits}::BIGINT AS h FROM embeddings)
          SELECT (vec_id // 5)::VARCHAR AS media_pk, count(*) AS kept FROM p WHERE bit_count(h) BETWEEN 12 AND 52 GROUP BY vec_id // 5""".replace("{bits}", similarity.BITS_SQL))
def drop_degenerate(v):
    prints = similarity.fingerprints(v.embeddings).withColumn("hex", F.lpad(F.hex("hash"), 16, "0"))
    odd = prints.select("media_pk", F.explode(F.array(F.lit("0"), F.lit("ffffffffffffffff"), F.lit("3030000000"), F.lit("not hex"))).alias("hex"))
    good = similarity.readable(prints.select("media_pk", "hex").unionByName(odd))
    return good.groupBy("media_pk").agg(F.count(F.lit(1)).alias("kept"))


@query("""SELECT folder_id, media_pk, idx::BIGINT AS idx, ((row_number() OVER (PARTITION BY folder_id ORDER BY media_pk, idx) - 1) // 40)::BIGINT AS batch
          FROM files JOIN imports USING (media_pk)""")
def import_manifest(v):
    rows = v.files.join(v.imports.select("media_pk", "folder_id"), "media_pk").select("folder_id", "media_pk", F.col("idx").cast("long").alias("idx"))
    return merge.import_manifest(rows)


@query("""SELECT pk, name || ' 2' AS name, media_count + 1 AS media_count, CASE WHEN pk = 'col0' THEN 'now' ELSE 'before' END AS last_sync FROM collections""")
def upsert_collection(v):
    base = v.collections.withColumn("last_sync", F.lit("before"))
    seen = v.collections.select("pk", F.concat("name", F.lit(" 2")).alias("name"), (F.col("media_count") + 1).alias("media_count"), F.lit(1).alias("seq"))
    out = merge.upsert_keep(base, seen, ["pk"], ["last_sync"])
    return out.withColumn("last_sync", F.when(F.col("pk") == "col0", "now").otherwise(F.col("last_sync")))


@query("""SELECT pk AS media_pk, code, url, media_type::BIGINT AS media_type, strftime(taken_at, '%Y-%m-%dT%H:%M:%S') AS taken_at, username, caption, duration::DOUBLE AS video_duration, NULL::VARCHAR AS title,
          coalesce(c, '') AS collections FROM media LEFT JOIN (SELECT media_pk, string_agg(collection_pk, '|' ORDER BY seen_at, collection_pk) AS c FROM membership GROUP BY media_pk) ON media_pk = pk""")
def write_sidecars(v):
    """The sidecars of all posts, written as JSON and read again."""
    from .streams import folder

    path = folder(v)
    sidecars.write(v.media, library.membership_lists(v.membership), path)
    return sidecars.read(v.spark, path).select(
        F.col("pk").alias("media_pk"), "code", "url", F.col("media_type").cast("long").alias("media_type"), "taken_at", "author.username", "caption", "video_duration", "music.title", F.array_join("collections", "|").alias("collections")
    )
