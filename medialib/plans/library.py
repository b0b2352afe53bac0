"""Queries that join posts, files and the asset library."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.wordlists import TUTORIAL_MARKS
from ..operators import library, posts
from .query import query

THERE = "SELECT f.* FROM files f JOIN disk_inventory d USING (path) WHERE kind IN ('video', 'photo')"
SNAP = "SELECT regexp_replace(url, '/+$', '') AS key, string_agg(DISTINCT f, '|' ORDER BY f) FILTER (f <> '') AS folders, min(id) AS item_id FROM (SELECT id, url, unnest(string_split(folders, '|')) AS f FROM library_items) GROUP BY 1"


@query(f"""SELECT media_pk, count(*) AS n_files, string_agg(path, '|' ORDER BY idx, path) AS paths, coalesce(any_value(c), '') AS collections, coalesce(any_value(n), 0) AS described
           FROM ({THERE}) LEFT JOIN (SELECT media_pk, string_agg(collection_pk, '|' ORDER BY seen_at, collection_pk) AS c FROM membership GROUP BY media_pk) USING (media_pk)
           LEFT JOIN (SELECT media_pk, count(*) AS n FROM ai_meta WHERE description <> '' GROUP BY media_pk) USING (media_pk) JOIN media ON pk = media_pk GROUP BY media_pk""")
def library_posts(v):
    rows = library.library_posts(v.media, v.files, v.disk_inventory, v.membership, v.ai_meta)
    return rows.select("media_pk", "n_files", F.array_join("paths", "|").alias("paths"), F.array_join("collections", "|").alias("collections"), "described")


@query(f"""SELECT media_pk, idx::BIGINT AS idx, path FROM ({THERE}) f JOIN media m ON m.pk = f.media_pk
           WHERE status = 'done' AND NOT EXISTS (SELECT 1 FROM ai_meta a WHERE a.media_pk = f.media_pk AND a.idx = f.idx AND a.description <> '')""")
def undescribed_files(v):
    return library.undescribed_files(v.media, v.files, v.disk_inventory, v.ai_meta).select("media_pk", F.col("idx").cast("long").alias("idx"), "path")


@query("SELECT media_pk, count(*) AS n_files, bool_and(d.path IS NOT NULL) AS all_there FROM files f LEFT JOIN disk_inventory d USING (path) GROUP BY media_pk")
def files_exist(v):
    return posts.files_exist(v.files, v.disk_inventory)


CLEAN = """SELECT pk, url FROM media m WHERE status = 'done' AND EXISTS (SELECT 1 FROM files f WHERE f.media_pk = pk) AND EXISTS (SELECT 1 FROM imports i WHERE i.media_pk = pk)
           AND NOT EXISTS (SELECT 1 FROM review r WHERE r.media_pk = pk AND decided IS NULL)"""


@query(f"SELECT pk FROM ({CLEAN})")
def cleanup_candidates(v):
    return library.cleanup_candidates(v.media, v.files, v.imports, v.review).select("pk")


@query(f"SELECT pk, regexp_replace(url, '/+$', '') IN (SELECT regexp_replace(url, '/+$', '') FROM library_items) AS confirmed FROM ({CLEAN})")
def cleanup_confirmed(v):
    return library.cleanup_confirmed(library.cleanup_candidates(v.media, v.files, v.imports, v.review), v.library_items)


@query(f"SELECT key, coalesce(folders, '') AS folders, item_id FROM ({SNAP}) WHERE key <> ''")
def library_snapshot(v):
    return library.library_snapshot(v.library_items).withColumn("folders", F.array_join("folders", "|"))


@query(f"""SELECT pk AS media_pk, coalesce(string_split(folders, '|')[1], '') AS folder_id, item_id FROM media JOIN ({SNAP}) ON key = regexp_replace(url, '/+$', '')
           WHERE pk NOT IN (SELECT media_pk FROM imports)""")
def repair_imports(v):
    return library.repair_imports(library.library_snapshot(v.library_items), v.media, v.imports).drop("collection_pk")


@query(f"""SELECT pk, path, 'delete' AS action FROM ({CLEAN}) c JOIN files f ON f.media_pk = pk JOIN disk_inventory d USING (path) WHERE regexp_replace(url, '/+$', '') IN (SELECT regexp_replace(url, '/+$', '') FROM library_items)
           UNION ALL SELECT pk, '', 'archive' FROM ({CLEAN}) WHERE regexp_replace(url, '/+$', '') IN (SELECT regexp_replace(url, '/+$', '') FROM library_items)""")
def cleanup_manifest(v):
    confirmed = library.cleanup_confirmed(library.cleanup_candidates(v.media, v.files, v.imports, v.review), v.library_items)
    delete, archive = library.cleanup_manifest(confirmed, v.files, v.disk_inventory)
    return delete.withColumn("action", F.lit("delete")).unionByName(archive.select("pk", F.lit("").alias("path"), F.lit("archive").alias("action")))


PRESENT = f"SELECT pk, regexp_replace(url, '/+$', '') IN (SELECT key FROM ({SNAP})) OR pk IN (SELECT media_pk FROM imports) AS present FROM media"


@query(PRESENT)
def in_library(v):
    return library.in_library(v.media, library.library_snapshot(v.library_items), v.imports)


@query(f"""SELECT media_pk, count(*) AS n_files FROM ({THERE}) WHERE media_pk IN (SELECT pk FROM ({PRESENT}) WHERE NOT present)
           AND media_pk NOT IN (SELECT media_pk FROM review WHERE decided IS NULL) GROUP BY media_pk""")
def push_plan(v):
    present = library.in_library(v.media, library.library_snapshot(v.library_items), v.imports)
    return library.push_plan(library.library_posts(v.media, v.files, v.disk_inventory, v.membership, v.ai_meta), v.review, present).select("media_pk", "n_files")


#: A shelf for each collection of a post; col5 has no folder of its own.
SHELVES = "SELECT media_pk, collection_pk, CASE WHEN collection_pk = 'col5' THEN '' ELSE 'fld' || collection_pk[4:4] END AS folder_id, m.url FROM membership JOIN media m ON m.pk = media_pk"
ON_SHELF = f"""SELECT s.media_pk, s.collection_pk, s.folder_id, (k.key IS NOT NULL AND (s.folder_id = '' OR list_contains(string_split(coalesce(k.folders, ''), '|'), s.folder_id))) OR i.media_pk IS NOT NULL AS present
  FROM ({SHELVES}) s LEFT JOIN ({SNAP}) k ON k.key = regexp_replace(s.url, '/+$', '') LEFT JOIN (SELECT DISTINCT media_pk, collection_pk FROM imports WHERE k % 2 = 1) i ON i.media_pk = s.media_pk AND i.collection_pk = s.collection_pk"""


def shelves(v):
    folder = F.when(F.col("collection_pk") == "col5", "").otherwise(F.concat(F.lit("fld"), F.substring("collection_pk", 4, 1)))
    return v.membership.select("media_pk", "collection_pk", folder.alias("folder_id")).join(v.media.select(F.col("pk").alias("media_pk"), "url"), "media_pk")


def on_shelf(v):
    return library.in_library_by_folder(shelves(v), library.library_snapshot(v.library_items), v.imports.where("k % 2 = 1"))


@query(ON_SHELF)
def in_library_by_folder(v):
    return on_shelf(v)


SENT = f"""SELECT p.folder_id, p.media_pk, p.collection_pk, f.idx::BIGINT AS idx, path FROM ({ON_SHELF}) p JOIN ({THERE}) f USING (media_pk) WHERE NOT present AND p.media_pk NOT IN (SELECT media_pk FROM review WHERE decided IS NULL)"""


@query(f"SELECT *, ((row_number() OVER (PARTITION BY folder_id ORDER BY media_pk, collection_pk, idx, path) - 1) // 40)::BIGINT AS batch FROM ({SENT})")
def push_by_folder(v):
    sent, _ = library.push_by_folder(shelves(v), library.existing(v.files, v.disk_inventory), v.review, on_shelf(v))
    return sent.withColumn("idx", F.col("idx").cast("long"))


@query(f"SELECT DISTINCT media_pk, collection_pk, folder_id FROM ({SENT})")
def push_marks(v):
    return library.push_marks(shelves(v), library.existing(v.files, v.disk_inventory), v.review, on_shelf(v))


@query("SELECT media_pk, min(collection_pk) AS collection_pk FROM membership WHERE media_pk NOT IN (SELECT media_pk FROM imports) GROUP BY media_pk")
def import_queue(v):
    return library.import_queue(v.membership.join(v.imports.select("media_pk"), "media_pk", "left_anti"))


def items(v):
    """Library items, every second of our own named by a file's stem."""
    return v.library_items.withColumn("name", F.when(F.col("id").startswith("itm") & (F.col("modification_time") % 2 == 0), F.concat(F.substring("id", 4, 9), F.lit("_0"))).otherwise(F.col("name")))


MATCH = """SELECT id, annotation, coalesce(f.media_pk, m.pk) AS media_pk, coalesce(f.idx, CASE WHEN m.pk IS NOT NULL THEN 0 END)::BIGINT AS idx
  FROM (SELECT *, CASE WHEN id LIKE 'itm%' AND modification_time % 2 = 0 THEN substring(id, 4, 9) || '_0' ELSE name END AS n FROM library_items) i
  LEFT JOIN files f ON f.media_pk || '_' || f.idx = i.n LEFT JOIN media m ON regexp_replace(m.url, '/+$', '') = regexp_replace(i.url, '/+$', '')"""


@query(f"SELECT id, media_pk, idx FROM ({MATCH})")
def match_items(v):
    return library.match_items(items(v), v.files, v.media).select("id", "media_pk", "idx")


@query(f"SELECT id, x.media_pk, x.idx, prompt_hash FROM ({MATCH}) x JOIN ai_meta a ON a.media_pk = x.media_pk AND a.idx = x.idx WHERE contains(annotation, 'Visual summary:') AND prompt_hash <> 'h0'")
def stale_descriptions(v):
    return library.stale_descriptions(library.match_items(items(v), v.files, v.media), v.ai_meta, "h0").select("id", "media_pk", "idx", "prompt_hash")


@query(f"""SELECT id, media_pk FROM ({MATCH}) WHERE media_pk IS NOT NULL AND NOT contains(annotation, 'Visual summary:')
           AND media_pk NOT IN (SELECT media_pk FROM membership WHERE collection_pk = 'col5') AND media_pk IN (SELECT media_pk FROM ({THERE}))""")
def describe_backlog(v):
    skip = v.membership.where("collection_pk = 'col5'").select("media_pk")
    there = library.existing(v.files, v.disk_inventory).select("media_pk")
    rows = library.match_items(items(v), v.files, v.media).where(~posts.described(F.col("annotation"))).where("media_pk is not null")
    return rows.join(skip, "media_pk", "left_anti").join(there, "media_pk", "left_semi").select("id", "media_pk")


@query(f"""WITH d AS (SELECT 0 AS queue, f.media_pk, f.idx::BIGINT AS idx, '' AS id, coalesce(downloaded_at, first_seen) AS shown_at FROM ({THERE}) f JOIN media m ON m.pk = f.media_pk
    WHERE status = 'done' AND NOT EXISTS (SELECT 1 FROM ai_meta a WHERE a.media_pk = f.media_pk AND a.idx = f.idx AND a.description <> '')),
  l AS (SELECT 1, media_pk, idx, id, NULL FROM ({MATCH}) WHERE media_pk IS NOT NULL AND NOT contains(annotation, 'Visual summary:'))
  SELECT queue, media_pk, idx, id FROM (SELECT * FROM d UNION ALL SELECT * FROM l) WHERE media_pk NOT IN (SELECT media_pk FROM membership WHERE collection_pk = 'col5')
  ORDER BY queue, shown_at DESC NULLS LAST, CASE WHEN queue = 1 THEN id END, media_pk, idx LIMIT 1500""")
def backlog_by_budget(v):
    """Fifteen hundred descriptions: what lies on disk without one, then the library's."""
    disk = library.undescribed_files(v.media, v.files, v.disk_inventory, v.ai_meta)
    matched = library.match_items(items(v), v.files, v.media).where(~posts.described(F.col("annotation")))
    return library.backlog(disk, matched, v.membership.where("collection_pk = 'col5'"), 1500)


@query("""SELECT f.media_pk, f.idx::BIGINT AS idx, coalesce(a.description, b.description) AS description FROM files f
          LEFT JOIN ai_meta a ON a.media_pk = f.media_pk AND a.idx = f.idx LEFT JOIN ai_meta b ON b.media_pk = f.media_pk AND b.idx = 0""")
def ai_for_slide(v):
    return library.ai_for_slide(v.files, v.ai_meta).select("media_pk", F.col("idx").cast("long").alias("idx"), "description")


@query("SELECT media_pk, string_agg(collection_pk, '|' ORDER BY seen_at, collection_pk) AS collections FROM membership GROUP BY media_pk")
def membership_lists(v):
    return library.membership_lists(v.membership).withColumn("collections", F.array_join("collections", "|"))


@query("SELECT media_pk, target, owner FROM (SELECT pk AS media_pk, username || '_' || (k % 50) AS target, min(pk) OVER (PARTITION BY username || '_' || (k % 50)) AS owner FROM media) WHERE media_pk <> owner")
def path_conflicts(v):
    return library.path_conflicts(v.media.select(F.col("pk").alias("media_pk"), F.concat("username", F.lit("_"), F.col("k") % 50).alias("target")))


@query("""SELECT media_pk, idx::BIGINT AS idx, CASE WHEN n = 1 THEN name ELSE name || '_' || n END AS final FROM (
            SELECT media_pk, idx, name, row_number() OVER (PARTITION BY kind, name ORDER BY media_pk, idx) + CASE WHEN name = 'n3' THEN 1 ELSE 0 END AS n FROM (SELECT *, 'n' || (k % 40) AS name FROM files))""")
def unique_names(v):
    rows = v.files.select("media_pk", F.col("idx").cast("long").alias("idx"), F.col("kind").alias("folder"), F.concat(F.lit("n"), F.col("k") % 40).alias("name"))
    taken = v.files.select(F.col("kind").alias("folder"), F.lit("n3").alias("name")).distinct()
    return library.unique_names(rows, taken).select("media_pk", "idx", "final")


@query(f"""SELECT media_pk, 'Saved by the owner in collection: ' || j || '.' AS hint, {" OR ".join(f"contains(lower(j), '{m}')" for m in TUTORIAL_MARKS)} AS tutorial
           FROM (SELECT media_pk, array_to_string(list(name ORDER BY seen_at, collection_pk)[1:4], ', ') AS j FROM membership JOIN collections ON pk = collection_pk GROUP BY media_pk)""")
def collection_hint(v):
    return library.collection_hint(v.membership, v.collections)
