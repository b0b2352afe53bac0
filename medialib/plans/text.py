"""Queries of the text functions, as columns of whole-table jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import wordlists as W
from ..operators import library, posts
from ..sources.staging import scratch, staged
from .posts import KIND
from .query import query
from .tagging import evenly

X = "unnest(string_split(tags, chr(10)))"
CLEAN = "trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(regexp_replace(trim(x), '^#+|#+$', ''))), '[\\s_]+', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-{2,}', '-', 'g'), '-')"


@query(f"SELECT x AS raw, {CLEAN} AS tag, count(*) AS n FROM (SELECT {X} AS x FROM ai_meta) GROUP BY ALL")
def clean_token(v):
    raw = v.ai_meta.select(F.explode(F.split("tags", "\n")).alias("raw"))
    return raw.groupBy("raw", T.clean_token(F.col("raw")).alias("tag")).agg(F.count(F.lit(1)).alias("n"))


ONE = "trim(regexp_replace(regexp_replace(lower(trim(regexp_replace(trim(x), '^#+|#+$', ''))), '\\s+', '-', 'g'), '[^\\w\\-]', '', 'g'), '-')"


@query(f"""SELECT media_pk, idx::BIGINT AS idx, array_to_string(list_filter(c, lambda t, i: t <> '' AND length(t) <= 30 AND list_position(c, t) = i)[1:15], '|') AS tags
           FROM (SELECT media_pk, idx, list_transform(string_split(tags, chr(10)), lambda x: {ONE}) AS c FROM ai_meta)""")
def clean_tags(v):
    return v.ai_meta.select("media_pk", F.col("idx").cast("long").alias("idx"), F.array_join(T.clean_tags(F.split("tags", "\n")), "|").alias("tags"))


TAGS = f"(SELECT list_filter(h, lambda t, i: list_position(h, t) = i)[1:15] FROM (SELECT list_transform(regexp_extract_all(caption, '{W.HASHTAG}', 1), lambda t: lower(t)) AS h))"


@query(f"SELECT pk, array_to_string({TAGS}, '|') AS hashtags FROM media")
def hashtags(v):
    return v.media.select("pk", F.array_join(T.hashtags(F.col("caption")), "|").alias("hashtags"))


SAFE = "regexp_replace(regexp_replace(trim(regexp_replace(trim({}), '[<>:\"/\\\\|?*]', '_', 'g')), '\\s+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g')"


ACCENT = "(CASE k % 2 WHEN 0 THEN concat('cafe', chr(769), ' ') ELSE '' END)".replace("chr(769)", "'\u0301'")


@query(f"SELECT pk, CASE WHEN n = '' THEN 'unnamed' WHEN length(n) > 40 THEN regexp_replace(n[1:40], '[ .]+$', '') ELSE n END AS name FROM (SELECT pk, {SAFE.format('nfc_normalize(ACCENT || url || caption)').replace('ACCENT', ACCENT)} AS n FROM media)")
def safe_component(v):
    """Names that begin with a letter and its accent apart, every second time."""
    return v.media.select("pk", T.safe_component(T.nfc(F.concat(F.expr(ACCENT), "url", "caption")), 40).alias("name"))


BARE = "trim(regexp_replace(regexp_replace(caption, '[#@][^\\s#@]+', ' ', 'g'), '\\s+', ' ', 'g'))"


def slug_sql(limit: int) -> str:
    chosen = f"regexp_replace({BARE}, '^[ \\-–—·•,.:;!?|/\\\\]+|[ \\-–—·•,.:;!?|/\\\\]+$', '', 'g')"
    cut = f"CASE WHEN contains(({chosen})[{limit // 2 + 1}:{limit}], ' ') THEN regexp_replace(({chosen})[1:{limit}], ' [^ ]*$', '') ELSE ({chosen})[1:{limit}] END"
    return f"CASE WHEN length({chosen}) > {limit} THEN regexp_replace({cut}, '[ \\-–—·•,.:;!?]+$', '') ELSE {chosen} END"


@query(f"SELECT pk, {slug_sql(20)} AS slug FROM media")
def caption_slug(v):
    return v.media.select("pk", T.caption_slug(F.col("caption"), 20).alias("slug"))


NAME = f"strftime(taken_at, '%Y-%m-%d') || '_' || username || '_' || ({slug_sql(60)}) || '_' || code"


def named(v):
    return T.render_template("{date}_{user}_{title}_{code}", F.col("taken_at"), F.col("username"), F.col("code"), F.lit("video"), F.col("pk"), F.lit(""), F.col("caption"))


TIDY = f"regexp_replace(regexp_replace(regexp_replace({NAME}, '[<>:\"/\\\\|?*]', '_', 'g'), '[ -]*_[ _-]*', '_', 'g'), ' *-[ -]*', '-', 'g')"


@query(f"SELECT pk, regexp_replace({SAFE.format('trim(' + TIDY + ')')}, '[ .]+$', '') AS name FROM media")
def render_template(v):
    return v.media.select("pk", named(v).alias("name"))


@query("SELECT path, 'base' || CASE WHEN idx = 0 THEN '' ELSE '_' || lpad(idx::VARCHAR, 2, '0') END || '.jpg' AS name FROM files")
def asset_name(v):
    return v.files.select("path", T.asset_name(F.lit("base"), F.when(F.col("idx") > 0, F.col("idx")), F.lit("jpg")).alias("name"))


@query(f"""SELECT path, n AS target, n <> regexp_extract(path, '([^/]+)$', 1) AS renamed FROM (
           SELECT path, regexp_replace({SAFE.format('trim(' + TIDY + ')')}, '[ .]+$', '') || CASE WHEN idx = 0 THEN '' ELSE '_' || lpad(idx::VARCHAR, 2, '0') END || regexp_extract(path, '(\\.[^.]+)$', 1) AS n FROM files f JOIN media m ON m.pk = f.media_pk)""")
def file_name_plan(v):
    """Every file's target name, and whether it differs from what it has."""
    base = evenly(v.media, "pk").select(F.col("pk").alias("media_pk"), named(v).alias("base"))
    ext = F.regexp_extract("path", r"(\.[^.]+)$", 1)
    rows = v.files.join(base, "media_pk").select("path", T.asset_name(F.col("base"), F.when(F.col("idx") > 0, F.col("idx")), ext).alias("target"))
    return rows.withColumn("renamed", F.col("target") != F.regexp_extract("path", r"([^/]+)$", 1))


#: Thumbnails and sidecars of most files, and some names that the job will ask for.
BESIDE = f"""n AS (SELECT k, pk AS media_pk, regexp_replace({SAFE.format('trim(' + TIDY + ')')}, '[ .]+$', '') AS base FROM media),
  g AS (SELECT *, regexp_extract(path, '([^/]+)\\.[^.]+$', 1) AS stem, regexp_extract(path, '(\\.[^.]+)$', 1) AS ext FROM files),
  d AS (SELECT path FROM disk_inventory UNION SELECT '/thumbs/' || stem || '.jpg' FROM g WHERE (k + idx) % 3 <> 0 UNION SELECT '/meta/' || stem || '.json' FROM g WHERE (k + idx) % 4 <> 0
        UNION SELECT '/thumbs/' || base || '.jpg' FROM n WHERE k % 5 = 0 UNION SELECT '/thumbs/' || base || '_3.jpg' FROM n WHERE k % 2 = 0 UNION SELECT '/lib/' || base || '_01.mp4' FROM n WHERE k % 3 = 0)"""


@query(f"""WITH {BESIDE},
  p AS (SELECT 'file' AS kind, path, '/lib/' AS folder, base || CASE WHEN count(*) OVER (PARTITION BY media_pk) > 1 THEN '_' || lpad((row_number() OVER (PARTITION BY media_pk ORDER BY idx, path))::VARCHAR, 2, '0') ELSE '' END AS stem, ext
          FROM g JOIN n USING (media_pk) WHERE path IN (SELECT path FROM d)
        UNION ALL SELECT DISTINCT 'thumb', '/thumbs/' || stem || '.jpg', '/thumbs/', base, '.jpg' FROM g JOIN n USING (media_pk) WHERE '/thumbs/' || stem || '.jpg' IN (SELECT path FROM d)
        UNION ALL SELECT DISTINCT 'sidecar', '/meta/' || stem || '.json', '/meta/', base, '.json' FROM g JOIN n USING (media_pk) WHERE '/meta/' || stem || '.json' IN (SELECT path FROM d)),
  r AS (SELECT *, row_number() OVER (PARTITION BY folder, stem, ext ORDER BY path) AS nth FROM p WHERE path <> folder || stem || ext),
  c AS (SELECT DISTINCT folder, stem, ext, m FROM r, range(1, 20) x(m)),
  free AS (SELECT folder, stem, ext, m, row_number() OVER (PARTITION BY folder, stem, ext ORDER BY m) AS nth FROM c
           WHERE folder || stem || CASE WHEN m > 1 THEN '_' || m ELSE '' END || ext NOT IN (SELECT path FROM d)
             AND (m = 1 OR folder || stem || '_' || m || ext NOT IN (SELECT folder || stem || ext FROM r)))
  SELECT kind, path, folder || stem || CASE WHEN m > 1 THEN '_' || m ELSE '' END || ext AS target, true AS renamed FROM r JOIN free USING (folder, stem, ext, nth)
  UNION ALL SELECT kind, path, path, false FROM p WHERE path = folder || stem || ext""")
def rename_manifest(v):
    """What a renaming job moves: files, thumbnails and sidecars, past names that are in use."""
    with scratch(v.spark) as within:
        names = staged(evenly(v.media, "pk").select("k", F.col("pk").alias("media_pk"), named(v).alias("base")), within)  # costs much, and is asked for often
        files = staged(v.files.select("k", "idx", "media_pk", "path"), within)
        stems = files.withColumn("stem", F.substring_index(F.substring_index("path", "/", -1), ".", 1))
        made = [
            (stems.where("(k + idx) % 3 <> 0"), "/thumbs/", "stem", ".jpg"), (stems.where("(k + idx) % 4 <> 0"), "/meta/", "stem", ".json"),
            (names.where("k % 5 = 0"), "/thumbs/", "base", ".jpg"), (names.where("k % 2 = 0"), "/thumbs/", "base", "_3.jpg"), (names.where("k % 3 = 0"), "/lib/", "base", "_01.mp4"),
        ]
        disk = v.disk_inventory.select("path")
        for rows, folder, column, ext in made:
            disk = disk.unionByName(rows.select(F.concat(F.lit(folder), column, F.lit(ext)).alias("path")))
        disk = staged(disk)
        plan = library.rename_targets(files, names, disk, {"thumb": ("/thumbs", ".jpg"), "sidecar": ("/meta", ".json")})
    return library.rename_moves(plan, disk)


@query("SELECT pk, CASE WHEN length(caption) > 30 THEN rtrim(caption[1:29]) || '…' ELSE caption END AS title FROM media")
def short_title(v):
    return v.media.select("pk", T.short_title(F.col("caption"), F.col("username"), F.col("code"), 30).alias("title"))


@query(r"SELECT url, CASE WHEN e = '.jpeg' THEN '.jpg' WHEN e IN ('.jpg', '.png', '.webp', '.mp4', '.mov', '.gif', '.heic') THEN e ELSE '.jpg' END AS ext FROM (SELECT url, lower(regexp_extract(string_split(string_split(url, '?')[1], '#')[1], '[^/.](\.[^/.]+)/*$', 1)) AS e FROM pages)")
def ext_from_url(v):
    return v.pages.select("url", T.ext_from_url(F.col("url")).alias("ext"))


META = "media m LEFT JOIN (SELECT media_pk, description, screen_text, transcript, summary FROM ai_meta WHERE idx = 0) a ON a.media_pk = m.pk"
BLOCKS = "nullif(caption, ''), CASE WHEN coalesce(summary, '') <> '' THEN 'In short: ' || summary END, CASE WHEN coalesce(description, '') <> '' THEN 'Visual summary: ' || description END"
NOTE = f"concat_ws(chr(10) || chr(10), {BLOCKS}, CASE WHEN coalesce(screen_text, '') <> '' THEN 'On screen: ' || screen_text END, CASE WHEN coalesce(transcript, '') <> '' THEN 'Voice-over: ' || transcript END)"


def told(v):
    meta = v.ai_meta.where("idx = 0").select(F.col("media_pk").alias("pk"), "description", "screen_text", "transcript", "summary")
    return v.media.join(meta, "pk", "left")


@query(f"SELECT pk, 'Автор' <> '' AND true AS ok, concat_ws(chr(10) || chr(10), {BLOCKS}, 'Автор: @' || username || chr(10) || 'Посилання: ' || url) AS comment FROM {META}")
def file_comment(v):
    return told(v).select("pk", F.lit(True).alias("ok"), T.file_comment(F.col("caption"), F.col("description"), F.col("summary"), F.col("username"), F.col("url")).alias("comment"))


@query(f"""SELECT pk, array_to_string(list_filter(h, lambda t, i: list_position(list_transform(h, lambda o: lower(o)), lower(t)) = i)[1:30], '; ') AS keywords
           FROM (SELECT pk, list_concat({TAGS}, ['Blender', username]) AS h FROM media)""")
def keywords(v):
    return v.media.select("pk", T.keywords(T.hashtags(F.col("caption")), F.array(F.lit("Blender"), F.col("username"))).alias("keywords"))


def annotated(v):
    return T.annotation(*[F.col(c) for c in ("caption", "description", "screen_text", "transcript", "summary")])


@query(f"SELECT pk, ({NOTE})[1:3000] AS note FROM {META}")
def annotation_build(v):
    return told(v).select("pk", F.substring(annotated(v), 1, 3000).alias("note"))


@query("SELECT pk, caption || CASE WHEN coalesce(summary, '') = '' AND coalesce(description, '') = '' AND coalesce(screen_text, '') = '' AND coalesce(transcript, '') <> '' THEN chr(10) || chr(10) || 'Voice-over: ' || transcript ELSE '' END AS note FROM " + META)
def strip_description(v):
    return told(v).select("pk", T.strip_description(annotated(v)).alias("note"))


@query(f"""SELECT pk, title, note, array_to_string(list_filter(h, lambda t, i: list_position(list_transform(h, lambda o: lower(o)), lower(t)) = i AND trim(t) <> '')[1:30], '|') AS tags
           FROM (SELECT pk, CASE WHEN length(caption) > 70 THEN rtrim(caption[1:69]) || '…' ELSE caption END AS title, ({NOTE})[1:3000] AS note, list_concat(['@' || username, {KIND.format('post')}], {TAGS}) AS h FROM {META})""")
def item_build(v):
    """The library item of each post."""
    kind = posts.post_kind(F.col("media_type"), F.col("product_type"))
    own = F.concat(F.array(F.concat(F.lit("@"), "username"), kind), T.hashtags(F.col("caption")))
    tags = F.slice(T.distinct_in_order(F.filter(own, lambda t: F.trim(t) != ""), F.lower), 1, 30)
    return told(v).select("pk", T.short_title(F.col("caption"), F.col("username"), F.col("code")).alias("title"), F.substring(annotated(v), 1, 3000).alias("note"), F.array_join(tags, "|").alias("tags"))


@query("SELECT path, CASE WHEN bytes < 1024 THEN bytes || ' B' WHEN bytes < 1048576 THEN printf('%.1f KB', bytes / 1024) ELSE printf('%.1f MB', bytes / 1048576) END AS size FROM files")
def human_size(v):
    return v.files.select("path", T.human_size(F.col("bytes")).alias("size"))


@query("SELECT pk FROM media UNION ALL SELECT 'side' || page_id FROM pages WHERE page_id % 3 <> 0")
def posts_union(v):
    """Posts of the table, and those of sidecars whose file the table doesn't know."""
    sidecars = v.pages.select(F.concat(F.lit("side"), "page_id").alias("pk"), "page_id")
    known = v.pages.where("page_id % 3 = 0").select(F.concat(F.lit("side"), "page_id").alias("pk"))
    return v.media.select("pk").unionByName(sidecars.join(known, "pk", "left_anti").select("pk"))
