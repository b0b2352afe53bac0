"""Media-library views over the driver's tables, in SQL that Spark and DuckDB both read.

A view names others in braces; ``frame()`` gives it as a Spark DataFrame, and
``with_views()`` puts the views that a DuckDB query names before it as CTEs.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def quoted(text: str) -> str:
    """A string literal; the texts have no backslash."""
    return "'" + text.replace("'", "''") + "'" if "'" not in text else "concat(" + ", chr(39), ".join(f"'{p}'" for p in text.split("'")) + ")"


def pick(number: str, values: list) -> str:
    """The value with a number from 0: a CASE, or a part of a long list's text."""
    if len(values) > 15:
        return f"split_part({quoted('|'.join(values))}, '|', CAST({number} AS INT) + 1)"
    cases = " ".join(f"WHEN {k} THEN {quoted(v) if isinstance(v, str) else v}" for k, v in enumerate(values))
    return f"(CASE {number} {cases} END)"


def div(a: str, b: str) -> str:
    return f"CAST(floor(({a}) / {b}) AS BIGINT)"


USERS = ["alt_studio", "daily_memes_ua", "gamestart", "studio.alt", "bob", "3d-artist", "brandlab", "funny_cats", "myfriend", "spartan_plays"]
PHRASES = [
    "5 tools for every designer", "How to make glass in Blender", "Stop using this mistake again", "sunset over the hills",
    "Node setup breakdown, Houdini + Redshift", "The difference between hue and tint explained", "paid partnership with a brand",
    "Comment CODE and I will send you the link", "just released a new version", "when the render fails",
    "Free training: masterclass in Cinema 4D", "my cat being relatable",
]
HASHTAGS = ["meme", "funny", "art", "3d", "blender", "c4d", "ad", "sponsored", "design", "ae", "lol", "render", "promo", "photography", "unity"]
STATUSES = ["done", "done", "pending", "done", "skipped", "failed", "archived", "gave_up"]
RAW_TAGS = [
    "Hard Light", "soft-light", "#backlit", "rim_light", "Golden Hour", "neon-lit", "warm-tones", "Cool Tones", "monochromatic",
    "close-up", "wide shot", "low-angle", "overhead", "vertical", "square", "symmetrical", "dramatic", "calm", "handheld",
    "locked-off", "orbit", "crane", "slow-motion", "time-lapse", "render", "cgi", "3d", "backlight", "fashion", "Skiing",
    "meme", "cinematic", "ad", "sci-fi", "unknown thing", "weird!!", "blurry", "c4d", "blender", "ue5", "tutorial", "tips",
    "portrait", "architecture", "interior", "high-key", "low-key", "autotagged",
]
CATEGORIES = ["meme", "art", "ad", "game", "other", ""]
ERRORS = [
    "PleaseWaitFewMinutes: try later", "429 too many requests", "LoginRequired", "checkpoint reached", "file not found",
    "feedback_required", "timeout", "not logged in, rate limit",
]

_TAGS = ", chr(10), ".join(pick(f"(k * 3 + idx * 5 + {j} * 7) % 48", RAW_TAGS) for j in range(8))

VIEWS: dict[str, str] = {
    "media": f"""
      SELECT o_orderkey AS k, lpad(CAST(o_orderkey AS STRING), 9, '0') AS pk, concat('C', lpad(CAST(o_orderkey AS STRING), 9, '0')) AS code,
             {pick("o_orderkey % 10", USERS)} AS username,
             concat({pick("o_orderkey % 12", PHRASES)}, ' #', {pick("o_orderkey % 15", HASHTAGS)}, ' #', {pick(div("o_orderkey", "7") + " % 15", HASHTAGS)}) AS caption,
             {pick("o_orderkey % 4", [2, 2, 1, 8])} AS media_type,
             CASE WHEN o_orderkey % 3 = 0 THEN 'clips' ELSE 'feed' END AS product_type,
             o_orderdate AS taken_at, o_orderdate + INTERVAL 1 DAY AS first_seen,
             CASE WHEN {pick("o_orderkey % 8", STATUSES)} = 'done' THEN o_orderdate + (o_orderkey % 30) * INTERVAL 1 DAY END AS downloaded_at,
             {pick("o_orderkey % 8", STATUSES)} AS status,
             concat('https://example.test/p/C', lpad(CAST(o_orderkey AS STRING), 9, '0'), '/') AS url,
             o_orderkey % 4 AS attempts, {pick("o_orderkey % 8", ERRORS)} AS last_error,
             o_totalprice % 180 AS duration, o_orderkey % 11 = 0 AS paid, CAST(o_orderkey % 13 = 0 AS INT) AS sponsors
      FROM {{orders}}""",
    "files": """
      SELECT concat('/lib/', pk, '_', CAST(idx AS STRING), CASE kind WHEN 'video' THEN '.mp4' ELSE '.jpg' END) AS path,
             pk AS media_pk, k, idx, kind, bytes
      FROM (SELECT l_orderkey AS k, lpad(CAST(l_orderkey AS STRING), 9, '0') AS pk, l_linenumber - 1 AS idx,
                   CASE l_linenumber % 4 WHEN 1 THEN 'video' WHEN 2 THEN 'photo' WHEN 3 THEN 'video' ELSE 'thumb' END AS kind,
                   CAST(floor(max(l_extendedprice)) AS BIGINT) AS bytes
            FROM {lineitem} GROUP BY l_orderkey, l_linenumber) f""",
    "disk_inventory": "SELECT path, bytes AS size FROM {files} WHERE (k + idx) % 7 <> 0",
    "membership": """
      SELECT lpad(CAST(l_orderkey AS STRING), 9, '0') AS media_pk, l_orderkey AS k, concat('col', CAST(l_suppkey % 6 AS STRING)) AS collection_pk,
             min(l_shipdate) AS seen_at
      FROM {lineitem} GROUP BY l_orderkey, l_suppkey % 6""",
    "collections": f"""
      SELECT collection_pk AS pk, {pick("CAST(substring(collection_pk, 4, 1) AS INT)", ["Liked", "Inspiration", "Houdini Tut", "Fashion", "To watch", "Ads"])} AS name,
             CAST(count(*) + 3 AS BIGINT) AS media_count
      FROM {{membership}} GROUP BY collection_pk""",
    "imports": """
      SELECT media_pk, collection_pk, concat('fld', substring(collection_pk, 4, 1)) AS folder_id,
             CASE WHEN k % 2 = 0 THEN '' ELSE concat('itm', media_pk) END AS item_id, seen_at AS imported_at, k
      FROM {membership} WHERE k % 3 = 0""",
    "review": f"""
      SELECT pk AS media_pk, concat('/lib/', pk, '_0.mp4') AS path, {pick("k % 3", ["rules", "model"])} AS source,
             {pick("k % 3", ["skip", "download", "review"])} AS verdict, taken_at AS added_at,
             CASE WHEN k % 2 = 0 THEN NULL ELSE 'kept' END AS decided, k
      FROM {{media}} WHERE k % 5 = 0""",
    "ai_meta": f"""
      SELECT media_pk, idx, k, {pick("k % 6", CATEGORIES)} AS category, CASE WHEN (k + idx) % 9 = 0 THEN '' ELSE concat('a shot of item ', CAST(idx AS STRING)) END AS description,
             concat({_TAGS}) AS tags, concat('h', CAST({div("k", "3")} % 3 AS STRING)) AS prompt_hash,
             {pick("k % 4", ["", "step 1", "cheat sheet", ""])} AS screen_text, CASE WHEN k % 5 = 0 THEN 'made in houdini' ELSE '' END AS transcript,
             CASE WHEN k % 2 = 0 THEN 'short' ELSE '' END AS summary
      FROM {{files}} WHERE kind <> 'thumb'""",
    "agreement": f"""
      SELECT lpad(CAST(doc_id AS STRING), 9, '0') AS media_pk, {pick("doc_id % 6", CATEGORIES)} AS category,
             CASE WHEN quality = 1 THEN 'download' ELSE 'skip' END AS proposed, CASE WHEN toxic = 0 THEN 'kept' ELSE 'dropped' END AS decided
      FROM {{labels}}""",
    # numbered by hours: what is before an hour, and the place within it
    "feed": """
      SELECT CASE WHEN e.side = 0 THEN 'liked' ELSE 'saved' END AS collection_pk,
             earlier + row_number() OVER (PARTITION BY e.side, e.hour ORDER BY ts DESC, event_id) AS pos,
             CASE WHEN event_id % 97 = 0 THEN '' ELSE lpad(CAST(user_id AS STRING), 9, '0') END AS pk, event_id
      FROM (SELECT user_id % 2 AS side, date_trunc('hour', ts) AS hour, ts, event_id, user_id FROM {events}) e
      JOIN (SELECT side, hour, CAST(sum(n) OVER (PARTITION BY side ORDER BY hour DESC) AS BIGINT) - n AS earlier
            FROM (SELECT user_id % 2 AS side, date_trunc('hour', ts) AS hour, count(*) AS n FROM {events} GROUP BY 1, 2) h) p ON p.side = e.side AND p.hour = e.hour""",
    "failure_log": f"""
      SELECT event_id AS seq, lpad(CAST(user_id AS STRING), 9, '0') AS pk,
             CASE event_type WHEN 'error' THEN 'fail' WHEN 'purchase' THEN 'success' WHEN 'signup' THEN 'retry' END AS event,
             {pick("event_id % 8", ERRORS)} AS error
      FROM {{events}} WHERE event_type IN ('error', 'purchase', 'signup')""",
    "runs": """
      SELECT earlier + row_number() OVER (PARTITION BY e.hour ORDER BY ts, event_id) AS id, ts AS started_at,
             CASE WHEN event_id % 11 = 0 THEN NULL ELSE ts + CAST(floor(value) AS INT) * INTERVAL 1 MINUTE END AS finished_at
      FROM (SELECT date_trunc('hour', ts) AS hour, ts, event_id, value FROM {events} WHERE event_type = 'signup') e
      JOIN (SELECT hour, CAST(sum(n) OVER (ORDER BY hour) AS BIGINT) - n AS earlier
            FROM (SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM {events} WHERE event_type = 'signup' GROUP BY 1) h) p ON p.hour = e.hour""",
    "library_items": f"""
      SELECT concat('itm', pk) AS id, concat('post ', pk) AS name, CASE WHEN k % 2 = 0 THEN url ELSE substring(url, 1, length(url) - 1) END AS url,
             {pick("k % 4", ["fld0", "fld1|fld2", "", "fld3"])} AS folders, concat('render|', {pick("k % 5", ["mine", "Backlit", "blender", "old", "x"])}) AS tags,
             CASE WHEN k % 2 = 0 THEN concat('words', chr(10), chr(10), 'Visual summary: a shot') ELSE 'words' END AS annotation, k AS modification_time
      FROM {{media}} WHERE k % 3 = 0
      UNION ALL
      SELECT concat('dup', pk), concat('post ', pk), url, 'fld0', 'render', '', k + 1000000 FROM {{media}} WHERE k % 9 = 0
      UNION ALL
      SELECT concat('pg', CAST(page_id AS STRING)), 'page', url, '', '', '', page_id FROM {{pages}}""",
    "latencies": f"""
      SELECT l_suppkey % 3 AS model, l_orderkey AS image, max(l_quantity) / 10 AS seconds, {pick("(l_orderkey + l_suppkey % 3 * (l_orderkey % 2)) % 4", CATEGORIES[:4])} AS category,
             l_orderkey % 17 <> 0 AS ok
      FROM {{lineitem}} GROUP BY l_suppkey % 3, l_orderkey, (l_orderkey + l_suppkey % 3 * (l_orderkey % 2)) % 4""",
    "model_answers": """
      SELECT media_pk, idx, k, replace(replace(CASE (k + idx) % 10
        WHEN 0 THEN '~("category": "art", "confidence": 0.9, "description": "a ~( brace", "tags": ["render", "close-up"])~ ok'
        WHEN 1 THEN concat('```json', chr(10), '~("category": "meme", "confidence": 1.7, "summary": "a joke", "tags": "funny, wide shot")~', chr(10), '```')
        WHEN 2 THEN 'I think this is game footage.'
        WHEN 3 THEN '<think>maybe ~()~</think>~("category": "ad", "confidence": "x", "description": "a can", "tags": [~("tag": "low-key", "evidence": "no light visible")~, ~("tag": "faceless", "evidence": "no face")~, ~("tag": "close-up", "evidence": "tight frame")~])~'
        WHEN 4 THEN '~("category": "poem", "description": "lines", "tags": [])~'
        WHEN 5 THEN 'nothing to see'
        WHEN 6 THEN '~("category": "art", "confidence": 0.4, "on_screen_text": ["A", " ", "B"], "tags": ["x"])~'
        WHEN 7 THEN '~("category": "art", "description": "broken'
        WHEN 8 THEN '~("category": " Art ", "confidence": 0.6, "medium": "CGI", "description": "  two   spaces ")~ )~'
        ELSE '<think>cut off' END, '~(', chr(123)), ')~', chr(125)) AS answer_text
      FROM {files} WHERE kind <> 'thumb'""",
    "frame_features": "SELECT CAST(label AS STRING) AS media_pk, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS frame_no, vec_id, embedding, CAST((vec_id * 37) % 256 AS DOUBLE) AS luma FROM {embeddings}",
}


def _names(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


def view_sql(name: str) -> str:
    """A view's text with the names of its sources bare (single braces name sources, doubled ones are literal)."""
    sql = re.sub(r"(?<!\{)\{(\w+)\}(?!\})", lambda m: m[1] if m[1] in VIEWS or m[1] in TABLES else m[0], VIEWS[name])
    return sql.replace("{{", "{").replace("}}", "}")


def sources(name: str) -> list[str]:
    return [x for x in re.findall(r"(?<!\{)\{(\w+)\}(?!\})", VIEWS[name]) if x in VIEWS or x in TABLES]


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or view of sf_dir."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    parts = {x: frame(spark, sf_dir, x) for x in dict.fromkeys(sources(name))}
    text = VIEWS[name].replace("{{", "\0").replace("}}", "\1")
    text = re.sub(r"\{(\w+)\}", lambda m: f"{{{m[1]}}}", text).replace("\0", "{{").replace("\1", "}}")
    return spark.sql(text, **parts)


def with_views(sql: str) -> str:
    """A DuckDB query with the views that it names, and those that they name, as CTEs."""
    order: list[str] = []

    def need(name: str) -> None:
        if name in VIEWS and name not in order:
            for x in sources(name):
                need(x)
            order.append(name)

    for word in re.findall(r"\b\w+\b", sql):
        need(word)
    if not order:
        return sql
    views = reduce(lambda text, name: f"{text}{name} AS ({view_sql(name)}),\n", order, "")
    body = sql.strip()
    if body[:4].upper() == "WITH":
        rest = body[4:].lstrip()
        recursive = rest[:9].upper() == "RECURSIVE"
        return f"WITH {'RECURSIVE ' * recursive}{views}{rest[9:] if recursive else rest}"
    return f"WITH {views.rstrip().rstrip(',')}\n{body}"
