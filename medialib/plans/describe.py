"""Queries on model answers, requests and frame plans."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import wordlists as W
from ..operators import answers, frames, library, posts, prompts, rules
from ..operators import tags as tag_ops
from ..sources import vocabulary as vocab
from .query import query
from .tagging import PROFILE_CASE, _re, evenly, listed, normal_sql, once_a_post, soft_sql, useful_sql

RAW = "trim(string_split(list_last(string_split(answer_text, '</think>')), '<think>')[1])"


@query(f"SELECT media_pk, idx::BIGINT AS idx, {RAW} AS raw FROM model_answers")
def strip_thinking(v):
    return v.model_answers.select("media_pk", F.col("idx").cast("long").alias("idx"), answers.strip_thinking(F.col("answer_text")).alias("raw"))


#: CTEs r (media_pk, idx, k, raw) and j (also json): the chunks of a text, its strings whole, up to the brace that closes the first one.
JSON = r"""r AS (SELECT media_pk, idx, k, {RAW} AS raw FROM model_answers),
j1 AS (SELECT media_pk, idx, regexp_extract_all(substr(raw, instr(raw, '{')), '(?s)"(?:[^"\\]|\\.)*(?:"|\\?$)|[{}]|[^"{}]+') AS t FROM r WHERE contains(raw, '{')),
j2 AS (SELECT media_pk, idx, t, unnest(range(1, len(t) + 1)) AS i, unnest(t) AS x FROM j1),
j3 AS (SELECT *, sum(CASE x WHEN '{' THEN 1 WHEN '}' THEN -1 ELSE 0 END) OVER (PARTITION BY media_pk, idx ORDER BY i) AS depth FROM j2),
j4 AS (SELECT media_pk, idx, array_to_string(any_value(t)[1:min(i) FILTER (depth = 0)], '') AS json FROM j3 GROUP BY media_pk, idx HAVING count(*) FILTER (depth = 0) > 0),
j AS (SELECT r.*, json FROM r LEFT JOIN j4 USING (media_pk, idx))""".replace("{RAW}", RAW)


@query(f"WITH {JSON} SELECT media_pk, idx::BIGINT AS idx, json FROM j")
def first_json(v):
    return v.model_answers.select("media_pk", F.col("idx").cast("long").alias("idx"), answers.first_json(answers.strip_thinking(F.col("answer_text"))).alias("json"))


def parsed(v):
    return answers.parse_answers(v.model_answers)


def _squeezed(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '\\s+', ' ', 'g'))"


TAG = r"trim(regexp_replace(regexp_replace(lower(trim(regexp_replace(trim(x), '^#+|#+$', '', 'g'))), '\s+', '-', 'g'), '[^\w\-]', '', 'g'), '-')"


def _cleaned(items: str) -> str:
    """clean_tags(): the first 15 of the distinct ones, in order."""
    made = f"list_filter(list_transform({items}, lambda x: {TAG}), lambda x: x <> '' AND length(x) <= 30)"
    return f"(SELECT list_filter(m, lambda x, i: list_position(m, x) = i)[1:15] FROM (SELECT {made} AS m))"


NEGATIVE = "'(?i)\\b(no|not|none|absent|without|unclear|cannot|can''t|n/a)\\b'"
#: After JSON: a (media_pk, idx, k, category, confidence, description, summary, screen_text, tags, rejected, ok).
PARSED = f"""v AS (SELECT *, coalesce(json_valid(json), false) AS valid, lower(trim(coalesce(json ->> '$.category', ''))) AS cat,
  coalesce({', '.join(f"CASE WHEN regexp_matches(raw, '(?i)\\b{c}\\b') THEN '{c}' END" for c in W.CATEGORIES)}) AS named FROM (SELECT media_pk, idx, k, raw, CASE WHEN json_valid(json) THEN json END AS json, json IS NULL AS bare FROM j)),
f AS (SELECT *, valid AND cat IN ({', '.join(f"'{c}'" for c in W.CATEGORIES)}) AS known, bare AND named IS NOT NULL AS guessed, {_squeezed("json ->> '$.summary'")} AS told,
  greatest(0, least(1, coalesce(try_cast(json ->> '$.confidence' AS DOUBLE), 0))) AS sure, coalesce(json -> '$.on_screen_text', json -> '$.screen_text') AS screen, json -> '$.tags' AS t FROM v),
h AS (SELECT *, CASE WHEN json_type(t) = 'ARRAY' THEN list_transform(from_json(t, '["json"]'), lambda x: CASE WHEN json_type(x) = 'OBJECT'
     THEN {{'tag': coalesce(x ->> '$.tag', x ->> '$.name', ''), 'why': coalesce(x ->> '$.evidence', '')}} ELSE {{'tag': x ->> '$', 'why': ''}} END)
   WHEN t IS NULL THEN [] ELSE list_transform(regexp_split_to_array(t ->> '$', '[,;' || chr(10) || ']+'), lambda x: {{'tag': x, 'why': ''}}) END AS items FROM f),
d AS (SELECT *, list_transform(items, lambda x: {{'tag': x.tag, 'no': regexp_matches(x.why, {NEGATIVE}) AND NOT contains(lower(trim(x.tag)), 'less') AND NOT regexp_matches(lower(trim(x.tag)), '^(no-|non-|without-)')}}) AS marked FROM h),
a AS (SELECT media_pk, idx, k, CASE WHEN bare THEN coalesce(named, '') WHEN known THEN cat ELSE '' END AS category, CASE WHEN guessed THEN 0.5::DOUBLE WHEN known THEN sure::DOUBLE ELSE 0.0::DOUBLE END AS confidence,
  CASE WHEN valid THEN (CASE WHEN coalesce(json ->> '$.description', '') = '' THEN told ELSE {_squeezed("json ->> '$.description'")} END)[1:1200] ELSE '' END AS description, CASE WHEN valid THEN told[1:300] ELSE '' END AS summary,
  CASE WHEN valid THEN ({_squeezed("CASE WHEN json_type(screen) = 'ARRAY' THEN array_to_string(list_filter(from_json(screen, '[\"varchar\"]'), lambda x: trim(x) <> ''), ' | ') ELSE screen ->> '$' END")})[1:500] ELSE '' END AS screen_text,
  {_cleaned("list_transform(list_filter(marked, lambda x: NOT x.no), lambda x: x.tag)")} AS tags, {_cleaned("list_transform(list_filter(marked, lambda x: x.no), lambda x: x.tag)")} AS rejected, known OR guessed AS ok FROM d)"""


@query(f"WITH {JSON}, {PARSED} SELECT media_pk, idx::BIGINT AS idx, category, confidence, description, screen_text FROM a")
def parse_answers(v):
    return parsed(v).select("media_pk", F.col("idx").cast("long").alias("idx"), "category", "confidence", "description", "screen_text")


@query(f"WITH {JSON}, {PARSED} SELECT media_pk, idx::BIGINT AS idx, array_to_string(tags, '|') AS tags, array_to_string(rejected, '|') AS rejected FROM a")
def split_tags(v):
    return parsed(v).select("media_pk", F.col("idx").cast("long").alias("idx"), F.array_join("tags", "|").alias("tags"), F.array_join("rejected", "|").alias("rejected"))


#: A word of the caption in some spelling, or a medium in another.
SPELT = "CASE k % 4 WHEN 1 THEN ' Live_Action ' WHEN 2 THEN concat(upper(substring(tag, 1, 1)), substring(tag, 2)) WHEN 3 THEN concat(tag, '?') ELSE tag END"
ALIASED = " ".join(f"WHEN '{raw}' THEN '{tag}'" for raw, tag in W.STARTER_ALIASES.items() if tag in W.MEDIUMS)


@query(f"""SELECT pk, CASE WHEN m IN ({", ".join(f"'{m}'" for m in W.MEDIUMS)}) THEN m ELSE '' END AS medium FROM (SELECT pk, CASE low {ALIASED} ELSE low END AS m FROM (
           SELECT pk, regexp_replace(lower(trim({SPELT})), '[\\s_]+', '-', 'g') AS low FROM (SELECT pk, k, regexp_extract(caption, '#([a-z0-9]+)', 1) AS tag FROM media)))""")
def clean_medium(v):
    rows = v.media.select("pk", "k", F.regexp_extract("caption", "#([a-z0-9]+)", 1).alias("tag"))
    return rows.select("pk", answers.clean_medium(F.expr(SPELT), W.STARTER_ALIASES).alias("medium"))


#: What a slide says besides its answer's tags: the post's caption and the words on screen.
SAID = "SELECT a.media_pk || '_' || a.idx AS id, concat_ws(' ', nullif(caption, ''), nullif(screen_text, '')) AS text, concat_ws(' ', nullif(screen_text, ''), nullif(caption, '')) AS blob FROM a LEFT JOIN media ON pk = a.media_pk"
INGEST = f"SELECT id, CASE WHEN idx % 4 IN (0, 2) THEN 'video' ELSE 'image' END AS mode, list_concat(tags, {useful_sql('blob')}, coalesce(software, [])) AS tags FROM a JOIN said ON id = a.media_pk || '_' || a.idx LEFT JOIN soft USING (id)"
#: The names that the CTEs of the tags take as well.
OWN_PARSED = PARSED.replace("\nh AS", "\nh0 AS").replace("FROM h)", "FROM h0)").replace("d AS (SELECT *, list_transform", "d0 AS (SELECT *, list_transform").replace("ok FROM d)", "ok FROM d0)")


@query(f"""WITH RECURSIVE {JSON}, {OWN_PARSED}, said AS ({SAID}), {soft_sql("SELECT id, text FROM said")}, {normal_sql(INGEST)}
  SELECT n.id, category, confidence, description, array_to_string(kept, '|') AS tags, array_to_string(list_concat(dropped, rejected), '|') AS left_over
  FROM n JOIN a ON n.id = a.media_pk || '_' || a.idx WHERE description <> '' OR summary <> '' OR len(kept) > 1""")
def answer_ingest(v):
    """Rows for the description table: parsed answers with their tags and those that their posts' texts give brought into the vocabulary, and what was left over."""
    captions = v.media.select(F.col("pk").alias("media_pk"), "caption")
    rows = evenly(parsed(v)).join(captions, "media_pk", "left").withColumn("id", F.concat_ws("_", "media_pk", F.col("idx").cast("string")))
    rows = rows.withColumn("mode", posts.tag_mode(F.when(F.col("idx") % 4 % 2 == 0, ".mp4").otherwise(".jpg")))
    useful = rules.useful_tags(rules.joined(F.col("screen_text"), F.col("caption")))
    software = rules.software_tags(rules.joined(F.col("caption"), F.col("screen_text")))
    rows = once_a_post(rows, ["screen_text", "caption"], useful=useful, software=software)
    own = F.array(tag_ops.normalized(F.concat("tags", "useful", "software"), F.col("mode"), vocab.starter()))
    told = F.filter(own, lambda x: (F.col("description") != "") | (F.col("summary") != "") | (F.size(x["kept"]) > 1))
    return rows.select("id", "category", "confidence", "description", "rejected", F.inline(told)).select(
        "id", "category", "confidence", "description", F.array_join("kept", "|").alias("tags"), F.array_join(F.concat("dropped", "rejected"), "|").alias("left_over")
    )


#: A vocabulary file: the starter's lists with titles and notes.
FILE = json.dumps({"version": 2, "categories": [
    {"key": c.key, "title": c.title.upper(), "tags": c.tags, "limit": c.limit, "mode": c.mode, "profiles": list(c.profiles), "note": "the main one" if c.limit == 1 else ""} for c in vocab.starter().categories
]})


def owners(v) -> vocab.Vocabulary:
    return vocab.loaded(v.spark.createDataFrame([(FILE,)], "value string"))


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _lists_sql() -> str:
    """render() of FILE by mode and profiles, an array or null."""
    blocks = []
    for c in vocab.starter().categories:
        if "hidden" in c.profiles:
            continue
        shown = "true" if "core" in c.profiles else f"profiles IS NULL OR list_has_any(profiles, {listed(list(c.profiles))})"
        head = f"{c.title.upper()} — pick 0-{c.limit}" + ("  (the main one)" if c.limit == 1 else "")
        blocks.append(f"CASE WHEN ({'true' if c.mode == 'both' else f'mode = {_text(c.mode)}'}) AND ({shown}) THEN {_text(head + chr(10) + ', '.join(c.tags))} END")
    return "concat_ws(chr(10) || chr(10), " + ", ".join(blocks) + ")"


#: Posts with mode, kind, frames, medium, and profiles that every tenth lacks.
ASKED = f"""q0 AS (SELECT pk, k, username, caption, {listed([*W.MEDIUM_PROFILES, 'x'])}[k % 10 + 1] AS medium, CASE media_type WHEN 2 THEN 'video' ELSE 'image' END AS mode,
  CASE media_type WHEN 2 THEN 'reel' WHEN 8 THEN 'carousel' ELSE '' END AS kind, CASE WHEN media_type <> 2 THEN 1 WHEN duration <= 0 THEN 12 WHEN duration <= 10 THEN 4 WHEN duration <= 30 THEN 8 WHEN duration <= 60 THEN 12 WHEN duration <= 120 THEN 20 ELSE 24 END AS n FROM media),
q1 AS (SELECT *, list_concat(CASE medium {PROFILE_CASE} ELSE {listed(W.UNKNOWN_MEDIUM_PROFILES)} END, CASE WHEN regexp_matches(caption, {_re(W.WORDS_3D)}) THEN ['3d'] ELSE [] END, CASE WHEN regexp_matches(caption, {_re(W.WORDS_GRAPHIC)}) THEN ['graphic'] ELSE [] END) AS c FROM q0),
q2 AS (SELECT *, CASE WHEN k % 10 <> 7 THEN c END AS profiles FROM q1),
q AS (SELECT *, {_lists_sql()} AS lists FROM q2)"""


def asked(v):
    medium = F.element_at(F.array(*map(F.lit, [*W.MEDIUM_PROFILES, "x"])), (F.col("k") % 10 + 1).cast("int"))
    video = F.col("media_type") == 2
    kind = F.when(video, "reel").when(F.col("media_type") == 8, "carousel").otherwise("")
    return v.media.select(
        "pk", "k", "username", "caption", kind.alias("kind"), posts.tag_mode(F.when(video, ".mp4").otherwise(".jpg")).alias("mode"), frames.frame_plan(F.col("duration"), video, 24).cast("int").alias("frames"),
        F.when(F.col("k") % 10 != 7, rules.profiles_for(medium, F.col("caption"))).alias("profiles"),
    )


@query(f"WITH {ASKED} SELECT pk, length(lists)::BIGINT AS n_chars, md5(lists) AS lists FROM q")
def render_vocab(v):
    """The vocabulary's text in the prompt of each post, told by its length and its hash."""
    lists = prompts.render(owners(v), F.col("mode"), F.col("profiles"))
    return asked(v).withColumn("lists", lists).select("pk", F.length("lists").cast("long").alias("n_chars"), F.md5("lists").alias("lists"))


TEMPLATE = "Look at {frames} frames of a {kind} ({mode}).{examples}Lists:\n{taxonomy}"


def _filled_sql(template: str, values: dict) -> str:
    out = _text(template)
    for name, value in values.items():
        out = f"replace({out}, {_text('{' + name + '}')}, {value})"
    return out


_SHAPE = {"frames": "n::VARCHAR", "kind": "CASE kind WHEN '' THEN 'post' ELSE kind END", "mode": "upper(mode)"}
_TEMPLATED = "CASE WHEN k % 3 = 0 THEN " + _filled_sql(prompts.SINGLE_PASS, {"taxonomy": "lists", "examples": "examples"} | _SHAPE) + " ELSE " + _filled_sql(TEMPLATE, {"taxonomy": "lists", "examples": "examples"} | _SHAPE) + " END"
_SECOND = _filled_sql(prompts.TAGS, {"taxonomy": "lists", "summary": "coalesce(trim(summary), '')", "description": "coalesce(trim(description), '')", "ocr": "coalesce(nullif(trim(screen_text), ''), 'none')"} | _SHAPE)


@query(f"""WITH {ASKED}, x AS (SELECT {_text(chr(10) + prompts.EXAMPLES_HEADER + chr(10))} || string_agg('- "' || description || '"', chr(10) ORDER BY k DESC, idx DESC) || chr(10) AS examples
    FROM (SELECT description, k, idx FROM ai_meta WHERE description <> '' ORDER BY k DESC, idx DESC LIMIT 3)),
  y AS (SELECT media_pk, array_to_string(list(name ORDER BY seen_at, collection_pk)[1:4], ', ') AS j FROM membership JOIN collections ON pk = collection_pk GROUP BY media_pk),
  z AS (SELECT q.*, examples, a.summary, a.description, a.screen_text, concat_ws(chr(10), 'Account: @' || username, 'Caption: ' || trim(caption)[1:400],
      'Saved by the owner in collection: ' || j || '.' || CASE WHEN {" OR ".join(f"contains(lower(j), '{m}')" for m in W.TUTORIAL_MARKS)} THEN {_text(prompts.TUTORIAL_HINT)} ELSE '' END,
      {_text(prompts.TRANSCRIPT_LABEL)} || nullif(trim(transcript)[1:1200], '')) AS told
    FROM q CROSS JOIN x LEFT JOIN y ON y.media_pk = q.pk LEFT JOIN (SELECT * FROM ai_meta WHERE idx = 0) a ON a.media_pk = q.pk)
  SELECT pk, md5({_TEMPLATED} || chr(10) || chr(10) || told) AS request, md5({_SECOND} || chr(10) || chr(10) || told) AS tag_request, told FROM z""")
def request_batch(v):
    """Both requests of each post, told by their hashes, and the lines that tell of the post."""
    last = v.ai_meta.where("description <> ''").orderBy(F.desc("k"), F.desc("idx")).limit(prompts.MAX_EXAMPLES).collect()  # three at most
    meta = v.ai_meta.where("idx = 0").select(F.col("media_pk").alias("pk"), "transcript", "summary", "description", "screen_text")
    rows = asked(v).join(meta, "pk", "left").withColumn("template", F.when(F.col("k") % 3 != 0, TEMPLATE))
    made = prompts.request_batch(rows, library.collection_hint(v.membership, v.collections), [r.description for r in last], owners(v))
    return made.select("pk", F.md5("request").alias("request"), F.md5("tag_request").alias("tag_request"), "told")


@query("SELECT media_pk, idx::BIGINT AS idx, sha1(prompt_hash || chr(10) || 'model' || chr(10) || '896px')[1:12] AS hash FROM ai_meta")
def prompt_hash(v):
    return v.ai_meta.select("media_pk", F.col("idx").cast("long").alias("idx"), answers.prompt_hash(F.col("prompt_hash"), F.lit("model"), F.lit(896)).alias("hash"))


STARTER = ", ".join(f"('{c.key}', {no}, {c.limit}, '{t}', {k})" for no, c in enumerate(vocab.starter().categories) for k, t in enumerate(c.tags))


@query(f"""SELECT category, category || ': pick 0-' || lim || chr(10) || string_agg(s.tag, ', ' ORDER BY k) AS block, coalesce(sum(n), 0)::BIGINT AS used
           FROM (VALUES {STARTER}) AS s(category, no, lim, tag, k) LEFT JOIN (SELECT tag, count(*) AS n FROM (SELECT unnest(list_distinct(string_split(tags, chr(10)))) AS tag FROM ai_meta) GROUP BY tag) u USING (tag) GROUP BY category, lim""")
def vocab_usage(v):
    """Vocabulary lists, and how often descriptions use their tags."""
    rows = vocab.tables(v.spark, vocab.starter()).join(tag_ops.tag_frequency(v.ai_meta), "tag", "left")
    lists = rows.groupBy("category", "limit").agg(F.array_sort(F.collect_list(F.struct("place", "tag")))["tag"].alias("t"), F.coalesce(F.sum("n"), F.lit(0)).alias("used"))
    return lists.select("category", F.concat("category", F.lit(": pick 0-"), "limit", F.lit("\n"), F.array_join("t", ", ")).alias("block"), "used")


COUNT = "CASE WHEN kind <> 'video' THEN 1 WHEN d <= 0 THEN 12 WHEN d <= 10 THEN 4 WHEN d <= 30 THEN 8 WHEN d <= 60 THEN 12 WHEN d <= 120 THEN 20 ELSE 32 END"
PLAN = f"SELECT path, least(24, {COUNT})::BIGINT AS n FROM (SELECT path, kind, coalesce(duration, 0) AS d FROM files LEFT JOIN media ON pk = media_pk)"


def planned(v):
    rows = v.files.join(v.media.select(F.col("pk").alias("media_pk"), "duration"), "media_pk", "left")
    return rows.select("path", "k", frames.frame_plan(F.col("duration"), F.col("kind") == "video", 24).cast("int").alias("count"))


@query(PLAN)
def frame_plan(v):
    return planned(v).select("path", F.col("count").cast("long").alias("n"))


@query(f"""WITH p AS (SELECT path, n, 6000 + (n * 100) AS ctx FROM ({PLAN})), s AS (SELECT *, unnest([896, 768, 640, 512]) AS side, 0 AS less FROM p UNION ALL SELECT *, 512, unnest(range(1, greatest(1, n - 2))) FROM p),
f AS (SELECT path, n - less AS c, side, less, (n - less) * round_even((side / 32) * (side * 9 / 16 / 32), 0) + 3500 <= ctx AS ok FROM s)
SELECT path, c AS fit_count, side::BIGINT AS fit_side FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ok DESC, CASE WHEN ok THEN less ELSE -less END, CASE WHEN ok THEN -side ELSE side END) AS q FROM f) WHERE q = 1""")
def fit_plan(v):
    rows = planned(v).withColumn("side", F.lit(896)).withColumn("context", F.lit(6000) + F.col("count") * 100)
    return frames.fit_plan(rows).select("path", F.col("fit_count").cast("long").alias("fit_count"), F.col("fit_side").cast("long").alias("fit_side"))


@query("""SELECT pk, array_to_string(CASE WHEN n = 1 THEN [floor(t * 0.5)::BIGINT] ELSE list_transform(range(0, n), lambda i: greatest(0, least(t - 1, floor(t * (a + (1.0::DOUBLE - 2 * a) / (n - 1) * i)::DOUBLE)::BIGINT))) END, '|') AS frames
          FROM (SELECT pk, k % 90 + 1 AS t, k % 7 + 1 AS n, CASE WHEN k % 90 + 1 > 30 THEN 0.06::DOUBLE ELSE 0.0::DOUBLE END AS a FROM media)""")
def even_positions(v):
    return v.media.select("pk", F.array_join(frames.even_positions(F.col("k") % 90 + 1, F.col("k") % 7 + 1), "|").alias("frames"))
