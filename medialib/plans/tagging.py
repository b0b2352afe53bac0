"""Queries of the rules and of the controlled vocabulary."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import wordlists as W
from ..operators import library, merge, posts, rules
from ..operators import tags as ops
from ..sources import vocabulary as vocab
from .query import query


def values(rows, names: str) -> str:
    def one(x):
        return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)

    return f"(VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS v({names})"


def listed(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


TOKENS = "list_filter(string_split_regex(lower(username), '[^a-z0-9]+'), lambda t: t <> '')"


def hit_sql(hints) -> str:
    def one(h):
        n = len(h)
        return f"list_contains(parts, '{h}') OR (starts_with(low, '{h}') AND length(low) > {n} AND NOT regexp_matches(low[{n + 1}], '[\\p{{L}}\\p{{N}}]')) OR (ends_with(low, '{h}') AND length(low) > {n} AND NOT regexp_matches(low[length(low) - {n}], '[\\p{{L}}\\p{{N}}]'))"

    return "CASE " + " ".join(f"WHEN {one(h)} THEN '{h}'" for h in hints) + " END"


@query(f"SELECT username, {hit_sql(W.ART_ACCOUNT_HINTS)} AS art_hint, {hit_sql(W.MEME_ACCOUNT_HINTS)} AS meme_hint, count(*) AS n FROM (SELECT username, lower(username) AS low, {TOKENS} AS parts FROM media) GROUP BY ALL")
def account_hit(v):
    hint = [rules.account_hit(F.col("username"), h) for h in (W.ART_ACCOUNT_HINTS, W.MEME_ACCOUNT_HINTS)]
    return v.media.groupBy("username", hint[0].alias("art_hint"), hint[1].alias("meme_hint")).agg(F.count(F.lit(1)).alias("n"))


CLASSIFY = f"""c AS (SELECT pk, k, username, lower(username) AS low, {TOKENS} AS parts, lower(caption) AS cap, paid, sponsors, duration,
  list_distinct(list_transform(regexp_extract_all(caption, '{W.HASHTAG}', 1), lambda t: lower(t))) AS h FROM media),
s AS (SELECT *, 3 * paid::INT + 3 * (sponsors > 0)::INT + 2 * (len(list_intersect(h, {listed(W.AD_TAGS)})) > 0)::INT
  + 2 * ({' OR '.join(f"contains(cap, '{p}')" for p in W.AD_PHRASES)})::INT AS ad,
  len(list_intersect(h, {listed(W.ART_TAGS)})) AS a, least(2, len(list_intersect(h, {listed(W.ART_TAGS)}))) + (({hit_sql(W.ART_ACCOUNT_HINTS)}) IS NOT NULL)::INT AS art,
  least(2, len(list_intersect(h, {listed(W.MEME_TAGS)}))) + 2 * (({hit_sql(W.MEME_ACCOUNT_HINTS)}) IS NOT NULL)::INT AS m FROM c),
u AS (SELECT *, m + (duration > 0 AND duration <= 30 AND art = 0)::INT AS meme FROM s),
r AS (SELECT pk, k, CASE WHEN low = 'myfriend' THEN 'skip' WHEN low = 'bob' THEN 'download' WHEN ad >= 2 THEN 'download' WHEN a > 0 AND art > meme THEN 'download'
  WHEN meme >= 2 AND art = 0 THEN 'skip' ELSE 'review' END AS decision, art::BIGINT AS art, meme::BIGINT AS meme, ad::BIGINT AS ad FROM u)"""


def classified(v):
    return rules.classify(v.media.withColumn("full_name", F.lit("")), ["myfriend"], ["Bob"], 30.0)


@query(f"WITH {CLASSIFY} SELECT pk, decision, art, meme, ad FROM r")
def classify_rules(v):
    return classified(v)


def judged(v):
    ok, category = F.col("k") % 5 != 0, F.element_at(F.array(*map(F.lit, W.CATEGORIES)), (F.col("k") % 5 + 1).cast("int"))
    model = rules.model_decision(ok, category, (F.col("k") % 10) / 10, ["meme", "game"])
    rows = classified(v).withColumnRenamed("decision", "rules").join(v.media.select("pk", "k"), "pk")
    rows = rows.select("pk", "k", "rules", model.alias("model"), F.when(F.col("k") % 2 == 0, "liked").otherwise("saved").alias("collection_pk"))
    return rules.judge_liked(rows)


JUDGED = f"""{CLASSIFY}, q AS (SELECT pk, k, decision AS rules, CASE WHEN k % 5 <> 0 AND (k % 10) / 10 >= 0.55 THEN CASE WHEN k % 5 IN (0, 3) THEN 'skip' WHEN k % 5 IN (1, 2) THEN 'download' END END AS model FROM r),
j AS (SELECT pk, k, rules, model, CASE WHEN k % 2 = 0 THEN CASE WHEN rules <> 'review' THEN rules ELSE coalesce(model, 'review') END ELSE 'download' END AS final FROM q)"""


@query(f"WITH {JUDGED} SELECT pk, final FROM j")
def judge_liked(v):
    return judged(v).select("pk", "final")


@query(f"WITH {JUDGED} SELECT pk, coalesce(model, '') AS model FROM j")
def model_decision(v):
    return judged(v).select("pk", F.coalesce("model", F.lit("")).alias("model"))


@query(f"""WITH {JUDGED} SELECT pk, CASE WHEN final = 'skip' THEN CASE WHEN rules = 'review' AND k % 2 = 0 THEN 'review:model' ELSE 'skip' END WHEN k % 7 = 0 THEN 'review:dupe' WHEN final = 'review' THEN 'review:rules' ELSE 'import' END AS route FROM j""")
def route_posts(v):
    rows = judged(v)
    by_model = (F.col("rules") == "review") & (F.col("k") % 2 == 0)
    return rows.select("pk", rules.route(F.col("final"), by_model, F.col("k") % 7 == 0, True).alias("route"))


def _re(pattern: str) -> str:
    return "'(?i)" + pattern.replace("'", "''") + "'"


def useful_sql(blob: str) -> str:
    found = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({blob}, {_re(p)}) THEN '{t}' END" for t, p in W.USEFUL_RULES.items()) + "], lambda t: t IS NOT NULL)"
    return f"(SELECT list_concat(f, CASE WHEN list_has_any(f, {listed(W.CONTENT_TAGS)}) AND regexp_matches({blob}, {_re(W.SOFTWARE)}) THEN ['software-tip'] ELSE [] END, CASE WHEN list_has_any(f, {listed(W.CONTENT_TAGS)}) THEN ['useful'] ELSE [] END) FROM (SELECT {found} AS f))"


@query(f"SELECT pk, array_to_string({useful_sql('caption')}, '|') AS useful FROM media")
def useful_tags(v):
    return v.media.select("pk", F.array_join(rules.useful_tags(F.col("caption")), "|").alias("useful"))


def soft_sql(source: str) -> str:
    """CTEs t (the words of source rows id, text) to soft (id, software: the names in order), for those that name any."""
    return f"""t AS (SELECT id, regexp_extract_all(lower(text), '(#?[a-z0-9]+)', 1) AS t FROM ({source})),
p AS (SELECT id, t, unnest(range(1, len(t) + 1)) AS i FROM t),
m AS (SELECT id, i, n, tag FROM p, (VALUES (1), (2), (3)) AS s(n), {values([(a, b, len(a.split())) for a, b in rules.software_phrases().items()], 'phrase, tag, size')}
  WHERE size = n AND i + n - 1 <= len(t) AND phrase = array_to_string(list_transform(t[i:i+n-1], lambda w: ltrim(w, '#')), ' ') AND NOT (n = 1 AND list_contains({listed(W.AMBIGUOUS_SOFTWARE)}, t[i]))),
b AS (SELECT id, i, max(n) AS n, arg_max(tag, n) AS tag FROM m GROUP BY id, i),
greedy AS (SELECT id, i, n, tag FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i) AS q FROM b) WHERE q = 1
      UNION ALL SELECT b.id, b.i, b.n, b.tag FROM greedy JOIN b ON b.id = greedy.id AND b.i = (SELECT min(c.i) FROM b c WHERE c.id = greedy.id AND c.i >= greedy.i + greedy.n)),
soft AS (SELECT id, list(tag ORDER BY i) AS software FROM (SELECT id, tag, min(i) AS i FROM greedy GROUP BY id, tag) GROUP BY id)"""


@query(f"WITH RECURSIVE {soft_sql('SELECT pk AS id, caption AS text FROM media')} SELECT pk, coalesce(array_to_string(software, '|'), '') AS software FROM media LEFT JOIN soft ON id = pk")
def software_tags(v):
    return v.media.select("pk", F.array_join(rules.software_tags(F.col("caption")), "|").alias("software"))


CLEAN = "trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(regexp_replace(trim(x), '^#+|#+$', ''))), '[\\s_]+', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-{2,}', '-', 'g'), '-')"
#: What a raw tag stands for in a mode, from the lists themselves: an alias of the mode, an alias, the tag; the alias only if its target fits or the tag doesn't.
RESOLVED = f"""(WITH l AS (SELECT no, category, lim, cmode, trim(t) AS tag FROM {values([(no, key, limit, mode, tags) for no, (key, limit, mode, _, tags) in enumerate(W.STARTER_CATEGORIES)], 'no, category, lim, cmode, tags')}, unnest(string_split(tags, ',')) AS u(t)),
  al AS (SELECT * FROM {values(W.STARTER_ALIASES.items(), 'raw, target')}), ma AS (SELECT * FROM {values([(m, a, b) for m, x in W.MODE_ALIASES.items() for a, b in x.items()], 'mode, raw, target')}),
  modes AS (SELECT unnest(['image', 'video']) AS mode), fit AS (SELECT mode, tag, arg_min(category, no) AS category, arg_min(lim, no) AS lim FROM l, modes WHERE cmode IN ('both', mode) GROUP BY mode, tag),
  raws AS (SELECT mode, tag AS raw FROM l, modes UNION SELECT mode, raw FROM al, modes UNION SELECT mode, raw FROM ma),
  named AS (SELECT r.mode, r.raw, coalesce(ma.target, CASE WHEN al.target IS NULL OR (t.tag IS NULL AND o.tag IS NOT NULL) THEN r.raw ELSE al.target END) AS tag
    FROM raws r LEFT JOIN ma ON ma.mode = r.mode AND ma.raw = r.raw LEFT JOIN al ON al.raw = r.raw LEFT JOIN fit t ON t.mode = r.mode AND t.tag = al.target LEFT JOIN fit o ON o.mode = r.mode AND o.tag = r.raw)
  SELECT named.mode, named.raw, named.tag, category, lim, rival FROM named LEFT JOIN fit ON fit.mode = named.mode AND fit.tag = named.tag
  LEFT JOIN {values([(t, no) for no, g in enumerate(W.EXCLUSIVE) for t in g], 'tag, rival')} ON v.tag = named.tag) AS v"""


def normal_sql(source: str) -> str:
    """CTEs e (the tags of source rows id, mode, tags in order) to n (id, kept, dropped)."""
    return f"""o AS ({source}),
e0 AS (SELECT id, mode, unnest(range(1, len(tags) + 1)) AS pos, unnest(tags) AS x FROM o),
e1 AS (SELECT id, mode, pos, {CLEAN} AS raw FROM e0),
e2 AS (SELECT id, pos, coalesce(v.tag, e1.raw) AS tag, category, lim, rival FROM e1 LEFT JOIN {RESOLVED} ON v.mode = e1.mode AND v.raw = e1.raw WHERE e1.raw NOT IN ('', 'autotagged') AND NOT list_contains({listed(W.IGNORED_TAGS)}, e1.raw)),
e AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS n FROM e2 WHERE NOT list_contains({listed(W.IGNORED_TAGS)}, tag)),
g AS (SELECT id, 0::BIGINT AS n, []::VARCHAR[] AS kept, []::VARCHAR[] AS cats, []::INT[] AS rivals, []::VARCHAR[] AS dropped FROM o UNION ALL
  SELECT id, m, CASE WHEN ok THEN list_append(kept, tag) ELSE kept END, CASE WHEN ok THEN list_append(cats, category) ELSE cats END,
         CASE WHEN ok AND rival IS NOT NULL THEN list_append(rivals, rival::INT) ELSE rivals END, CASE WHEN category IS NULL AND NOT list_contains(kept, tag) THEN list_append(dropped, tag) ELSE dropped END
  FROM (SELECT g.*, e.n AS m, e.tag, e.category, e.rival, category IS NOT NULL AND NOT list_contains(kept, e.tag) AND NOT coalesce(list_contains(rivals, e.rival::INT), false)
          AND len(list_filter(cats, lambda c: c = e.category)) < e.lim AS ok FROM g JOIN e ON e.id = g.id AND e.n = g.n + 1) h),
n AS (SELECT id, list_append(arg_max(kept, n), 'autotagged') AS kept, arg_max(dropped, n) AS dropped FROM g GROUP BY id)"""


SLIDE = "SELECT media_pk || '_' || idx AS id, CASE WHEN idx % 4 IN (0, 2) THEN 'video' ELSE 'image' END AS mode, {} AS tags FROM ai_meta"


def evenly(rows, key="media_pk"):
    """rows dealt out by key to as many tasks as a shuffle has: what follows costs by the row, while a shuffle's own size is told by bytes."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def once_a_post(rows, texts, **columns):
    """rows with columns of texts, which are worked out once for the slides of a post that say the same; a group is a post's slides at most."""
    slide = F.struct(*[c for c in rows.columns if c not in ("media_pk", *texts)])
    groups = rows.groupBy("media_pk", *texts).agg(F.collect_list(slide).alias("_slides")).withColumns(columns)
    return groups.select("media_pk", *texts, *columns, F.inline("_slides"))


def slides(v):
    mode = posts.tag_mode(F.when(F.col("idx") % 4 % 2 == 0, ".mp4").otherwise(".jpg"))
    return evenly(v.ai_meta).select(F.concat_ws("_", "media_pk", "idx").alias("id"), "media_pk", "k", mode.alias("mode"), F.filter(F.split("tags", "\n"), lambda t: t != "").alias("tags"), "screen_text", "transcript")


@query(f"WITH RECURSIVE {normal_sql(SLIDE.format('string_split(tags, chr(10))'))} SELECT id, array_to_string(kept, '|') AS kept, array_to_string(dropped, '|') AS dropped FROM n")
def normalize_tags(v):
    return ops.normalize_tags(slides(v), vocab.starter()).select("id", F.array_join("kept", "|").alias("kept"), F.array_join("dropped", "|").alias("dropped"))


BLOB = "concat_ws(' ', nullif(screen_text, ''), nullif(caption, ''), nullif(transcript, ''))"
ALL_TAGS = f"list_concat(string_split(tags, chr(10)), {useful_sql(BLOB)})"


def renormal(v):
    """Described slides whose tags change: what they and their post's caption say is brought into the vocabulary; slides without tags stay as they are."""
    captions = v.media.select(F.col("pk").alias("media_pk"), "caption")
    rows = slides(v).where(F.size("tags") > 0).join(captions, "media_pk", "left")
    useful = rules.useful_tags(rules.joined(F.col("screen_text"), F.col("caption"), F.col("transcript")))
    rows = once_a_post(rows, ["screen_text", "caption", "transcript"], useful=useful)
    own = F.array(ops.normalized(F.concat("tags", "useful"), F.col("mode"), vocab.starter()))
    changed = F.filter(own, lambda x: F.transform("tags", F.lower) != F.transform(x["kept"], F.lower))
    return rows.select("*", F.inline(changed))  # a filter would work the tags out twice


NORMAL = normal_sql(SLIDE.format(ALL_TAGS) + " LEFT JOIN media ON pk = media_pk WHERE tags <> ''")
CHANGED = "c AS (SELECT media_pk, k, n.id, kept, string_split(tags, chr(10)) AS old FROM n JOIN ai_meta ON media_pk || '_' || idx = n.id WHERE list_transform(string_split(tags, chr(10)), lambda t: lower(t)) <> list_transform(kept, lambda t: lower(t)))"


@query(f"WITH RECURSIVE {NORMAL}, {CHANGED} SELECT id, array_to_string(kept, '|') AS kept FROM c")
def normalize_library(v):
    return renormal(v).select("id", F.array_join("kept", "|").alias("kept"))


#: CTEs up to own (media_pk, id, tags): the library's items of each post, by the id that an import has, else by url.
ITEMS = """by_id AS (SELECT media_pk, i.id, i.tags FROM (SELECT media_pk, max(item_id) AS id FROM imports WHERE item_id <> '' GROUP BY media_pk) JOIN library_items i USING (id)),
own AS (SELECT * FROM by_id UNION ALL SELECT pk, i.id, i.tags FROM media JOIN library_items i ON rtrim(i.url, '/') = rtrim(media.url, '/') WHERE rtrim(media.url, '/') <> '' AND pk NOT IN (SELECT media_pk FROM by_id))"""


def items_of_posts(v):
    return library.items_of_posts(v.media.select(F.col("pk").alias("media_pk"), "url"), v.imports, v.library_items.select("id", "url", "tags"))


@query(f"""WITH RECURSIVE {NORMAL}, {CHANGED}, {ITEMS}, x AS (SELECT c.id, i.id AS item_id, list_concat(list_filter(string_split(i.tags, '|'), lambda t: NOT list_contains(list_transform(old, lambda o: lower(o)), lower(t))), kept) AS w FROM c JOIN own i USING (media_pk))
  SELECT id, item_id, array_to_string(list_filter(w, lambda t, q: list_position(list_transform(w, lambda o: lower(o)), lower(t)) = q AND trim(t) <> '')[1:60], '|') AS tags FROM x""")
def retag_manifest(v):
    """The library's items of changed slides with their new tags; normalize_stats counts the slides that have none."""
    items = items_of_posts(v).select("media_pk", F.col("id").alias("item_id"), F.split("tags", r"\|").alias("theirs"))
    rows = renormal(v).join(items, "media_pk")
    return rows.select("id", "item_id", F.array_join(ops.merge_tags(F.col("theirs"), F.col("tags"), F.col("kept")), "|").alias("tags"))


@query(f"""WITH w AS (SELECT id, string_split(tags || '|MINE|Render|new', '|') AS t FROM library_items) SELECT id, array_to_string(list_filter(t, lambda x, q: list_position(list_transform(t, lambda o: lower(o)), lower(x)) = q AND trim(x) <> ''), '|') AS tags FROM w""")
def merge_tags(v):
    new = F.array(F.lit("MINE"), F.lit("Render"), F.lit("new"))
    return v.library_items.select("id", F.array_join(ops.merge_tags(F.split("tags", r"\|"), F.array(F.lit("-")), new), "|").alias("tags"))


VOCAB = values([(t,) for c in vocab.starter().categories for t in c.tags], "tag")
USED = "(SELECT tag, count(*) AS n FROM (SELECT unnest(list_distinct(string_split(tags, chr(10)))) AS tag FROM ai_meta) WHERE tag <> 'autotagged' GROUP BY tag)"


@query(f"""WITH t AS (SELECT count(*) AS n FROM ai_meta WHERE len(list_filter(string_split(tags, chr(10)), lambda t: t NOT IN ('', 'autotagged'))) > 0), u AS {USED}
  SELECT 'total' AS kind, '' AS tag, n FROM t UNION ALL SELECT 'size', '', (SELECT count(DISTINCT tag) FROM {VOCAB}) UNION ALL SELECT 'overused', tag, (100 * u.n // t.n)::BIGINT FROM u, t WHERE u.n / t.n > 0.4
  UNION ALL SELECT 'dead', tag, count(*) FROM {VOCAB} WHERE tag NOT IN (SELECT tag FROM u) GROUP BY tag UNION ALL (SELECT 'top', tag, n FROM u ORDER BY n DESC, tag LIMIT 15)""")
def vocabulary_report(v):
    return ops.vocabulary_report(v.ai_meta, vocab.starter())


@query(f"SELECT DISTINCT tag FROM {VOCAB} WHERE tag NOT IN (SELECT tag FROM {USED})")
def dead_tags(v):
    return vocab.tables(v.spark, vocab.starter()).select("tag").join(ops.tag_frequency(v.ai_meta), "tag", "left_anti").distinct()


@query(f"""SELECT mode, raw, tag, coalesce(category, '') AS category, count(*) AS n FROM (SELECT CASE WHEN idx % 4 IN (0, 2) THEN 'video' ELSE 'image' END AS mode, unnest(list_distinct(string_split(tags, chr(10)))) AS raw FROM ai_meta)
  JOIN {RESOLVED} USING (mode, raw) GROUP BY ALL""")
def vocab_lookup(v):
    """Raw tags in use that the vocabulary knows, with what they stand for in their mode."""
    known = v.spark.createDataFrame([r[:4] for r in ops.resolution(vocab.starter())], "mode string, raw string, tag string, category string")
    each = slides(v).select("mode", F.explode(F.array_distinct("tags")).alias("raw"))
    return each.groupBy("mode", "raw").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(known), ["mode", "raw"]).withColumn("category", F.coalesce("category", F.lit("")))


PROFILE_CASE = " ".join(f"WHEN '{m}' THEN {listed(p)}" for m, p in W.MEDIUM_PROFILES.items())


@query(f"""WITH m AS (SELECT pk, caption, {listed([*W.MEDIUM_PROFILES, 'x'])}[k % 10 + 1] AS medium FROM media),
  c AS (SELECT pk, list_concat(CASE medium {PROFILE_CASE} ELSE {listed(W.UNKNOWN_MEDIUM_PROFILES)} END, CASE WHEN regexp_matches(caption, {_re(W.WORDS_3D)}) THEN ['3d'] ELSE [] END, CASE WHEN regexp_matches(caption, {_re(W.WORDS_GRAPHIC)}) THEN ['graphic'] ELSE [] END) AS c FROM m)
  SELECT pk, array_to_string(list_filter({listed(W.PROFILE_ORDER)}, lambda p: list_contains(c, p)), '|') AS profiles FROM c""")
def profiles_for(v):
    medium = F.element_at(F.array(*map(F.lit, [*W.MEDIUM_PROFILES, "x"])), (F.col("k") % 10 + 1).cast("int"))
    return v.media.select("pk", F.array_join(rules.profiles_for(medium, F.col("caption")), "|").alias("profiles"))


@query("""WITH r AS (SELECT media_pk, verdict AS proposed, CASE WHEN verdict = 'skip' THEN 'dropped' ELSE 'kept' END AS decided FROM review WHERE decided IS NULL AND source = 'model')
  SELECT 'decision' AS output, media_pk, decided AS value FROM r UNION ALL SELECT 'agreement', media_pk, proposed || '>' || decided FROM r UNION ALL SELECT 'skip', media_pk, '' FROM r WHERE decided = 'dropped'
  UNION ALL SELECT 'delete', r.media_pk, path FROM r JOIN files f ON f.media_pk = r.media_pk WHERE decided = 'dropped'""")
def bulk_agree(v):
    """The model's proposals accepted for all that waits by its word: decisions, agreement rows, skip marks and files to delete."""
    decisions, agreement, skips, files = merge.accept_proposals(v.review, v.files)
    row = lambda rows, name, value: rows.select(F.lit(name).alias("output"), "media_pk", value.alias("value"))
    out = row(decisions, "decision", F.col("decided")).unionByName(row(agreement, "agreement", F.concat("proposed", F.lit(">"), "decided")))
    return out.unionByName(row(skips, "skip", F.lit(""))).unionByName(row(files, "delete", F.col("path")))


@query("""SELECT DISTINCT lower(username) AS account, CASE WHEN k % 10 IN (0, 5) THEN 'allow' ELSE 'block' END AS list FROM media WHERE username <> '' AND k % 10 IN (0, 5, 8)""")
def account_lists(v):
    rows = v.media.where("username <> '' and k % 10 in (0, 5, 8)")
    return rows.select(F.lower("username").alias("account"), F.when((F.col("k") % 10).isin(0, 5), "allow").otherwise("block").alias("list")).distinct()


OVERLAY = values([("render", "mine"), ("new", "own"), *((a, b) for a, b in W.STARTER_ALIASES.items() if a not in ("render", "new"))], "raw, target")


@query(f"SELECT raw, target, count(*) AS n FROM (SELECT unnest(string_split(tags, chr(10))) AS raw FROM ai_meta) JOIN {OVERLAY} USING (raw) GROUP BY raw, target")
def vocab_overlay(v):
    """What raw tags in use stand for: by a file's aliases, and by the built-in ones where the file has none."""
    file = v.spark.createDataFrame([("render", "mine"), ("new", "own")], "raw string, target string")
    each = v.ai_meta.select(F.explode(F.split("tags", "\n")).alias("raw"))
    return each.join(F.broadcast(vocab.overlay(file, vocab.built_in_aliases(v.spark))), "raw").groupBy("raw", "target").agg(F.count(F.lit(1)).alias("n"))
