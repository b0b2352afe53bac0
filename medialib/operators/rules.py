"""Transparent text rules: what a post is, what it is useful for, which software it names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import wordlists as W
from ..functions.lookup import lookup
from ..functions.text import hashtags, text


def account_hit(name: Column, hints: list[str]) -> Column:
    """The first hint that is a whole part of an account's name, or stands at its start or end by itself; else null."""
    low = F.lower(text(name))
    parts = F.split(low, "[^a-z0-9]+")

    def hit(hint: str) -> Column:
        n = len(hint)
        before, after = F.substring(low, -n - 1, 1), F.substring(low, n + 1, 1)
        longer = F.length(low) > n
        return F.array_contains(parts, hint) | (low.startswith(hint) & longer & ~after.rlike(r"[\p{L}\p{N}]")) | (low.endswith(hint) & longer & ~before.rlike(r"[\p{L}\p{N}]"))

    return F.coalesce(*[F.when(hit(h), F.lit(h)) for h in hints])


def _score(hits: Column) -> Column:
    return F.least(F.size(hits), F.lit(2))


def classify(posts: DataFrame, block: list[str] = (), allow: list[str] = (), max_meme_seconds: float = 0.0) -> DataFrame:
    """pk, decision (download, skip, review), art, meme, ad of posts (pk, username, full_name, caption, duration, paid, sponsors)."""
    tags = hashtags(F.col("caption"), None)

    def among(words: list[str]) -> Column:
        return F.array_intersect(tags, F.array(*map(F.lit, words)))

    def account(hints: list[str]) -> Column:
        return F.coalesce(account_hit(F.col("username"), hints), account_hit(F.col("full_name"), hints)).isNotNull().cast("int")

    low = F.lower(text(F.col("caption")))
    phrase = F.lit(False)
    for words in W.AD_PHRASES:
        phrase = phrase | low.contains(words)
    ad = 3 * F.coalesce(F.col("paid"), F.lit(False)).cast("int") + 3 * (F.coalesce("sponsors", F.lit(0)) > 0).cast("int") + 2 * (F.size(among(W.AD_TAGS)) > 0).cast("int") + 2 * phrase.cast("int")
    rows = posts.withColumn("_art", among(W.ART_TAGS)).withColumn("ad", ad)
    rows = rows.withColumn("art", _score(F.col("_art")) + account(W.ART_ACCOUNT_HINTS))
    short = F.lit(max_meme_seconds > 0) & (F.col("duration") > 0) & (F.col("duration") <= max_meme_seconds) & (F.col("art") == 0)
    rows = rows.withColumn("meme", _score(among(W.MEME_TAGS)) + 2 * account(W.MEME_ACCOUNT_HINTS) + F.coalesce(short, F.lit(False)).cast("int"))
    name = F.lower(text(F.col("username")))
    decision = (
        F.when(name.isin([b.lower() for b in block]), "skip").when(name.isin([a.lower() for a in allow]), "download")
        .when(F.col("ad") >= 2, "download").when((F.size("_art") > 0) & (F.col("art") > F.col("meme")), "download")
        .when((F.col("meme") >= 2) & (F.col("art") == 0), "skip").otherwise("review")
    )
    return rows.select("pk", decision.alias("decision"), *[F.col(c).cast("long").alias(c) for c in ("art", "meme", "ad")])


def model_decision(ok: Column, category: Column, confidence: Column, skip: list[str], least: float = 0.55) -> Column:
    """skip, download or null (undecided) from a model's answer."""
    sure = ok & (confidence >= least)
    return F.when(sure & category.isin(skip), "skip").when(sure & category.isin("art", "ad"), "download")


def judge_liked(rows: DataFrame, enabled=True, uncertain: str = "review") -> DataFrame:
    """rows (collection_pk, rules, model) with final: only the liked collection is judged; rules, then the model, then `uncertain`."""
    judged = F.when(F.col("rules") != "review", F.col("rules")).otherwise(F.coalesce("model", F.lit(uncertain)))
    return rows.withColumn("final", F.when((F.col("collection_pk") == "liked") & F.lit(enabled), judged).otherwise("download"))


def route(final: Column, by_model: Column, held: Column, glance: bool) -> Column:
    """Where a post goes: skip, review:source or import."""
    return F.when(final == "skip", F.when(by_model & F.lit(glance), "review:model").otherwise("skip")).when(held, "review:dupe").when(final == "review", "review:rules").otherwise("import")


def useful_tags(blob: Column) -> Column:
    """What a post is useful for, in rule order; with software-tip and useful where they follow."""
    none = F.array().cast("array<string>")

    def all_of(x: Column) -> Column:
        content = F.arrays_overlap(x["found"], F.array(*map(F.lit, W.CONTENT_TAGS)))
        tip = F.when(content & x["blob"].rlike("(?iUd)" + W.SOFTWARE), F.array(F.lit("software-tip"))).otherwise(none)
        return F.concat(x["found"], tip, F.when(content, F.array(F.lit("useful"))).otherwise(none))

    def told(text: Column) -> Column:
        found = F.filter(F.array(*[F.when(text.rlike("(?iUd)" + p), F.lit(tag)) for tag, p in W.USEFUL_RULES.items()]), lambda t: t.isNotNull())
        return F.struct(text.alias("blob"), found.alias("found"))

    return F.transform(F.transform(F.array(blob), told), all_of)[0]  # the text and its rules are worked out once


def joined(*parts: Column) -> Column:
    return F.concat_ws(" ", *[F.nullif(text(p), F.lit("")) for p in parts])


def software_phrases() -> dict[str, str]:
    """Phrases of one to three words, by their words; later entries win."""
    table: dict[str, str] = {}
    for name, tag in [*((t, t) for t in W.SOFTWARE_TAGS), *W.SOFTWARE_ALIASES.items()]:
        table[name.replace("-", " ")] = tag
        table[name.replace("-", "")] = tag
    return table | W.SOFTWARE_PHRASES


def software_tags(blob: Column) -> Column:
    """The software that a text names, by appearance: the longest phrase first, left to right; doubtful words only as hashtags.

    The phrases are looked up by a hash; a row needs no other. A null text names none.
    """
    find = lookup({p: (len(p.split()), t) for p, t in software_phrases().items()}, {"n": "int", "tag": "string"})
    begins = lookup({w: (True,) for p in software_phrases() if " " in p for w in p.split()[:1]}, {"there": "boolean"})
    words = F.regexp_extract_all(F.lower(F.coalesce(blob, F.lit(""))), F.lit("(#?[a-z0-9]+)"), F.lit(1))

    def at(tokens: Column, i: Column) -> Column:
        own = [F.ltrim(F.get(tokens, i + k), F.lit("#")) for k in range(3)]
        longer = F.coalesce(*[find(F.concat(*[x for k in range(n) for x in (F.lit(" "), own[k])][1:])) for n in (3, 2)])
        alone = F.when(~F.get(tokens, i).isin(W.AMBIGUOUS_SOFTWARE), find(own[0]))
        return F.struct(i.alias("at"), F.coalesce(F.when(begins(own[0]).isNotNull(), longer), alone).alias("b"))

    def greedy(spans: Column) -> Column:
        start = F.struct(F.lit(0).alias("free"), F.array().cast("array<string>").alias("found"))
        step = lambda s, x: F.when(x["at"] < s["free"], s).otherwise(F.struct((x["at"] + x["b"]["n"]).alias("free"), F.concat(s["found"], F.array(x["b"]["tag"])).alias("found")))
        return F.aggregate(F.filter(spans, lambda x: x["b"].isNotNull()), start, step, lambda s: F.array_distinct(s["found"]))

    each = lambda tokens: greedy(F.transform(F.sequence(F.lit(0), F.size(tokens)), lambda i: at(tokens, i)))
    return F.transform(F.array(words), each)[0]  # one text: its words are worked out once


def profiles_for(medium: Column, words: Column) -> Column:
    """The vocabulary profiles that a medium and words of a text call for, in their order."""
    chosen = F.array(*map(F.lit, W.UNKNOWN_MEDIUM_PROFILES))
    for name, profiles in W.MEDIUM_PROFILES.items():
        chosen = F.when(medium == name, F.array(*map(F.lit, profiles))).otherwise(chosen)
    chosen = F.when(words.rlike("(?iUd)" + W.WORDS_3D), F.array_union(chosen, F.array(F.lit("3d")))).otherwise(chosen)
    chosen = F.when(words.rlike("(?iUd)" + W.WORDS_GRAPHIC), F.array_union(chosen, F.array(F.lit("graphic")))).otherwise(chosen)
    return F.array_intersect(F.array(*map(F.lit, W.PROFILE_ORDER)), chosen)
