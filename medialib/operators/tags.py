"""Free tags forced into a controlled vocabulary, and reports on how it is used."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import wordlists as W
from ..functions.text import clean_token, distinct_in_order
from ..sources.vocabulary import Vocabulary


def tag_frequency(ai_meta: DataFrame) -> DataFrame:
    """tag, n: descriptions that have it, the marker left out."""
    each = ai_meta.select(F.explode(F.array_distinct(F.split("tags", "\n"))).alias("tag")).where(F.col("tag") != W.MARKER)
    return each.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def resolution(vocabulary: Vocabulary) -> list[tuple]:
    """(mode, raw, tag, category, limit, rivals) of each raw tag that the vocabulary knows, by mode; rivals: the tags that it excludes."""
    rivals: dict[str, list[str]] = {}
    for group in vocabulary.exclusive:
        for t in group:
            rivals.setdefault(t, []).extend(x for x in group if x != t)
    rows = []
    for mode in ("image", "video"):
        fits = {}
        for c in vocabulary.categories:
            if c.mode in ("both", mode):
                for t in c.tags:
                    fits.setdefault(t, (c.key, c.limit))
        known = {t for c in vocabulary.categories for t in c.tags} | set(vocabulary.aliases) | set(W.MODE_ALIASES[mode])
        for raw in sorted(known):
            tag = W.MODE_ALIASES[mode].get(raw)
            if tag is None:
                tag = vocabulary.aliases.get(raw, raw)
                tag = raw if tag not in fits and raw in fits else tag
            rows.append((mode, raw, tag, *fits.get(tag, (None, None)), rivals.get(tag, [])))
    return rows


def normalized(tags: Column, mode: Column, vocabulary: Vocabulary) -> Column:
    """kept, dropped (arrays) of an array of raw tags: the vocabulary's tags, at most a category's limit of each, the marker last.

    Limits and exclusive tags depend on what is kept before them, so the tags
    are folded in order; a row needs no other. Null tags have none. Raw tags are
    looked up by a hash, so a larger vocabulary takes no longer.
    """
    known = {(m, raw): entry for m, raw, *entry in resolution(vocabulary)}
    marker, left_out = W.MARKER, {"", W.MARKER, *W.IGNORED_TAGS}

    def fold(raw: list[str], mode: str | None) -> dict:
        kept, used, blocked, dropped = [], {}, set(), []
        for x in raw:
            tag, category, limit, rivals = known.get((mode, x), (x, None, None, ()))
            if x in left_out or tag in left_out or tag in kept:
                continue
            if category is None:
                dropped.append(tag)
            elif tag not in blocked and used.get(category, 0) < limit:
                kept.append(tag)
                used[category] = used.get(category, 0) + 1
                blocked.update(rivals)
        return {"kept": [*kept, marker], "dropped": dropped}

    kind = pa.struct([("kept", pa.list_(pa.string())), ("dropped", pa.list_(pa.string()))])

    @F.arrow_udf("kept array<string>, dropped array<string>")
    def folded(raw: pa.Array, modes: pa.Array) -> pa.Array:
        return pa.array(list(map(fold, raw.to_pylist(), modes.to_pylist())), kind)

    none = F.array().cast("array<string>")
    clean = lambda x: F.when(x.rlike("^[a-z0-9]+(-[a-z0-9]+)*$"), x).otherwise(clean_token(x))  # noqa: E731 most are clean
    return folded(F.transform(F.coalesce(tags, none), clean), mode)


def normalize_tags(rows: DataFrame, vocabulary: Vocabulary, tags: str = "tags", mode: str = "mode") -> DataFrame:
    """rows with kept and dropped: normalized() of their raw tags, row by row."""
    return rows.withColumn("_own", normalized(F.col(tags), F.col(mode), vocabulary)).select(*rows.columns, "_own.kept", "_own.dropped")


def vocabulary_report(ai_meta: DataFrame, vocabulary: Vocabulary, over: float = 0.4, top: int = 15) -> DataFrame:
    """kind (total, size, overused, dead, top), tag, n: how the vocabulary is used."""
    spark = ai_meta.sparkSession
    own = F.filter(F.array_distinct(F.split("tags", "\n")), lambda t: ~t.isin("", W.MARKER))
    total = ai_meta.where(F.size(own) > 0).agg(F.count(F.lit(1)).alias("n"))
    used = tag_frequency(ai_meta)
    vocab = spark.createDataFrame([(t,) for c in vocabulary.categories for t in c.tags], "tag string")
    rows = total.select(F.lit("total").alias("kind"), F.lit("").alias("tag"), "n")
    rows = rows.unionByName(vocab.distinct().agg(F.count(F.lit(1)).alias("n")).select(F.lit("size").alias("kind"), F.lit("").alias("tag"), "n"))
    share = used.join(total.withColumnRenamed("n", "all"))  # one row
    rows = rows.unionByName(share.where(F.col("n") / F.col("all") > over).select(F.lit("overused").alias("kind"), "tag", F.floor(100 * F.col("n") / F.col("all")).cast("long").alias("n")))
    rows = rows.unionByName(vocab.join(used, "tag", "left_anti").groupBy("tag").agg(F.count(F.lit(1)).alias("n")).select(F.lit("dead").alias("kind"), "tag", "n"))
    return rows.unionByName(used.orderBy(F.desc("n"), "tag").limit(top).select(F.lit("top").alias("kind"), "tag", "n"))


def merge_tags(old, model_tags, new, most: int = 60):
    """An item's tags without the model's earlier ones, then the new ones; the first spelling wins."""
    gone = F.transform(model_tags, F.lower)
    kept = F.filter(old, lambda t: ~F.array_contains(gone, F.lower(t)))
    return F.slice(distinct_in_order(F.filter(F.concat(kept, new), lambda t: F.trim(t) != ""), F.lower), 1, most)
