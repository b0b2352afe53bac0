"""Model answers: out of the text, into checked fields."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import wordlists as W
from ..functions.text import clean_tags, squeezed, stripped, text

#: Words by which an evidence denies its tag.
NEGATIVE = r"(?iU)\b(no|not|none|absent|without|unclear|cannot|can't|n/a)\b"


def strip_thinking(answer: Column) -> Column:
    """What follows the last closed block of thinking and comes before an open one."""
    return stripped(F.substring_index(F.substring_index(text(answer), "</think>", -1), "<think>", 1))


#: A string with its escapes (to the end of the text, if it is never closed), or a brace.
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\\?\Z)|[{}]', re.S)


def balanced(raw: str | None) -> str | None:
    """The first balanced {…} of a text, strings and escapes respected; None if there is none."""
    begin, depth = (raw or "").find("{"), 0
    for token in _TOKEN.finditer(raw, begin) if begin >= 0 else ():
        depth += {"{": 1, "}": -1}.get(token[0], 0)
        if not depth:
            return raw[begin : token.end()]
    return None


@F.pandas_udf(T.StringType())
def first_json(answers: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """balanced() of each text, which jumps from one string or brace to the next."""
    for part in answers:
        yield part.map(balanced)


def _field(data: Column, name: str) -> Column:
    return F.get_json_object(data, f"$.{name}")


def split_tags(raw: Column) -> tuple[Column, Column]:
    """Accepted and rejected tags of the JSON of an answer's tags: strings or {tag, evidence}; an evidence that denies rejects its tag."""
    items = F.from_json(raw, "array<string>")
    name = lambda x: F.when(x.startswith("{"), F.coalesce(F.get_json_object(x, "$.tag"), F.get_json_object(x, "$.name"), F.lit(""))).otherwise(x)

    def denied(x: Column) -> Column:
        tag = F.lower(F.trim(name(x)))
        negative = tag.contains("less") | tag.rlike("^(no-|non-|without-)")
        return F.coalesce(x.startswith("{") & F.get_json_object(x, "$.evidence").rlike(NEGATIVE) & ~negative, F.lit(False))

    some = F.coalesce(items, F.split(F.coalesce(raw, F.lit("")), "[,;\n]+"))
    return clean_tags(F.transform(F.filter(some, lambda x: ~denied(x)), name)), clean_tags(F.transform(F.filter(some, denied), name))


def parse_answers(answers: DataFrame, column: str = "answer_text") -> DataFrame:
    """answers with category, confidence, description, summary, screen_text, tags, rejected, ok.

    An answer of no JSON gives the first category that it names, at 0.5; an
    unknown category isn't ok but keeps its texts; broken JSON has nothing.
    """
    rows = answers.withColumn("raw", strip_thinking(F.col(column))).withColumn("json", first_json(F.col("raw")))
    data, none = F.col("json"), F.array().cast("array<string>")
    # in steps, each of which is worked out once however often the next ones use it
    rows = rows.withColumns({
        "_valid": F.coalesce(F.try_parse_json(data).isNotNull(), F.lit(False)),
        "_named": F.coalesce(*[F.when(F.col("raw").rlike(rf"(?iU)\b{c}\b"), F.lit(c)) for c in W.CATEGORIES]),
        "_category": F.lower(F.trim(F.coalesce(_field(data, "category"), F.lit("")))),
        "_sure": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.expr("try_cast(get_json_object(json, '$.confidence') as double)"), F.lit(0.0)))),
        "_screen": F.coalesce(_field(data, "on_screen_text"), _field(data, "screen_text"), F.lit("")),
        "_summary": squeezed(_field(data, "summary")), "_told": _field(data, "description"), "_tags": _field(data, "tags"),
    })
    screen, valid, named = F.col("_screen"), F.col("_valid"), F.col("_named")
    accepted, rejected = split_tags(F.col("_tags"))
    parts = F.array_join(F.filter(F.from_json(screen, "array<string>"), lambda x: F.trim(x) != ""), " | ")
    rows = rows.withColumns({
        "_accepted": F.when(valid, accepted).otherwise(none), "_rejected": F.when(valid, rejected).otherwise(none),
        "_shown": squeezed(F.when(screen.startswith("["), parts).otherwise(screen)),
        "_description": F.when(F.coalesce("_told", F.lit("")) == "", F.col("_summary")).otherwise(squeezed(F.col("_told"))),
        "_known": valid & F.col("_category").isin(W.CATEGORIES),
    })
    known, bare = F.col("_known"), data.isNull() & named.isNotNull()
    return rows.select(
        *answers.columns,
        F.when(data.isNull(), F.coalesce(named, F.lit(""))).when(known, F.col("_category")).otherwise("").alias("category"),
        F.when(bare, 0.5).when(known, F.col("_sure")).otherwise(0.0).alias("confidence"),
        F.when(valid, F.substring("_description", 1, 1200)).otherwise("").alias("description"),
        F.when(valid, F.substring("_summary", 1, 300)).otherwise("").alias("summary"),
        F.when(valid, F.substring("_shown", 1, 500)).otherwise("").alias("screen_text"),
        F.col("_accepted").alias("tags"), F.col("_rejected").alias("rejected"), (known | bare).alias("ok"),
    )


def clean_medium(medium: Column, aliases: dict[str, str]) -> Column:
    """A medium in its one form, else ''."""
    low = F.regexp_replace(F.lower(stripped(text(medium))), r"(?U)[\s_]+", "-")
    known = low
    for raw, target in aliases.items():
        if target in W.MEDIUMS:
            known = F.when(low == raw, target).otherwise(known)
    return F.when(known.isin(W.MEDIUMS), known).otherwise("")


def prompt_hash(template: Column, model: Column, side: Column) -> Column:
    return F.substring(F.sha1(F.concat(text(template), F.lit("\n"), text(model), F.when(side > 0, F.concat(F.lit("\n"), side.cast("string"), F.lit("px"))).otherwise(""))), 1, 12)
