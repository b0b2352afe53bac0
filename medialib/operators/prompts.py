"""Requests to a vision model: the vocabulary's text, the prompts, and what they tell of a post."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, squeezed, stripped, text, unless_empty
from ..sources.vocabulary import CORE, HIDDEN, Vocabulary

#: Examples of a request, letters of each, and of a caption and a transcript.
MAX_EXAMPLES, EXAMPLE, CAPTION, TRANSCRIPT = 3, 400, 400, 1200
#: Fixed value: what a transcript stands after in a request.
TRANSCRIPT_LABEL = "Voice-over transcript (what the author SAYS; use it to name the technique, do not retell it): "
#: Fixed value: what a request adds for a post of a collection of tutorials.
TUTORIAL_HINT = " This is likely a tutorial or breakdown: describe WHICH technique or workflow is being shown, step by step where visible, not just what the picture looks like."

#: Templates are parameters; these are short ones of our own.
DESCRIBE = "These are {frames} frames of one {kind} ({mode}). Answer in JSON with category, confidence, medium, summary, description and on_screen_text.\n{examples}"
SINGLE_PASS = DESCRIBE + "\nAdd tags, from these lists only:\n{taxonomy}"
TAGS = "You have described a {kind} ({mode}, {frames} frames): {summary} {description}\nText on screen: {ocr}\nChoose its tags from these lists only:\n{taxonomy}"
EXAMPLES_HEADER = "Descriptions in the wanted style:"


def render(vocabulary: Vocabulary, mode: Column, profiles: Column) -> Column:
    """The lists that a post's prompt shows, in the vocabulary's order: those of its mode, and of its profiles or the core.

    profiles: an array, or null for all lists that aren't hidden. Lists without tags are left out.
    """
    blocks = []
    for c in vocabulary.categories:
        if not c.tags or HIDDEN in c.profiles:
            continue
        head = f"{c.title or c.key} — pick 0-{c.limit}" + (f"  ({c.note})" if c.note else "")
        own = c.profiles or (CORE,)
        shown = F.lit(True) if CORE in own else reduce(lambda a, p: a | F.array_contains(profiles, p), own, profiles.isNull())
        fits = F.lit(True) if c.mode == "both" else mode == c.mode
        blocks.append(F.when(fits & shown, F.lit(head + "\n" + ", ".join(c.tags))))
    return F.concat_ws("\n\n", *blocks)


def render_examples(examples: Column) -> Column:
    """The first three of an array of texts as lines under a header; '' if none of them has words."""
    first = F.filter(F.transform(F.slice(examples, 1, MAX_EXAMPLES), squeezed), lambda x: x != "")
    lines = F.array_join(F.transform(first, lambda x: F.concat(F.lit('- "'), F.substring(x, 1, EXAMPLE), F.lit('"'))), "\n")
    return F.when(F.coalesce(F.size(first), F.lit(0)) > 0, F.concat(F.lit(f"\n{EXAMPLES_HEADER}\n"), lines, F.lit("\n"))).otherwise("")


def _filled(template: Column, values: dict[str, Column]) -> Column:
    """The template with its places filled, one name after the other; taxonomy is the first.

    The lists are much longer than all else, so they are put in last, where that
    gives the same text: they hold no place nor a part of one, and what was put
    in before has made no new place for them.
    """
    lists, place = values["taxonomy"], F.lit("{taxonomy}")

    def rest(filled: Column) -> Column:
        for name, value in values.items():
            filled = F.replace(filled, F.lit("{" + name + "}"), value) if name != "taxonomy" else filled
        return filled

    plain = (F.octet_length(lists) > max(map(len, values)) + 2) & ~F.contains(lists, F.lit("{")) & ~F.contains(lists, F.lit("}"))
    taken = lambda x: F.octet_length(x) - F.octet_length(F.replace(x, place, F.lit("")))
    last = lambda own, short: F.when(plain & (taken(short) == taken(own)), F.replace(short, place, lists)).otherwise(rest(F.replace(own, place, lists)))
    return let(template, lambda own: let(rest(own), lambda short: last(own, short)))


def _shape(frames: Column, kind: Column, mode: Column) -> dict[str, Column]:
    return {
        "frames": F.greatest(F.lit(1), F.coalesce(frames, F.lit(1))).cast("string"), "kind": F.coalesce(F.nullif(kind, F.lit("")), F.lit("post")),
        "mode": F.upper(F.coalesce(F.nullif(mode, F.lit("")), F.lit("video"))),
    }


def prompt(template: Column, frames: Column, kind: Column, mode: Column, lists: Column, examples: Column, default: str = SINGLE_PASS) -> Column:
    """A template with its places filled; an empty one is the default. examples: an array of texts."""
    return _prompt(template, frames, kind, mode, lists, render_examples(examples), default)


def _prompt(template: Column, frames: Column, kind: Column, mode: Column, lists: Column, examples: Column, default: str = SINGLE_PASS) -> Column:
    return _filled(unless_empty(stripped(text(template)), F.lit(default)), {"taxonomy": text(lists), "examples": examples} | _shape(frames, kind, mode))


def tag_prompt(template: Column, frames: Column, kind: Column, mode: Column, lists: Column, summary: Column, description: Column, screen: Column) -> Column:
    """The second request: the post is described, its tags are to be chosen."""
    told = {"summary": stripped(text(summary)), "description": stripped(text(description)), "ocr": F.coalesce(F.nullif(stripped(text(screen)), F.lit("")), F.lit("none"))}
    return _filled(F.coalesce(F.nullif(text(template), F.lit("")), F.lit(TAGS)), {"taxonomy": text(lists)} | told | _shape(frames, kind, mode))


def context(username: Column, caption: Column, hint: Column, transcript: Column) -> Column:
    """The lines of a request that tell of the post."""
    said, shown = stripped(text(caption)), stripped(text(transcript))
    parts = [
        F.when(text(username) != "", F.concat(F.lit("Account: @"), username)), F.when(said != "", F.concat(F.lit("Caption: "), F.substring(said, 1, CAPTION))),
        F.when(text(hint) != "", hint), F.when(shown != "", F.concat(F.lit(TRANSCRIPT_LABEL), F.substring(shown, 1, TRANSCRIPT))),
    ]
    return F.concat_ws("\n", *parts)


def request_batch(posts: DataFrame, hints: DataFrame, examples: list[str], vocabulary: Vocabulary) -> DataFrame:
    """pk, request, tag_request, told of posts (pk, username, caption, kind, mode, frames, profiles, template, transcript, summary, description, screen_text).

    hints: media_pk, hint, tutorial. The context (told) follows each prompt after an empty line. Posts with equal pk have a row each.
    The examples are the same for all posts and are rendered once, when this is called.
    """
    hint = F.when(F.col("tutorial"), F.concat("hint", F.lit(TUTORIAL_HINT))).otherwise(F.col("hint"))
    rows = posts.join(hints.select(F.col("media_pk").alias("pk"), hint.alias("_hint")), "pk", "left")
    rows = rows.withColumn("_lists", render(vocabulary, F.col("mode"), F.col("profiles"))).withColumn("_told", context(F.col("username"), F.col("caption"), F.col("_hint"), F.col("transcript")))
    shape = [F.col(c) for c in ("template", "frames", "kind", "mode", "_lists")]
    lines = posts.sparkSession.range(1).select(render_examples(F.array(*map(F.lit, examples)).cast("array<string>"))).first()[0]
    first = _prompt(*shape, F.lit(lines))
    second = tag_prompt(F.lit(""), *shape[1:], F.col("summary"), F.col("description"), F.col("screen_text"))
    told = F.nullif("_told", F.lit(""))
    return rows.select("pk", F.concat_ws("\n\n", first, told).alias("request"), F.concat_ws("\n\n", second, told).alias("tag_request"), F.col("_told").alias("told"))
