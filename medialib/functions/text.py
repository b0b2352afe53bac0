"""Text functions as column expressions: tags, hashtags, titles, file names and annotations."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .wordlists import HASHTAG

#: Symbols that titles go without.
PICTOGRAMS = r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE00}-\x{FE0F}\x{2190}-\x{21FF}\x{2B00}-\x{2BFF}\x{200B}-\x{200F}]+"
#: Fixed value: the blanks of Unicode, those of the pattern (?U)\s.
BLANKS = "".join(map(chr, (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
EXTENSIONS = [".jpg", ".jpeg", ".png", ".webp", ".mp4", ".mov", ".gif", ".heic"]
RESERVED = ["CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10))]


def let(value: Column, use) -> Column:
    """use(value), with value worked out once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def text(value: Column) -> Column:
    """Null as ''."""
    return F.coalesce(value.cast("string"), F.lit(""))


def unless_empty(value: Column, other: Column) -> Column:
    """value, or other for ''; value is worked out once, where a nullif within other functions would work it out twice."""
    return let(value, lambda x: F.when(x == "", other).otherwise(x))


def stripped(value: Column) -> Column:
    """Without blanks of any kind at the ends. A pattern would look at each letter of the text for them."""
    return F.btrim(value, F.lit(BLANKS))


def squeezed(value: Column) -> Column:
    """Blanks of any kind as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text(value), r"(?U)\s+", " "))


def distinct_in_order(items: Column, key=None) -> Column:
    """The first of each item, or of each key, in order."""
    if key is None:
        return F.array_distinct(items)
    keys = F.transform(items, key)
    return F.filter(items, lambda x, i: F.array_position(keys, key(x)) == i + 1)


def clean_token(value: Column) -> Column:
    """A tag in its one form: small letters, hyphens, no hash sign."""
    tag = F.lower(stripped(F.regexp_replace(stripped(text(value)), "^#+|#+$", "")))
    tag = F.regexp_replace(F.regexp_replace(tag, r"(?U)[\s_]+", "-"), "[^a-z0-9-]", "")
    return F.regexp_replace(F.regexp_replace(tag, "-{2,}", "-"), "^-+|-+$", "")


def clean_tags(items: Column, most: int = 15) -> Column:
    """A model's tags: small letters, hyphens for blanks, word characters only, at most 30 long, distinct, the first ones."""

    def one(x: Column) -> Column:
        tag = F.lower(stripped(F.regexp_replace(stripped(text(x)), "^#+|#+$", "")))
        return F.regexp_replace(F.regexp_replace(F.regexp_replace(tag, r"(?U)\s+", "-"), r"(?U)[^\w\-]", ""), "^-+|-+$", "")

    made = F.filter(F.transform(items, one), lambda x: (x != "") & (F.length(x) <= 30))
    return F.slice(F.array_distinct(made), 1, most)


def hashtags(caption: Column, most: int | None = 15) -> Column:
    found = F.array_distinct(F.transform(F.regexp_extract_all(text(caption), F.lit(HASHTAG), F.lit(1)), F.lower))
    return found if most is None else F.slice(found, 1, most)


@F.pandas_udf(StringType())
def nfc(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Texts with their letters composed; Spark has no function for that. Null stays null, ASCII is passed on."""
    for part in texts:
        yield part.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


def safe_component(name: Column, most: int = 80) -> Column:
    """A file or folder name that any system takes. Letters are expected in composed form: nfc() brings names from outside into it."""
    clean = stripped(F.regexp_replace(stripped(text(name)), r'[<>:"/\\|?*\x00-\x1f]', "_"))
    clean = F.regexp_replace(F.regexp_replace(clean, r"(?U)\s+", " "), r"^[ .]+|[ .]+$", "")
    named = let(clean, lambda c: F.when(c == "", "unnamed").when(F.upper(F.split_part(c, F.lit("."), F.lit(1))).isin(RESERVED), F.concat(F.lit("_"), c)).otherwise(c))
    cut = let(named, lambda c: F.when(F.length(c) > most, F.regexp_replace(F.substring(c, 1, most), "[ .]+$", "")).otherwise(c))
    return unless_empty(cut, F.lit("unnamed"))


def caption_slug(caption: Column, limit: int = 60) -> Column:
    """The first line of a caption with words in it, for a file name; cut between words if that leaves enough."""
    whole = F.regexp_replace(text(caption), r"https?://\S+", " ")
    lines = F.transform(
        F.split(whole, "\r\n|[\n\r]", -1), lambda x: F.regexp_replace(F.regexp_replace(x, r"[#@][^\s#@]+", " "), PICTOGRAMS, " ")
    )
    good = F.filter(lines, lambda x: F.length(squeezed(x)) >= 3)
    bare = F.regexp_replace(F.translate(whole, "#@", "  "), PICTOGRAMS, " ")
    chosen = F.coalesce(F.get(good, F.lit(0)), bare)
    chosen = F.regexp_replace(F.regexp_replace(chosen, r"(?U)\s+", " "), r"^[ \-–—·•,.:;!?|/\\]+|[ \-–—·•,.:;!?|/\\]+$", "")

    def shorter(x: Column) -> Column:
        cut = F.substring(x, 1, limit)
        word = F.when(F.instr(F.substring(cut, limit // 2 + 1, limit), " ") > 0, F.regexp_replace(cut, " [^ ]*$", "")).otherwise(cut)
        return F.when(F.length(x) > limit, F.regexp_replace(word, r"[ \-–—·•,.:;!?]+$", "")).otherwise(x)

    return let(let(chosen, shorter), lambda c: F.when(c == "", "").otherwise(safe_component(c, limit)))


def base_name(taken_at: Column, username: Column, code: Column) -> Column:
    day = F.coalesce(F.date_format(taken_at, "yyyy-MM-dd"), F.lit("0000-00-00"))
    user, own = F.coalesce(F.nullif(username, F.lit("")), F.lit("unknown")), F.coalesce(F.nullif(code, F.lit("")), F.lit("nocode"))
    return F.concat(day, F.lit("_"), safe_component(user, 40), F.lit("_"), safe_component(own, 30))


def render_template(template: str, taken_at, username, code, kind, media_id, collection, caption) -> Column:
    """A file name from a template of eight tokens; separators that empty ones leave are tidied."""

    def or_else(value: Column, other: str) -> Column:
        return F.coalesce(F.nullif(text(value), F.lit("")), F.lit(other))

    own = or_else(code, "nocode")
    values = {
        "{date}": F.coalesce(F.date_format(taken_at, "yyyy-MM-dd"), F.lit("0000-00-00")),
        "{time}": F.coalesce(F.date_format(taken_at, "HH-mm"), F.lit("00-00")),
        "{user}": or_else(username, "unknown"), "{code}": own, "{type}": or_else(kind, "post"), "{id}": text(media_id),
        "{collection}": text(collection), "{title}": unless_empty(caption_slug(caption), own),
    }
    made = F.lit(template)
    for token, value in values.items():
        made = F.replace(made, F.lit(token), value)
    made = F.regexp_replace(made, "[ -]*_[ _-]*", "_")
    made = F.regexp_replace(F.regexp_replace(made, " *-[ -]*", "-"), "^[ _-]+|[ _-]+$", "")
    return let(safe_component(made, 120), lambda n: F.when(n == "unnamed", base_name(taken_at, username, code)).otherwise(n))


def asset_name(base: Column, index: Column, ext: Column) -> Column:
    dotted = F.when(ext.startswith("."), ext).otherwise(F.concat(F.lit("."), ext))
    return F.when(index.isNull(), F.concat(base, dotted)).otherwise(F.concat(base, F.lit("_"), F.lpad(index.cast("string"), F.greatest(F.lit(2), F.length(index.cast("string"))), F.lit("0")), dotted))


def short_title(caption: Column, username: Column, code: Column, limit: int = 70) -> Column:
    first = squeezed(F.element_at(F.split(stripped(text(caption)), "\r\n|[\n\r]", -1), 1))
    user = F.coalesce(F.nullif(username, F.lit("")), F.lit("unknown"))
    other = F.concat(F.lit("@"), user, F.lit(" · "), text(code))
    return let(first, lambda f: F.when(F.length(f) > limit, F.concat(F.rtrim(F.substring(f, 1, limit - 1)), F.lit("…"))).when(f != "", f).otherwise(other))


def ext_from_url(url: Column, default: str = ".jpg") -> Column:
    path = F.split_part(F.split_part(text(url), F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1))
    suffix = F.lower(F.regexp_extract(path, r"[^/.](\.[^/.]+)/*$", 1))
    return F.when(suffix == ".jpeg", ".jpg").when(suffix.isin(EXTENSIONS), suffix).otherwise(default)


def blocks(*parts: Column, by: str = "\n\n") -> Column:
    """The parts that aren't empty, apart by blank lines."""
    return F.concat_ws(by, *[F.nullif(p, F.lit("")) for p in parts])


def labelled(label: str, value: Column, most: int | None = None) -> Column:
    clean = squeezed(value)
    cut = clean if most is None else F.substring(clean, 1, most)
    return F.when(clean == "", "").otherwise(F.concat(F.lit(label + " "), cut))


def annotation(caption, description, screen_text, transcript, summary) -> Column:
    """An item's note: the caption, and what a model saw."""
    return blocks(
        stripped(text(caption)), labelled("In short:", summary), labelled("Visual summary:", description),
        labelled("On screen:", screen_text), labelled("Voice-over:", transcript, 800),
    )


def strip_description(note: Column) -> Column:
    """A note without our blocks, from the first of them on."""
    whole = F.concat(F.lit("\n\n"), text(note))
    return stripped(F.regexp_replace(whole, r"(?s)\n\n(?:In short:|Visual summary:|Опис:|On screen:).*$", ""))


def file_comment(caption, description, summary, author, url) -> Column:
    tail = F.concat_ws("\n", F.when(text(author) != "", F.concat(F.lit("Автор: @"), author)), F.when(text(url) != "", F.concat(F.lit("Посилання: "), url)))
    return blocks(F.substring(stripped(text(caption)), 1, 2000), labelled("In short:", summary), labelled("Visual summary:", description, 2000), tail)


def keywords(*lists: Column, most: int = 30) -> Column:
    return F.array_join(F.slice(distinct_in_order(F.filter(F.concat(*lists), lambda x: x != ""), F.lower), 1, most), "; ")


def human_size(n: Column) -> Column:
    """B below a KB, else one decimal (halves to even) of the largest unit up to GB."""
    made = F.concat(F.format_string("%.1f", F.bround(n / 1024**3, 1)), F.lit(" GB"))
    for power, unit in ((2, "MB"), (1, "KB")):
        made = F.when(n < 1024 ** (power + 1), F.concat(F.format_string("%.1f", F.bround(n / 1024**power, 1)), F.lit(f" {unit}"))).otherwise(made)
    return F.when(n < 1024, F.concat(n.cast("bigint").cast("string"), F.lit(" B"))).otherwise(made)
