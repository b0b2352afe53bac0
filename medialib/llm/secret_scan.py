"""Secret scans with corpus-wide ownership frequency; DataFrame functions only.

Every candidate value of the corpus is counted by distinct repositories and
owners. A value that many owners have is a copied example; one that only an
owner or two have, and that looks like a credential, is taken for live.
Places come from split() and regexp_extract_all(), which cut a text at the same
matches: a match starts after all pieces and matches before it. Texts without a
match are left alone after one rlike().
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

_VALUE = "[A-Za-z0-9+/_.=-]"
_KEY = "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
_ASSIGN = _KEY + r"""["']?\x20*[:=]\x20*["']?(""" + _VALUE
#: kind, pattern of a match, pattern that a text with a valid match has, group of the value, its least length.
#: An access key or hex run of at least n characters is the same as the maximal run, dropped when shorter.
KINDS = (
    ("assign", _ASSIGN + "+)", _ASSIGN + "{6,})", 2, 6),
    ("access", "AKIA[A-Z0-9]{16,}", "AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", "[0-9a-f]{24,}", "[0-9a-f]{24,}", 0, 24),
    ("owned", "[A-Za-z0-9+/_=-]{20,}", "[A-Za-z0-9+/_=-]{20,}", 0, 20),
)
SPAN = "struct<start:int,kind_no:int,end:int,kind:string,value:string>"
#: How many elements of an array, and how many characters of a text, are dealt with at a time.
PART, PART_CHARS = 64, 1024


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value worked out once however often it is used."""
    return F.transform(F.array(value), use)[0]


def _scan(values: Column, first: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """What step(state, value) finds along an array, one after the other; it gives the next state and an array of kind.

    A fold copies its state at each step, so the array is dealt with by parts:
    first the state at the beginning of each part, then each part's findings.
    """
    none = F.array().cast(f"array<{kind}>")

    def one(s: Column, x: Column) -> Column:
        state, found = step(s["state"], x)
        return F.struct(state.alias("state"), F.concat(s["own"], found).alias("own"))

    def found_in(part: Column, state: Column) -> Column:
        return F.aggregate(part, F.struct(state.alias("state"), none.alias("own")), one, lambda s: s["own"])

    def joined(parts: Column) -> Column:
        after = lambda states, part: F.aggregate(part, F.element_at(states, -1), lambda s, x: step(s, x)[0])
        states = F.aggregate(parts, F.array(first), lambda states, part: F.concat(states, F.array(after(states, part))))
        return F.flatten(F.zip_with(parts, F.slice(states, F.lit(1), F.size(parts)), found_in))

    def parts(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / PART).cast("int")), lambda k: F.slice(v, k * PART + 1, PART))

    return _let(values, lambda v: F.when(F.size(v) < 1, none).otherwise(_let(parts(v), joined)))


def _matches(text: Column, no: int) -> Column:
    """The matches of a kind as SPAN, in order; leftmost, non-overlapping, ends exclusive, in code points."""
    kind, pattern, test, group, least = KINDS[no]
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    steps = F.arrays_zip(
        F.transform(F.slice(pieces, F.lit(1), F.size(found)), F.length).alias("before"),
        F.transform(found, F.length).alias("size"),
        values.alias("value"),
    )

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + x["before"]
        span = F.struct(
            start.alias("start"), F.lit(no).alias("kind_no"), (start + x["size"]).alias("end"),
            F.lit(kind).alias("kind"), x["value"].alias("value"),
        )
        ok = F.length(x["value"]) >= least
        if kind == "owned":
            ok = ok & x["value"].rlike("[a-z]") & x["value"].rlike("[A-Z]") & x["value"].rlike("[0-9]")
        return start + x["size"], F.when(ok, F.array(span)).otherwise(F.array().cast(f"array<{SPAN}>"))

    none = F.array().cast(f"array<{SPAN}>")
    return F.when(text.rlike(test), _scan(steps, F.lit(0), step, SPAN)).otherwise(none)


def _apart(wide: Column, base: Column) -> Column:
    """The wide spans that overlap no base span, by two scans over all spans by start.

    A base span that starts before a wide one overlaps it if it ends after its
    start: the furthest end so far tells. One that starts later overlaps it if it
    starts before its end: the nearest start, seen from behind, tells.
    """
    none = F.array().cast(f"array<{SPAN}>")
    is_base = lambda x: x["kind_no"] < 3

    def after(top: Column, x: Column) -> tuple[Column, Column]:
        return F.when(is_base(x), F.greatest(top, x["end"])).otherwise(top), F.when(is_base(x) | (top > x["start"]), none).otherwise(F.array(x))

    def before(nearest: Column, x: Column) -> tuple[Column, Column]:
        return F.when(is_base(x), x["start"]).otherwise(nearest), F.when(is_base(x) | (nearest < x["end"]), none).otherwise(F.array(x))

    clear = _scan(F.array_sort(F.concat(base, wide)), F.lit(0), after, SPAN)
    return _scan(F.reverse(F.array_sort(F.concat(base, clear))), F.lit(2**31 - 1), before, SPAN)


def candidate_spans(text: Column) -> Column:
    """Base spans and the wider ones that overlap no base span, by start, then kind as listed."""
    base = F.concat(*[_matches(text, no) for no in range(3)])
    both = F.struct(base.alias("base"), _matches(text, 3).alias("wide"))
    return _let(
        both,
        lambda s: F.array_sort(F.when((F.size(s["base"]) < 1) | (F.size(s["wide"]) < 1), F.concat(s["base"], s["wide"]))
                               .otherwise(F.concat(s["base"], _apart(s["wide"], s["base"])))),
    )


def ownership(candidates: DataFrame) -> DataFrame:
    """value_hash, n_repos, n_owners from rows of (value_hash, owner, repo); a null owner or repo counts as one of its own.

    Copies are counted together before each shuffle, so a value that a third of
    the corpus has sends a row per task, owner and repository.
    """
    return (
        candidates.groupBy("value_hash", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("value_hash", "owner").agg(F.count(F.lit(1)).alias("n_repos"))
        .groupBy("value_hash").agg(F.sum("n_repos").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"))
    )


def _judged(found: DataFrame, max_owners: int) -> DataFrame:
    """found (row_id, owner, repo, spans, …) with live: the spans, in order, whose value at most max_owners have."""
    each = found.where(F.size("spans") > 0).select(
        "row_id", "owner", "repo", F.posexplode("spans").alias("no", "span")
    ).select("row_id", "owner", "repo", "no", F.sha2(F.col("span.value"), 256).alias("value_hash"))
    few = ownership(each).where(F.col("n_owners") <= max_owners).select("value_hash")
    live = each.join(few, "value_hash", "left_semi").groupBy("row_id").agg(F.array_sort(F.collect_list("no")).alias("numbers"))
    spans = F.transform(F.coalesce("numbers", F.array().cast("array<int>")), lambda k: F.get("spans", k))
    return found.join(live, "row_id", "left").withColumn("live", spans).drop("numbers")


def _columns(docs: DataFrame, text_col: str, owner_col: str, repo_cols: tuple[str, ...]) -> list[Column]:
    text = F.coalesce(F.col(text_col), F.lit(""))
    repo = F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in repo_cols])
    return [F.col(owner_col).cast("string").alias("owner"), repo.alias("repo"), candidate_spans(text).alias("spans")]


def secret_scan(
    docs: DataFrame, id_col="doc_id", text_col="text", owner_col="source", repo_cols=("source", "lang"), max_owners=2
) -> DataFrame:
    """A row per row of docs: base counts and spans, the method's spans, and how many base secrets look live.

    Base spans always stay; wider ones are added if their value belongs to at
    most max_owners owners. A null text is empty and has no spans; repeated rows
    give repeated results; other columns of docs play no part. Time grows with a
    text's length and its spans (sorted), and, divided by some 8,000,
    with the square of its spans, since a scan copies the states of the parts before.
    """
    found = written(
        docs.select(F.col(id_col).alias("doc_id"), *_columns(docs, text_col, owner_col, repo_cols)).withColumn(
            "row_id", F.monotonically_increasing_id()
        ),
        "secret-spans",
    )
    judged = _judged(found, max_owners)
    base = F.filter("spans", lambda s: s["kind_no"] < 3)
    kept = F.array_sort(F.concat(base, F.filter("live", lambda s: s["kind_no"] == 3)))
    n_live = F.size(F.filter("live", lambda s: s["kind_no"] < 3))

    def told(spans: Column) -> Column:
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
        )

    def count(no: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind_no"] == no)).cast("long")

    return judged.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(told(base), 256).alias("base_sha256"),
        told(kept).alias("spans"),
        n_live.cast("long").alias("n_live"),
        (F.size(base) - n_live).cast("long").alias("n_copied"),
    )


def redact(
    docs: DataFrame, text_col="text", owner_col="source", repo_cols=("source", "lang"), max_owners=2, mark="<SECRET>"
) -> DataFrame:
    """docs with the values of owner-specific secrets replaced by a mark; every row stays, copied examples too.

    Only the texts with a candidate take part in the join. A null text stays null. Where live values overlap, the
    mark stands for both. Time grows with a text's length and spans, not with their product.
    """
    any_kind = "|".join(f"(?:{test})" for _, _, test, _, _ in KINDS)
    hit = F.coalesce(F.col(text_col).rlike(any_kind), F.lit(False))
    whole = F.struct(*[F.col(c) for c in docs.columns]).alias("doc")
    found = written(
        docs.where(hit).select(whole, *_columns(docs, text_col, owner_col, repo_cols)).withColumn(
            "row_id", F.monotonically_increasing_id()
        ),
        "secret-docs",
    )
    text = F.col(f"doc.{text_col}")
    spots = F.array_sort(F.transform("live", lambda s: F.struct((s["end"] - F.length(s["value"])).alias("begin"), s["end"].alias("end"))))
    blocks = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % PART_CHARS), F.lit(0))

    def cleaned(s: Column) -> Column:
        def between(begin: Column, end: Column) -> Column:
            first = F.floor(begin / PART_CHARS).cast("int")
            own = F.slice(s["blocks"], first + 1, F.floor((end - 1) / PART_CHARS).cast("int") - first + 1)
            return F.when(end > begin, F.substring(F.array_join(own, ""), begin % PART_CHARS + 1, end - begin)).otherwise("")

        def step(at: Column, x: Column) -> tuple[Column, Column]:
            kept = F.when(x["begin"] >= at, F.array(between(at, x["begin"]), F.lit(mark))).otherwise(F.array().cast("array<string>"))
            return F.greatest(at, x["end"]), kept

        last = F.array_max(F.transform(s["spots"], lambda x: x["end"]))
        return F.concat(F.array_join(_scan(s["spots"], F.lit(0), step, "string"), ""), between(last, F.length(text)))

    clean = F.when(F.size("live") < 1, text).otherwise(_let(F.struct(blocks.alias("blocks"), spots.alias("spots")), cleaned))
    changed = _judged(found, max_owners).select("doc", clean.alias("new"))
    new = [F.col("new").alias(c) if c == text_col else F.col(f"doc.{c}").alias(c) for c in docs.columns]
    return docs.where(~hit).unionByName(changed.select(*new))


def _sql() -> str:
    quoted = [p.replace("'", "''") for _, p, _, _, _ in KINDS]
    parts = []
    for no, (kind, _, _, group, least) in enumerate(KINDS):
        more = " AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[0-9]')" if no == 3 else ""
        parts.append(
            f"""SELECT r, {no} AS kind_no, '{kind}' AS kind, s, s + length(m[i]) AS e, v FROM (
  SELECT r, m, i, vs[i] AS v,
         (list_sum(list_transform(p[1:i], lambda x: length(x)))
          + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0))::BIGINT AS s
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT r, regexp_extract_all(t, '{quoted[no]}') AS m, regexp_extract_all(t, '{quoted[no]}', {group}) AS vs,
           string_split_regex(t, '{quoted[no]}') AS p
    FROM d WHERE regexp_matches(t, '{quoted[no]}')))) WHERE length(v) >= {least}{more}"""
        )
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, source AS owner,
         concat(coalesce(source, ''), '/', coalesce(lang, '')) AS repo
  FROM documents),
c AS ({" UNION ALL ".join(parts)}),
a AS (SELECT * FROM c WHERE kind_no < 3 OR NOT EXISTS (
  SELECT 1 FROM c AS b WHERE b.r = c.r AND b.kind_no < 3 AND b.s < c.e AND c.s < b.e)),
o AS (SELECT v, count(DISTINCT coalesce('=' || owner, '')) AS n FROM a JOIN d USING (r) GROUP BY v),
j AS (SELECT a.*, n <= 2 AS live, kind || ':' || s || ':' || e AS told FROM a JOIN o USING (v)),
g AS (
  SELECT r, count(*) FILTER (kind_no = 0) AS n_assign, count(*) FILTER (kind_no = 1) AS n_access,
         count(*) FILTER (kind_no = 2) AS n_hex,
         string_agg(told, ',' ORDER BY s, kind_no) FILTER (kind_no < 3) AS base,
         string_agg(told, ',' ORDER BY s, kind_no) FILTER (kind_no < 3 OR live) AS spans,
         count(*) FILTER (kind_no < 3 AND live) AS n_live, count(*) FILTER (kind_no < 3 AND NOT live) AS n_copied
  FROM j GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM d LEFT JOIN g USING (r)
"""


ORACLE_SQL = _sql()
