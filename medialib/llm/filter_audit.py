"""Filter interaction audit: what each of several filters removes, alone, in every order, and on the whole.

The removal game of a group of documents gives a coalition of filters the
number of documents that it removes. Counts by which filters a document fails
are all that is needed of the documents; the rest is one row a group. The
potential of Hart and Mas-Colell follows by recursion over the coalitions,

    P(none) = 0,   |S| P(S) = v(S) + sum of P(S without i) over i in S,

the Shapley value of a filter is P(all) - P(all without it), and what a filter
removes at a step of an order is the difference of two coalitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial, lcm

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rows, picked, texts, written

#: The filters by letter, in the order of a mask's bits; E tells copies.
LETTERS = "ABCDE"
COPY = 1 << LETTERS.index("E")
CAPITALS, MARKS = bytes(range(65, 91)), b"#$%&*|"
NOT_FIRST = bytes(range(0x80, 0xC0))
MASKS = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("high", pa.int64()), ("low", pa.int64())])


def text_mask(text: bytes) -> int:
    """Which of A (few words), B (few different words), C (many capitals), D (marks) a text fails."""
    words = text.split()
    capitals = len(text) - len(text.translate(None, CAPITALS))
    points = len(text.translate(None, NOT_FIRST))
    return (
        (len(words) < 50)
        + 2 * (100 * len(set(words)) < 65 * len(words))
        + 4 * (100 * capitals > 5 * points)
        + 8 * (len(text.translate(None, MARKS)) < len(text))
    )


def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = Rows(MASKS)
    for batch in batches:
        for key, part, text in zip(batch.column("doc_id").to_pylist(), batch.column("part").to_pylist(), texts(batch), strict=True):
            digest = xxhash.xxh3_128_digest(text)
            high, low = (int.from_bytes(digest[k : k + 8], "big", signed=True) for k in (0, 8))
            rows.add(key, part, text_mask(text), high, low)
            if rows.full():
                yield rows.batch()
    yield from rows.rest()


def failures(docs: DataFrame, id_col="doc_id", text_col="text", part_col="source") -> DataFrame:
    """doc_id, part, mask of each row: the filters that it fails, as bits.

    A null text is empty and a null part ''. A text is a copy (E) if a row with
    a smaller id has the same (told by 128 bits of hash); rows with one id are
    no copies of each other for that, and a null id is neither smaller nor larger.
    """
    chosen = picked(docs, text_col, doc_id=id_col, part=part_col).withColumn("part", F.coalesce("part", F.lit("")))
    found = written(chosen.mapInArrow(_masks, "doc_id long, part string, mask int, high long, low long"), "filter-masks")
    # the join is by text and id, so that the copies of one text are dealt out; of a text there is one row on the right
    firsts = found.where("doc_id is not null").groupBy("high", "low").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return found.join(firsts, ["high", "low", "doc_id"], "left").select("doc_id", "part", F.col("mask").bitwiseOR(F.when(copy, COPY).otherwise(0)).alias("mask"), "low")


def counts(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: how many documents fail just these filters, and how many of them are labelled so.

    A document is good (toxic) if a row of labels with its id says quality 1 (toxic 1).
    """
    told = (
        labels.where("doc_id is not null").groupBy("doc_id")
        .agg(F.max((F.coalesce("quality", F.lit(0)) == 1).cast("int")).alias("good"), F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("int")).alias("toxic"))
        .withColumn("spread", F.lit(0).cast("long"))
    )
    spread = F.when(F.col("doc_id").isNull(), F.col("low")).otherwise(0)  # null ids meet nothing; without this they would all meet it in one task
    return (
        failed.withColumn("spread", spread.cast("long")).join(told, ["doc_id", "spread"], "left").groupBy("part", "mask")
        .agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.coalesce(F.col(c), F.lit(0)).cast("long")).alias(c) for c in ("good", "toxic")])
    )


def removal_game(by_mask: dict[int, int], n: int) -> list[int]:
    """What each coalition of n filters removes, by its bits."""
    return [sum(k for mask, k in by_mask.items() if mask & s) for s in range(1 << n)]


def potentials(game: list[int], n: int) -> list[int]:
    """Hart and Mas-Colell's potential of each coalition, times the least common multiple of 1 to n: whole numbers."""
    scale, found = lcm(*range(1, n + 1)), [0] * (1 << n)
    for s in range(1, 1 << n):
        without = sum(found[s ^ (1 << i)] for i in range(n) if s >> i & 1)
        found[s] = (scale * game[s] + without) // s.bit_count()
    return found


AUDIT = pa.schema(
    [("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32())]
    + [(c, pa.int64()) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")]
)


def interactions(counted: DataFrame, letters: str = LETTERS) -> DataFrame:
    """The audit of each part from counts(): part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A row for each part, order of the filters and step. shapley is the sum of
    what the step's filter removes over all orders: n! times its Shapley value.
    """
    n = len(letters)
    orders = list(permutations(range(n)))
    everyone = (1 << n) - 1

    def audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows(AUDIT)
        for batch in batches:
            for part, masks in zip(batch.column("part").to_pylist(), batch.column("masks").to_pylist(), strict=True):
                total = sum(m["n"] for m in masks)
                all_, good, toxic = (removal_game({m["mask"]: m[c] for m in masks}, n) for c in ("n", "good", "toxic"))
                potential = potentials(all_, n)
                share = [factorial(n) * (potential[everyone] - potential[everyone ^ 1 << i]) // lcm(*range(1, n + 1)) for i in range(n)]
                for order in orders:
                    name, before = "".join(letters[i] for i in order), 0
                    for step, i in enumerate(order, 1):
                        after = before | 1 << i
                        removed = all_[after] - all_[before]
                        rows.add(
                            part, name, step, total - all_[after], removed, all_[1 << i] - removed, all_[everyone] - all_[everyone ^ 1 << i],
                            good[after] - good[before], toxic[after] - toxic[before], share[i],
                        )
                        before = after
                if rows.full():
                    yield rows.batch()
        yield from rows.rest()

    parts = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))  # a row for each mask at most
    return parts.mapInArrow(
        audited,
        "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long",
    )


def filter_audit(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", part_col="source") -> DataFrame:
    """interactions() of the five filters over docs, by part; labels: doc_id, quality, toxic.

    A document that fails several filters is removed by the first of them in an
    order. An empty table has no part and so no row; repeated rows count each;
    other columns play no part. Texts are read once; a text of a task is in
    memory as bytes and words, some ten times its length.
    """
    return interactions(counts(failures(docs, id_col, text_col, part_col), labels))


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id
  FROM documents),
f AS (
  SELECT r, doc_id, part, unnest(['A', 'B', 'C', 'D', 'E']) AS f,
         unnest([len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t),
                 regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > first_id, false)]) AS fails
  FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM (SELECT doc_id, part, string_agg(CASE WHEN fails THEN f ELSE '' END, '' ORDER BY f) AS fails FROM f GROUP BY r, doc_id, part) LEFT JOIN l USING (doc_id)
  GROUP BY part, fails),
o AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order
  FROM (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) a(f), (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) b(f), (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) c(f),
       (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) d(f), (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) e(f)
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT filter_order, step, filter_order[step] AS f, filter_order[1:step - 1] AS before FROM o, range(1, 6) AS r(step)),
x AS (
  SELECT part, filter_order, step, f, n, good, toxic, contains(fails, f) AS own, fails = f AS alone,
         len(translate(fails, before, '')) < len(fails) AS earlier
  FROM s, m),
y AS (
  SELECT part, filter_order, step, f, sum(CASE WHEN earlier OR own THEN 0 ELSE n END) AS kept, sum(CASE WHEN own AND NOT earlier THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN own AND earlier THEN n ELSE 0 END) AS redundant, sum(CASE WHEN alone THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN own AND NOT earlier THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN own AND NOT earlier THEN toxic ELSE 0 END) AS toxic_lost
  FROM x GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM y
"""
