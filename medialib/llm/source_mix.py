"""Mixing sources to target weights: a low-discrepancy schedule of slots, filled with shuffled blocks of equal length.

Slot k of the mix has the point 0.b0 b1 b2... whose binary digits are those of
k, lowest first (van der Corput). The point falls into the interval of one
source among the cumulative shares, so that any stretch of the mix has each
source at about its share. How many slots before k a source has follows from
the digits of k, without counting them: the slots below k fall into runs of
2^m, and the points of such a run stand at equal distances.

A source's documents are shuffled and laid one after the other, again and again
where its target asks for repeats; that is cut into blocks of equal length, and
the source's slot of rank r takes its block r.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Binary digits of a point, and with that the most slots of a mix.
DIGITS = 48
#: More sources than this are refused: their table goes to the driver and to each task.
MOST_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: list[int], most_repeats: int = 3) -> list[Fraction]:
    """Shares of the sum of sizes by weight, none above most_repeats times its size; what is above goes to the rest by weight.

    Dealing the excess again until none is above ends at the level where the
    capped ones and the level times the others' weights make up the sum.
    """
    left, weight, level = Fraction(sum(sizes)), sum(weights), Fraction(0)
    order = sorted(range(len(sizes)), key=lambda i: Fraction(sizes[i], weights[i]))
    for i in order:
        level = left / weight
        if most_repeats * sizes[i] > level * weights[i]:
            break
        left, weight = left - most_repeats * sizes[i], weight - weights[i]
        if not weight:
            break
    return [min(Fraction(most_repeats * n), level * w) for n, w in zip(sizes, weights, strict=True)]


def points_below(k: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many of the first k points lie below each bound (a whole number of 2^-DIGITS), elementwise."""
    found, prefix = np.zeros(np.broadcast(k, bounds).shape, np.int64), np.zeros_like(k)
    for m in range(DIGITS, -1, -1):
        has = (k >> m) & 1
        # the 2^m slots after the prefix: equal distances, from the prefix's own point on
        room = np.maximum(bounds - prefix, 0)
        found += has * np.minimum(-(-room >> (DIGITS - m)), 1 << m)
        if m < DIGITS:
            prefix = prefix + (has << (DIGITS - 1 - m))
    return found


def points(k: np.ndarray) -> np.ndarray:
    """The point of each slot, times 2^DIGITS."""
    found = np.zeros_like(k)
    for m in range(DIGITS):
        found |= ((k >> m) & 1) << (DIGITS - 1 - m)
    return found


class Plan:
    """Sources in order with their sizes, targets and intervals; bounded by MOST_SOURCES."""

    def __init__(self, sources: list[tuple[str | None, int]], weights: list[int], block: int, most_repeats: int = 3):
        self.names, self.sizes, self.block = [s for s, _ in sources], [n for _, n in sources], block
        self.targets = targets(self.sizes, weights, most_repeats)
        #: whole words that each source gives, and the blocks that it takes for them
        self.words = [floor(t + Fraction(1, 2)) for t in self.targets]
        self.blocks = np.array([-(-n // block) for n in self.words], np.int64)
        # shares by blocks: each source's points end as its blocks do
        whole = max(1, int(self.blocks.sum()))
        self.bounds = np.array([0, *((int(c) << DIGITS) // whole for c in np.cumsum(self.blocks))], np.int64)
        self.slots = self._slots()

    def _enough(self, slots: int) -> bool:
        below = points_below(np.array(slots, np.int64), self.bounds)
        return bool((np.diff(below) >= self.blocks).all())

    def _slots(self) -> int:
        """The fewest slots in which every source has as many as it has blocks."""
        low, high = 0, int(self.blocks.sum())
        while not self._enough(high):
            low, high = high, 2 * high + 1
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if self._enough(middle) else (middle + 1, high)
        return high


def schedule(spark, plan: Plan) -> DataFrame:
    """slot, source_no, block_no: the slots of a mix, each with a block of its source; slots beyond a source's last block stay out."""
    bounds, blocks = plan.bounds, plan.blocks

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch.column("id").to_numpy()
            source = np.searchsorted(bounds, points(slot), side="right") - 1
            rank = points_below(slot, bounds[source + 1]) - points_below(slot, bounds[source])
            own = rank < blocks[source]
            yield pa.RecordBatch.from_arrays([pa.array(x[own]) for x in (slot, source, rank)], names=["slot", "source_no", "block_no"])

    return spark.range(plan.slots).mapInArrow(placed, "slot long, source_no long, block_no long")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    """doc_id, source, size (words), key: the place of a row in its source's shuffle, 60 bits of a hash."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), text))
    return docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").alias("key"),
    )


def _laid(sized: DataFrame, stretch_docs: int) -> DataFrame:
    """sized with start, where a document begins among its source's shuffled words, and nth, which tells rows of one key apart.

    A source is summed by stretches of the shuffle, of about stretch_docs rows
    of the whole table at most, so that no task has a whole source.
    """
    stretches = 1
    while stretches * stretch_docs < sized.count():
        stretches *= 2
    rows = sized.withColumn("stretch", F.shiftright("key", 60 - (stretches.bit_length() - 1)))
    sums = rows.groupBy("source", "stretch").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("_s"), F.col("stretch").alias("_t"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("source", "stretch").orderBy("key", "doc_id", "size")
    rows = rows.withColumn("start", F.coalesce(F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("nth", F.row_number().over(within))
    return rows.join(sums, rows["source"].eqNullSafe(sums["_s"]) & (rows["stretch"] == sums["_t"])).withColumn("start", F.col("start") + F.col("base")).drop("_s", "_t", "base", "stretch")


def _pieces(laid: DataFrame, block: int, repeats: Column) -> DataFrame:
    """block_no, from_word, words: the parts of each document in its source's blocks, with all repeats; one null block for an empty one."""
    passes = laid.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), repeats - 1)))
    passes = passes.withColumn("at", F.col("start") + F.col("pass") * F.col("source_size"))
    blocks = F.when(F.col("size") > 0, F.sequence(F.expr(f"at div {block}"), F.expr(f"(at + size - 1) div {block}"))).otherwise(F.array(F.lit(None).cast("long")))
    pieces = passes.withColumn("block_no", F.explode(blocks))
    begin = F.greatest("at", F.col("block_no") * block)
    end = F.least(F.col("at") + F.col("size"), (F.col("block_no") + 1) * block, F.col("quota"))
    return pieces.withColumn("from_word", begin - F.col("at")).withColumn("words", F.greatest(F.coalesce(end - begin, F.lit(0)), F.lit(0).cast("long"))).drop("pass", "at")


def mix(
    docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=(1, 2, 3), most_repeats=3, block=1024, seed="", stretch_docs=1 << 16
) -> DataFrame:
    """The mix of all sources: slot (null: not taken), doc_id, source, source_no, key, nth, size, source_size, target, start, from_word, words.

    A row for each part of a document in a block, with the slot of the block in
    the mix; from_word is where the part begins in its document. Sources by code
    point, null last, have the weights in turn; targets add up to all words.
    Each source gives its target to the word, and no document more than
    most_repeats times its size. A null text has size 0; a document without
    words, or whose words are not taken, has rows without a slot. The shuffle is
    by a hash of id and text, so reruns agree; whole repeated rows share their
    place in it. More than MOST_SOURCES sources raise an error. A text costs its
    length in memory. The table of sizes is written when this is called.
    """
    spark = docs.sparkSession
    sized = written(_sized(docs, id_col, text_col, source_col, seed), "sizes")
    found = sized.groupBy("source").agg(F.sum("size").alias("n")).orderBy(F.col("source").asc_nulls_last()).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    plan = Plan([(r.source, r.n) for r in found], [weights[i % len(weights)] for i in range(len(found))], block, most_repeats)
    listed = spark.createDataFrame(
        [(name, no, n, float(t), w, -(-w // n) if n and w else 1) for no, (name, n, t, w) in enumerate(zip(plan.names, plan.sizes, plan.targets, plan.words, strict=True))],
        "_source string, source_no long, source_size long, target double, quota long, passes long",
    )
    laid = _laid(sized, stretch_docs)
    laid = laid.join(F.broadcast(listed), laid["source"].eqNullSafe(listed["_source"])).drop("_source")
    pieces = _pieces(laid, block, F.col("passes"))
    taken = pieces.join(schedule(spark, plan), ["source_no", "block_no"], "left")
    return taken.select(
        F.when(F.col("words") > 0, F.col("slot")).alias("slot"), "doc_id", "source", "source_no", "key", "nth", "size", "source_size", "target", "start", "from_word", "words"
    )


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken of each row of docs: how many of its words the mix() takes, repeats counted."""
    taken = F.when(F.col("slot").isNotNull(), F.col("words")).otherwise(0)
    return (
        mix(docs, **options).groupBy("source_no", "start", "key", "nth", "doc_id", "size", "source_size", "target").agg(F.sum(taken).cast("long").alias("taken"))
        .select("doc_id", "size", "source_size", "target", "taken")
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
c AS (
  SELECT *, sum(n) OVER () - coalesce(sum(3 * n) OVER o, 0) AS words_left, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS weight_left
  FROM s WINDOW o AS (ORDER BY n * (6 // w), source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT words_left AS num, weight_left AS den FROM c WHERE 3 * n * weight_left > words_left * w ORDER BY n * (6 // w), source LIMIT 1),
t AS (
  SELECT source, n, CASE WHEN 3 * n * den > num * w THEN (num * w)::DOUBLE / den ELSE (3 * n)::DOUBLE END AS target,
         CASE WHEN 3 * n * den > num * w THEN (2 * num * w + den) // (2 * den) ELSE 3 * n END AS quota
  FROM s LEFT JOIN l ON true),
p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d)
SELECT doc_id, size, n AS source_size, target,
       (greatest(0, least(start + size, quota) - start) + greatest(0, least(start + size + n, quota) - start - n)
        + greatest(0, least(start + size + 2 * n, quota) - start - 2 * n))::BIGINT AS taken
FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source
"""
