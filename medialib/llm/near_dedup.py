"""MinHash near-dedup for weighted shingles: ProbMinHash, banding, verification, classes.

Each shingle of a text is a Poisson process whose rate is the shingle's weight;
its arrivals fall on the places of the signature, and each place keeps the
shingle that comes first. Arrivals come in order, so a shingle is done once its
next one is later than the last place's first (early termination). Two
signatures agree at a place with the probability Jaccard similarity of the
weighted shingles. A shingle that stands c times weighs 1 + ln c. A link needs a
Jaccard similarity of the sets, from which the weighted one is far where repeats
differ, so a text with repeats is banded by a signature with equal weights too,
and candidates are told by the signatures with equal weights alone.

Exact copies are one node from the start. In a bucket of a band every text is
compared with one pivot, never all with all; what that leaves open is settled in
a second pass, which compares the texts that are not in their bucket's main
component with all of the bucket, in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import grams, hashed, mixed, picked, texts, written
from .components import components

SHINGLE, SIMILAR = 5, 0.8
BANDS, BAND_ROWS = 32, 5
PLACES = BANDS * BAND_ROWS
#: With equal weights a pair at SIMILAR agrees at fewer places than this share with a chance of about 1e-7 (binomial, 160 places).
LEAST_AGREED = 0.62
BLOCK = 512
STEP = 0x9E3779B97F4A7C15


def shingles(text: bytes) -> np.ndarray:
    """Hashes of the five-word shingles, with repeats; of all words together for a shorter text; none without words."""
    words = hashed(text.split())
    return grams(words, min(SHINGLE, len(words))) if len(words) else words


def signature(found: np.ndarray, places: int = PLACES) -> np.ndarray:
    """The ProbMinHash signature of shingles (with repeats), as 32-bit hashes of the shingles kept."""
    elements, counts = np.unique(found, return_counts=True)
    rate = 1 + np.log(counts)
    first, kept = np.full(places, np.inf), np.zeros(places, np.uint64)
    at, alive, drawn, latest = np.zeros(len(elements)), np.arange(len(elements)), 0, np.inf
    each = max(1, -(-2 * places // max(1, len(elements))))
    while len(alive):
        counter = np.array([(drawn + k + 1) * STEP % 2**64 for k in range(each)], np.uint64)
        random = mixed(elements[alive][:, None] + counter)
        gap = -np.log1p(-((random >> np.uint64(11)) * 2.0**-53)) / rate[alive][:, None]
        arrival = at[alive][:, None] + np.cumsum(gap, axis=1)
        row, column = np.nonzero(arrival < latest)
        when = arrival[row, column]
        place = (mixed(random[row, column] + np.uint64(STEP)) % np.uint64(places)).astype(np.int64)
        np.minimum.at(first, place, when)
        won = when == first[place]
        kept[place[won]] = elements[alive[row[won]]]
        at[alive] = arrival[:, -1]
        latest = first.max()
        alive = alive[at[alive] < latest]
        drawn += each
    return (mixed(kept) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, signature (equal weights), weighted (null where no shingle repeats: the same) of the rows of docs that have a word."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, made, weighted = [], [], []
            for k, text in enumerate(texts(batch)):
                found = shingles(text)
                if len(found):
                    once = np.unique(found)
                    rows.append(k)
                    made.append(signature(once))
                    weighted.append(signature(found) if len(once) < len(found) else None)
            if rows:
                take = pa.array(rows)
                flat = pa.array(np.concatenate(made))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, PLACES, dtype=np.int32)), flat)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(take), batch.column("text_hash").take(take), lists, pa.array(weighted, pa.list_(pa.int32()))],
                    names=["doc_id", "text_hash", "signature", "weighted"],
                )

    return docs.select("doc_id", "text_hash", "text").mapInArrow(signed, "doc_id long, text_hash string, signature array<int>, weighted array<int>")


def _bands(column: str) -> Column:
    """band, key of each band of a signature."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda b: F.struct(b.alias("band"), F.xxhash64(b, F.slice(column, b * BAND_ROWS + 1, BAND_ROWS)).alias("key")),
    )


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), PLACES)


def _likely(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures agree at LEAST_AGREED of the places or more."""

    def agreed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = (_matrix(batch.column("x")) == _matrix(batch.column("y"))).mean(1) >= LEAST_AGREED
            yield batch.select(["a", "b"]).filter(pa.array(near))

    return (
        pairs.join(signed.select(F.col("node").alias("a"), F.col("signature").alias("x")), "a")
        .join(signed.select(F.col("node").alias("b"), F.col("signature").alias("y")), "b")
        .select("a", "b", "x", "y").mapInArrow(agreed, "a long, b long")
    )


def _sets(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """node, set: the sorted set of shingles of each node."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [np.unique(shingles(t)).view(np.int64) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.list_(pa.int64()))], names=["node", "set"])

    own = docs.join(nodes.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
    return own.select("doc_id", "text").mapInArrow(sets, "node long, set array<long>")


def _verified(pairs: DataFrame, own: DataFrame, similar: float) -> DataFrame:
    """The pairs of nodes (a, b) whose sets of shingles (own: node, set) have a Jaccard similarity of at least similar."""

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                one, two = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(both >= similar * (len(one) + len(two) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return (
        pairs.join(own.select(F.col("node").alias("a"), F.col("set").alias("x")), "a")
        .join(own.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
        .select("a", "b", "x", "y").mapInArrow(close, "a long, b long")
    )


def _mixed(placed: DataFrame) -> DataFrame:
    """key, main (its largest component), n, outside (texts that are not in it) of the buckets (key, node, pivot, component) of several components.

    Two texts of which one is the pivot have been compared; two others have not.
    """
    sizes = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"), F.max("pivot").alias("pivot"))
    main = F.max_by("component", F.struct("n", "component"))
    return (
        sizes.groupBy("key").agg(main.alias("main"), F.sum("n").alias("n"), (F.sum("n") - F.max("n")).alias("outside"), F.count(F.lit(1)).alias("parts"), F.max("pivot").alias("pivot"))
        .where("parts > 1 and (n > 2 or not pivot)").drop("parts", "pivot")
    )


def _linkable(own: DataFrame, similar: float) -> DataFrame:
    """node, n, common: sizes of the sets, and how many of their shingles another set has as well, where that can make a link.

    No two texts share more than either has in common with all others, so a
    text with less in common than `similar` of its set has no link at all.
    """
    each = own.select("node", F.explode("set").alias("shingle"))
    twice = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("shingle")
    common = each.join(twice, "shingle", "left_semi").groupBy("node").agg(F.count(F.lit(1)).cast("int").alias("common"))
    return own.select("node", F.size("set").alias("n")).join(common, "node").where(F.col("common") >= similar * F.col("n"))


def _dealt(rows: DataFrame) -> DataFrame:
    """rows of buckets (key, node, component, main, of, outside) by key, part and block: every text that asks meets every text of its bucket.

    Those outside the main component ask. Both sides go by blocks of about
    BLOCK texts, so a group has no more than two blocks, however large its bucket.
    """
    def number(of: str) -> Column:
        return F.ceil(F.col(of) / BLOCK)

    def own(of: str) -> Column:
        return F.pmod(F.xxhash64("node"), number(of))

    def all_of(of: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), number(of) - 1))

    asked = rows.where("component <> main").withColumn("part", own("outside")).withColumn("block", all_of("of")).withColumn("asks", F.lit(True))
    given = rows.withColumn("part", all_of("outside")).withColumn("block", own("of")).withColumn("asks", F.lit(False))
    return asked.unionByName(given)


def _open_links(placed: DataFrame, signed: DataFrame, able: DataFrame, own: DataFrame, similar: float) -> DataFrame:
    """Links that join components, within buckets: texts outside a bucket's main component against all of it, in blocks.

    placed: key, node, pivot (whether it is), component. able: node, n, common; a pair shares at most
    the lesser common, which bounds its similarity before its signatures and
    then its sets (own: node, set) are compared. A group gives a link only
    where its links before leave two components apart, so what it gives is no
    more than the texts it has.
    """
    rows = placed.join(able, "node")
    rows = written(rows.join(_mixed(rows).withColumnRenamed("n", "of"), "key"), "open-buckets")
    columns = ("key", "part", "block", "node", "component", "asks", "n", "common")
    both = signed.join(own.join(able.select("node"), "node", "left_semi"), "node")
    dealt = _dealt(rows).select(*columns).join(both, "node").select(*columns, "signature", "set")

    def links_of(rows: list) -> list[tuple[int, int]]:
        node, component, asks, n, common, signature = (np.concatenate(c) for c in list(zip(*rows, strict=True))[:-1])
        sets = [s for *_, part in rows for s in part]
        ask, give = np.flatnonzero(asks), np.flatnonzero(~asks)
        parent = {c: c for c in component.tolist()}

        def root(c: int) -> int:
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        found = []
        for k in range(0, len(ask), 64):
            part = ask[k : k + 64]
            agreed = np.zeros((len(part), len(give)), np.int16)
            for p in range(PLACES):
                agreed += signature[part, p][:, None] == signature[give, p]
            most = np.minimum(common[part][:, None], common[give])
            near = (agreed >= LEAST_AGREED * PLACES) & (most >= similar * (n[part][:, None] + n[give] - most))
            x, y = np.nonzero(near & (component[part][:, None] != component[give]))
            for order in np.argsort(-agreed[x, y], kind="stable").tolist():
                i, j = int(part[x[order]]), int(give[y[order]])
                one, two = root(int(component[i])), root(int(component[j]))
                if one == two:
                    continue
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if both >= similar * (n[i] + n[j] - both):
                    parent[one] = two
                    found.append((int(node[i]), int(node[j])))
        return found

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list = []
        current = None

        def settled() -> Iterator[pa.RecordBatch]:
            found = links_of(waiting) if waiting else []
            waiting.clear()
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, own_part, block, node, component = (batch.column(c).to_numpy() for c in ("key", "part", "block", "node", "component"))
            asks, n, common = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("asks", "n", "common"))
            signature, sets = _matrix(batch.column("signature")), [s.values.to_numpy() for s in batch.column("set")]
            edges = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (own_part[1:] != own_part[:-1]) | (block[1:] != block[:-1]), [True]])).tolist()
            for begin, end in zip(edges[:-1], edges[1:], strict=True):
                if (key[begin], own_part[begin], block[begin]) != current:
                    yield from settled()
                current = (key[begin], own_part[begin], block[begin])
                waiting.append(tuple(c[begin:end] for c in (node, component, asks, n, common, signature, sets)))
        yield from settled()

    return dealt.repartition("key", "part", "block").sortWithinPartitions("key", "part", "block").mapInArrow(compared, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", similar=SIMILAR) -> DataFrame:
    """doc_id, first_id, class_id of each row: the lowest id with the same text, and the lowest id of its class.

    Documents are in a class if their texts are equal or a chain of links joins
    them; a link is a Jaccard similarity of at least `similar` between sets of
    five-word shingles, whose bands (equal weights) meet with probability over
    1 - 4e-6 at 0.8, however often a text repeats its shingles. Null texts
    are empty, and equal as such; rows with one id are one document; a row with
    a null id is in no class (null); other columns play no part. A very long text
    is held whole with its shingles' hashes, some ten times its length; its signature has the size of any.
    """
    docs = picked(docs, text_col, doc_id=id_col).withColumn("text_hash", F.md5("text"))
    known = docs.where("doc_id is not null")
    ids = written(known.select("doc_id", "text_hash"), "ids")
    classes = written(ids.groupBy("text_hash").agg(F.min("doc_id").alias("first_id")), "text-classes")
    signed = written(
        signatures(known).join(classes.withColumnRenamed("first_id", "doc_id"), ["doc_id", "text_hash"], "left_semi")
        .dropDuplicates(["doc_id", "text_hash"]).select(F.col("doc_id").alias("node"), "signature", "weighted"),
        "signatures",
    )
    either = F.when(F.col("weighted").isNull(), _bands("signature")).otherwise(F.array_union(_bands("signature"), _bands("weighted")))
    every = signed.select("node", F.inline(either))
    signed = signed.select("node", "signature")
    order = F.struct(F.xxhash64("node", F.col("band") % 4), "node")
    shared = every.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(order)["node"].alias("pivot")).where("n > 1").drop("n")
    members = written(every.select("key", "node").join(shared, "key"), "buckets")
    near = F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")
    pairs = members.where("node <> pivot").select(*near).distinct()
    own = written(_sets(members.select("node").distinct(), known), "shingles")  # the texts are shuffled this once
    links = written(_verified(written(_likely(pairs, signed), "pairs"), own, similar), "pivot-links")
    placed = members.select("key", "node", (F.col("node") == F.col("pivot")).alias("pivot")).join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = written(placed, "placed")
    unsettled = placed.join(_mixed(placed).select("key"), "key", "left_semi").select("node").distinct()
    able = written(_linkable(own.join(unsettled, "node", "left_semi"), similar), "linkable")
    links = links.unionByName(written(_open_links(placed, signed, able, own, similar), "open-links"))
    found = components(links).select(F.col("node").alias("first_id"), "component")
    judged = (
        ids.join(classes, "text_hash").join(found, "first_id", "left")
        .select("doc_id", "first_id", F.coalesce("component", "first_id").alias("class_id"))
    )
    lone = docs.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("first_id"), F.lit(None).cast("long").alias("class_id"))
    return judged.unionByName(lone)


def deduplicated(docs: DataFrame, id_col="doc_id", text_col="text", similar=SIMILAR) -> DataFrame:
    """docs with the lowest id of each class only; rows with a null id stay, of rows repeated under one id one stays."""
    judged = near_duplicates(docs, id_col, text_col, similar)
    kept = written(judged.where("doc_id = class_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")), "kept-ids")
    chosen = docs.join(kept.select(F.col("doc_id").alias(id_col)), id_col, "left_semi")
    if not kept.where("n > 1").isEmpty():
        chosen = chosen.dropDuplicates([id_col])
    return chosen.unionByName(docs.where(F.col(id_col).isNull()))
