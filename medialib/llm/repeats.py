"""Passages that repeat across documents: what suffix-array and substring dedup share, and the two operators.

A window is a run of `window` words. Its anchor is the least of the hashes of
its `gram`-word grams (its minimiser), so equal windows have equal anchors, and
neighbouring windows mostly share one. Words are told by 64-bit hashes. The steps:

1. classes: a row per text with the lowest and highest document that has it, so
   that copies of a text are read once.
2. anchors: a row per text and anchor; those that two different texts have
   stay, and all of a text that several documents have.
3. segments: runs of windows with the same surviving anchor. Equal segments are
   counted together before they are shuffled, so a passage that a third of the
   corpus shares is one segment.
4. shards: the segments of an anchor meet in a shard, whose index of bounded
   size (an FM-index or a sparse suffix array) has all of them; what the index
   finds is all there is. The windows of an anchor that stands in very many
   different segments are dealt out by all their words first, which splits it.
5. runs of windows with the documents that share them go back to the texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fm_index, suffix_array
from .common import Rows, grams, picked, ranges, row_groups, texts, word_hashes, written

#: Low bits of a key that hold a place in the text; the rest is the hash that windows are anchored by.
PLACE_BITS = np.uint64(28)
SHARD_WORDS, HOT_SEGMENTS = 300_000, 2_000
RUN = "array<struct<at:int,n:int,low:long,high:long>>"
Search = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int], tuple[np.ndarray, np.ndarray]]


def window_anchors(hashes: np.ndarray, first: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """The runs of windows with one anchor of texts whose words' hashes stand one after the other, each from its first on.

    text, begin and end (of the first words of the run's windows, exclusive),
    and the place of the anchor's first word; and, last, the hashes of all grams.
    """
    found = grams(hashes, gram)
    span = window - gram + 1
    none = np.empty(0, np.int64)
    if len(found) < span:
        return none, none, none, none, found
    key = (found >> PLACE_BITS << PLACE_BITS) | np.arange(len(found), dtype=np.uint64)
    done = 1
    while 2 * done <= span:
        key = np.minimum(key[:-done], key[done:])
        done *= 2
    if done < span:
        key = np.minimum(key[: len(key) - (span - done)], key[span - done :])
    at = (key & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)
    sizes = np.diff(first)
    text = np.repeat(np.arange(len(sizes)), sizes)[: len(at)]
    whole = np.arange(len(at)) + window <= first[text + 1]
    fresh = whole.copy()
    fresh[1:] &= ~whole[:-1] | (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(fresh)
    last = whole.copy()
    last[:-1] &= ~whole[1:] | fresh[1:]
    return text[begin], begin, np.flatnonzero(last) + 1, at[begin], found


def _with_text_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return picked(docs, text_col, doc_id=id_col).withColumn("text_key", F.xxhash64("text"))


def shared_anchors(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """text_key, anchors: the anchors of each text that a different text has as well. docs: doc_id, text, text_key."""

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            fresh = []
            for key in batch.column("text_key").to_pylist():
                fresh.append(key not in seen)
                if len(seen) < 200_000:
                    seen.add(key)
            batch = batch.filter(pa.array(fresh, pa.bool_()))
            for begin, end in row_groups(batch.column("text")):
                part = batch.slice(begin, end - begin)
                text, _, _, at, found = window_anchors(*word_hashes(part.column("text")), window, gram)
                keys = part.column("text_key").to_numpy()[text]
                own = found[at].view(np.int64)
                order = np.lexsort((own, keys))
                once = np.ones(len(order), bool)
                once[1:] = (own[order][1:] != own[order][:-1]) | (keys[order][1:] != keys[order][:-1])
                order = order[once]
                yield pa.RecordBatch.from_arrays([pa.array(own[order]), pa.array(keys[order])], names=["anchor", "text_key"])

    rows = docs.where("doc_id is not null").select("text", "text_key").mapInArrow(anchors, "anchor long, text_key long")
    both = (
        rows.groupBy("anchor").agg(F.min("text_key").alias("a"), F.max("text_key").alias("b"))
        .where("a < b").select("anchor")
    )
    return rows.join(both, "anchor").groupBy("text_key").agg(F.collect_set("anchor").alias("anchors"))


def text_classes(docs: DataFrame) -> DataFrame:
    """text_key, text_hash, first_id and last_id (the lowest and highest doc_id with it) of each text."""
    return (
        docs.where("doc_id is not null").select("doc_id", "text_key", F.md5("text").alias("text_hash"))
        .groupBy("text_key", "text_hash").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    )


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Binary values of consecutive 64-bit numbers."""
    offsets = np.concatenate([[0], np.cumsum(sizes * 8)]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _segments(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """anchor, doc_id, last_id, start, place, words of the runs of windows whose anchor is among docs.anchors, or of all where docs.every."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in row_groups(batch.column("text")):
                part = batch.slice(low, high - low)
                hashes, first = word_hashes(part.column("text"))
                text, begin, end, at, found = window_anchors(hashes, first, window, gram)
                own = found[at]
                lists = part.column("anchors")
                wanted = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                counts = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                salt = lambda numbers: numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                keep = np.isin(own ^ salt(text), wanted ^ salt(np.repeat(np.arange(len(counts)), counts)))
                keep |= part.column("every").to_numpy(zero_copy_only=False)[text]
                text, begin, end, at, own = text[keep], begin[keep], end[keep], at[keep], own[keep]
                sizes = end - begin + window - 1
                ids, last = (part.column(c).to_numpy()[text] for c in ("doc_id", "last_id"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own.view(np.int64)), pa.array(ids), pa.array(last), pa.array(begin - first[text]), pa.array((at - begin).astype(np.int32)),
                     _lists(hashes[ranges(begin, sizes)], sizes)],
                    names=["anchor", "doc_id", "last_id", "start", "place", "words"],
                )

    return docs.select("doc_id", "last_id", "text", "anchors", "every").mapInArrow(
        cut, "anchor long, doc_id long, last_id long, start long, place int, words binary"
    )


def _windows(segments: DataFrame, window: int) -> DataFrame:
    """Segments taken apart into their windows, each dealt out by all its words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in row_groups(batch.column("words"), 256 << 10):
                part = batch.slice(low, high - low)
                lists = part.column("words")
                sizes = pa.compute.binary_length(lists).to_numpy(zero_copy_only=False) // 8
                words = np.frombuffer(b"".join(lists.to_pylist()), np.uint64)
                counts = np.maximum(0, sizes - window + 1).astype(np.int64)
                row, shift = np.repeat(np.arange(len(sizes)), counts), ranges(np.zeros(len(sizes), np.int64), counts)
                begin = np.repeat(np.cumsum(sizes) - sizes, counts) + shift
                each = np.full(len(begin), window, np.int64)
                columns = {c: part.column(c).to_numpy()[row] for c in ("doc_id", "last_id", "start", "place")}
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams(words, window)[begin].view(np.int64)), pa.array(columns["doc_id"]), pa.array(columns["last_id"]),
                     pa.array(columns["start"] + shift), pa.array((columns["place"] - shift).astype(np.int32)), _lists(words[ranges(begin, each)], each)],
                    names=["anchor", "doc_id", "last_id", "start", "place", "words"],
                )

    return segments.select("anchor", "doc_id", "last_id", "start", "place", "words").mapInArrow(
        cut, "anchor long, doc_id long, last_id long, start long, place int, words binary"
    )


def _runs(keys: np.ndarray, anchors: np.ndarray, counts: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.RecordBatch:
    """anchor, key, runs: neighbouring windows (counts: how many each segment has) that the same documents share."""
    number = np.repeat(np.arange(len(counts)), counts)
    shared = low < high
    fresh = shared.copy()
    fresh[1:] &= ~shared[:-1] | (number[1:] != number[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    last = shared.copy()
    last[:-1] &= ~shared[1:] | fresh[1:]
    begin, end = np.flatnonzero(fresh), np.flatnonzero(last) + 1
    whose, first, times = np.unique(number[begin], return_index=True, return_counts=True)
    at = begin - (np.cumsum(counts) - counts)[number[begin]]
    structs = pa.StructArray.from_arrays(
        [pa.array(at.astype(np.int32)), pa.array((end - begin).astype(np.int32)), pa.array(low[begin]), pa.array(high[begin])], names=["at", "n", "low", "high"]
    )
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(begin)).astype(np.int32)), structs)
    return pa.RecordBatch.from_arrays([pa.array(anchors[whose]), pa.array(keys[whose]), lists], names=["anchor", "key", "runs"])


def _searched(contents: DataFrame, window: int, search: Search, shard_words: int) -> DataFrame:
    """anchor, key, runs of the segments of which a window is shared by different documents; anchors are dealt to shards."""
    total = contents.agg(F.sum(F.length("words")).alias("n")).first().n or 0
    parts = max(1, round(total / (8 * shard_words)))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        size = 0

        def searched() -> pa.RecordBatch:
            shard = pa.Table.from_batches(waiting).combine_chunks()
            waiting.clear()
            column = {c: shard.column(c).to_numpy() for c in ("anchor", "key", "low", "high")}
            lists = shard.column("words")
            sizes = pa.compute.binary_length(lists).to_numpy().astype(np.int64) // 8
            words = np.frombuffer(b"".join(lists.to_pylist()), np.uint64)
            low, high = search(words, sizes, shard.column("place").to_numpy().astype(np.int64), column["low"], column["high"], window)
            return _runs(column["key"], column["anchor"], np.maximum(0, sizes - window + 1), low, high)

        for batch in batches:  # an anchor's segments stand together
            anchors, begin = batch.column("anchor").to_numpy(), 0
            if waiting and len(anchors) and size >= shard_words and waiting[-1].column("anchor")[-1].as_py() != anchors[0]:
                yield searched()
                size = 0
            sizes = np.cumsum(pa.compute.binary_length(batch.column("words")).to_numpy(zero_copy_only=False)) // 8
            for edge in (np.flatnonzero(anchors[1:] != anchors[:-1]) + 1).tolist():
                if size + sizes[edge - 1] - (sizes[begin - 1] if begin else 0) >= shard_words:
                    waiting.append(batch.slice(begin, edge - begin))
                    yield searched()
                    begin, size = edge, 0
            if begin < len(anchors):
                waiting.append(batch.slice(begin))
                size += int(sizes[-1] - (sizes[begin - 1] if begin else 0))
        if waiting:
            yield searched()

    return (
        contents.select("anchor", "key", "words", "place", "low", "high").repartition(parts, "anchor").sortWithinPartitions("anchor")
        .mapInArrow(found, f"anchor long, key long, runs {RUN}")
    )


def shared_windows(
    docs: DataFrame, window: int, gram: int, search: Search, shard_words=SHARD_WORDS, hot_segments=HOT_SEGMENTS
) -> DataFrame:
    """text_key, text_hash, first_id, last_id, runs of each text of which a window stands in documents with different ids.

    runs: from window `at` on, n windows stand in documents of which low is the lowest and high the highest.
    docs: doc_id, text, text_key.
    """
    classes = written(text_classes(docs), "text-classes")
    several = F.col("first_id") < F.col("last_id")
    chosen = written(
        classes.join(shared_anchors(docs, window, gram), "text_key", "left").where(several | F.col("anchors").isNotNull())
        .select("text_key", F.col("first_id").alias("doc_id"), "last_id", several.alias("every"), F.when(~several, F.col("anchors")).alias("anchors")),
        "anchors",
    )

    def keyed(rows: DataFrame) -> DataFrame:
        return rows.withColumn("key", F.xxhash64("words", "place"))

    def contents(rows: DataFrame) -> DataFrame:
        return rows.groupBy("anchor", "key", "words", "place").agg(F.min("doc_id").alias("low"), F.max("last_id").alias("high"))

    segments = written(keyed(_segments(docs.join(chosen, ["doc_id", "text_key"]), window, gram)), "segments")
    each = written(contents(segments), "contents")
    hot = written(each.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_segments).select("anchor"), "hot-anchors")
    if not hot.isEmpty():
        apart = written(keyed(_windows(segments.join(hot, "anchor", "left_semi"), window)), "windows")
        segments = segments.join(hot, "anchor", "left_anti").unionByName(apart)
        each = each.join(hot, "anchor", "left_anti").unionByName(contents(apart))
    found = written(_searched(each, window, search, shard_words), "shared-windows")
    placed = F.transform(
        "runs", lambda r: F.struct((F.col("start") + r["at"]).alias("at"), r["n"].cast("long").alias("n"), r["low"].alias("low"), r["high"].alias("high"))
    )
    runs = (
        segments.select("anchor", "key", "doc_id", "start").join(found, ["anchor", "key"])
        .groupBy(F.col("doc_id").alias("first_id")).agg(F.flatten(F.collect_list(placed)).alias("runs"))
    )
    return classes.join(runs, "first_id").select("text_key", "text_hash", "first_id", "last_id", "runs")


def _of_documents(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """doc_id, text_key, first_id, last_id, runs: those of a text for each document that has it."""
    own = docs.where("doc_id is not null").select("doc_id", "text_key", F.md5("text").alias("text_hash")).distinct()
    return own.join(shared, ["text_key", "text_hash"]).drop("text_hash")


def _windows_of(runs: pa.Scalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """at, n, low of a list of runs."""
    return tuple(runs.values.field(c).to_numpy() for c in ("at", "n", "low"))


def _covered(n: int, window: int, starts: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Which of n words the windows from each start on, so many, cover."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + times - 1 + window, -1)
    return np.cumsum(edges[:n]) > 0


def substring_dedup(docs: DataFrame, id_col="doc_id", text_col="text", window=13, gram=5, **sizes) -> DataFrame:
    """Removes what an earlier document has: doc_id, n_words, n_removed, kept_text of each row.

    A word goes if a window over it also starts in a document with a smaller
    doc_id; the index of a shard is an FM-index. The words that stay are joined
    by a space. A null text has no words; a null doc_id neither loses words nor
    costs another's; rows with one doc_id are not earlier than each other; other
    columns play no part. Tables between the steps are written when this is called.
    """
    docs = _with_text_key(docs, id_col, text_col)
    shared = shared_windows(docs, window, gram, fm_index.windows_shared, **sizes)
    taken = F.filter("runs", lambda r: r["low"] < F.col("doc_id"))
    side = _of_documents(docs, written(shared, "shared-texts")).select("doc_id", "text_key", taken.alias("runs")).where(F.size("runs") > 0)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows(schema)
        for batch in batches:
            for text, doc, runs in zip(texts(batch), batch.column("doc_id").to_pylist(), batch.column("runs"), strict=True):
                left = words = text.split()
                if runs.is_valid:
                    starts, times, _ = _windows_of(runs)
                    gone = _covered(len(words), window, starts, times)
                    left = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                whole = b" ".join(left)
                rows.add(doc, len(words), len(words) - len(left), whole.decode(), size=len(whole))
                if rows.full():
                    yield rows.batch()
        yield from rows.rest()

    return (
        docs.join(written(side, "removals"), ["doc_id", "text_key"], "left").select("doc_id", "text", "runs")
        .mapInArrow(kept, "doc_id long, n_words long, n_removed long, kept_text string")
    )


def repeated_passages(docs: DataFrame, id_col="doc_id", text_col="text", window=50, gram=8, **sizes) -> DataFrame:
    """Passages of window words or more that documents with different ids share: doc_id, start_word, end_word, n_words, first_doc_id.

    A row per maximal stretch of a document, ends exclusive, that such windows
    cover; first_doc_id is the lowest document that has one of them, the
    document itself where it comes first; for copies of a whole text it is the
    lowest document with that text. The index of a shard is a sparse suffix
    array. Shorter or null texts, null ids, and rows that are repeated under one
    id have no rows; other columns play no part. Tables between the steps are
    written when this is called.
    """
    docs = _with_text_key(docs, id_col, text_col)
    shared = shared_windows(docs, window, gram, suffix_array.windows_shared, **sizes)
    side = _of_documents(docs, written(shared, "shared-texts"))
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "start_word", "end_word", "n_words", "first_doc_id")])

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows(schema)
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "first_id", "last_id"))
            for doc, first, last, runs in zip(*columns, batch.column("runs"), strict=True):
                at, n, low = _windows_of(runs)
                order = np.argsort(at, kind="stable")
                at, n, low = at[order], n[order], low[order]
                cuts = np.flatnonzero(at[1:] > np.maximum.accumulate(at + n - 1)[:-1] + window) + 1
                for own in np.split(np.arange(len(at)), cuts):
                    begin, end = int(at[own[0]]), int((at[own] + n[own]).max()) - 1 + window
                    rows.add(doc, begin, end, end - begin, first if first < last else int(low[own].min()))
                if rows.full():
                    yield rows.batch()
        yield from rows.rest()

    return side.mapInArrow(stretches, "doc_id long, start_word long, end_word long, n_words long, first_doc_id long")


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT r, doc_id, i, md5(array_to_string(w[i:i+12], ' ')) AS g
  FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
gone AS (
  SELECT DISTINCT r, i + k AS p
  FROM (SELECT r, i, doc_id, min(doc_id) OVER (PARTITION BY g) AS first_id FROM win), range(0, 13) AS s(k)
  WHERE first_id < doc_id),
each AS (SELECT r, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM each ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

PASSAGES_SQL = r"""
WITH t AS (SELECT DISTINCT doc_id, coalesce(text, '') AS t FROM documents WHERE doc_id IS NOT NULL),
d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         min(doc_id) OVER (PARTITION BY t) AS lo, max(doc_id) OVER (PARTITION BY t) AS hi
  FROM t),
win AS (
  SELECT r, i, min(doc_id) OVER (PARTITION BY g) AS lo, max(doc_id) OVER (PARTITION BY g) AS hi
  FROM (SELECT r, doc_id, i, md5(array_to_string(w[i:i+49], ' ')) AS g
        FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50))),
cut AS (SELECT *, coalesce(i - lag(i) OVER (PARTITION BY r ORDER BY i) > 50, true) AS fresh FROM win WHERE lo < hi),
run AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY r ORDER BY i) AS no FROM cut)
SELECT doc_id, 0::BIGINT AS start_word, len(w)::BIGINT AS end_word, len(w)::BIGINT AS n_words, lo AS first_doc_id
FROM d WHERE lo < hi AND len(w) >= 50
UNION ALL
SELECT doc_id, s - 1, e + 49, e - s + 50, f
FROM (SELECT r, min(i) AS s, max(i) AS e, min(lo) AS f FROM run GROUP BY r, no) JOIN d USING (r) WHERE d.lo = d.hi
"""
