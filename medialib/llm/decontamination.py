"""Benchmark decontamination: CGK embeddings and bit-sampling LSH over item-sized windows, then exact edit distance.

The CGK random walk reads a window word by word and stays or moves on as a
random bit of word and step says; two texts a few edits apart fall into step
again, so their walks agree at most steps. A table samples a few steps of one
walk as its key; walks times tables make the recall. Only windows that can lie
within the edit bound are embedded: with at most t edits a window keeps at least
n - q + 1 - q t of the item's n - q + 1 word q-grams, within t places of where
they stand in the item (the q-gram lemma), so none is lost by that. What the
tables propose is checked by edit distance over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rows, alnum_words, grams, hashed, mixed, picked, ranges, texts

GRAM, WALKS, TABLES, SAMPLED = 3, 8, 8, 4
BLOCK_CHARS = 8 << 20
#: How many words of a text, gram postings, and steps of walks are in memory at a time.
STRETCH, MOST_POSTINGS, MOST_STEPS = 4096, 1 << 19, 1 << 21
HITS = pa.schema([(c, pa.int64()) for c in ("doc_id", "item_id", "start_word", "n_words", "edits")])


def nearest_stretch(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(edits, begin, end) of the stretch of text with the least word edit distance to item; the first such end, the longest stretch for it."""

    def last_row(a: np.ndarray, b: np.ndarray, free: bool) -> np.ndarray:
        places = np.arange(len(b) + 1)
        row = np.zeros(len(b) + 1, np.int64) if free else places
        for k, word in enumerate(a):
            new = np.concatenate([[k + 1], np.minimum(row[1:] + 1, row[:-1] + (b != word))])
            row = np.minimum.accumulate(new - places) + places
        return row

    row = last_row(item, text, True)
    end = int(row.argmin())
    back = last_row(item[::-1], text[:end][::-1], False)
    return int(row[end]), end - int(len(back) - 1 - back[::-1].argmin()), end


class Items:
    """A block of benchmark items: gram postings for the lemma, and the LSH tables of their walks."""

    def __init__(self, rows: list[tuple[int, str]], max_edits: float, seed: int = 7):
        found = [(key, hashed(alnum_words(text.encode()))) for key, text in sorted(set(rows))]
        self.items = [(key, words) for key, words in found if len(words)]
        self.sizes = np.array([len(w) for _, w in self.items], np.int64)
        self.bounds = (self.sizes * max_edits).astype(np.int64)
        widths = np.minimum(GRAM, self.sizes // (self.bounds + 1)).clip(1)
        self.least = np.maximum(1, self.sizes - widths + 1 - widths * self.bounds)
        self.postings = {}
        for q in sorted(set(widths.tolist())):
            own = [(no, grams(words, q)) for no, (_, words) in enumerate(self.items) if widths[no] == q]
            names, rank = np.unique(np.concatenate([g for _, g in own]), return_inverse=True)
            item = np.concatenate([np.full(len(g), no) for no, g in own])
            place = np.concatenate([np.arange(len(g)) for _, g in own])
            line = rank * len(self.items) + item
            order = np.argsort(line, kind="stable")
            self.postings[q] = names, line[order], item[order], place[order]
        random = np.random.default_rng(seed)
        self.walk_seeds = random.integers(1, 2**63, WALKS, dtype=np.uint64)
        self.samples = np.sort(random.random((WALKS, TABLES, SAMPLED)), axis=2)
        keys = [self.keys(words, np.zeros(1, np.int64), len(words)).ravel() for _, words in self.items]
        table = np.concatenate([np.empty(0, np.uint64), *keys])
        order = np.argsort(table, kind="stable")
        self.table, self.table_item = table[order], np.repeat(np.arange(len(self.items)), WALKS * TABLES)[order]

    def keys(self, words: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
        """The table keys (window x walk and table) of the windows of `size` words from each start; past the text's end is padding."""
        padded = np.append(words, np.uint64(0))
        limit = np.minimum(starts + size, len(words))[:, None]
        at = np.repeat(starts[:, None], WALKS, 1)
        steps = np.empty((2 * size, *at.shape), np.uint64)
        for step in range(2 * size):
            inside = at < limit
            word = np.where(inside, padded[np.minimum(at, len(words))], np.uint64(0))
            steps[step] = word
            move = mixed(word ^ (self.walk_seeds + np.uint64(step * 0x9E3779B97F4A7C15 % 2**64))) >> np.uint64(63)
            at = at + (inside & (move == 1))
        place = (self.samples * 2 * size).astype(np.int64)
        walk = np.arange(WALKS)[:, None, None]
        taken = steps[place, :, walk]  # walk, table, sample, window
        key = np.full(taken.shape[:2] + taken.shape[3:], np.uint64(size))
        for k in range(SAMPLED):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + taken[:, :, k])
        which = (np.arange(WALKS)[:, None] * TABLES + np.arange(TABLES)).astype(np.uint64)
        return mixed(key + which[:, :, None]).reshape(WALKS * TABLES, -1).T

    def windows(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(size, start) of the windows that may lie within an item's bound.

        A text is read in stretches that overlap by the longest item and its
        bound, so that each window is whole in one; where a stretch's grams have
        many postings, they are gone through by ranges of items.
        """
        found_here = [np.empty(0, np.int64)]
        most = int((self.sizes + 2 * self.bounds).max(initial=0)) + GRAM
        step = max(STRETCH, 2 * most)
        for q, (names, line, item, place) in self.postings.items():
            found = grams(words, q)
            at = np.minimum(np.searchsorted(names, found), len(names) - 1)
            known = np.flatnonzero(names[at] == found)
            for begin in range(0, max(1, len(words) - most), step):
                there = known[np.searchsorted(known, begin) : np.searchsorted(known, begin + step + most)]
                if not len(there):
                    continue
                low = at[there] * len(self.items)
                total = int((np.searchsorted(line, low + len(self.items)) - np.searchsorted(line, low)).sum())
                cuts = np.linspace(0, len(self.items), -(-total // MOST_POSTINGS) + 1).astype(np.int64)
                for least, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    first = np.searchsorted(line, low + least)
                    times = np.searchsorted(line, low + end) - first
                    posting = ranges(first, times)
                    who, shift = item[posting], np.repeat(there, times) - place[posting]
                    own, start = self._within(who, shift)
                    found_here.append(np.unique(self.sizes[own] << 40 | start))
        both = np.unique(np.concatenate(found_here))
        return both >> 40, both & ((np.int64(1) << 40) - 1)

    def _within(self, who: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The (item, start) that grams enough speak for, from each gram's item and start of the window that it would give."""
        wide = np.int64(1) << 40
        line = np.sort(who * wide + shift + (wide >> 1))
        who, shift = line >> 40, (line & (wide - 1)) - (wide >> 1)
        bound = self.bounds[who]
        near = np.searchsorted(line, line + bound, side="right") - np.searchsorted(line, line - bound)
        ok = near >= self.least[who]
        return who[ok], np.maximum(shift[ok], 0)

    def hits(self, text: bytes) -> dict[int, tuple[int, int, int]]:
        """item_id: (edits, start word, words) of the nearest stretch of each item that is within its bound."""
        words = hashed(alnum_words(text))
        sizes, starts = self.windows(words)
        pairs: set[tuple[int, int]] = set()
        for size in np.unique(sizes).tolist():
            own = starts[sizes == size]
            at_once = max(1, MOST_STEPS // (2 * size * WALKS))
            for begin in range(0, len(own), at_once):
                part = own[begin : begin + at_once]
                keys = self.keys(words, part, size)
                low = np.searchsorted(self.table, keys)
                times = np.searchsorted(self.table, keys, side="right") - low
                for w, k in zip(*np.nonzero(times), strict=True):
                    pairs.update((int(no), int(part[w])) for no in self.table_item[low[w, k] : low[w, k] + times[w, k]])
        best: dict[int, tuple[int, int, int]] = {}
        for no, start in sorted(pairs):
            key, item = self.items[no]
            bound = int(self.bounds[no])
            begin = max(0, start - bound)
            edits, a, b = nearest_stretch(item, words[begin : start + len(item) + 2 * bound])
            found = (edits, begin + a, b - a)
            if edits <= bound and found < best.get(key, (1 << 60, 0, 0)):
                best[key] = found
        return best


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text",
    item_col="item_id", item_text_col="text", max_edits=0.2,
) -> DataFrame:
    """doc_id, item_id, start_word, n_words, edits: for each row of docs, its nearest stretch to each item within the bound.

    Words are lower-cased runs of letters and digits; an item of n words is found
    where a stretch is at most max_edits n word edits away. Items without words
    and null texts are found nowhere; repeated items count once, repeated rows of
    docs give repeated results. The benchmark is searched in blocks of bounded
    size, each against all rows of docs (a scan for each BLOCK_CHARS of items). A
    very long text is read in stretches; time grows with its length and the grams
    that it shares with items, memory with its length alone.
    """
    items = benchmark.where(F.col(item_text_col).isNotNull()).select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("item")).distinct()
    total = items.agg(F.sum(F.length("item"))).first()[0] or 0
    blocks = -(-total // BLOCK_CHARS)
    numbered = items.withColumn("block", F.pmod(F.xxhash64("item_id", "item"), F.lit(max(1, blocks))))
    chosen = picked(docs, text_col, doc_id=id_col)
    out = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, start_word long, n_words long, edits long")
    for block in range(blocks):
        rows = [(r.item_id, r.item) for r in numbered.where(F.col("block") == block).select("item_id", "item").collect()]
        shared = docs.sparkSession.sparkContext.broadcast(Items(rows, max_edits))  # BLOCK_CHARS of items, by a hash

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            rows = Rows(HITS)
            for batch in batches:
                for key, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
                    for item, (edits, start, n) in shared.value.hits(text).items():
                        rows.add(key, item, start, n, edits)
                    if rows.full():
                        yield rows.batch()
            yield from rows.rest()

        found = chosen.mapInArrow(search, "doc_id long, item_id long, start_word long, n_words long, edits long")
        out = found if block == 0 else out.unionByName(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", **options) -> DataFrame:
    """docs without the rows whose id contaminated() finds; rows with a null id stay."""
    bad = contaminated(docs, benchmark, id_col, text_col, **options).select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(bad, id_col, "left_anti").select(*docs.columns)
