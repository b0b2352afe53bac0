"""Phrase collocation mining with stripes: for each prefix an associative counter of the words that follow it.

The phrases of k words are counted as stripes of their first k - 1 words. Each
task counts its texts' stripes, stripes of one prefix meet and are added
elementwise, and what has the least count stays. A phrase can only have that
count if its first and its last k - 1 words have it, so the stripes of a level
take only phrases of which the level before knows both. It is known from a
Bloom filter, which lets pass some that it shouldn't: they fall at the sum, and
no phrase is lost. Extensions, prefix totals and the most frequent extension of
a phrase are read off the stripes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from .common import flat, hashes_at, mixed, picked, row_groups, word_starts, written

SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_BREAK, _GAP = np.zeros(256, bool), np.zeros(256, bool)
_BREAK[list(SEPARATORS)] = True
_GAP[list(SEPARATORS + b" \t")] = True
#: A random number for each byte of a word, one for both cases of an ASCII letter.
_NUMBERS = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
_NUMBERS[65:91] = _NUMBERS[97:123]
_NUMBERS[_GAP] = 0
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bits of a Bloom filter for each phrase, and at most: what is broadcast stays below 256 MB. A fuller filter only prunes less.
BITS_EACH, MOST_BITS = 16, 1 << 31
#: Bits of a slice of a filter, the unit in which it is built.
SLICE = 1 << 15
#: Prefixes with more than this share of all words have stripes in sections.
SECTION_SHARE = 1 << 12
SECTION_WORDS = 1 << 24
#: Words of all texts for each part in which stripes are sent and added, at most.
PART_WORDS = 1 << 21


def lang_numbers(langs: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in langs], np.uint64)


def tokens(column: pa.Array, langs: list[str]) -> tuple[np.ndarray, ...]:
    """Of all words of the texts: the bytes, where each begins and ends, 64-bit hashes (of language and word), the text's number, and whether the next word is of the same piece."""
    data, offsets = flat(column)
    starts = word_starts(data, offsets, _GAP)
    text = np.searchsorted(offsets, starts, side="right") - 1
    hashes = mixed(hashes_at(data, starts, _NUMBERS) ^ lang_numbers(langs)[text])
    # the first byte between words after each one's begin, or its text's end
    gaps = np.append(np.flatnonzero(_GAP[data]), len(data))
    ends = np.minimum(gaps[np.searchsorted(gaps, starts)], offsets[text + 1])
    joined = np.zeros(len(starts), bool)
    if len(starts):
        joined[:-1] = ~np.logical_or.reduceat(_BREAK[data], starts)[:-1] & (text[1:] == text[:-1])
    return data, starts, ends, hashes, text, joined


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    for batch in batches:
        for begin, end in row_groups(batch.column("text"), 8 << 20):
            part = batch.slice(begin, end - begin)
            yield part.column("text"), part.column("lang").to_pylist()


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, w (hash), n of every word; one row for each language with word null has all its words. docs: lang, text."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for column, langs in _groups(batches):
            data, starts, ends, hashes, text, _ = tokens(column, langs)
            found, first, n = np.unique(hashes, return_index=True, return_counts=True)
            whole = data.tobytes()
            words = [whole[a:b].translate(_LOWER).decode() for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
            totals: dict[str, int] = {}
            for lang, k in zip(langs, np.bincount(text, minlength=len(langs)).tolist(), strict=True):
                totals[lang] = totals.get(lang, 0) + k
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([langs[t] for t in text[first].tolist()] + list(totals), pa.string()), pa.array(words + [None] * len(totals), pa.string()),
                    pa.concat_arrays([signed(found), pa.array([0] * len(totals), pa.int64())]), pa.concat_arrays([pa.array(n, pa.int64()), pa.array(list(totals.values()), pa.int64())]),
                ],
                names=["lang", "word", "w", "n"],
            )

    rows = docs.mapInArrow(counted, "lang string, word string, w long, n long")
    return rows.groupBy("lang", "word", "w").agg(F.sum("n").alias("n"))


def phrase_keys(words: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of each phrase of words' hashes, by position."""
    key = words[0].copy()
    for w in words[1:]:
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + w)
    return key


def _places(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each key in a Bloom filter of so many, both in one slice."""
    keys = mixed(keys + np.uint64(1))
    base = (keys >> np.uint64(20)) % np.uint64(bits // SLICE) * np.uint64(SLICE)
    return base + (keys & np.uint64(SLICE - 1)), base + (mixed(keys) & np.uint64(SLICE - 1))


class Filter:
    """A Bloom filter: bytes of a whole number of slices."""

    def __init__(self, bits: int):
        self.bits, self.table = bits, np.zeros(bits // 8, np.uint8)

    def knows(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for at in _places(keys, self.bits):
            found &= (self.table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return found


def phrase_filter(phrases: DataFrame, size: int) -> Filter:
    """The filter of the phrases w1, w2, …: its slices are made by tasks, and what comes to the driver is MOST_BITS at most."""
    bits = SLICE
    while bits < min(MOST_BITS, BITS_EACH * phrases.count()):
        bits *= 2
    columns = [f"w{k}" for k in range(1, size + 1)]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = _places(phrase_keys([batch.column(c).to_numpy().view(np.uint64) for c in columns]), bits)
            yield pa.RecordBatch.from_arrays([signed(one >> np.uint64(15)), signed(one), signed(two)], names=["slice", "one", "two"])

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: dict[int, np.ndarray] = {}
        for batch in batches:
            for name in ("one", "two"):
                for no, at in _split(batch.column("slice").to_numpy(), batch.column(name).to_numpy()):
                    slices.setdefault(no, np.zeros(SLICE, bool))[at & (SLICE - 1)] = True
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(slices), pa.int64()), pa.array([np.packbits(b, bitorder="little").tobytes() for b in slices.values()], pa.binary())], names=["slice", "bits"]
        )

    rows = phrases.select(*columns).mapInArrow(keyed, "slice long, one long, two long").repartition("slice").mapInArrow(filled, "slice long, bits binary")
    made = Filter(bits)
    for batch in rows.toArrow().to_batches():
        for no, packed in zip(batch.column("slice").to_pylist(), batch.column("bits").to_pylist(), strict=True):
            made.table[no * (SLICE // 8) : (no + 1) * (SLICE // 8)] = np.frombuffer(packed, np.uint8)
    return made


def _split(keys: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(keys, kind="stable")
    own, first = np.unique(keys[order], return_index=True)
    yield from zip(own.tolist(), np.split(values[order], first[1:]), strict=True)


def _sections(prefix: np.ndarray, following: np.ndarray, hot: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """The section of a prefix's stripe in which a following word is counted."""
    if not len(hot):
        return np.zeros(len(prefix), np.int64)
    at = np.minimum(np.searchsorted(hot, prefix), len(hot) - 1)
    n = np.where(hot[at] == prefix, parts[at], 1).astype(np.uint64)
    return (mixed(following) % n).astype(np.int64)


def stripes(docs: DataFrame, size: int, known, hot, parts: int) -> DataFrame:
    """The stripes of phrases of size words, in a row for each part of a group of texts: part, w1 … (the stripes' prefixes), sizes (of the stripes), following, counts.

    known: broadcast filter of the phrases one word shorter. hot: broadcast
    keys of prefixes, sorted, and their numbers of sections. A stripe's part, of
    so many, comes from its prefix and section.
    """
    names = [f"w{k}" for k in range(1, size)]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for column, langs in _groups(batches):
            *_, hashes, _, joined = tokens(column, langs)
            m = len(hashes) - size + 1
            if m <= 0:
                continue
            shorter = [hashes[k : len(hashes) - size + 2 + k] for k in range(size - 1)]
            there = known.value.knows(phrase_keys(shorter))
            whole = there[:-1] & there[1:]
            for k in range(size - 1):
                whole &= joined[k : k + m]
            at = np.flatnonzero(whole)
            if not len(at):
                continue
            words = [hashes[at + k] for k in range(size)]
            _, first, n = np.unique(phrase_keys(words), return_index=True, return_counts=True)
            words = [w[first] for w in words]
            prefix = phrase_keys(words[:-1])
            section = _sections(prefix, words[-1], *hot.value).astype(np.uint64)
            own = mixed(prefix + section)  # a stripe's number
            part = (own % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((own, part))
            own, part = own[order], part[order]
            head = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            begin = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            by_stripe = pa.array(np.append(np.searchsorted(head, begin), len(head)).astype(np.int32))
            by_word = pa.array(np.append(begin, len(own)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part[begin], pa.int64()), *[pa.ListArray.from_arrays(by_stripe, signed(w[order][head])) for w in words[:-1]],
                    pa.ListArray.from_arrays(by_stripe, pa.array(np.diff(np.append(head, len(own))).astype(np.int32), pa.int32())),
                    pa.ListArray.from_arrays(by_word, signed(words[-1][order])), pa.ListArray.from_arrays(by_word, pa.array(n[order], pa.int64())),
                ],
                names=["part", *names, "sizes", "following", "counts"],
            )

    return docs.mapInArrow(counted, "part long, " + ", ".join(f"{c} array<long>" for c in names) + ", sizes array<int>, following array<long>, counts array<long>")


def merged(rows: DataFrame, size: int, least: int, tasks: int) -> DataFrame:
    """w1 … w<size>, a: the phrases that have least occurrences in the stripes, which are added elementwise, one part after the other."""
    names = [f"w{k}" for k in range(1, size)]
    result = [*names, f"w{size}", "a"]

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # the words and counts of the part that the next row may go on with

        def out() -> pa.RecordBatch:
            *words, n = [np.concatenate(x) for x in zip(*held, strict=True)]
            keys = phrase_keys([w.view(np.uint64) for w in words])
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            total = np.add.reduceat(n[order], head)
            often = total >= least
            at = order[head[often]]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (*[w[at] for w in words], total[often])], names=result)

        last = None
        for batch in batches:
            for k, part in enumerate(batch.column("part").to_pylist()):
                if held and part != last:
                    yield out()
                    held = []
                last = part
                prefix, (sizes, following, counts) = ([batch.column(c)[k].values.to_numpy() for c in x] for x in (names, ["sizes", "following", "counts"]))
                held.append([*[np.repeat(w, sizes) for w in prefix], following, counts])
        if held:
            yield out()

    dealt = rows.repartitionById(tasks, (F.col("part") % tasks).cast("int")).sortWithinPartitions("part")
    return dealt.mapInArrow(added, ", ".join(f"{c} long" for c in result))


def _hot(spark, phrases: DataFrame, size: int, total: int):
    """Broadcast: the keys of the prefixes that have more than a share of all words, and in how many sections their stripes are counted.

    There are at most `parts` of them: SECTION_SHARE, or a part for each SECTION_WORDS words.
    """
    parts = max(SECTION_SHARE, -(-total // SECTION_WORDS))
    columns = [f"w{k}" for k in range(1, size + 1)]
    often = phrases.where(F.col("a") * parts > total).select(*columns, "a").toArrow()
    words = [often.column(c).to_numpy().view(np.uint64) for c in columns]
    keys, times = phrase_keys(words), often.column("a").to_numpy()
    order = np.argsort(keys)
    return spark.sparkContext.broadcast((keys[order], -(-times[order] * parts // max(1, total))))


def phrases_by_size(docs: DataFrame, most_words: int, least: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Languages (lang, n), words (lang, word, w1, a) and the phrases of 1, 2, … most_words words (w1 …, a) with least occurrences; docs: lang, text."""
    spark = docs.sparkSession
    counted = written(word_counts(docs).where((F.col("n") >= least) | F.col("word").isNull()), "words")
    langs = counted.where("word is null").select("lang", "n")
    words = counted.where("word is not null").select("lang", "word", F.col("w").alias("w1"), F.col("n").alias("a"))
    total = langs.agg(F.sum("n")).first()[0] or 0
    found = [words.select("w1", "a")]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = tasks * max(1, -(-total // (tasks * PART_WORDS)))
    for size in range(2, most_words + 1):
        before = found[-1]
        known = spark.sparkContext.broadcast(phrase_filter(before, size - 1))
        found.append(written(merged(stripes(docs, size, known, _hot(spark, before, size - 1, total), parts), size, least, tasks), f"phrases-{size}"))
    return langs, words, found


def _part(found: list[DataFrame], begin: int, end: int, name: str) -> DataFrame:
    """The counts of phrases of end - begin words, keyed as the words begin … end of longer ones."""
    part = found[end - begin - 1]
    return part.select(*[F.col(f"w{k - begin + 1}").alias(f"w{k + 1}") for k in range(begin, end)], F.col("a").alias(name))


def scored(found: list[DataFrame], size: int) -> DataFrame:
    """w1 …, a, l, r, score of the phrases of size words: those of the lowest-scoring cut, ties to the smallest first part."""
    rows, wide = found[size - 1], DecimalType(38, 0)
    for k in range(1, size):
        rows = rows.join(_part(found, 0, k, f"l{k}"), [f"w{i}" for i in range(1, k + 1)]).join(_part(found, k, size, f"r{k}"), [f"w{i}" for i in range(k + 1, size + 1)])
    # a product of more than 64 bits, divided whole
    cuts = [
        F.struct(
            F.expr(f"CAST(2000000 AS DECIMAL(10, 0)) * CAST(a AS DECIMAL(20, 0)) div CAST(l{k} + r{k} AS DECIMAL(20, 0))").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")
        )
        for k in range(1, size)
    ]
    rows = rows.withColumn("cut", F.least(*cuts) if len(cuts) > 1 else cuts[0])
    return rows.select(*[f"w{k}" for k in range(1, size + 1)], "a", "cut.l", "cut.r", "cut.score")


def _longest_share(found: list[DataFrame], size: int) -> list[DataFrame]:
    """For the phrases of size words, the most frequent extension to the right and to the left: w1 …, most."""
    longer = found[size]
    names = [f"w{k}" for k in range(1, size + 1)]
    left = [F.col(f"w{k + 1}").alias(f"w{k}") for k in range(1, size + 1)]
    return [longer.groupBy(*names).agg(F.max("a").alias("right")), longer.select(*left, "a").groupBy(*names).agg(F.max("a").alias("left"))]


def collocations(docs: DataFrame, text_col="text", lang_col="lang", most_words=4, least=30, top=2000, subsumed=80, salts=64) -> DataFrame:
    """The top phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z) and cut at SEPARATORS; a phrase of 2 to
    most_words words lies within a piece. a, l and r are the occurrences of the
    phrase and of the two parts of its lowest-scoring cut, score is
    floor(2,000,000 a / (l + r)), n all words of the language. A phrase goes if
    a longer one with it has subsumed percent of its occurrences; one that is
    longer by a word has at least as many as those longer still, so these are
    asked. A null text is empty, a null language 'und', repeated rows count
    each, other columns play no part, and an empty table gives an empty one.
    Words are told by 64-bit hashes, exactly counted by text first. A text is
    held whole in a task with some 30 bytes for each of its words. The tables of
    words and phrases are written when this is called.
    """
    rows = picked(docs, text_col, lang=lang_col).withColumn("lang", F.coalesce("lang", F.lit("und")))
    langs, words, found = phrases_by_size(rows, most_words, least)
    every = None
    for size in range(2, most_words + 1):
        names = [f"w{k}" for k in range(1, size + 1)]
        own = scored(found, size)
        if size < most_words:
            right, left = _longest_share(found, size)
            most = F.greatest(F.coalesce("right", F.lit(0)), F.coalesce("left", F.lit(0))).cast("decimal(20,0)")
            own = own.join(right, names, "left").join(left, names, "left").where(~(100 * most >= subsumed * F.col("a").cast("decimal(20,0)"))).drop("right", "left")
        for k in range(1, size + 1):
            own = own.join(words.select(F.col("w1").alias(f"w{k}"), F.col("word").alias(f"t{k}"), *(["lang"] if k == 1 else [])), f"w{k}")
        own = own.select("lang", F.concat_ws(" ", *[f"t{k}" for k in range(1, size + 1)]).alias("phrase"), "a", "l", "r", "score")
        every = own if every is None else every.unionByName(own)
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the best of each share of a language first, so that no task has all of one
    shares = every.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    shares = shares.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*best))).where(F.col("rank") <= top)
    ranked = shares.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(langs, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


ORACLE_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
g AS (SELECT lang, m, w[i:i + m - 1] AS g FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM p, range(1, 5) AS s(m) WHERE len(w) >= m)),
f AS (SELECT lang, m, g, count(*) AS a FROM g GROUP BY lang, m, g HAVING count(*) >= 30),
cut AS (
  SELECT c.lang, c.m, c.g, c.a, k, l.a AS l, r.a AS r, (2000000::HUGEINT * c.a) // (l.a + r.a) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM f WHERE m > 1) c
  JOIN f l ON l.lang = c.lang AND l.g = c.g[1:k] JOIN f r ON r.lang = c.lang AND r.g = c.g[k + 1:]),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inside AS (
  SELECT lang, g[i:i + k - 1] AS g, max(a) AS most
  FROM (SELECT lang, g, a, k, unnest(range(1, m - k + 2)) AS i FROM f, range(2, 4) AS s(k) WHERE m > k) GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN inside USING (lang, g) WHERE most IS NULL OR 100 * most < 80 * a),
named AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM named) JOIN total USING (lang)
WHERE rank <= 2000
"""
