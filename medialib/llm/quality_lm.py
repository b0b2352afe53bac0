"""A quality classifier by perplexity under an interpolated modified Kneser-Ney trigram model of trusted text.

Triples are counted in parts, by their last two words; continuation counts and
the counts of contexts follow from them and are packed into shards by the n-grams'
hashes. Texts are scored by joining their n-grams, once for each block of texts,
with the counts of the model's shards, so no task and no driver has the whole
model, which grows with the trusted texts. Shards are made, and documents scored,
in a fixed number of rounds, so that only a part of what is shuffled lies on disk
at a time.
Every text is scored whole; a document is rejected if its perplexity is above a
high quantile of the perplexities of held-out trusted documents in its language.
"""

from __future__ import annotations

import itertools
import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clear, hashed, mixed, picked, ranges, texts, written

#: The word before a text's first one; and how many words the open vocabulary is taken to have.
BEGIN, WORDS = 0, 1 << 20
PRIOR_WORDS = 30.0
#: N-grams of a shard of the model; words of a block of texts, which asks for an n-gram once; what is worked on at a time.
SHARD, BLOCK_WORDS, RANGE = 1 << 20, 1 << 20, 1 << 20
#: Bits of the filter for a shard, and for all shards at most; asked n-grams for each of the model's before shards are copied.
SLICE, MOST_BITS, ASKS_EACH = 1 << 22, 1 << 31, 8
#: Words of a chunk of trusted text, in which triples are counted before the shuffle; bytes of text for each part of the counts.
CHUNK_WORDS, PART_BYTES = 1 << 20, 1 << 22
#: Rounds in which shards are made, documents are scored (at most), and the blocks of a round ask; bytes of text that a round of
#: documents is worth, and those of a task of it, about a block.
SHARD_ROUNDS, DOC_ROUNDS, ASK_ROUNDS = 3, 8, 2
ROUND_BYTES, TASK_BYTES = 1 << 25, 6 * BLOCK_WORDS
#: Trusted ids (8 bytes each) that are broadcast at most; more are joined by a shuffle.
BROADCAST_IDS = 1 << 22
#: What the model has of an n-gram: its count (of the contexts before it, below trigrams), and as a context its total
#: and how many n-grams follow that are counted once, twice and more often.
FACTS = ["n", "total", "once", "twice", "more"]


def _tokens(text: bytes) -> list[bytes]:
    return text.lower().split()  # ASCII letters only


def _discounts(times: list[int]) -> list[float]:
    """D1, D2, D3+ of an order from its numbers of n-grams that are counted once to four times."""
    n1, n2, n3, n4 = times
    if not n1 or not n2:
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(d, 0.1), k + 0.9) for k, d in enumerate(raw)]


def _keys(words: list[np.ndarray]) -> np.ndarray:
    """64-bit hashes of n-grams, other ones for each length."""
    key = np.full(len(words[0]), len(words), np.uint64)
    for w in words:
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + w)
    return key


def _planes(values: np.ndarray) -> bytes:
    """64-bit numbers byte by byte, compressed."""
    return zstandard.compress(np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _numbers(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.int64).ravel()


def _packed_keys(keys: np.ndarray) -> bytes:
    """Ascending keys by their differences."""
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def _unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_numbers(data).view(np.uint64), dtype=np.uint64)


def _summed(keys: np.ndarray, facts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending keys, each once, and the sums of their facts (a row for each of FACTS)."""
    order = np.argsort(keys, kind="stable")
    own, first = np.unique(keys[order], return_index=True)
    return own, np.add.reduceat(facts[:, order], first, axis=1) if len(own) else facts


def _shards(keys: np.ndarray, power: int) -> np.ndarray:
    return (keys >> np.uint64(64 - power)).astype(np.int64) if power else np.zeros(len(keys), np.int64)


def _cuts(keys: np.ndarray, power: int) -> Iterator[tuple[int, slice]]:
    """The shards, of 2 ** power, of ascending keys and where each shard's are."""
    shards = _shards(keys, power)
    first = _firsts(shards)
    for no, begin, end in zip(shards[first].tolist(), first.tolist(), [*first[1:].tolist(), len(keys)], strict=True):
        yield no, slice(begin, end)


@dataclass
class _Triples:
    """Different triples a, b, c of words, by their places among words (ascending hashes), ascending by b, c and a, with their counts."""

    words: np.ndarray
    a: np.ndarray
    b: np.ndarray
    c: np.ndarray
    n: np.ndarray

    @classmethod
    def counted(cls, words: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray, n: np.ndarray) -> _Triples:
        """Those of triples in any order that may repeat."""
        bits = len(words).bit_length()
        if 3 * bits < 64:
            key = b << 2 * bits | c << bits | a
        else:
            key = np.unique(b << 32 | c, return_inverse=True)[1] << 32 | a
        order = np.argsort(key, kind="stable")
        first = _firsts(key[order])
        at = order[first]
        return cls(words, a[at], b[at], c[at], np.add.reduceat(n[order], first) if len(first) else n)

    def some(self, at: np.ndarray) -> _Triples:
        """The triples at ascending places, with the words that they use."""
        codes, used = [x[at] for x in (self.a, self.b, self.c)], np.zeros(len(self.words), bool)
        for x in codes:
            used[x] = True
        places = np.cumsum(used) - 1
        return _Triples(self.words[used], *[places[x] for x in codes], self.n[at])

    def row(self, part: int) -> pa.RecordBatch:
        values = [_packed_keys(self.words), _packed_keys((self.b << 32 | self.c).view(np.uint64)), _planes(self.a), _planes(self.n)]
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), *[pa.array([x], pa.binary()) for x in values]], names=["part", "words", "pairs", "a", "n"])

    @classmethod
    def read(cls, row: dict) -> _Triples:
        pairs = _unpacked_keys(row["pairs"]).view(np.int64)
        return cls(_unpacked_keys(row["words"]), _numbers(row["a"]), pairs >> 32, pairs & 0xFFFFFFFF, _numbers(row["n"]))

    def facts(self, within: Callable[[np.ndarray], np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Order, ascending keys and counts of the n-grams that begin or end with these triples and whose keys are within; order 0: contexts, with the rest of FACTS.

        The triples have to be all that there are with their b and c; what several such tables tell of a key is to be summed.
        """

        def sent(order: int, keys: np.ndarray, *values: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
            at = np.flatnonzero(within(keys))
            at = at[np.argsort(keys[at])]
            return order, keys[at], np.stack([x[at] for x in values]).astype(np.int64)

        def context(first: np.ndarray, n: np.ndarray) -> Iterator[np.ndarray]:
            for each in (n, n == 1, n == 2, n > 2):
                yield np.add.reduceat(each.astype(np.int64), first) if len(first) else each

        a, b, c = (self.words[x] for x in (self.a, self.b, self.c))
        yield sent(3, _keys([a, b, c]), self.n)
        both = self.b << 32 | self.a
        order = np.argsort(both)
        first = _firsts(both[order])
        yield sent(0, _keys([a[order[first]], b[order[first]]]), *context(first, self.n[order]))
        pairs = _firsts(self.b << 32 | self.c)
        times = np.diff(np.append(pairs, len(self.n)))
        yield sent(2, _keys([b[pairs], c[pairs]]), times)
        first = _firsts(self.b[pairs])
        yield sent(0, _keys([b[pairs[first]]]), *context(first, times))
        times = np.bincount(self.c[pairs], minlength=len(self.words))
        yield sent(1, _keys([self.words[times > 0]]), times[times > 0])


def _firsts(ascending: np.ndarray) -> np.ndarray:
    """Where each of different values stands first."""
    return np.flatnonzero(np.append(True, ascending[1:] != ascending[:-1])) if len(ascending) else np.zeros(0, np.int64)


class Filter:
    """Bits that tell of a key that the model doesn't have it; those of a shard stand together, so that shards make their own."""

    def __init__(self, power: int):
        self.power, self.each = power, max(64, min(SLICE, MOST_BITS >> power))
        self.bits = np.zeros((self.each << power) // 8, np.uint8)

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two places within a shard's bits."""
        return tuple(mixed(keys + np.uint64(k)) & np.uint64(self.each - 1) for k in (1, 2))

    def slice_of(self, keys: np.ndarray) -> bytes:
        found = np.zeros(self.each, bool)
        for at in self.places(keys):
            found[at] = True
        return np.packbits(found, bitorder="little").tobytes()

    def knows(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), bool)
        for begin in range(0, len(keys), RANGE):
            part = keys[begin : begin + RANGE]
            base = (part >> np.uint64(64 - self.power) if self.power else np.zeros(len(part), np.uint64)) * np.uint64(self.each)
            one, two = (base + at for at in self.places(part))
            out[begin : begin + RANGE] = (
                self.bits[one >> np.uint64(3)] >> (one & np.uint64(7)).astype(np.uint8) & self.bits[two >> np.uint64(3)] >> (two & np.uint64(7)).astype(np.uint8) & 1
            )
        return out


@dataclass
class Model:
    """shards has a row for each shard (shard, size, keys, facts); the rest has a size that doesn't depend on the texts, or MOST_BITS at most."""

    shards: DataFrame
    size: int
    known: Filter
    cuts: tuple[list[float], list[float], list[float]]
    total: int
    none: float


def _counts(trusted: DataFrame, text_col: str, within: str) -> DataFrame:
    """The different triples of the given texts in parts, those with the same last two words in one."""
    rows = picked(trusted, text_col)
    parts = 1 + (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART_BYTES

    def chunk(pieces: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(x) for x in pieces])
        words, codes = np.unique(np.concatenate(pieces), return_inverse=True)
        at = ranges(np.cumsum(sizes) - sizes, sizes - 2)
        found = _Triples.counted(words, codes[at], codes[at + 1], codes[at + 2], np.ones(len(at), np.int64))
        part = (_keys([words[found.b], words[found.c]]) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        first = _firsts(part[order])
        for at in np.split(order, first[1:]):
            yield found.some(at).row(int(part[at[0]]))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, held = [], 0
        for batch in batches:
            for text in texts(batch):
                words = hashed(_tokens(text))
                seq = np.concatenate([np.full(2, BEGIN, np.uint64), words])
                for begin in range(0, len(words), CHUNK_WORDS):
                    pieces.append(seq[begin : begin + CHUNK_WORDS + 2])
                    held += len(pieces[-1])
                    if held >= CHUNK_WORDS:
                        yield from chunk(pieces)
                        pieces, held = [], 0
        if pieces:
            yield from chunk(pieces)

    def merged(rows: pa.Table) -> pa.Table:
        each = list(map(_Triples.read, rows.to_pylist()))
        words, places = np.unique(np.concatenate([x.words for x in each]), return_inverse=True)
        places = np.split(places, np.cumsum([len(x.words) for x in each])[:-1])
        codes = [np.concatenate([at[getattr(x, name)] for x, at in zip(each, places, strict=True)]) for name in "abc"]
        found = _Triples.counted(words, *codes, np.concatenate([x.n for x in each]))
        return pa.Table.from_batches([found.row(rows.column("part")[0].as_py())])

    shape = "part long, words binary, pairs binary, a binary, n binary"
    return written(rows.mapInArrow(chunks, shape).groupBy("part").applyInArrow(merged, shape), "triples", within=within)


def train(trusted: DataFrame, text_col: str = "text") -> Model:
    """The counts of the given texts' words, pairs and triples, in shards.

    Only the different triples are stored besides the shards. A round takes the
    n-grams of its shards from them, and what it shuffles goes when it ends.
    """
    spark, folder = trusted.sparkSession, f"lm-{uuid.uuid4().hex}"
    triples = _counts(trusted, text_col, folder)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pairs in batch.column("pairs"):
                found = _unpacked_keys(pairs.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([len(found) + len(_firsts(found))], pa.int64())], names=["n"])

    size = triples.select("pairs").mapInArrow(sizes, "n long").agg(F.sum("n")).first()[0] or 0
    power = max(0, math.ceil(math.log2(max(1, size) / SHARD)))
    rounds = min(SHARD_ROUNDS, 1 << power)

    def packed(turn: int):
        def of_turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    for order, keys, facts in _Triples.read(row).facts(lambda x: _shards(x, power) * rounds >> power == turn):
                        for no, at in _cuts(keys, power):
                            yield _shard_row(no, keys[at], facts[:, at]).append_column("order", pa.array([order], pa.int64()))

        return of_turn

    known = Filter(power)

    def merged(parts: pa.Table) -> pa.Table:
        by: list[list] = [[(np.zeros(0, np.uint64), np.zeros((1 if order else len(FACTS) - 1, 0), np.int64))] for order in range(4)]
        for order, keys, facts in zip(*[parts.column(c).to_pylist() for c in ("order", "keys", "facts")], strict=True):
            by[order].append((_unpacked_keys(keys), _numbers(facts).reshape(1 if order else len(FACTS) - 1, -1)))
        every, times, total = [], [], 0
        for order, found in enumerate(by):
            keys, facts = _summed(np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found], axis=1))
            every.append((keys, facts))
            if order:
                times += [*[int((facts[0] == k).sum()) for k in range(1, 5)], len(keys)]
                total += int(facts[0].sum()) if order == 1 else 0
        given = np.concatenate([x for x, _ in every])
        keys = np.sort(given)
        keys = keys[_firsts(keys)]
        facts = np.zeros((len(FACTS), len(keys)), np.int64)
        for order, (own, values) in enumerate(every):
            facts[0 if order else slice(1, None), np.searchsorted(keys, own)] = values[0] if order else values
        row = _shard_row(parts.column("shard")[0].as_py(), keys, facts)
        row = row.append_column("bits", pa.array([Filter(power).slice_of(keys)], pa.binary()))
        return pa.Table.from_batches([row.append_column("times", pa.array([[*times, total]], pa.list_(pa.int64())))])

    shape = "shard long, size long, keys binary, facts binary"
    shards = reduce(DataFrame.unionByName, [
        written(triples.mapInArrow(packed(turn), f"{shape}, order long").groupBy("shard").applyInArrow(merged, f"{shape}, bits binary, times array<long>"), "lm-shards")
        for turn in range(rounds)
    ])
    clear(spark, folder)
    size, times = 0, np.zeros(16, np.int64)
    for row in shards.select("shard", "size", "bits", "times").toLocalIterator():
        known.bits[row["shard"] * known.each // 8 : (row["shard"] + 1) * known.each // 8] = np.frombuffer(row["bits"], np.uint8)
        size, times = size + row["size"], times + np.array(row["times"])
    *times, total = times.tolist()
    cuts = tuple(_discounts(times[k : k + 4]) for k in (0, 5, 10))
    once, twice, _, _, words = times[:5]
    taken = sum(d * n for d, n in zip(cuts[0], (once, twice, words - once - twice), strict=True)) / total if total else 1.0
    return Model(shards.drop("bits", "times"), size, known, cuts, total, taken / WORDS)


def _shard_row(no: int, keys: np.ndarray, facts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([no], pa.int64()), pa.array([len(keys)], pa.int64()), pa.array([_packed_keys(keys)], pa.binary()), pa.array([_planes(facts)], pa.binary())],
        names=["shard", "size", "keys", "facts"],
    )


class _Block:
    """The n-grams of a block of texts that the model may have: words by their codes (-1: not in the model), pairs and triples by where they begin.

    asks has the different ones' keys, ascending; a block read back from its codes asks for the same.
    """

    def __init__(self, words: np.ndarray, codes: np.ndarray, known: Filter):
        here, hashes = codes >= 0, words[codes] if len(words) else np.zeros(len(codes), np.uint64)
        at = np.flatnonzero(here[:-1] & here[1:])
        pairs = _keys([hashes[at], hashes[at + 1]])
        have = known.knows(pairs)
        self.two, pairs = at[have], pairs[have]
        here = np.zeros(len(codes) + 1, bool)
        here[self.two] = True
        at = np.flatnonzero(here[:-1] & here[1:])
        triples = _keys([hashes[at], hashes[at + 1], hashes[at + 2]])
        have = known.knows(triples)
        self.three, triples = at[have], triples[have]
        self.codes = codes
        self.asks, where = np.unique(np.concatenate([_keys([words]), pairs, triples]), return_inverse=True)
        self.word, self.pair, self.triple = np.split(where, [len(words), len(words) + len(pairs)])

    @staticmethod
    def asked(words: np.ndarray, codes: np.ndarray, known: Filter, low: int, high: int) -> np.ndarray:
        """asks of the shards from low to high, without the places of the rest."""
        here, hashes = codes >= 0, words[codes] if len(words) else np.zeros(len(codes), np.uint64)

        def own(keys: np.ndarray) -> np.ndarray:
            shards = _shards(keys, known.power)
            return keys[(low <= shards) & (shards < high)]

        at = np.flatnonzero(here[:-1] & here[1:])
        pairs = _keys([hashes[at], hashes[at + 1]])
        have = known.knows(pairs)
        at, pairs = at[have], own(pairs[have])
        at = at[:-1][np.diff(at) == 1]
        triples = own(_keys([hashes[at], hashes[at + 1], hashes[at + 2]]))
        keys = np.sort(np.concatenate([own(_keys([words])), pairs, triples[known.knows(triples)]]))
        return keys[_firsts(keys)]

    def log_p(self, facts: np.ndarray, cuts, total: int, none: float) -> np.ndarray:
        """Log probabilities of the words from the third on, by the model's facts of asks (zeros: it has none)."""

        def own(n: np.ndarray, cut: list[float]) -> np.ndarray:
            return np.maximum(n - np.array([0.0, *cut])[np.minimum(n, 3)], 0.0)

        def last(values: np.ndarray, other: float) -> np.ndarray:
            return np.append(values[self.word], other)  # for code -1

        n, all_, once, twice, more = facts
        ones = last(own(n, cuts[0]) / (total or 1) + none, none)
        totals, taken = last(all_, 0), last(cuts[1][0] * once + cuts[1][1] * twice + cuts[1][2] * more, 0.0)
        out = np.empty(max(0, len(self.codes) - 2))
        for begin in range(0, len(out), RANGE):
            size = min(RANGE, len(out) - begin)

            def dense(at: np.ndarray, asked: np.ndarray, values: np.ndarray, of: int) -> np.ndarray:
                low, high = np.searchsorted(at, [of, of + size])  # noqa: B023
                found = np.zeros(size, values.dtype)  # noqa: B023
                found[at[low:high] - of] = values[asked[low:high]]
                return found

            p = ones[self.codes[begin + 2 : begin + 2 + size]]
            b = self.codes[begin + 1 : begin + 1 + size]
            whole, n2 = totals[b], dense(self.two, self.pair, n, begin + 1)
            p = np.where(whole > 0, (own(n2, cuts[1]) + taken[b] * p) / np.maximum(whole, 1), p)
            whole, n3 = dense(self.two, self.pair, all_, begin), dense(self.three, self.triple, n, begin)
            mass = sum(d * dense(self.two, self.pair, x, begin) for d, x in zip(cuts[2], (once, twice, more), strict=True))
            out[begin : begin + size] = np.log(np.where(whole > 0, (own(n3, cuts[2]) + mass * p) / np.maximum(whole, 1), p))
        return out


_BLOCKS = pa.schema([
    ("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("langs", pa.list_(pa.string())), ("sizes", pa.list_(pa.int64())),
    ("words", pa.binary()), ("codes", pa.binary()), ("most_asks", pa.int64()),
])


def _read(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """The words and codes of a block."""
    planes = np.frombuffer(zstandard.decompress(row["codes"]), np.uint8).reshape(4, -1)
    return _unpacked_keys(row["words"]), np.ascontiguousarray(planes.T).view("<i4").ravel()


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a shard, its keys and facts first (block -1), then what blocks ask of it; one row of each is held."""
    of, keys, facts = None, np.zeros(0, np.uint64), np.zeros((len(FACTS), 0), np.int64)
    for batch in batches:
        shards, blocks, asks, given = (batch.column(c) for c in ("shard", "block", "keys", "facts"))
        for k in range(len(batch)):
            shard, block, asked = shards[k].as_py(), blocks[k].as_py(), _unpacked_keys(asks[k].as_py())
            if block < 0:
                of, keys, facts = shard, asked, _numbers(given[k].as_py()).reshape(len(FACTS), -1)
                continue
            found = np.zeros((len(FACTS), len(asked)), np.int64)
            if of == shard and len(keys):
                at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
                have = keys[at] == asked
                found[:, have] = facts[:, at[have]]
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([shard], pa.int64()), pa.array([_planes(found)], pa.binary())], names=["block", "shard", "facts"])


def scores(docs: DataFrame, model: Model, id_col="doc_id", text_col="text", lang_col="lang") -> DataFrame:
    """doc_id, lang, n_words, nll (minus the sum of log probabilities) of each row; null text: no words, null lang: ''.

    Texts are put into blocks of about BLOCK_WORDS words. A block asks once for
    each different n-gram that a filter of the model lets pass; what it asks of
    a shard meets the shard's counts in one task, and the answers come back to
    the block. What the filter lets pass wrongly has no count. Where much more
    is asked than the model has, its shards are copied, so that no task answers
    for too many blocks. A text longer than a block is one by itself. Documents
    are scored in rounds, by a hash of their id; a round's blocks and answers go
    when its scores are stored.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model.known)
    power, cuts, total, none = model.known.power, model.cuts, model.total, model.none

    def made(no: int, ids: list, langs: list, parts: list[np.ndarray]) -> pa.RecordBatch:
        seq = np.concatenate([x for part in parts for x in (np.full(2, BEGIN, np.uint64), part)])
        codes = np.full(len(seq), -1, np.int32)
        have = (seq == BEGIN) | shared.value.knows(_keys([seq]))
        words, codes[have] = np.unique(seq[have], return_inverse=True)
        packed = zstandard.compress(codes.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)
        values = [[no], [ids], [langs], [[len(part) for part in parts]], [_packed_keys(words)], [packed], [len(words) + 2 * len(codes)]]
        return pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(values, _BLOCKS, strict=True)], schema=_BLOCKS)

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no, size, ids, langs, parts = TaskContext.get().partitionId() << 32, 0, [], [], []
        for batch in batches:
            for doc_id, lang, text in zip(batch.column("doc_id").to_pylist(), batch.column("lang").to_pylist(), texts(batch), strict=True):
                words = hashed(_tokens(text))
                if ids and size + len(words) + 2 > BLOCK_WORDS:
                    yield made(no, ids, langs, parts)
                    no, size, ids, langs, parts = no + 1, 0, [], [], []
                size += len(words) + 2
                ids.append(doc_id), langs.append(lang), parts.append(words)
        if ids:
            yield made(no, ids, langs, parts)

    def asked(low: int, high: int):
        def of_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    asks = _Block.asked(*_read(row), shared.value, low, high)
                    for no, at in _cuts(asks, power):
                        yield pa.RecordBatch.from_arrays([pa.array([no], pa.int64()), pa.array([row["block"]], pa.int64()), pa.array([_packed_keys(asks[at])], pa.binary())], names=["shard", "block", "keys"])

        return of_shards

    def summed(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        row = blocks.to_pylist()[0]
        parts = answers.sort_by("shard").column("facts").to_pylist()
        facts = np.concatenate([np.zeros((len(FACTS), 0), np.int64), *[_numbers(x).reshape(len(FACTS), -1) for x in parts]], axis=1)
        each = _Block(*_read(row), shared.value).log_p(facts, cuts, total, none)
        before, n = np.concatenate([[0.0], np.cumsum(each)]), np.array(row["sizes"], np.int64)
        first = np.cumsum(n + 2) - n - 2
        return pa.table({"doc_id": pa.array(row["ids"], pa.int64()), "lang": pa.array(row["langs"], pa.string()), "n_words": n, "nll": before[first] - before[first + n]})

    chosen = picked(docs, text_col, doc_id=id_col, lang=lang_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("lang"), "text")
    size = chosen.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rounds, turns = min(DOC_ROUNDS, 1 + size // ROUND_BYTES), min(ASK_ROUNDS, 1 << power)
    tasks = max(spark.sparkContext.defaultParallelism, -(-size // (rounds * TASK_BYTES)))

    def answered(blocks: DataFrame, copies: int, low: int, high: int) -> DataFrame:
        """What the shards from low to high answer."""
        asks = blocks.select("block", "words", "codes").mapInArrow(asked(low, high), "shard long, block long, keys binary")
        rows = asks.select("shard", F.pmod(F.xxhash64("block"), F.lit(copies).cast("long")).alias("copy"), "block", "keys", F.lit(None).cast("binary").alias("facts")).unionByName(
            model.shards.where((F.col("shard") >= low) & (F.col("shard") < high))
            .select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))).alias("copy"), F.lit(-1).cast("long").alias("block"), "keys", "facts")
        )
        dealt = rows.repartition("shard", "copy").sortWithinPartitions("shard", "copy", "block").drop("copy")
        return dealt.mapInArrow(_answered, "block long, shard long, facts binary")

    found = []
    for turn in range(rounds):
        folder = f"lm-{uuid.uuid4().hex}"
        own = chosen.where(F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == turn).coalesce(tasks) if rounds > 1 else chosen
        blocks = written(own.mapInArrow(gathered, "block long, ids array<long>, langs array<string>, sizes array<long>, words binary, codes binary, most_asks long"), "lm-blocks", within=folder)
        copies = 1 + (blocks.agg(F.sum("most_asks")).first()[0] or 0) // max(1, int(ASKS_EACH * model.size))
        edges = [(k << power) // turns for k in range(turns + 1)]
        answers = reduce(DataFrame.unionByName, [written(answered(blocks, copies, *at), "lm-answers", within=folder) for at in itertools.pairwise(edges)])
        each = blocks.drop("most_asks").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(summed, "doc_id long, lang string, n_words long, nll double")
        found.append(written(each, "lm-part"))
        clear(spark, folder)
    return reduce(DataFrame.unionByName, found)


def classify(
    docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", lang_col="lang",
    max_train: int | None = None, quantile=0.99, margin=1.1,
) -> DataFrame:
    """doc_id, lang, n_words, log_ppl, threshold, kept for each row of docs.

    Trusted are the documents with quality 1 and not toxic 1. Four in five of
    them, by a hash of the id, train the model (all of these, unless max_train
    says how many at most); the others set the thresholds: margin times the
    given quantile of log_ppl in a language, over all languages for one that has none. log_ppl is a text's mean
    of minus log p per word, drawn to the language's middle as if PRIOR_WORDS
    more words had it, so that texts of a few words aren't judged by chance;
    a text without words has the middle itself and stays. Labels may repeat or
    be null; without trusted documents every document is kept. A very long text
    is held whole in a task, with its words' numbers and scores.
    """
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(5))
    trusted = written(
        labels.where("quality = 1 and coalesce(toxic, 0) <> 1 and doc_id is not null").select("doc_id").distinct()
        .join(docs.select(F.col(id_col).alias("doc_id")).distinct(), "doc_id"),
        "lm-trusted",
    )
    chosen = trusted.where(fold < 4).withColumnRenamed("doc_id", id_col)
    if max_train is not None:
        chosen = chosen.orderBy(F.xxhash64(id_col), id_col).limit(max_train)
    if trusted.count() <= BROADCAST_IDS:
        chosen = F.broadcast(chosen)
    sample = docs.join(chosen, id_col, "left_semi")
    found = written(scores(docs, train(sample, text_col), id_col, text_col, lang_col), "lm-scores")
    held = found.join(trusted.where(fold == 4), "doc_id", "left_semi").where("n_words > 0")
    raw = F.col("nll") / F.col("n_words")
    middles = written(held.groupBy("lang").agg(F.percentile_approx(raw, 0.5, 10_000).alias("middle")), "lm-middles")
    middle = held.agg(F.percentile_approx(raw, 0.5, 10_000)).first()[0] or 0.0
    drawn = (F.col("nll") + PRIOR_WORDS * F.coalesce("middle", F.lit(middle))) / (F.col("n_words") + PRIOR_WORDS)
    limit = margin * F.percentile_approx(drawn, quantile, 10_000)
    # written first, so that Spark knows their size (a row per language) and joins them without a shuffle of the rest
    limits = written(held.join(middles, "lang").groupBy("lang", "middle").agg(limit.alias("limit")), "lm-limits")
    top = held.join(middles, "lang").agg(limit).first()[0]
    threshold = F.coalesce("limit", F.lit(top).cast("double"))
    return found.join(limits, "lang", "left").select(
        "doc_id", "lang", "n_words", drawn.alias("log_ppl"), threshold.alias("threshold"),
        F.coalesce(drawn <= threshold, F.lit(True)).alias("kept"),
    )


def accepted(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", **options) -> DataFrame:
    """docs without the rows whose id classify() rejects; rows with a null id stay."""
    judged = classify(docs, labels, id_col, text_col, lang_col, **options)
    bad = judged.where(~F.col("kept")).select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(bad, id_col, "left_anti").select(*docs.columns)
