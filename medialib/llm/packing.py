"""Token pieces, and their packing into sequences by patterns fitted to the length histogram.

Patterns are few pieces whose lengths fill a sequence; how often each is used is
a non-negative least-squares fit to the histogram of lengths, rounded down; what
is left is packed best-fit, longest first, on the histogram as well. The plan is
as large as the patterns, whatever the corpus; the pieces take their places in
it by their rank among the pieces of their length, in parallel.
"""

from __future__ import annotations

import json
import os
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import Rows, picked, written
from .token_counts import byte_of_character

#: Fixed value: where the byte-level tokenizer of the vocabulary file starts a new pre-token.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SALTS = 128
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Ids:
    """Token ids of texts by a tokenizer's file, as its library gives them with add_special_tokens=False.

    The tokenizer is left at its defaults, so that the string of an added token
    in a text is that token. A file of byte-level BPE whose ids are its ranks is
    read into a faster encoder of the same vocabulary, which gives the same ids
    (compared on every code point); the tokenizer takes the texts that the
    faster one refuses, those with over about a million white spaces in a row.
    """

    def __init__(self, tokenizer_json: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has a core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.fast = self._fast(json.loads(tokenizer_json))

    @staticmethod
    def _fast(file: dict):
        import tiktoken

        model, cut, added = file["model"], file.get("pre_tokenizer") or {}, file.get("added_tokens", [])
        plain = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True) and not file.get("normalizer")
        whole = not any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") for t in added)
        own = {t["content"] for t in added}
        vocabulary = {t: k for t, k in model["vocab"].items() if t not in own}
        by_rank = sorted(vocabulary, key=vocabulary.get)
        merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model.get("merges", [])]
        if model.get("type") != "BPE" or not plain or not whole or by_rank[256:] != merges or sorted(map(len, by_rank[:256])) != [1] * 256:
            return None
        byte = byte_of_character()
        ranks = {bytes(map(byte.__getitem__, t)): k for t, k in vocabulary.items()}
        return tiktoken.Encoding("file", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={t["content"]: t["id"] for t in added})

    def of(self, text: str) -> bytes:
        """The ids as little-endian 32-bit numbers."""
        if self.fast:
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()
            except ValueError:  # the regex ran out of stack
                pass
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def pieces_of(ids: bytes, most: int) -> Iterator[tuple[int, int, int, bytes]]:
    """piece, start, length, ids: a text that is too long is cut from its end, so that only the first piece is short."""
    n = len(ids) // 4
    start = 0
    for k in range(-(-n // most)):
        end = n - (-(-n // most) - 1 - k) * most
        yield k, start, end - start, ids[4 * start : 4 * end]
        start = end


def token_pieces(
    docs: DataFrame, tokenizer_json: str, end_id: int, most: int, id_col="doc_id", text_col="text", keep_ids=False
) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, and ids (array<int>) if asked for.

    Each document is its text's ids and end_id; a null text is the end_id alone.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)  # a vocabulary file

    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * keep_ids)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, rows, end = Ids(shared.value), Rows(schema), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            keys, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for key, text in zip(keys, texts, strict=True):
                for k, start, length, own in pieces_of(encoder.of(text) + end, most):
                    more = (np.frombuffer(own, "<u4").astype("i4"),) if keep_ids else ()
                    rows.add(key, k, start, length, zlib.crc32(own), *more, size=len(own) if keep_ids else 0)
                if rows.full():
                    yield rows.batch()
        yield from rows.rest()

    return picked(docs, text_col, doc_id=id_col).mapInArrow(cut, PIECES + ", ids array<int>" * keep_ids)


def patterns(most: int) -> np.ndarray:
    """One to three lengths, in no order, that fill a sequence exactly; short rows are filled up with 0."""
    a = np.arange(1, most)
    pairs = np.stack([a, most - a, 0 * a], 1)[a >= most - a]
    x, y = np.meshgrid(a, a, indexing="ij")
    keep = (x >= y) & (y >= most - x - y) & (most - x - y > 0)
    triples = np.stack([x[keep], y[keep], most - x[keep] - y[keep]], 1)
    return np.concatenate([[[most, 0, 0]], pairs, triples])


def fitted(histogram: np.ndarray, shapes: np.ndarray, steps: int = 1000) -> np.ndarray:
    """Non-negative repeat counts x of the patterns that make |A x - histogram|² small, by accelerated projected gradient.

    Each residual is weighed by its length, which counts a token left over the
    same wherever it is left, over the number of patterns with that length, which
    lets all lengths converge alike.
    """
    used = (shapes > 0) & (histogram[shapes] > 0)
    alive = (used == (shapes > 0)).all(1)  # a pattern with a length that no piece has gets none
    shapes = shapes[alive]
    out = np.zeros(len(alive))
    if not len(shapes):
        return out
    uses = np.bincount(shapes.ravel(), minlength=len(histogram))
    weight = np.arange(len(histogram)) / len(histogram) / np.maximum(uses, 1)
    x = y = np.zeros(len(shapes))
    t = 1.0
    for _ in range(steps):
        over = np.bincount(shapes.ravel(), np.repeat(y, 3), len(histogram)) - histogram
        new = np.maximum(0, y - (over * weight)[shapes].sum(1) / 3)
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        y = new + (before - 1) / t * (new - x)
        x = new
    out[alive] = x
    return out


def plan(histogram: np.ndarray, most: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences), using up the histogram: counts of pieces by length, 0 to most."""
    rest = histogram.astype(np.int64).copy()
    made: list[tuple[tuple[int, ...], int]] = []
    shapes = patterns(most)
    counts = np.floor(fitted(rest.astype(float), shapes) + 1e-6).astype(np.int64)
    for k in np.argsort(-counts, kind="stable"):
        lengths = [int(v) for v in shapes[k] if v]
        n = min([int(counts[k]), *(int(rest[v]) // lengths.count(v) for v in lengths)])
        if counts[k] <= 0:
            break
        if n > 0:
            for v in lengths:
                rest[v] -= n
            made.append((tuple(lengths), n))
    room: dict[int, list] = defaultdict(list)  # by what is left in them: kinds of open sequences and their counts
    for v in range(most, 0, -1):
        todo = int(rest[v])
        while todo:
            space = min((s for s, kinds in room.items() if s >= v and kinds), default=None)
            if space is None:
                each = most // v
                full, part = divmod(todo, each)
                if full:
                    room[most - each * v].append(((v,) * each, full))
                if part:
                    room[most - part * v].append(((v,) * part, 1))
                break
            kind, n = room[space].pop()
            take = min(n, todo)
            if n > take:
                room[space].append((kind, n - take))
            room[space - v].append(((*kind, v), take))
            todo -= take
    return made + [x for kinds in room.values() for x in kinds]


def places(made: list[tuple[tuple[int, ...], int]], most: int) -> dict[str, np.ndarray]:
    """The plan as runs: the pieces of a length with ranks from first on go to sequences from sequence on, at an offset."""
    rows, done, sequence = [], [0] * (most + 1), 0
    for lengths, n in made:
        at = 0
        for v in lengths:
            rows.append((v, done[v], sequence, at))
            done[v] += n
            at += v
        sequence += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return dict(zip(("length", "first", "sequence", "offset"), table.T, strict=True))


def pack(pieces: DataFrame, most: int) -> DataFrame:
    """pieces (doc_id, piece, length, …; lengths 1 to most) with sequence_id and offset, gapless from 0 in each sequence.

    Ranks are taken within a length and one of SALTS parts of it, so that a
    length that a third of the pieces have is dealt to many tasks; the counts
    that join the parts are most x SALTS numbers at most. A piece longer than
    most is an error; no pieces give no rows.
    """
    pieces = written(
        pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)).cast("int")), "pieces"
    )
    counts = np.zeros((most + 1, SALTS), np.int64)
    for length, salt, n in pieces.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("n")).collect():
        if not 1 <= length <= most:
            raise ValueError(f"a piece of {length} tokens doesn't go into a sequence of {most}")
        counts[length, salt] = n
    runs = places(plan(counts.sum(1), most), most)
    shared = pieces.sparkSession.sparkContext.broadcast((np.cumsum(counts, 1) - counts, runs))
    ranked = pieces.withColumn(
        "_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")) - 1
    )
    columns = [c for c in pieces.columns if c != "_salt"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, runs = shared.value
        key = runs["length"] << 44 | runs["first"]
        for batch in batches:
            length, salt, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_salt", "_rank"))
            rank = rank + before[length, salt]
            run = np.searchsorted(key, length << 44 | rank, side="right") - 1
            sequence = runs["sequence"][run] + rank - runs["first"][run]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(sequence), pa.array(runs["offset"][run])],
                names=[*columns, "sequence_id", "offset"],
            )

    kinds = ", ".join(f"`{c}` {kind}" for c, kind in pieces.drop("_salt").dtypes)
    return ranked.mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def vocabulary_file(path: str) -> str:
    """The text of a tokenizer's file on the driver; tasks get it from there."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def pack_documents(spark: SparkSession, docs: DataFrame, tokenizer: Callable[[], str] | str, most=1024, end_id=2) -> DataFrame:
    """token_pieces() of docs, packed; tokenizer is the path of a tokenizer's file."""
    path = tokenizer if isinstance(tokenizer, str) else tokenizer()
    return pack(token_pieces(docs, vocabulary_file(path), end_id, most), most)
