"""Greedy word-piece counts by a linear longest-match automaton.

The vocabulary is a trie with two roots, one for pieces that start a word and
one for those that go on. A failure link leads from what has been read to what
is still to be matched once the longest pieces are taken off its front, and a
count says how many pieces that takes off; a word is read once, character by
character, and no piece is ever built (the LinMaxMatch method).
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Rows, picked, texts

START, GO_ON, NONE = 0, 1, -1
CACHE = 500_000


def automaton(start: Iterable[bytes], go_on: Iterable[bytes]) -> dict[str, np.ndarray]:
    """Arrays of the trie: edges (node << 8 | byte), their targets, and each node's failure link and popped-piece count."""
    edges: dict[int, int] = {}
    ends: set[int] = set()
    nodes = 2
    for root, pieces in ((START, start), (GO_ON, go_on)):
        for piece in pieces:
            at = root
            for byte in piece:
                key = at << 8 | byte
                if key not in edges:
                    edges[key] = nodes
                    nodes += 1
                at = edges[key]
            if at > 1:
                ends.add(at)
    children: dict[int, list[tuple[int, int]]] = {}
    for key, to in edges.items():
        children.setdefault(key >> 8, []).append((key & 255, to))
    fail, pops = [NONE] * nodes, [0] * nodes
    queue = deque([START, GO_ON])
    while queue:
        parent = queue.popleft()
        for byte, node in children.get(parent, ()):
            queue.append(node)
            if node in ends:
                fail[node], pops[node] = GO_ON, 1
                continue
            back, taken = fail[parent], pops[parent]
            while back != NONE and (back << 8 | byte) not in edges:
                taken += pops[back]
                back = fail[back]
            if back != NONE:
                fail[node], pops[node] = edges[back << 8 | byte], taken
    return {
        "edges": np.fromiter(edges.keys(), np.int64, len(edges)),
        "to": np.fromiter(edges.values(), np.int32, len(edges)),
        "fail": np.array(fail, np.int32),
        "pops": np.array(pops, np.int32),
    }


class Counts(dict):
    """Pieces by word; a word that the vocabulary can't spell counts as one unknown piece."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.edges = dict(zip(arrays["edges"].tolist(), arrays["to"].tolist(), strict=True))
        self.fail, self.pops = arrays["fail"].tolist(), arrays["pops"].tolist()

    def count(self, word: bytes) -> int:
        edges, fail, pops = self.edges, self.fail, self.pops
        at, n = START, 0
        for byte in word:
            while (to := edges.get(at << 8 | byte)) is None:
                n += pops[at]
                at = fail[at]
                if at == NONE:
                    return 1
            at = to
        while at > GO_ON:
            n += pops[at]
            at = fail[at]
            if at == NONE:
                return 1
        return n

    def __missing__(self, word: bytes) -> int:
        n = self.count(b" " + word)
        if len(word) <= 40:
            self[word] = n
        return n


def byte_of_character() -> dict[str, int]:
    """How byte-level files write a byte: as the character of that number if it prints, the others as those from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = sorted(set(range(256)).difference(plain))
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def byte_level_vocabulary(tokenizer_json: str) -> tuple[list[bytes], list[bytes]]:
    """Pieces that start with a space, and all without one, from a byte-level tokenizer's file."""
    byte = byte_of_character()
    model = json.loads(tokenizer_json)
    special = {t["content"] for t in model.get("added_tokens", [])}
    pieces = [bytes(byte[c] for c in token) for token in model["model"]["vocab"] if token not in special]
    return [p for p in pieces if p[:1] == b" " and b" " not in p[1:]], [p for p in pieces if b" " not in p]


def token_counts(docs: DataFrame, tokenizer_json: str, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, n_words, n_tokens of each row: white-space words, and the pieces of their greedy longest match.

    A null or empty text has none; repeated rows are counted row by row; other
    columns play no part. The automaton is as large as the vocabulary file. A very long text is
    held whole, with its words: some ten times its length; a word goes through the automaton once a task.
    """
    shared = docs.sparkSession.sparkContext.broadcast(automaton(*byte_level_vocabulary(tokenizer_json)))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rows = Counts(shared.value), Rows(schema)
        for batch in batches:
            for key, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
                words = text.split()
                rows.add(key, len(words), sum(map(counts.__getitem__, words)))
                if len(counts) > CACHE:
                    counts.clear()
                if rows.full():
                    yield rows.batch()
        yield from rows.rest()

    return picked(docs, text_col, doc_id=id_col).mapInArrow(counted, "doc_id long, n_words long, n_tokens long")
