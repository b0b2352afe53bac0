"""Licence scans by a positional rare-token index of licence templates.

The index has, for each word of the templates, the templates and positions it
stands at. A first pass counts in how many documents each template word occurs.
Each template is indexed by its rarest words (highest IDF), so many that without
them no alignment can reach the least score. In a second pass each place in a
file where one of them stands votes for its templates at a relative position
(place in the file minus place in the template); an alignment with votes enough is
compared word for word, and a label needs the template's mandatory phrase there as well.
Phrases are also found on their own, wherever their words stand consecutively.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rows, alnum_words, picked, texts

#: Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Opening words of public licences and notices, with the phrases that must stand in the match.
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache license",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license",)),
    ("gpl", "licensed under the gnu general public license version 3", ("gnu general public license",)),
    ("lgpl", "licensed under the gnu lesser general public license version 3", ("gnu lesser general public license",)),
    ("agpl", "licensed under the gnu affero general public license version 3", ("gnu affero general public license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted", "without restriction")),
    ("mit", "released under the mit license", ("mit license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "conditions are met")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify", "hereby granted")),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    ("cc0", "to the extent possible under law the author has dedicated all copyright and related rights to the public domain worldwide", ("public domain",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)
MIN_SCORE, RARE_WORDS = 0.7, 8


def phrase_places(words: list[bytes], phrases: list[list[bytes]]) -> list[tuple[int, int]]:
    """(first word, phrase number) of each place where a phrase's words stand consecutively."""
    joined = b" " + b" ".join(words) + b" "
    found = []
    for no, phrase in enumerate(phrases):
        sought = b" " + b" ".join(phrase) + b" "
        at = joined.find(sought)
        word = last = 0
        while at >= 0:
            word += joined.count(b" ", last, at)
            last = at
            found.append((word, no))
            at = joined.find(sought, at + 1)
    return found


class Index:
    """Postings of the templates' rarest words, and the documents that have each word: as large as the templates."""

    def __init__(self, templates=TEMPLATES, phrases: Mapping[str, str] = PHRASES):
        self.templates = [(label, words.encode().split(), [m.encode().split() for m in must]) for label, words, must in templates]
        self.phrases = [p.encode().split() for p in phrases]
        self.labels = list(phrases.values())
        self.words = frozenset(w for _, words, _ in self.templates for w in words)
        self.weigh({}, 0)

    def weigh(self, counts: Mapping[str, int], n_docs: int) -> None:
        """Sets IDF, and with it the postings.

        An alignment that two votes don't speak for has at most one of the
        places of the template's rare words; these are taken until what they
        weigh, less the heaviest of them, is more than a match may lack.
        """
        self.idf = {w: math.log((n_docs + 1) / (counts.get(w.decode(), 0) + 1)) + 1e-3 for w in self.words}
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.weights: list[float] = []
        self.votes: list[int] = []
        for no, (_, words, _) in enumerate(self.templates):
            total = sum(self.idf[w] for w in words)
            weight, heaviest = 0.0, 0.0
            for k, word in enumerate(sorted(set(words), key=lambda w: (-self.idf[w], w))):
                if k >= RARE_WORDS and weight - heaviest > (1 - MIN_SCORE) * total + 1e-9:
                    break
                weight += self.idf[word] * words.count(word)
                heaviest = max(heaviest, self.idf[word])
                for at in (i for i, w in enumerate(words) if w == word):
                    self.postings[word].append((no, at))
            self.weights.append(total)
            self.votes.append(2 if weight - heaviest > (1 - MIN_SCORE) * total + 1e-9 else 1)

    def matches(self, words: list[bytes]) -> list[tuple[str, float]]:
        """Labels with the share of a template's weight (IDF) that stands in the file at one relative position."""
        rare = self.postings.keys() & set(words)
        if not rare:
            return []
        votes: Counter[tuple[int, int]] = Counter()
        for place, word in enumerate(words):
            if word in rare:
                for no, at in self.postings[word]:
                    votes[no, place - at] += 1
        best: dict[str, float] = {}
        for (no, shift), n in votes.items():
            label, template, must = self.templates[no]
            if n < self.votes[no]:
                continue
            there = words[max(0, shift) : shift + len(template)]
            own = template[max(0, -shift) :]
            agreed = sum(self.idf[a] for a, b in zip(own, there, strict=False) if a == b)
            score = agreed / self.weights[no]
            if score > best.get(label, 0) and score >= MIN_SCORE and all(phrase_places(there, [m]) for m in must):
                best[label] = min(1.0, score)
        return sorted(best.items())

    def scan(self, text: bytes) -> tuple:
        """n_words, n_base, first_word, last_word, base_labels, labels, score."""
        words = alnum_words(text)
        places = phrase_places(words, self.phrases)
        base = {self.labels[no] for _, no in places}
        matched = self.matches(words)
        starts = [at for at, _ in places]
        return (
            len(words), len(places), min(starts, default=None), max(starts, default=None),
            ",".join(sorted(base)), ",".join(sorted(base | {k for k, _ in matched})),
            max([1.0 if base else 0.0, *(score for _, score in matched)]),
        )


def document_counts(docs: DataFrame, index: Index, text_col="text") -> tuple[dict[str, int], int]:
    """In how many rows each template word occurs, and how many rows there are; one count per word and task is shuffled."""
    wanted = index.words

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        for batch in batches:
            for text in texts(batch):
                found[""] += 1
                found.update(w.decode() for w in wanted.intersection(alnum_words(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    rows = picked(docs, text_col).mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = {r.word: r.n for r in rows.collect()}  # the templates' words
    return counts, counts.pop("", 0)


def license_scan(docs: DataFrame, id_col="doc_id", text_col="text", templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """A row per row of docs: n_words, phrase places (n_base, first_word, last_word, base_labels), labels and score.

    labels has the phrases' labels and those of the templates that match; score
    is 1 for a phrase, else the best template's share of weight, else 0. A null
    text is empty: no words, no places, null first_word and last_word, '' labels. A
    very long text is held whole with its words, some ten times its length.
    """
    index = Index(templates, phrases)
    index.weigh(*document_counts(docs, index, text_col))
    shared = docs.sparkSession.sparkContext.broadcast(index)  # as large as the templates
    schema = pa.schema(
        [("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_words", "n_base", "first_word", "last_word")],
         ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]
    )

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows(schema)
        for batch in batches:
            for key, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
                rows.add(key, *shared.value.scan(text))
                if rows.full():
                    yield rows.batch()
        yield from rows.rest()

    return picked(docs, text_col, doc_id=id_col).mapInArrow(
        scanned,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double",
    )
