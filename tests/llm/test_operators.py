"""The corpus operators against brute force, on small texts with nulls, repeats, ties and clashing columns."""

import bisect
import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from medialib.llm import (
    common, components, decontamination, fm_index, host_rules, license_scan, near_dedup, packing, quality_lm, repeats, secret_scan,
    suffix_array, token_counts,
)
from medialib.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, kept string"
rnd = random.Random(11)
VOCAB = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 7))) for _ in range(400)]


def prose(n, seed):
    own = random.Random(seed)
    return " ".join(own.choice(VOCAB) for _ in range(n))


def frame(spark, texts, ids=None, sources=None):
    rows = [
        (k if ids is None else ids[k], t, "en", (sources or ["s0"])[k % len(sources or [1])], None, "clash", "clash")
        for k, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(df):
    return [r.asDict() for r in df.collect()]


ODD = ["", None, " \n\t", "word", "é ñ ü", "x" * 5000, "one two\none two\n\n  one two"]


@pytest.mark.parametrize("operator", [
    lambda d, s: license_scan.license_scan(d),
    lambda d, s: repeats.repeated_passages(d),
    lambda d, s: decontamination.contaminated(d, s.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")),
    lambda d, s: decontamination.decontaminate(d, s.createDataFrame([], "item_id long, text string")),
    lambda d, s: secret_scan.secret_scan(d),
    lambda d, s: secret_scan.redact(d),
    lambda d, s: near_dedup.near_duplicates(d),
    lambda d, s: near_dedup.deduplicated(d),
    lambda d, s: repeats.substring_dedup(d),
    lambda d, s: host_rules.host_rules(d),
    lambda d, s: quality_lm.classify(d, s.createDataFrame([(3, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int")),
    lambda d, s: packing.pack_documents(s, d, tokenizer_path),
    lambda d, s: token_counts.token_counts(d, packing.vocabulary_file(tokenizer_path())),
])
def test_empty_tables_and_odd_rows(spark, operator):
    assert operator(frame(spark, []), spark).collect() == []
    ids = [0, 1, 2, 3, 4, None, 3]
    operator(frame(spark, ODD, ids), spark).collect()


# 1
def test_license_base_is_what_a_plain_search_finds(spark):
    texts = [*ODD, "Apache License, apache-license; CC BY CC BY", "the MIT\nLicense", "gnu general public licenses", "GNU General Public License CC  by",
             "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"]
    got = {r["doc_id"]: r for r in rows_of(license_scan.license_scan(frame(spark, texts)))}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for k, text in enumerate(texts):
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(lower))
        places = [(i, label) for i in range(len(words)) for p, label in license_scan.PHRASES.items() if words[i : i + len(p.split())] == p.split()]
        r = got[k]
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert r["first_word"] == min((i for i, _ in places), default=None) and r["last_word"] == max((i for i, _ in places), default=None)
        assert r["base_labels"] == ",".join(sorted({x for _, x in places})) and 0 <= r["score"] <= 1
    assert got[len(texts) - 1]["labels"] == "mit" and got[len(texts) - 1]["base_labels"] == ""


def test_licenses_are_those_of_all_alignments(spark):
    own = random.Random(12)
    notices = [words for _, words, _ in license_scan.TEMPLATES]
    stray = sorted({w for n in notices for w in n.split()})
    texts = [f"{prose(60, 20)} {notices[13]} {prose(60, 21)} {a} {b}" for a in notices for b in (notices[5], notices[7])]
    for k in range(60):
        words = [w if own.random() < 0.85 else "changed" for w in own.choice(notices).split()]
        texts.append(" ".join([prose(300, 30 + k), *own.sample(stray, 40), *words, prose(100, 100 + k), *own.sample(stray, 20)]))
    texts += [" ".join(notices[0].split()[4:]), " ".join(notices[7].split()[:-5]), *ODD]
    index = license_scan.Index()
    split = [license_scan.alnum_words((t or "").encode()) for t in texts]
    counts = Counter(w.decode() for words in split for w in set(words))
    idf = {w: math.log((len(texts) + 1) / (counts[w.decode()] + 1)) + 1e-3 for _, template, _ in index.templates for w in template}
    got = {r["doc_id"]: r for r in rows_of(license_scan.license_scan(frame(spark, texts)))}
    for k, words in enumerate(split):
        found = set()
        for label, template, must in index.templates:
            for shift in range(1 - len(template), len(words)):
                there, rest = words[max(0, shift) : shift + len(template)], template[max(0, -shift) :]
                share = sum(idf[a] for a, b in zip(rest, there) if a == b) / sum(idf[w] for w in template)
                if share >= license_scan.MIN_SCORE and all(license_scan.phrase_places(there, [m]) for m in must):
                    found.add(label)
        assert got[k]["labels"] == ",".join(sorted(found | set(filter(None, got[k]["base_labels"].split(",")))))


# 2, 6
def shared_texts():
    part = prose(70, 1)
    texts = [prose(60, 2) + " " + part, part + " " + prose(30, 3), prose(40, 4), " ".join(part.split()[5:40]) + " " + prose(40, 5), prose(90, 6), prose(90, 6), None, "", "a " * 60, "a " * 40, part]
    for k in range(30):
        words = prose(120, 6).split()[k : k + 60]
        words[k % 60] = "changed"
        texts.append(" ".join(words))
    return texts


def removed(texts, ids, window):
    first = {}
    for doc, text in zip(ids, texts):
        words = (text or "").split()
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, text in zip(ids, texts):
        words = (text or "").split()
        gone = {i + k for i in range(len(words) - window + 1) if first[tuple(words[i : i + window])] < doc for k in range(window)}
        out.append((doc, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return sorted(out)


@pytest.mark.parametrize("sizes", [{}, {"shard_words": 50, "hot_segments": 2}])
def test_substring_dedup_is_what_all_windows_give(spark, sizes):
    texts = shared_texts()
    ids = list(range(100, 100 + len(texts)))
    rnd.shuffle(ids)
    got = repeats.substring_dedup(frame(spark, texts, ids), **sizes)
    assert sorted(tuple(r) for r in got.collect()) == removed(texts, ids, 13)


@pytest.mark.parametrize("sizes", [{}, {"shard_words": 50, "hot_segments": 2}])
def test_repeated_passages_cover_all_shared_windows(spark, sizes):
    texts = shared_texts()
    window = 20
    owners = defaultdict(set)
    for doc, text in enumerate(texts):
        words = (text or "").split()
        for i in range(len(words) - window + 1):
            owners[tuple(words[i : i + window])].add(doc)
    expected = {(doc, i + k) for doc, text in enumerate(texts) for i in range(len((text or "").split()) - window + 1)
                for k in range(window) if len(owners[tuple((text or "").split()[i : i + window])]) > 1}
    got = rows_of(repeats.repeated_passages(frame(spark, texts), window=window, gram=4, **sizes))
    assert {(r["doc_id"], p) for r in got for p in range(r["start_word"], r["end_word"])} == expected
    assert all(r["first_doc_id"] <= r["doc_id"] for r in got)


@pytest.mark.parametrize("window", [1, 2, 5, 13, 16, 20, 33])
def test_fm_index_agrees_with_plain_search(window):
    base = [rnd.randrange(4) for _ in range(300)]
    contents = [base[i : i + rnd.randrange(0, 60)] for i in (rnd.randrange(260) for _ in range(80))] + [[]]
    low = np.array([rnd.randrange(50) for _ in contents])
    high = low + np.array([rnd.randrange(5) for _ in contents])
    least, most = fm_index.windows_shared(np.array([w for c in contents for w in c], np.uint64), np.array([len(c) for c in contents]), low * 0, low, high, window)
    found = defaultdict(list)
    for no, words in enumerate(contents):
        for i in range(len(words) - window + 1):
            found[tuple(words[i : i + window])].append((low[no], high[no]))
    every = [found[tuple(words[i : i + window])] for words in contents for i in range(len(words) - window + 1)]
    assert least.tolist() == [min(x for x, _ in f) for f in every] and most.tolist() == [max(y for _, y in f) for f in every]


@pytest.mark.parametrize("window", [1, 3, 8])
def test_suffix_array_agrees_with_plain_search(window):
    contents, places = [], []
    for _ in range(120):  # the word 9 once in each: every window must hold its place
        before, after = rnd.randrange(window), rnd.randrange(window)
        contents.append([*(rnd.randrange(2) for _ in range(before)), 9, *(rnd.randrange(2) for _ in range(after))])
        places.append(before)
    low = np.array([rnd.randrange(50) for _ in contents])
    least, most = suffix_array.windows_shared(np.array([w for c in contents for w in c], np.uint64), np.array([len(c) for c in contents]), np.array(places), low, low + 1, window)
    found = defaultdict(list)
    for no, words in enumerate(contents):
        for i in range(len(words) - window + 1):
            found[tuple(words[i : i + window])].append(low[no])
    every = [found[tuple(words[i : i + window])] for words in contents for i in range(len(words) - window + 1)]
    assert least.tolist() == [min(f) for f in every] and most.tolist() == [max(f) + 1 for f in every]


def test_what_the_index_does_not_find_is_not_there(spark, monkeypatch):
    nothing = lambda words, sizes, places, lowest, highest, window: (np.repeat(lowest, np.maximum(0, sizes - window + 1)),) * 2
    monkeypatch.setattr(fm_index, "windows_shared", nothing)
    monkeypatch.setattr(suffix_array, "windows_shared", nothing)
    docs = frame(spark, shared_texts())
    assert repeats.substring_dedup(docs).where("n_removed > 0").isEmpty()
    assert repeats.repeated_passages(docs, window=20, gram=4).isEmpty()


def test_word_hashes_are_those_of_the_words():
    long = ["".join(random.Random(k).choices("abcé", k=3_000_000)) for k in (1, 2)]
    texts = ["", " a b\tc ", "ab", "cd", "é ñ\n\n漢字 x", "y" * 3_000_000, "b " + "y" * 3_000_000 + " c", *(prose(50, k) for k in range(30)), "a" * 1_100_000 + " b", "",
             f"{long[0]}  {long[1]} {long[0]}", f"q {long[0][:-1]}z {long[0]}", "y" * 2_999_999 + "\n" * 2_500_000 + "y " + "y" * (1 << 20), "é" * (1 << 19), "é" * (1 << 20)]
    hashes, first = common.word_hashes(pa.array(texts))
    assert first[0] == 0 and len(hashes) == first[-1]
    told = defaultdict(set)
    for t, (begin, end) in enumerate(zip(first[:-1], first[1:])):
        words = texts[t].split()
        assert len(words) == end - begin
        for w, h in zip(words, hashes[begin:end].tolist()):
            told[w].add(h)
    assert all(len(h) == 1 for h in told.values()) and len(set().union(*told.values())) == len(told)
    assert common.word_hashes(pa.array(["xab cd", "e"]).slice(1))[0].tolist() == common.word_hashes(pa.array(["e"]))[0].tolist()


def test_long_words_count_as_one(spark):
    """Words of 3 million bytes before, within and behind a passage that documents share, against brute force."""
    own = random.Random(31)
    long = ["".join(own.choices("abcdefgh", k=3_000_000)) for _ in range(2)]
    shared, other = prose(60, 71).split(), prose(60, 72).split()
    texts = [
        shared, [long[0], *shared, "tail"], [*shared[:30], long[1], *shared[30:]], ["a", *shared[:30], long[1], *shared[30:], "b"], [*shared, long[0], "w"],
        [*other, long[1], long[0]], [*other[:59], "x", *other[:20], long[0][:-1] + "z", *other[20:]], [*other[:40], *other[:20], long[0], *other[20:]], [long[0]], [long[0], *shared[:12], long[0]],
    ]
    docs = frame(spark, [" ".join(t) for t in texts])
    for window, got in (
        (13, {r["doc_id"]: (r["n_words"], r["kept_text"].split()) for r in rows_of(repeats.substring_dedup(docs))}),
        (50, {r["doc_id"]: (r["start_word"], r["end_word"], r["first_doc_id"]) for r in rows_of(repeats.repeated_passages(docs))}),
    ):
        seen = defaultdict(set)
        for k, words in enumerate(texts):
            for i in range(len(words) - window + 1):
                seen[tuple(words[i : i + window])].add(k)
        for k, words in enumerate(texts):
            grams = [seen[tuple(words[i : i + window])] for i in range(len(words) - window + 1)]
            if window == 13:
                gone = {i + j for i, docs_of in enumerate(grams) if min(docs_of) < k for j in range(window)}
                assert got[k] == (len(words), [w for i, w in enumerate(words) if i not in gone]), k
            else:
                at = [i for i, docs_of in enumerate(grams) if len(docs_of) > 1]
                assert (k in got) == bool(at), k
                if at:  # one stretch a document here
                    assert got[k] == (at[0], at[-1] + window, min(min(grams[i]) for i in at)), k


# 3
def test_edited_items_are_found_and_others_are_not(spark):
    items = [(k, prose(rnd.randrange(14, 50), 100 + k)) for k in range(12)] + [(12, None), (13, ""), (0, "again")]
    texts, planted = [], set()
    for k in range(12):
        words = items[k][1].split()
        for _ in range(len(words) // 10):
            words[rnd.randrange(len(words))] = "edited"
        texts.append(prose(50, 300 + k) + " " + " ".join(words) + " " + prose(20, 400 + k))
        planted.add((k, k))
    texts += [prose(200, 500 + k) for k in range(20)] + [None]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in rows_of(decontamination.contaminated(frame(spark, texts), bench)) if r["n_words"] > 1}
    assert got == planted
    left = {r["doc_id"] for r in rows_of(decontamination.decontaminate(frame(spark, texts), bench.where("item_id between 1 and 11")))}
    assert left == {0, *range(12, len(texts))}


def test_finds_are_those_of_the_edit_distance_over_all_windows(spark, monkeypatch):
    own = random.Random(31)
    small = VOCAB[:60]
    items = [(k, " ".join(own.choice(small) for _ in range(own.randrange(5, 40)))) for k in range(25)]
    texts = []
    for k in range(60):
        words = items[k % 25][1].split()
        for _ in range(own.randrange(0, 1 + len(words) // 5)):
            at = own.randrange(len(words))
            words[at : at + 1] = own.choice([[], ["edited"], [words[at], "added"]])
        texts.append(" ".join([*(own.choice(small) for _ in range(own.randrange(80))), *words, *(own.choice(small) for _ in range(own.randrange(80)))]))
    hashes = lambda t: common.hashed(common.alnum_words(t.encode()))
    expected = {}
    for d, text in enumerate(texts):
        for i, item in items:
            edits = decontamination.nearest_stretch(hashes(item), hashes(text))[0]
            if edits <= int(0.2 * len(item.split())):
                expected[d, i] = edits
    assert len(expected) >= 55
    bench = spark.createDataFrame(items, "item_id long, text string")
    for _ in range(2):
        got = {(r["doc_id"], r["item_id"]): r["edits"] for r in rows_of(decontamination.contaminated(frame(spark, texts), bench))}
        assert all(expected[k] == edits for k, edits in got.items()) and len(got) >= 0.95 * len(expected)
        for name, value in (("STRETCH", 40), ("MOST_POSTINGS", 30), ("MOST_STEPS", 500)):
            monkeypatch.setattr(decontamination, name, value)


def test_a_long_text_of_items_own_words_takes_bounded_memory():
    import tracemalloc

    items = decontamination.Items([(k, f"the same six words open each item {k} {prose(30, k)}") for k in range(1000)], 0.2)
    text = ("the same six words open each item " * 1600 + f"{7} {prose(30, 7)}").encode()
    tracemalloc.start()
    assert items.hits(text)[7][0] == 0
    assert tracemalloc.get_traced_memory()[1] < 150 << 20
    tracemalloc.stop()


def test_nearest_stretch_is_the_edit_distance():
    def slow(a, b):
        rows = [[0] * (len(b) + 1)]
        for i in range(len(a)):
            rows.append([i + 1])
            for j in range(len(b)):
                rows[-1].append(min(rows[i][j] + (a[i] != b[j]), rows[i][j + 1] + 1, rows[-1][j] + 1))
        return min(rows[-1])

    for _ in range(60):
        a, b = ([rnd.randrange(4) for _ in range(rnd.randrange(1, 12))] for _ in range(2))
        edits, begin, end = decontamination.nearest_stretch(np.array(a), np.array(b))
        assert edits == slow(a, b) and slow(a, b[begin:end]) == edits


# 4
def test_secret_places_and_owners(spark):
    key = "AKIA" + "Q7" * 9
    text = f"ñ token = 'abc' secret=token = abcdefgh {key} " + "0123456789abcdef" * 2 + " API_KEY: x1.y2.z3"
    texts = [text, *["password: changeme1"] * 4, None, "", "é" * 30]
    got = {r["doc_id"]: r for r in rows_of(secret_scan.secret_scan(frame(spark, texts, sources=["a", "b", "c", "d", "e"])))}
    spans = []
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for no, (kind, pattern, least, group) in enumerate([("assign", assign, 6, 2), ("access", "AKIA[A-Z0-9]+", 20, 0), ("hex", "[0-9a-f]+", 24, 0)]):
        for m in re.finditer(pattern, text, re.I if no == 0 else 0):
            if len(m[group]) >= least:
                spans.append((m.start(), no, f"{kind}:{m.start()}:{m.end()}"))
    assert got[0]["base_sha256"] == hashlib.sha256(",".join(s for *_, s in sorted(spans)).encode()).hexdigest()
    assert set(s for *_, s in spans) <= set(got[0]["spans"].split(","))
    assert got[0]["n_live"] == len(spans) and got[1]["n_copied"] == 1 and got[1]["n_live"] == 0
    assert got[5]["spans"] == "" and got[5]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    clean = {r["doc_id"]: r["text"] for r in rows_of(secret_scan.redact(frame(spark, texts, sources=["a", "b", "c", "d", "e"])))}
    assert key not in clean[0] and clean[0].startswith("ñ token = 'abc'") and clean[1] == texts[1] and clean[5] is None and len(clean) == len(texts)


def base_spans(text):
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for no, (kind, pattern, least, group) in enumerate([("assign", assign, 6, 2), ("access", "AKIA[A-Z0-9]+", 20, 0), ("hex", "[0-9a-f]+", 24, 0)]):
        for m in re.finditer(pattern, text, re.I if no == 0 else 0):
            if len(m[group]) >= least:
                yield m.start(), no, m.end(), f"{kind}:{m.start()}:{m.end()}", m[group]


def test_a_text_of_twenty_thousand_candidates_is_scanned_and_redacted_in_time(spark):
    own, words = random.Random(4), []
    for k in range(10_000):
        words += [f"token=ab{k:06d}", own.choice([f"AxQ{k % 97}{'q7W' * 8}{k}", f"secret=Cd{k:020d}Ef", f"{k:032x}/Zz", "é" * 3]), "word"]
    text = " ".join(words)
    base = sorted(base_spans(text))
    wide = [(m.start(), 3, m.end(), f"owned:{m.start()}:{m.end()}", m[0]) for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text)
            if re.search("[a-z]", m[0]) and re.search("[A-Z]", m[0]) and re.search("[0-9]", m[0])]
    starts, tops = [s for s, *_ in base], []
    for _, _, end, *_ in base:
        tops.append(max(end, tops[-1] if tops else 0))
    free = []
    for w in wide:
        at = bisect.bisect_left(starts, w[2])  # base spans that start before its end
        if not at or tops[at - 1] <= w[0]:
            free.append(w)
    began = time.time()
    got = rows_of(secret_scan.secret_scan(frame(spark, [text, "clean"])))[0]
    assert got["base_sha256"] == hashlib.sha256(",".join(x[3] for x in base).encode()).hexdigest() and len(base) > 10_000 and len(free) > 2_000
    assert got["spans"] == ",".join(x[3] for x in sorted(base + free))
    clean = {r["doc_id"]: r["text"] for r in rows_of(secret_scan.redact(frame(spark, [text, "clean"])))}
    expected, at = [], 0
    for begin, end in sorted((end - len(value), end) for _, _, end, _, value in base + free):
        if begin >= at:
            expected += [text[at:begin], "<SECRET>"]
        at = max(at, end)
    assert clean == {0: "".join(expected) + text[at:], 1: "clean"}
    assert time.time() - began < 60


# 5
def test_classes_are_the_components_of_all_links(spark):
    texts = []
    for g in range(6):
        base = prose(120, 700 + g).split()
        for k in range(25):
            own, edits = list(base), random.Random(g * 100 + k)
            for _ in range(edits.randrange(0, 12)):
                own[edits.randrange(len(own))] = f"w{edits.random()}"
            texts.append(" ".join(own))
    texts += [texts[3], texts[3] + " ", None, "", "few words", "few  words", *ODD]
    sets = [set(near_dedup.shingles((t or "").encode()).tolist()) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            same = (texts[i] or "") == (texts[j] or "")
            if same or (sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    got = {r["doc_id"]: r["class_id"] for r in rows_of(near_dedup.near_duplicates(frame(spark, texts)))}
    assert got == {k: root(k) for k in range(len(texts))}
    kept = [r["doc_id"] for r in rows_of(near_dedup.deduplicated(frame(spark, texts)))]
    assert sorted(kept) == sorted({root(k) for k in range(len(texts))})
    twice = near_dedup.deduplicated(frame(spark, ["a b c", "a b c", "x"], [1, 1, None]))
    assert sorted(str(r["doc_id"]) for r in rows_of(twice)) == ["1", "None"]


def test_a_near_pair_among_pages_that_quote_it_is_linked(spark):
    base, own = prose(300, 770).split(), random.Random(771)
    copy = list(base)
    for k in range(30, 300, 60):
        copy[k] = "edited"
    pages = [" ".join([*base, *(f"p{own.random()}" for _ in range(own.randrange(90, 100)))]) for _ in range(300)]
    texts = [*pages, " ".join(base), " ".join(copy)]
    sets = [set(near_dedup.shingles(t.encode()).tolist()) for t in texts]
    assert all(len(s & sets[300]) < 0.8 * len(s) for s in sets[:300]) and len(sets[300] & sets[301]) >= 0.8 * len(sets[300] | sets[301])
    got = {r["doc_id"]: r["class_id"] for r in rows_of(near_dedup.near_duplicates(frame(spark, texts)))}
    assert got == {**{k: k for k in range(301)}, 301: 300}


def test_pairs_that_differ_in_repeat_counts_only_are_linked(spark):
    texts = []
    for k in range(12):
        text, line = prose(54, 780 + 2 * k), prose(10, 781 + 2 * k)
        texts += [" ".join([text, *[line] * (1000 if k % 2 else 30)]), f"{text} {line}"]
    got = {r["doc_id"]: r["class_id"] for r in rows_of(near_dedup.near_duplicates(frame(spark, texts)))}
    assert got == {k: k - k % 2 for k in range(24)}


def test_open_buckets_go_by_blocks_on_both_sides(spark):
    n = 6 * near_dedup.BLOCK
    rows = spark.range(n).select(F.lit(7).cast("long").alias("key"), F.col("id").alias("node"), F.col("id").alias("component"), F.lit(n - 1).cast("long").alias("main"),
                                 F.lit(n).cast("long").alias("of"), F.lit(n - 1).cast("long").alias("outside"))
    groups = near_dedup._dealt(rows).groupBy("key", "part", "block").agg(F.count_if("asks").alias("ask"), F.count_if(~F.col("asks")).alias("give")).collect()
    assert sum(g.ask * g.give for g in groups) == n * (n - 1) and max(max(g.ask, g.give) for g in groups) < 1.3 * near_dedup.BLOCK


def test_small_blocks_give_the_same_classes(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    test_classes_are_the_components_of_all_links(spark)


def test_signatures_estimate_probability_jaccard():
    a, b = Counter(range(60)), Counter(range(30, 90))
    a[40], b[80] = 8, 4
    x, y = ({k: 1 + math.log(c) for k, c in w.items()} for w in (a, b))
    union = set(x) | set(y)
    exact = sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in union) for i in set(x) & set(y))
    rng = np.random.default_rng(5)
    hits = []
    for _ in range(40):
        names = rng.integers(0, 2**63, 200, dtype=np.uint64)
        one, two = (near_dedup.signature(names[np.array(list(w.elements()))]) for w in (a, b))
        hits.append((one == two).mean())
    assert abs(np.mean(hits) - exact) < 0.03


def test_components_of_chains_and_cycles(spark):
    links = [(k, k + 1) for k in range(1, 20)] + [(50, 51), (51, 52), (52, 50), (60, 60)]
    got = {r["node"]: r["component"] for r in rows_of(components.components(spark.createDataFrame(links, "a long, b long")))}
    assert got == {**{k: 1 for k in range(1, 21)}, 50: 50, 51: 50, 52: 50}


# 7
def test_rule_figures_by_hand():
    text = b"a b c d e f\n\nx # y\na b c d e f\n  \nx # y"
    words = text.split()
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    assert host_rules.figures(text) == (18, 18, 2, 4, 2, len(covered))
    assert host_rules.repeated_words([b"a"] * 6) == 6 and host_rules.repeated_words([b"a"] * 5) == 0


def test_hosts_are_judged_by_shrunk_rates(spark):
    good, bad = [prose(60, k) for k in range(40)], ["junk $ # |"] * 40
    texts = good + bad + [prose(60, 99), "a"]
    sources = ["good"] * 40 + ["bad"] * 39 + [None] + ["bad", "good"]
    df = frame(spark, texts).withColumn("source", F.element_at(F.array(*[F.lit(s) for s in sources]), (F.col("doc_id") + 1).cast("int")))
    got = {r["doc_id"]: r for r in rows_of(host_rules.host_rules(df))}
    assert all(got[k]["kept"] for k in range(40)) and not any(got[k]["kept"] for k in range(40, 80))
    assert not got[80]["base_failed"] and not got[80]["kept"] and got[81]["base_failed"]


# 8
def log_p(spark, trained, asked):
    """What the model of the trained texts gives to the last word of each asked text, after all before it."""
    whole = [x.rsplit(" ", 1)[0] if " " in x else "" for x in asked] + asked
    nll = {r["doc_id"]: r["nll"] for r in rows_of(quality_lm.scores(frame(spark, whole), quality_lm.train(frame(spark, trained))))}
    return [nll[k] - nll[len(asked) + k] for k in range(len(asked))]


def test_probabilities_sum_to_one_and_match_counts(spark):
    texts = ["a b a b a c", "a b c d", "b a", "c c c c"]
    names = ["a", "b", "c", "d"]
    for context in ("", "a ", "a b ", "d d ", "new b "):
        *each, other = log_p(spark, texts, [context + w for w in [*names, "other"]])
        assert sum(map(math.exp, each)) + math.exp(other) * (quality_lm.WORDS - len(names)) == pytest.approx(1, abs=1e-9)


def kneser_ney(texts: list[str]):
    """p(a, b, c) by the textbook's formulas over plain counts of words; WORDS words in all, discounts within their bounds."""
    three = Counter()
    for text in texts:
        words = ["", "", *text.split()]
        three.update(zip(words, words[1:], words[2:]))
    two = Counter((b, c) for _, b, c in three)
    one = Counter(c for _, c in two)

    def discounted(counts: Counter):
        n1, n2, n3, n4 = (sum(v == k for v in counts.values()) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
        return [0, *(min(max(d, 0.1), k + 0.9) for k, d in enumerate(raw))]

    d1, d2, d3 = (discounted(c) for c in (one, two, three))

    def level(counts: Counter, cut: list, key, inside, lower: float) -> float:
        own = {k: v for k, v in counts.items() if inside(k)}
        total = sum(own.values())
        if not total:
            return lower
        taken = sum(cut[min(v, 3)] for v in own.values())
        n = counts[key]
        return (n - cut[min(n, 3)] if n else 0) / total + taken / total * lower

    def p(a: str, b: str, c: str) -> float:
        low = level(one, d1, c, lambda k: True, 1 / quality_lm.WORDS)
        mid = level(two, d2, (b, c), lambda k: k[0] == b, low)
        return level(three, d3, (a, b, c), lambda k: k[:2] == (a, b), mid)

    return p


def test_model_and_verdicts_are_those_of_plain_counts(spark):
    own = random.Random(11)
    words = [f"w{k}" for k in range(300)]
    made = [" ".join(words[min(299, int(own.expovariate(1) ** 2 * 12))] for _ in range(own.randrange(5, 60))) for _ in range(90)]
    p = kneser_ney(made)
    asked = [[own.choice([*words, "new"]) for _ in range(3)] for _ in range(400)] + [x.split()[k : k + 3] for x in made for k in range(3)]
    for (a, b, c), got in zip(asked, log_p(spark, made, [" ".join(x) for x in asked]), strict=True):
        assert got == pytest.approx(math.log(p(a, b, c)), abs=1e-9)

    docs = frame(spark, made)
    labels = spark.createDataFrame([(k, 1, 0) for k in range(80)], "doc_id long, quality int, toxic int")
    fold = {r["doc_id"]: r["fold"] for r in rows_of(labels.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(5)).alias("fold")))}
    p = kneser_ney([made[k] for k in range(80) if fold[k] < 4])
    raw = []
    for text in made:
        seq = ["", "", *text.split()]
        raw.append((-sum(math.log(p(*x)) for x in zip(seq, seq[1:], seq[2:])), len(seq) - 2))
    held = [k for k in range(80) if fold[k] == 4]
    at = lambda values, share: sorted(values)[math.ceil(share * len(values)) - 1]
    middle = at([raw[k][0] / raw[k][1] for k in held], 0.5)
    drawn = [(nll + quality_lm.PRIOR_WORDS * middle) / (n + quality_lm.PRIOR_WORDS) for nll, n in raw]
    limit = at([drawn[k] for k in held], 0.8)
    got = {r["doc_id"]: r for r in rows_of(quality_lm.classify(docs, labels, quantile=0.8, margin=1.0))}
    for k in range(90):
        assert got[k]["log_ppl"] == pytest.approx(drawn[k], abs=1e-9) and got[k]["threshold"] == pytest.approx(limit, abs=1e-4)
        assert got[k]["kept"] == (drawn[k] <= limit) or abs(drawn[k] - limit) < 1e-4
    assert 0 < sum(not r["kept"] for r in got.values()) < 60


def test_scores_are_the_models_and_junk_goes(spark):
    good = [prose(80, 900 + k) for k in range(120)]
    junk = [" | ".join(f"q{rnd.random()}" for _ in range(40)) for _ in range(10)]
    docs = frame(spark, good + junk + ODD)
    labels = spark.createDataFrame([(k, 1, 0) for k in range(100)] + [(5, 1, None), (121, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in rows_of(quality_lm.classify(docs, labels, max_train=60))}
    assert len(got) == 137 and all(got[k]["kept"] for k in range(120)) and not any(got[k]["kept"] for k in range(120, 130))
    assert got[130]["kept"] and got[130]["n_words"] == 0


def test_all_trusted_documents_train_but_those_held_out(spark, monkeypatch):
    sizes, train = [], quality_lm.train
    monkeypatch.setattr(quality_lm, "train", lambda sample, text_col: sizes.append(sample.count()) or train(sample, text_col))
    docs = frame(spark, [f"a b {k % 7}" for k in range(4999)] + ["a b " * 50_000])
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    got = {r["doc_id"]: r for r in rows_of(quality_lm.classify(docs, labels))}
    monkeypatch.setattr(quality_lm, "BROADCAST_IDS", 0)
    quality_lm.classify(docs, labels)
    train_ids = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(5)) < 4).count()
    assert sizes == [train_ids, train_ids] and 3900 < train_ids < 4100
    assert len(got) == 5000 and got[4999]["n_words"] == 100_000


def test_keys_filters_and_blocks_by_themselves():
    own, made = random.Random(5), [prose(own_length, 70 + k) for k, own_length in enumerate([0, 1, 2, 400, 30, 30, 900, 5])]
    keys = np.unique(np.array([own.getrandbits(64) for _ in range(3000)], np.uint64))
    assert (quality_lm._unpacked_keys(quality_lm._packed_keys(keys)) == keys).all()
    for power in (0, 1, 5):
        known = quality_lm.Filter(power)
        for no, at in quality_lm._cuts(keys, power):
            known.bits[no * known.each // 8 : (no + 1) * known.each // 8] = np.frombuffer(known.slice_of(keys[at]), np.uint8)
        others = np.array([own.getrandbits(64) for _ in range(3000)], np.uint64)
        assert known.knows(keys).all() and known.knows(others).sum() < 30
        assert sum(at.stop - at.start for _, at in quality_lm._cuts(keys, power)) == len(keys)
    # a block read with an open filter asks for all n-grams; in ranges of three words it gives what it gives in one
    known.bits[:] = 255
    words = quality_lm.hashed([w for x in made for w in x.encode().split()])
    names, codes = np.unique(words, return_inverse=True)
    block = quality_lm._Block(names, codes.astype(np.int32), known)
    facts = np.array([[own.randrange(4) for _ in block.asks] for _ in quality_lm.FACTS])
    facts[1] = facts[2:].sum(axis=0) * 2
    cuts = ([0.5, 0.6, 0.7], [0.4, 0.5, 0.6], [0.3, 0.4, 0.5])
    whole = block.log_p(facts, cuts, 100, 1e-6)
    before, quality_lm.RANGE = quality_lm.RANGE, 3
    try:
        assert (block.log_p(facts, cuts, 100, 1e-6) == whole).all() and len(whole) == len(words) - 2
    finally:
        quality_lm.RANGE = before


def test_many_shards_and_blocks_give_the_same_scores(spark, monkeypatch):
    made = [prose(n, 70 + k) for k, n in enumerate([0, 1, 2, 400, 30, 30, 900, 5])]
    docs = frame(spark, made * 3).coalesce(1)
    one = {r["doc_id"]: r["nll"] for r in rows_of(quality_lm.scores(docs, quality_lm.train(frame(spark, made[2:]))))}
    monkeypatch.setattr(quality_lm, "SHARD", 100)  # the driver's: the number of shards
    monkeypatch.setattr(quality_lm, "ASKS_EACH", 0.02)  # the driver's: the number of copies
    model = quality_lm.train(frame(spark, made[2:]))
    assert model.known.power >= 5 and model.shards.count() > 20
    many = {r["doc_id"]: r["nll"] for r in rows_of(quality_lm.scores(frame(spark, made * 3).repartition(5), model))}
    assert many.keys() == one.keys() and all(many[k] == pytest.approx(one[k], abs=1e-9) for k in one)


def test_rounds_give_the_same_scores_and_hold_a_part_at_a_time(spark, monkeypatch):
    made = [prose(n, 70 + k) for k, n in enumerate([0, 1, 2, 400, 30, 30, 900, 5])]
    docs = frame(spark, made * 3)
    one = {r["doc_id"]: r["nll"] for r in rows_of(quality_lm.scores(docs, quality_lm.train(frame(spark, made[2:]))))}
    for name, value in {"SHARD": 500, "PART_BYTES": 1000, "ROUND_BYTES": 5000}.items():  # the driver's: how many of each there are
        monkeypatch.setattr(quality_lm, name, value)
    lying, sizes, written = Counter(), {}, quality_lm.written

    def counted(df, name, within=None):
        found = written(df, name, within)
        lying[name] += 1
        sizes.setdefault(name, []).append(found.count())
        if name == "lm-blocks":
            assert not lying["here"]
            lying["here"] = within
        return found

    def cleared(spark, within=""):
        lying["here"] = 0
        common.clear(spark, within)

    monkeypatch.setattr(quality_lm, "written", counted)
    monkeypatch.setattr(quality_lm, "clear", cleared)
    model = quality_lm.train(frame(spark, made[2:]))
    many = {r["doc_id"]: r["nll"] for r in rows_of(quality_lm.scores(docs, model))}
    assert many.keys() == one.keys() and all(many[k] == pytest.approx(one[k], abs=1e-9) for k in one)
    assert sizes["triples"][0] > 5 and len(sizes["lm-shards"]) == quality_lm.SHARD_ROUNDS and len(sizes["lm-blocks"]) > 3
    assert sum(sizes["lm-part"]) == 24 and len(sizes["lm-answers"]) == quality_lm.ASK_ROUNDS * len(sizes["lm-blocks"]) and not lying["here"]


def test_triples_give_the_facts_of_plain_counts():
    own = random.Random(6)
    three = Counter(tuple(own.randrange(9) for _ in range(3)) for _ in range(900))
    words = np.sort(np.array([own.getrandbits(64) for _ in range(9)], np.uint64))
    two = Counter((b, c) for _, b, c in three)
    expected = defaultdict(lambda: [0] * 5)
    for counts in (three, two, Counter(c for _, c in two)):
        for gram, n in counts.items():
            gram = gram if isinstance(gram, tuple) else (gram,)
            expected[gram][0] = n
            if len(gram) > 1:
                expected[gram[:-1]][1] += n
                expected[gram[:-1]][min(n, 3) + 1] += 1
    key = lambda gram: int(quality_lm._keys([words[[k]] for k in gram])[0])
    expected = {key(gram): facts for gram, facts in expected.items()}
    for spread in (1, 1 << 22):  # with so many words, three places don't fit into 64 bits
        places = np.arange(9) * spread
        many = np.zeros(places[-1] + 1, np.uint64)
        many[places] = words
        a, b, c = (np.array([places[k] for k in x]) for x in zip(*[gram for gram in three.elements()], strict=True))
        read = quality_lm._Triples.counted(many, a, b, c, np.ones(len(a), np.int64))
        cut = read.some(np.arange(len(read.n)))
        assert (cut.words == words).all()
        got = defaultdict(lambda: [0] * 5)
        for order, keys, facts in quality_lm._Triples.read({k: v[0] for k, v in cut.row(0).to_pydict().items()}).facts(lambda x: x >= 0):
            assert (keys[1:] >= keys[:-1]).all()
            for k, at in enumerate(keys.tolist()):
                got[at] = [x + y for x, y in zip(got[at], [*facts[:, k], 0, 0, 0, 0] if order else [0, *facts[:, k]], strict=True)]
        assert got == expected


# 9
def test_pieces_are_exact_and_places_gapless(spark):
    from tokenizers import Tokenizer

    texts = [prose(rnd.randrange(1, 300), 40 + k) for k in range(60)] + [prose(3000, 7), *ODD, "a  b \n c <|endoftext|> d", "don't  's", "a <|endoftext|> b", "x<|endoftext|>y  z", " a b", "a b ", "a \u00a0 b c\u3000d \u2003e"]
    got = rows_of(packing.pack_documents(spark, frame(spark, texts), tokenizer_path))
    tokenizer = Tokenizer.from_file(tokenizer_path())
    for k, text in enumerate(texts):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        own = sorted((r for r in got if r["doc_id"] == k), key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and sum(r["length"] for r in own) == len(ids)
        assert all(r["length"] == 1024 for r in own[1:])
        for r in own:
            part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
            assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"]
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= 1.05 * sum(r["length"] for r in got) / 1024 + 1


def test_ids_are_the_tokenizers_for_every_code_point():
    from tokenizers import Tokenizer

    ids, tokenizer = packing.Ids(packing.vocabulary_file(tokenizer_path())), Tokenizer.from_file(tokenizer_path())
    assert ids.fast
    own = random.Random(9)
    texts = [f"a{chr(c)}b1 {chr(c)} x{chr(c)}{chr(c)}  {chr(c)}1" for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    signs = ["a", "b", " ", "  ", "\n", "\t", "\u00a0", "\u3000", "1", "'s", "<|endoftext|>", "<|endof", "é", "!", "\u200b", "\x85", "你"]
    texts += ["".join(own.choices(signs, k=own.randrange(14))) for _ in range(20_000)] + ["a" + " " * 3_000_000 + "b", "x" * 200_000]
    for at in range(0, len(texts), 10_000):
        part = texts[at : at + 10_000]
        for text, encoded in zip(part, tokenizer.encode_batch(part, add_special_tokens=False), strict=True):
            assert ids.of(text) == np.array(encoded.ids, "<u4").tobytes(), text[:40]


def test_plans_use_up_any_histogram():
    for seed in range(6):
        counts = np.random.default_rng(seed).integers(0, [1, 5, 50, 3, 1000, 2][seed] + 1, 65)
        counts[0] = 0
        made = packing.plan(counts, 64)
        used = Counter()
        for lengths, n in made:
            assert sum(lengths) <= 64 and n > 0
            used.update({v: n * c for v, c in Counter(lengths).items()})
        assert all(used[v] == counts[v] for v in range(1, 65))


# 10
def test_counts_are_the_greedy_longest_matches(spark):
    start, go_on = token_counts.byte_level_vocabulary(packing.vocabulary_file(tokenizer_path()))
    first, rest = set(start), set(go_on)

    def greedy(word):
        n, at, pieces = 0, 0, first
        while at < len(word):
            end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
            if end is None:
                return 1
            n, at, pieces = n + 1, end, rest
        return n

    texts = [*ODD, prose(200, 3), "Überraschung naïve こんにちは \U0001f600\U0001f600", "internationalization pneumonoultramicroscopic"]
    got = {r["doc_id"]: r for r in rows_of(token_counts.token_counts(frame(spark, texts), packing.vocabulary_file(tokenizer_path())))}
    for k, text in enumerate(texts):
        words = (text or "").encode().split()
        assert (got[k]["n_words"], got[k]["n_tokens"]) == (len(words), sum(greedy(b" " + w) for w in words))
    small = token_counts.Counts(token_counts.automaton([b"ab", b"abc", b"a"], [b"b", b"bcx", b"c"]))
    assert [small.count(w) for w in (b"ab", b"abcx", b"abbcx", b"abz", b"abcc")] == [1, 1, 2, 1, 2]
