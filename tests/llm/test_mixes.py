"""Filter audit, source mix and collocations against brute force, on small tables with nulls, ties, repeats and clashing columns."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from medialib.llm import collocations, filter_audit, source_mix
from tests.llm.test_operators import frame, prose, rows_of

LABELS = "doc_id long, quality int, toxic int, part string"


# 11
def brute_audit(rows, labels):
    """Each order is run filter by filter over the documents of a part."""
    fails = []
    for doc, text, part in rows:
        text = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        mine = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": bool(re.search("[#$%&*|]", text)), "E": any(d is not None and doc is not None and d < doc and (t or "") == text for d, t, _ in rows),
        }
        fails.append((part or "", {f for f, x in mine.items() if x}, any(d == doc and q == 1 for d, q, _ in labels if d is not None), any(d == doc and t == 1 for d, _, t in labels if d is not None)))
    out, shapley = {}, Counter()
    for part in {p for p, *_ in fails}:
        mine = [x[1:] for x in fails if x[0] == part]
        for order in permutations("ABCDE"):
            left, gone = list(mine), []
            for step, f in enumerate(order, 1):
                removed = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                shapley[part, f] += len(removed)
                out[part, "".join(order), step] = [len(left), len(removed), sum(f in x[0] for x in gone), sum(x[0] == {f} for x in mine), sum(x[1] for x in removed), sum(x[2] for x in removed)]
                gone += removed
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_filter_audit_is_a_run_of_every_order(spark):
    own = random.Random(5)
    texts = [prose(60, 1), prose(60, 1), prose(60, 2) + " #", "WORD " * 60, "word " * 60, "a b", "", None, "É" * 30 + " x" * 60, prose(70, 3).upper(), prose(55, 4) + "\x0b|\x0c" + prose(9, 5), None, "word " * 60]
    texts += [" ".join(own.choice(["One", "two#", "three", "é", "$", "six\tseven"]) for _ in range(own.randrange(20, 90))) for _ in range(40)] + [prose(60, 1)] * 9
    sources = ["s0", None, "", "é", "s0", "s0"]
    ids = [*range(len(texts) - 4), 3, 3, None, None]
    own.shuffle(ids)
    docs = frame(spark, texts, ids, sources)
    labels = [(k, own.choice([0, 1, None]), own.choice([0, 1])) for k in range(0, 40)] + [(3, 1, 1), (None, 1, 1), (999, 1, 1), (5, None, None)]
    got = rows_of(filter_audit.filter_audit(docs, spark.createDataFrame([(*x, "clash") for x in labels], LABELS)))
    want = brute_audit([(i, t, sources[k % len(sources)]) for k, (i, t) in enumerate(zip(ids, texts))], labels)
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in names) for r in got} == want and len(got) == len(want)


def test_filter_audit_of_empty_tables(spark):
    none = spark.createDataFrame([], LABELS)
    assert filter_audit.filter_audit(frame(spark, []), none).collect() == []
    got = rows_of(filter_audit.filter_audit(frame(spark, [None, "x" * 5_000_000]), none))
    assert len(got) == 600 and {(r["step"], r["kept"], r["removed"]) for r in got if r["filter_order"] == "EABCD"} == {(1, 2, 0), (2, 0, 2), (3, 0, 0), (4, 0, 0), (5, 0, 0)}


def test_potentials_give_each_filter_its_share():
    own = random.Random(9)
    for n in (1, 2, 3, 4, 5):
        by_mask = {m: own.randrange(50) for m in range(1 << n)}
        game = filter_audit.removal_game(by_mask, n)
        assert game == [sum(c for m, c in by_mask.items() if m & s) for s in range(1 << n)]
        found, scale = filter_audit.potentials(game, n), np.lcm.reduce(range(1, n + 1))
        for s in range(1, 1 << n):  # the shares of a coalition's members add up to what it removes
            assert sum(found[s] - found[s ^ 1 << i] for i in range(n) if s >> i & 1) == scale * game[s]


# 12
def test_points_below_are_counted_from_the_digits():
    k = np.arange(700)
    value = source_mix.points(k)
    assert len(set(value.tolist())) == len(k)
    for bound in [0, 1, 1 << source_mix.DIGITS, (1 << source_mix.DIGITS) // 3, 5 << 40, *value[:50].tolist(), *(value[:50] + 1).tolist()]:
        want = np.concatenate([[0], np.cumsum(value < bound)[:-1]])
        assert (source_mix.points_below(k, np.array(bound)) == want).all(), bound


def test_targets_are_what_dealing_the_excess_again_ends_at():
    own = random.Random(6)
    for _ in range(60):
        sizes = [own.choice([0, own.randrange(1, 20), own.randrange(1, 3000)]) for _ in range(own.randrange(1, 9))]
        weights = [1 + i % 3 for i in range(len(sizes))]
        want, free, left = [Fraction(0)] * len(sizes), set(range(len(sizes))), Fraction(sum(sizes))
        while free:
            share = {i: left * weights[i] / sum(weights[j] for j in free) for i in free}
            over = [i for i in free if share[i] > 3 * sizes[i]]
            for i in over or list(free):
                want[i] = Fraction(3 * sizes[i]) if over else share[i]
            left -= sum(want[i] for i in over) if over else 0
            free -= set(over) if over else free
        assert source_mix.targets(sizes, weights) == want, sizes


@pytest.mark.parametrize("block, stretch", [(7, 8), (1024, 1 << 16)])
def test_mix_fills_its_slots_with_whole_blocks(spark, block, stretch):
    own = random.Random(7)
    texts = [None, "", " \n", *(prose(own.randrange(0, 90), k) for k in range(120)), "same words"] + ["same words", "", None] * 6
    sources = ["b", "a", None, "a", "a", "é", "tiny", "b", "b", "b"]
    ids = [*range(len(texts) - 6), 5, 5, 5, None, None, None]
    docs = frame(spark, texts, ids, sources).repartition(3)
    mixed = rows_of(source_mix.mix(docs, block=block, stretch_docs=stretch))
    listed = [(i, len((t or "").split()), sources[k % len(sources)]) for k, (i, t) in enumerate(zip(ids, texts))]
    sizes = defaultdict(int)
    for _, n, s in listed:
        sizes[s] += n
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = dict(zip(order, source_mix.targets([sizes[s] for s in order], [1 + i % 3 for i in range(len(order))])))
    slots = defaultdict(list)
    for r in mixed:
        if r["slot"] is not None:
            slots[r["slot"]].append(r)
    given = Counter()
    for rows in slots.values():
        assert len({r["source"] for r in rows}) == 1
        given[rows[0]["source"]] += sum(r["words"] for r in rows)
        assert sum(r["words"] for r in rows) <= block
    assert all(abs(given[s] - target[s]) <= Fraction(1, 2) for s in order)
    short = Counter(rows[0]["source"] for rows in slots.values() if sum(r["words"] for r in rows) < block)
    assert all(n == 1 for n in short.values())  # a source's last block alone
    if block == 7:  # every beginning of the mix has the sources at about their shares
        shares = {s: target[s] / sum(target.values()) for s in order}
        seen = Counter()
        for k, no in enumerate(sorted(slots), 1):
            seen[slots[no][0]["source"]] += 1
            assert all(abs(seen[s] - k * shares[s]) < 8 for s in order)
    taken = rows_of(source_mix.taken_words(docs, block=block, stretch_docs=stretch))
    assert sorted((str(r["doc_id"]), r["size"]) for r in taken) == sorted((str(i), n) for i, n, _ in listed)
    assert all(r["taken"] <= 3 * r["size"] and r["source_size"] in sizes.values() for r in taken)
    assert sum(r["taken"] for r in taken) == sum(given.values())
    again = rows_of(source_mix.taken_words(docs.repartition(5), block=block, stretch_docs=8))
    key = lambda r: (str(r["doc_id"]), r["size"], r["source_size"], r["target"], r["taken"])
    assert sorted(map(key, taken)) == sorted(map(key, again))


def test_mix_of_empty_and_odd_tables(spark, monkeypatch):
    assert source_mix.mix(frame(spark, [])).collect() == [] and source_mix.taken_words(frame(spark, [])).collect() == []
    got = rows_of(source_mix.taken_words(frame(spark, [None, "", "\t"])))
    assert [(r["size"], r["target"], r["taken"]) for r in got] == [(0, 0.0, 0)] * 3
    got = rows_of(source_mix.taken_words(frame(spark, ["w " * 400_000 + "x" * 3_000_000, "a b"], sources=["s", "t"])))
    # weights 1 and 2: the second is capped at three times its words, the first gets the rest
    assert sorted((r["size"], r["taken"]) for r in got) == [(2, 6), (400_001, 399_997)]
    monkeypatch.setattr(source_mix, "MOST_SOURCES", 2)
    with pytest.raises(ValueError):
        source_mix.mix(frame(spark, ["a", "b", "c"], sources=["1", "2", "3"]))


# 13
def brute_collocations(rows, most_words, least, top, subsumed):
    n, count = Counter(), Counter()
    for text, lang in rows:
        lang, lower = lang or "und", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for m in range(1, most_words + 1):
                for i in range(len(words) - m + 1):
                    count[lang, tuple(words[i : i + m])] += 1
    found = {k: a for k, a in count.items() if len(k[1]) > 1 and a >= least}
    most = defaultdict(int)
    for (lang, words), a in found.items():
        for m in range(2, len(words)):
            for i in range(len(words) - m + 1):
                most[lang, words[i : i + m]] = max(most[lang, words[i : i + m]], a)
    out = defaultdict(list)
    for (lang, words), a in found.items():
        if 100 * most[lang, words] < subsumed * a:
            score, _, l, r = min((2_000_000 * a // (count[lang, words[:k]] + count[lang, words[k:]]), k, count[lang, words[:k]], count[lang, words[k:]]) for k in range(1, len(words)))
            out[lang].append((-score, -a, " ".join(words).encode(), l, r))
    return {(lang, rank, p.decode(), -a, l, r, n[lang], -s) for lang, x in out.items() for rank, (s, a, p, l, r) in enumerate(sorted(x)[:top], 1)}


@pytest.mark.parametrize("top, parts", [(2000, 1 << 12), (12, 8)])
def test_collocations_are_those_of_a_plain_count(spark, monkeypatch, top, parts):
    monkeypatch.setattr(collocations, "SECTION_SHARE", parts)
    own = random.Random(13)
    vocab = ["the", "The", "of", "new", "york", "É", "é", "漢字", "x" * 40, "\x00a", "it's"]
    texts = [None, "", " ,.", "one", "new york city hall\x0bnew york city hall", "y" * 2_500_000 + " new york " + "y" * 2_500_000]
    for _ in range(300):
        words = [own.choice(vocab) + own.choice(["", "", "", "", ",", ".", "\n", "\t"]) for _ in range(own.randrange(1, 40))]
        texts.append(" ".join(words) + own.choice(["", " new york city hall", " the new york city", "  NEW\tYork,city"]))
    texts += ["same text again and again"] * 40
    langs = ["en", None, "fr", "und", "en", "en"]
    rows = [(k % 7, t, langs[k % len(langs)], "s", None, "clash", "clash") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, word string, w1 string").repartition(5)
    got = {tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in rows_of(collocations.collocations(docs, least=5, top=top))}
    assert got == brute_collocations([(t, lang) for _, t, lang, *_ in rows], 4, 5, top, 80)
    assert any(len(r[2].split()) == 4 for r in got)


def test_collocations_of_empty_tables_and_frequent_prefixes(spark):
    assert collocations.collocations(frame(spark, [])).collect() == []
    assert collocations.collocations(frame(spark, [None, "", "a b c"])).collect() == []
    got = rows_of(collocations.collocations(frame(spark, ["a b " * 20_000, None, "c " * 31])))
    assert {(r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in got} >= {("c c", 30, 31, 31, 40_031, 967_741)}


def test_stripes_of_a_part_travel_in_one_row(spark, monkeypatch):
    """Rows of a level go with the groups of texts and the parts, not with how many prefixes there are."""
    sent, made = [], collocations.stripes
    monkeypatch.setattr(collocations, "stripes", lambda *a: sent.append((rows := made(*a)).select("part", F.size("sizes"), F.aggregate("counts", F.lit(0).cast("long"), lambda x, y: x + y)).collect()) or rows)
    texts = [f"p{k} q{k} r{k}" for k in range(500)] * 6
    docs = spark.createDataFrame([(t, "en") for t in texts], "text string, lang string").coalesce(1)
    for part_words in (1 << 21, 300):
        monkeypatch.setattr(collocations, "PART_WORDS", part_words)  # the driver's: the number of parts
        sent.clear()
        found = collocations.phrases_by_size(docs, 3, 5)[2]
        assert [df.count() for df in found] == [1500, 1000, 500]
        parts = 4 if part_words > 9000 else 32
        for rows, prefixes, places in zip(sent, (1000, 500), (6000, 3000), strict=True):
            assert len(rows) == len({r[0] for r in rows}) <= parts
            assert (sum(r[1] for r in rows), sum(r[2] for r in rows)) == (prefixes, places)


def test_filters_lose_no_phrase(spark):
    words = spark.createDataFrame([(k * 7919, k) for k in range(-20_000, 20_000)], "w1 long, a long")
    made = collocations.phrase_filter(words, 1)
    assert made.knows(np.array([k * 7919 for k in range(-20_000, 20_000)]).view(np.uint64)).all()
    assert made.knows(np.arange(1, 50_000, dtype=np.uint64) * np.uint64(7919) + np.uint64(3)).mean() < 0.05
