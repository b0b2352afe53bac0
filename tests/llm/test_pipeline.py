"""The pipeline over the smallest tables: each stage against a plain version of what it is for, and run() against the stages one by one."""

import re
from collections import defaultdict
from pathlib import Path

import corpus_pipeline
from medialib.llm import common

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def shingles(text):
    words = (text or "").encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found = {"": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, FOLDER), f"test-{name}")
        found[name] = docs
    rows = {name: {r.doc_id: r for r in df.collect()} for name, df in found.items() if name != "packing"}
    names = list(rows)
    for before, after in zip(names, names[1:]):
        assert found[after].columns == COLUMNS and rows[after].keys() <= rows[before].keys() and rows[after]
        if after != "secrets":
            assert all(rows[after][k] == rows[before][k] for k in rows[after])
    labels = {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    good = [k for k, r in labels.items() if r.quality == 1 and r.toxic == 0 and k in rows[""]]
    assert sum(k in rows["quality"] for k in good) >= 0.95 * len(good)

    # near duplicates: no two that stay are linked, and each that goes is linked to a class of which one stays
    sets = {k: shingles(r.text) for k, r in rows["quality"].items()}
    links = defaultdict(set)
    for a in sets:
        for b in sets:
            if a < b and (rows["quality"][a].text == rows["quality"][b].text or (sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))):
                links[a].add(b)
                links[b].add(a)
    seen, kept = set(), set(rows["near_duplicates"])
    for k in sets:
        if k not in seen:
            group, todo = set(), [k]
            while todo:
                x = todo.pop()
                if x not in group:
                    group.add(x)
                    todo += links[x]
            seen |= group
            assert kept & group == {min(group)}

    # decontamination: no text that stays has an item word by word; those that go have most of one's words
    items = [re.findall(r"\w+", r.text.lower()) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    runs = [" ".join(i) for i in items if len(i) >= 8]
    for k in kept:
        text = " ".join(re.findall(r"\w+", (rows["near_duplicates"][k].text or "").lower()))
        if k in rows["decontaminate"]:
            assert not any(f" {r} " in f" {text} " for r in runs), k
        else:
            words = set(text.split())
            assert any(sum(w in words for w in i) >= 0.8 * len(i) for i in items), k

    # secrets: every document stays, and its text changes only where there may be one
    assert rows["secrets"].keys() == rows["decontaminate"].keys()
    odd = re.compile(r"AKIA|[0-9a-f]{24}|password|passwd|secret|token|api_?key", re.I)
    for k, r in rows["secrets"].items():
        assert r.text == rows["decontaminate"][k].text or odd.search(rows["decontaminate"][k].text)
        assert r.n_chars == len(r.text or "")

    # packing: whole sequences, every document's pieces, no gaps
    places, pieces = defaultdict(list), defaultdict(list)
    packed = found["packing"].collect()
    for r in packed:
        places[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.piece, r.start, r.length))
    assert pieces.keys() == rows["secrets"].keys()
    for each in places.values():
        end = 0
        for offset, length in sorted(each):
            assert offset == end
            end += length
        assert end <= 1024
    for each in pieces.values():
        end = 0
        for no, (piece, start, length) in enumerate(sorted(each)):
            assert (piece, start) == (no, end)
            end += length

    own = corpus_pipeline.run(spark, FOLDER)
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, own.collect())) == sorted(map(key, packed))
    left = [p.name for p in Path(common.shared_dir(spark).removeprefix("file:")).iterdir()]
    assert not any(n.startswith("scratch-") for n in left)
