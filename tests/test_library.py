"""Operators of the media library on small literal tables."""

import datetime as dt
import json
import random
import re
import time
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from medialib.functions import text as T
from medialib.functions import wordlists as W
from medialib.operators import answers, feed, frames, library, merge, posts, prompts, ranks, rules, similarity, stats, tags
from medialib.plans import fixtures, registry
from medialib.sources import readers, sidecars, vocabulary

SMALL = "/root/testdata/sf0.001"


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'long'}" for k, v in values.items()))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize("raw, expected", [("#Hard Light", "hard-light"), ("  rim__light ", "rim-light"), ("weird!!", "weird"), ("--", ""), (None, "")])
def test_clean_token(spark, raw, expected):
    assert one(spark, T.clean_token(F.col("a")), a=raw) == expected


@pytest.mark.parametrize("raw, expected", [('my: "best" <ref>/pack?', "my_ _best_ _ref__pack_"), ("", "unnamed"), ("CON", "_CON"), (" a.  b. ", "a. b"), (None, "unnamed")])
def test_safe_component(spark, raw, expected):
    assert one(spark, T.safe_component(F.col("a")), a=raw) == expected


def test_hashtags_and_titles(spark):
    caption = "#Reference #design #design #3d_model"
    assert one(spark, F.array_join(T.hashtags(F.col("a")), ","), a=caption) == "reference,design,3d_model"
    assert one(spark, T.caption_slug(F.col("a")), a="\U0001f600\U0001f600\n#x @y\nA long enough line, here!\n") == "A long enough line, here"
    assert one(spark, T.caption_slug(F.col("a")), a="\U0001f600 ✨") == ""
    assert one(spark, T.caption_slug(F.col("a"), 20), a="every word of this line is short") == "every word of this"
    assert one(spark, T.short_title(F.col("a"), F.lit("bob"), F.lit("C1")), a="") == "@bob · C1"
    assert one(spark, T.ext_from_url(F.col("a")), a="https://x.test/pic.jpeg?x=1") == ".jpg"
    assert one(spark, T.ext_from_url(F.col("a"), ".mp4"), a="https://x.test/pic") == ".mp4"


def test_annotation_and_its_removal(spark):
    note = T.annotation(F.col("a"), F.lit("a  shot"), F.lit("step 1"), F.lit(""), F.lit("short"))
    made = one(spark, note, a=" words ")
    assert made == "words\n\nIn short: short\n\nVisual summary: a shot\n\nOn screen: step 1"
    assert one(spark, T.strip_description(F.col("a")), a=made) == "words"


def test_template(spark):
    day = F.to_timestamp(F.lit("2026-08-20 10:11:00"))
    made = T.render_template("{date}_{user}__{collection}_{title}-{type}", day, F.lit("bob"), F.lit("C1"), F.lit(""), F.lit(""), F.lit(""), F.col("a"))
    assert one(spark, made, a="#only #tags") == "2026-08-20_bob_only tags-post"
    assert one(spark, T.asset_name(F.lit("b"), F.lit(3), F.lit("jpg")), a="") == "b_03.jpg"


def normal(spark, given, mode="video"):
    rows = spark.createDataFrame([(1, mode, given)], "id int, mode string, tags array<string>")
    row = tags.normalize_tags(rows, vocabulary.starter()).first()
    return row.kept, row.dropped


@pytest.mark.parametrize("mode, given, kept, dropped", [
    ("video", ["handheld", "locked-off", "orbit", "crane"], ["handheld", "orbit"], []),
    ("image", ["handheld", "portrait"], ["portrait"], ["handheld"]),
    ("video", ["CGI", "render", "3d"], ["3d-render"], []),
    ("video", ["fashion"], ["fashion-film"], []), ("image", ["fashion"], ["model"], []),
    ("video", ["unknown", "unknown", "meme", ""], [], ["unknown", "unknown"]),
    ("video", ["close-up", "medium-shot", "wide-shot"], ["close-up", "medium-shot"], []),
    ("video", [], [], []),
])
def test_normalize_tags(spark, mode, given, kept, dropped):
    assert normal(spark, given, mode) == ([*kept, "autotagged"], dropped)


def test_normalize_is_idempotent(spark):
    kept, _ = normal(spark, ["Skiing", "c4d", "low-key", "high-key", "tutorial", "orbit"])
    assert normal(spark, kept)[0] == kept


def test_account_hints_are_whole_words(spark):
    names = ["gamestart", "alt_studio", "studio.alt", "3d-artist", "spartan_plays", "", None]
    rows = spark.createDataFrame([(n,) for n in names], "a string").select(rules.account_hit(F.col("a"), ["art", "studio", "3d", "artist"]).alias("x")).collect()
    assert [r.x for r in rows] == [None, "studio", "studio", "3d", None, None, None]


def test_classifier(spark):
    rows = [("1", "bob", "x #render", 10.0, False, 0), ("2", "daily_memes", "lol #meme", 5.0, False, 0), ("3", "bob", "paid partnership", 5.0, False, 0), ("4", "bob", "sunset", None, None, None), ("5", "enemy", "#art #3d", 1.0, False, 0), ("6", "bob", "#meme #funny #art #design", 1.0, False, 0)]
    df = spark.createDataFrame(rows, "pk string, username string, caption string, duration double, paid boolean, sponsors int").withColumn("full_name", F.lit(None).cast("string"))
    got = {r.pk: r.decision for r in rules.classify(df, block=["Enemy"]).collect()}
    assert got == {"1": "download", "2": "skip", "3": "download", "4": "review", "5": "skip", "6": "review"}


def test_software_is_named_longest_first(spark):
    texts = ["Made in Blender + Redshift #c4d", "unity of design", "#unity", "after effects and AE, #ae", "unreal engine 5 unreal", "gamestart"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, blob string")
    got = {r.id: r.software for r in df.select("id", rules.software_tags(F.col("blob")).alias("software")).collect()}
    assert got == {0: ["blender", "redshift", "cinema-4d"], 1: [], 2: ["unity"], 3: ["after-effects"], 4: ["unreal-engine"], 5: []}


def test_useful_tags(spark):
    def tags_of(text):
        return one(spark, F.array_join(rules.useful_tags(F.col("a")), ","), a=text)

    assert tags_of("5 tools for designers in Blender") == "resource-list,software-tip,useful"
    assert tags_of("link in bio") == "link-in-bio" and tags_of("nothing") == ""


def test_answers(spark):
    texts = ['x {"category": "art", "confidence": 2, "description": "a } {\\" b", "tags": [{"tag": "Low Key", "evidence": "none seen"}, {"tag": "faceless", "evidence": "no face"}]} }', "it is a meme", "{broken", None, '<think>{}</think>{"category": "ad"}']
    df = spark.createDataFrame(list(enumerate(texts)), "id int, answer_text string")
    got = {r.id: r for r in answers.parse_answers(df).collect()}
    assert (got[0].category, got[0].confidence, got[0].description, got[0].tags, got[0].rejected) == ("art", 1.0, 'a } {" b', ["faceless"], ["low-key"])
    assert (got[1].category, got[1].confidence, got[1].ok) == ("meme", 0.5, True)
    assert not got[2].ok and not got[3].ok and got[4].category == "ad"


@pytest.mark.parametrize("copies", [0, 40])
def test_banded_search_is_the_nested_loop(spark, copies):
    """With copies: posts of the same hashes on both sides, queried posts that are known themselves, and several hashes of a post."""
    rnd = random.Random(3)
    known = [(f"k{n}", rnd.getrandbits(64) - 2**63) for n in range(300)] + [("flat", 0)]
    query = []
    for n in range(60):
        for _ in range(2):
            value = known[rnd.randrange(300)][1]
            for _ in range(rnd.randrange(0, 11)):
                value ^= 1 << rnd.randrange(63)
            query.append((f"q{n}", value))
    if copies:
        pair = [known[0][1], known[1][1]]
        known += [(f"c{n:02}", h) for n in range(copies) for h in pair]
        query += [(f"c{n:02}", h) for n in range(0, copies, 7) for h in pair] + [(f"d{n}", h) for n in range(copies) for h in [*pair, pair[0]]] + [("k5", known[5][1]), ("c00", pair[0])]
    bits = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1")
    fine = lambda h: 12 <= bits(h, 0) <= 52
    expected = {}
    for pk in {p for p, _ in query}:
        found = {}
        for h in [h for p, h in query if p == pk and fine(h)]:
            near = {}
            for other, g in known:
                if other != pk and fine(g) and bits(h, g) <= 8:
                    near[other] = min(near.get(other, 99), bits(h, g))
            for other, d in near.items():
                least, n = found.get(other, (99, 0))
                found[other] = (min(least, d), n + 1)
        good = [(d, -n, other) for other, (d, n) in found.items() if n >= 2 or d <= 2]
        if good:
            d, n, other = min(good)
            expected[pk] = (other, d, -n)
    got = similarity.similar_posts(spark.createDataFrame(query, "pk string, hash long"), spark.createDataFrame(known, "pk string, hash long")).collect()
    assert len(got) == len(expected) and {r.pk: (r.known_pk, r.distance, r.hits) for r in got} == expected


def test_feed_walk_stops(spark):
    rows = [("saved", k, f"p{k}") for k in range(1, 30)] + [("liked", k, f"l{k}" if k != 2 else "") for k in range(1, 9)]
    feeds = spark.createDataFrame(rows, "collection_pk string, pos long, pk string")
    known = spark.createDataFrame([(f"p{k}",) for k in range(5, 30)], "pk string")
    cursor = spark.createDataFrame([("liked", "l6")], "collection_pk string, cursor string")
    got = feed.feed_walk(feeds, known, cursor, stop_after_known=3).collect()
    assert sorted(r.pos for r in got if r.collection_pk == "saved") == list(range(1, 8))
    assert sorted(r.pos for r in got if r.collection_pk == "liked") == [1, 2, 3, 4, 5]
    assert {r.collection_pk: r.cursor for r in feed.liked_cursor(feeds).collect()} == {"saved": "p1", "liked": "l1"}


def test_failures_and_status(spark):
    log = [(1, "a", "fail", "x"), (2, "a", "fail", "y"), (3, "a", "success", ""), (4, "a", "fail", "z"), (1, "b", "fail", "x"), (2, "b", "fail", "x"), (3, "b", "fail", "q")]
    df = spark.createDataFrame(log, "seq long, pk string, event string, error string")
    got = {r.pk: (r.attempts, r.gave_up, r.last_error) for r in feed.failure_lifecycle(df).collect()}
    assert got == {"a": (1, False, "z"), "b": (3, True, "q")}
    assert {r.pk: r.status for r in feed.status_lifecycle(df).collect()} == {"a": "done", "b": "gave_up"}


def test_upserts(spark):
    base = spark.createDataFrame([(1, "a", "done"), (2, "b", "done")], "pk int, caption string, status string")
    change = spark.createDataFrame([(1, "c", "pending", 1), (1, "d", "pending", 2), (3, "e", "pending", 3)], "pk int, caption string, status string, seq int")
    kept = {tuple(r) for r in merge.upsert_keep(base, change, ["pk"], ["status"]).collect()}
    assert kept == {(1, "d", "done"), (2, "b", "done"), (3, "e", "pending")}
    assert {tuple(r) for r in merge.upsert_replace(base, change, ["pk"]).collect()} == {(1, "d", "pending"), (2, "b", "done"), (3, "e", "pending")}


def test_assets_kinds_errors(spark):
    res = [(2, "v1", "t1"), (None, None, "t2"), (9, "v3", "t3"), (1, None, None)]
    rows = [("1", 8, None, None, res), ("2", 2, "v", "t", None), ("3", 1, None, "t", None)]
    df = spark.createDataFrame(rows, "pk string, media_type int, video_url string, thumbnail_url string, resources array<struct<media_type:int,video_url:string,thumbnail_url:string>>")
    got = {(r.pk, r.idx, r.kind, r.url) for r in posts.explode_assets(df).collect()}
    assert got == {("1", 1, "video", "v1"), ("1", 2, "photo", "t2"), ("2", None, "video", "v"), ("3", None, "photo", "t")}
    assert one(spark, posts.error_class(F.col("a")), a="not logged in, rate limit") == "rate_limited"


def test_frames(spark):
    df = spark.createDataFrame([(32, 896, 8000), (4, 896, 100000), (6, 400, 3600)], "count int, side int, context int")
    got = [(r.fit_count, r.fit_side) for r in frames.fit_plan(df).collect()]
    assert got == [(31, 512), (4, 896), (3, 400)]
    assert one(spark, F.array_join(frames.even_positions(F.col("a"), F.lit(3)), ","), a=10) == "0,5,9"
    assert [one(spark, frames.frame_plan(F.lit(float(s)), F.lit(True)), a=1) for s in (0, 10, 11, 60, 121)] == [12, 4, 8, 12, 32]


def test_library_pages_overlap(spark):
    pages = spark.createDataFrame([(0, 1, "a"), (0, 2, "b"), (1, 2, "b"), (1, 3, None), (2, 4, None)], "page int, pos int, id string")
    assert sorted(str(r.id) for r in readers.scan_library(pages).collect()) == ["None", "None", "a", "b"]


def test_feed_pages_end(spark):
    page = "collection_pk string, page int, items array<struct<pk:string>>, cursor string"
    rows = [("c", 0, [("a",), (None,)], "n"), ("c", 1, [], "n"), ("c", 2, [], "n"), ("c", 3, [("late",)], "n"), ("d", 0, [("x",)], None), ("d", 1, [("y",)], "n")]
    got = [(r.collection_pk, r.pos, r.pk) for r in readers.scan_feed(spark.createDataFrame(rows, page)).collect()]
    assert sorted(got) == [("c", 1, "a"), ("c", 2, ""), ("d", 1, "x")]


@pytest.mark.parametrize("part", [3, 1 << 16])
def test_feeds_and_runs_in_parts(spark, part):
    """Feeds longer than a part, against a walk from post to post; blank posts are in no streak."""
    rng = random.Random(7)
    rows = {c: [(p, rng.choice(["", *"abcdefghij"]) if rng.random() < 0.7 else f"n{p}") for p in range(1, 41)] for c in ("liked", "x", "y")}
    known, cursor = set("abcde"), {"liked": "n30"}
    got = {}
    table = spark.createDataFrame([(c, p, k) for c, each in rows.items() for p, k in each], "collection_pk string, pos long, pk string")
    found = feed.feed_walk(table, spark.createDataFrame([(k,) for k in known], "pk string"), spark.createDataFrame(list(cursor.items()), "collection_pk string, cursor string"), 25, 0, 4, 30, part)
    for r in found.collect():
        got.setdefault(r.collection_pk, []).append((r.pos, r.pk, r.new))
    for c, each in rows.items():
        limit, seen, streak, walked = {"liked": 30}.get(c, 0), set(known), 0, []
        for n, (pos, pk) in enumerate(each, 1):
            if (limit and n > limit) or (c == "liked" and pk == cursor[c]):
                break
            walked.append((pos, pk, pk != "" and pk not in seen))
            if pk:
                streak = streak + 1 if pk in seen else 0
                seen.add(pk)
                if streak >= 4:
                    break
        assert sorted(got[c]) == walked
    start = dt.datetime(2024, 1, 1)
    runs = [(n, start + dt.timedelta(minutes=10 * n), None if n % 3 == 0 else start + dt.timedelta(minutes=10 * n + rng.randrange(90))) for n in range(1, 30)]
    waits = {r.id: r.wait for r in feed.run_gaps(spark.createDataFrame(runs, "id long, started_at timestamp, finished_at timestamp"), part=part).collect()}
    for n, at, _ in runs:
        ended = [e for k, _, e in runs if k < n and e]
        assert waits[n] == (max(0, 3600 - int((at - max(ended)).total_seconds())) if ended else 0)


def test_unique_names(spark):
    rows = spark.createDataFrame([("1", 0, "f", "n"), ("2", 0, "f", "n"), ("3", 0, "g", "n")], "media_pk string, idx int, folder string, name string")
    taken = spark.createDataFrame([("g", "n")], "folder string, name string")
    assert {r.media_pk: r.final for r in library.unique_names(rows, taken).collect()} == {"1": "n", "2": "n_2", "3": "n_2"}


def test_free_names_are_those_of_one_file_after_the_other(spark):
    own = random.Random(8)
    names = ["a", "a_2", "a_3", "a_5", "a_02", "b", "a_2_2"]
    disk = {f"/{folder}/{n}{ext}" for folder in "xy" for n in names for ext in (".jpg", "") if own.random() < 0.5} | {"/x/a.jpg", "/x/a_1.jpg"}
    wanted = [(f"/old/{k:03}", f"/{own.choice('xy')}/", own.choice(["a", "a", "a", "b", "a_2", "c"]), own.choice([".jpg", ""])) for k in range(150)]
    used, expected, asked = set(disk), {}, {f"{folder}{stem}{ext}" for _, folder, stem, ext in wanted}
    for path, folder, stem, ext in wanted:
        n = 1
        while (name := f"{folder}{stem}{f'_{n}' if n > 1 else ''}{ext}") in used or n > 1 and name in asked:
            n += 1
        expected[path] = name
        used.add(name)
    rows = spark.createDataFrame(wanted, "path string, folder string, stem string, ext string")
    got = {r.path: r.final for r in library.free_names(rows, spark.createDataFrame([(d,) for d in disk], "path string"), ["path"]).collect()}
    assert got == expected and len(set(got.values())) == 150


def test_rename_plan_moves_companions_and_overwrites_nothing(spark):
    files = spark.createDataFrame([("/l/one.mp4", "1", 0), ("/l/two_b.jpg", "2", 1), ("/l/two_a.jpg", "2", 0), ("/l/gone.jpg", "3", 0), ("/l/same.jpg", "4", 0)], "path string, media_pk string, idx int")
    names = spark.createDataFrame([("1", "new"), ("2", "pair"), ("3", "lost"), ("4", "same")], "media_pk string, base string")
    disk = ["/l/one.mp4", "/l/two_a.jpg", "/l/two_b.jpg", "/l/same.jpg", "/l/new.mp4", "/t/one.jpg", "/t/two_a.jpg", "/t/two_b.jpg", "/m/one.json", "/m/gone.json", "/t/same.jpg", "/m/new_2.json"]
    plan = library.rename_plan(files, names, spark.createDataFrame([(d,) for d in disk], "path string"), {"thumb": ("/t", ".jpg"), "sidecar": ("/m", ".json")}).collect()
    assert {(r.kind, r.path, r.target, r.renamed) for r in plan} == {
        ("file", "/l/one.mp4", "/l/new_2.mp4", True), ("file", "/l/two_a.jpg", "/l/pair_01.jpg", True), ("file", "/l/two_b.jpg", "/l/pair_02.jpg", True), ("file", "/l/same.jpg", "/l/same.jpg", False),
        ("thumb", "/t/one.jpg", "/t/new.jpg", True), ("thumb", "/t/two_a.jpg", "/t/pair.jpg", True), ("thumb", "/t/two_b.jpg", "/t/pair_2.jpg", True), ("thumb", "/t/same.jpg", "/t/same.jpg", False),
        ("sidecar", "/m/one.json", "/m/new.json", True), ("sidecar", "/m/gone.json", "/m/lost.json", True),
    }


def test_registry_and_views():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES) and len(registry.QUERIES) > 120
    assert "media AS (" in fixtures.with_views("SELECT * FROM review")


def test_vocabulary_file_and_its_text(spark):
    """Tags are cleaned, titles and notes kept; lists show by mode and profiles, hidden ones and those without tags never."""
    file = """{"version": 2, "aliases": {"Neon Light": "neon_lit"}, "categories": [
        {"key": "light", "title": "LIGHT", "note": "what is lit", "limit": 2, "tags": ["Soft light", "#neon_lit", ""]},
        {"key": "move", "mode": "video", "profiles": ["live"], "tags": ["orbit"]},
        {"key": "model", "mode": "image", "profiles": ["3d"], "tags": ["mesh"]}, {"key": "software", "profiles": ["hidden"], "tags": ["nuke"]}, {"key": "none", "tags": []}]}"""
    own = vocabulary.loaded(spark.createDataFrame([(file,)], "value string"))
    assert own.categories[0] == vocabulary.Category("light", ["soft-light", "neon-lit"], 2, "both", (), "LIGHT", "what is lit")
    assert own.aliases["neon-light"] == "neon-lit" and own.exclusive == [] and own.categories[1].limit == 3
    for broken in ("", "{", '{"version": 1, "categories": [{"key": "x", "tags": ["y"]}]}', '{"version": 2, "categories": []}', '{"version": 2, "categories": 5}'):
        assert vocabulary.loaded(spark.createDataFrame([(broken,)], "value string")) == vocabulary.starter()
    light = "LIGHT — pick 0-2  (what is lit)\nsoft-light, neon-lit"
    rows = spark.createDataFrame([(1, "video", ["live"]), (2, "image", ["live"]), (3, "image", None), (4, "video", []), (5, "image", ["3d", "core"])], "id int, mode string, profiles array<string>")
    got = {r.id: r.x for r in rows.select("id", prompts.render(own, F.col("mode"), F.col("profiles")).alias("x")).collect()}
    assert got == {1: f"{light}\n\nmove — pick 0-3\norbit", 2: light, 3: f"{light}\n\nmodel — pick 0-3\nmesh", 4: light, 5: f"{light}\n\nmodel — pick 0-3\nmesh"}


def test_requests(spark):
    """Places are filled in order, examples cut to three, empty parts left out."""
    assert one(spark, prompts.render_examples(F.array(F.lit(" a  b "), F.lit(""), F.col("a"), F.lit("fourth"))), a="x" * 500) == f'\n{prompts.EXAMPLES_HEADER}\n- "a b"\n- "{"x" * 400}"\n'
    assert one(spark, prompts.render_examples(F.array(F.col("a"))), a=" ") == ""
    assert one(spark, prompts.render_examples(F.array().cast("array<string>")), a=" ") == ""
    made = prompts.prompt(F.col("a"), F.lit(0), F.lit(""), F.lit("image"), F.lit("L"), F.array(F.lit("e")))
    assert one(spark, made, a=" {frames} {kind} {mode} [{taxonomy}]{examples}.") == f'1 post IMAGE [L]\n{prompts.EXAMPLES_HEADER}\n- "e"\n.'
    assert "{" not in one(spark, made, a=None) and "L" in one(spark, made, a=None)
    tagged = prompts.tag_prompt(F.lit("{summary}|{description}|{ocr}|{taxonomy}"), F.lit(1), F.lit("reel"), F.lit(None).cast("string"), F.lit("L"), F.lit(" s "), F.col("a"), F.lit(" "))
    assert one(spark, tagged, a=None) == "s||none|L"
    assert one(spark, prompts.context(F.lit("bob"), F.col("a"), F.lit(None).cast("string"), F.lit(" said ")), a=" ") == f"Account: @bob\n{prompts.TRANSCRIPT_LABEL}said"
    assert one(spark, prompts.context(F.lit(None).cast("string"), F.col("a"), F.lit(""), F.lit("")), a=None) == ""


def test_job_counters(spark):
    plan = spark.createDataFrame([("a", "b", True, False), ("c", "c", False, False), ("d", "e", True, True), ("f", None, None, None)], "path string, target string, tagged boolean, failed boolean")
    assert stats.refresh_stats(plan).first().asDict() == {"seen": 4, "renamed": 1, "tagged": 1, "skipped": 2, "failed": 1}
    assert stats.refresh_stats(plan.limit(0)).first().asDict() == {"seen": 0, "renamed": 0, "tagged": 0, "skipped": 0, "failed": 0}
    files = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "c"), ("3", "d"), ("4", "e"), ("5", "f")], "media_pk string, path string")
    disk = spark.createDataFrame([("a", 5), ("c", 7), ("e", 9), ("f", 1)], "path string, size long")
    review = spark.createDataFrame([("4", None), ("5", "kept")], "media_pk string, decided string")
    present = spark.createDataFrame([("2", True), ("1", False)], "pk string, present boolean")
    refused = spark.createDataFrame([("5",)], "media_pk string")
    assert stats.push_stats(files, disk, review, present, refused).first().asDict() == {"sent": 1, "missing": 2, "failed": 1, "already": 1}
    assert stats.push_stats(files.limit(0), disk, review, present, refused).first().asDict() == {"sent": 0, "missing": 0, "failed": 0, "already": 0}
    assert stats.cleanup_stats(files, disk, spark.createDataFrame([("c",)], "path string")).first().asDict() == {"posts": 5, "bytes": 15, "files": 3, "missing": 2, "failed": 1}
    changes = spark.createDataFrame([("x", "i"), ("y", "j"), ("z", None)], "id string, item_id string")
    items = spark.createDataFrame([("i",), ("i",)], "id string")
    assert stats.normalize_stats(files, changes, items).first().asDict() == {"rows": 6, "changed": 3, "updated": 1, "missing": 2}


def test_items_of_a_post_go_by_id_then_by_url(spark):
    posts = spark.createDataFrame([("1", "u/1/"), ("2", "u/2"), ("3", "u/3"), ("4", ""), ("5", None), ("6", "u/6")], "media_pk string, url string")
    imports = spark.createDataFrame([("1", "a"), ("1", ""), ("2", "gone"), ("3", ""), ("6", None)], "media_pk string, item_id string")
    items = spark.createDataFrame([("a", "elsewhere"), ("b", "u/1"), ("c", "u/2//"), ("d", "u/3"), ("e", "u/3/"), ("f", ""), ("g", None)], "id string, url string")
    found = {(r.media_pk, r.id) for r in library.items_of_posts(posts, imports, items).collect()}
    assert found == {("1", "a"), ("2", "c"), ("3", "d"), ("3", "e")}
    changes = spark.createDataFrame([("x", "d"), ("x", "e"), ("y", None)], "id string, item_id string")
    assert stats.normalize_stats(posts, changes, items).first().asDict() == {"rows": 6, "changed": 2, "updated": 2, "missing": 1}


def test_sidecars_are_read_as_written(spark, tmp_path):
    posts_ = spark.createDataFrame([("1", "C1", "bob", "a і \"q\"\nb", 7, "song"), ("2", None, None, None, None, None)], "pk string, code string, username string, caption string, like_count long, music_title string")
    lists = spark.createDataFrame([("1", ["Ads", "Art"])], "media_pk string, collections array<string>")
    sidecars.write(posts_, lists, str(tmp_path / "s"))
    got = {r.pk: r for r in sidecars.read(spark, str(tmp_path / "s")).collect()}
    assert got["1"].caption == "a і \"q\"\nb" and got["1"].author.username == "bob" and got["1"].like_count == 7 and got["1"].music.title == "song" and got["1"].collections == ["Ads", "Art"]
    assert got["2"].caption == "" and got["2"].author.username is None and got["2"].music is None and got["2"].collections == [] and got["2"].media_type == 0


def test_letters_are_composed(spark):
    assert one(spark, T.safe_component(T.nfc(F.col("a"))), a="café й") == "café й"
    assert one(spark, T.nfc(F.col("a")), a=None) is None


def test_full_vocabulary_file(spark, tmp_path):
    """400 tags in 20 categories, as many aliases, exclusive groups of three, odd values; read from a file, then used."""
    lists = [{"key": f"c{n}", "title": "" if n % 2 else f"T{n}", "limit": [2, "4", 0, None, "x"][n % 5], "mode": ["both", "video", None, ""][n % 4], "tags": [f" #Tag {n}_{k} " for k in range(20)] + ["", "!!"], "profiles": ["core"] if n % 3 else None} for n in range(20)]
    aliases = {f"Old {n} {k}": f"tag-{n}-{k}" for n in range(20) for k in range(20)} | {"skiing": "tag-0-0"}
    path = tmp_path / "vocabulary.json"
    path.write_text(json.dumps({"version": "3", "categories": lists, "aliases": aliases, "exclusive": [["Tag 0 0", "tag-0-1", "tag-0-2"], ["tag-0-0", "tag-4-0"]]}, indent=1))
    own = vocabulary.read(spark, str(path))
    assert [len(c.tags) for c in own.categories] == [20] * 20 and own.categories[3].tags[:2] == ["tag-3-0", "tag-3-1"]
    assert [c.limit for c in own.categories[:5]] == [2, 4, 3, 3, 3] and [c.mode for c in own.categories[:4]] == ["both", "video", "both", "both"]
    assert own.categories[1].title == "c1" and own.categories[3].profiles == () and own.categories[4].profiles == ("core",)
    assert own.aliases["skiing"] == "tag-0-0" and own.aliases["dancing"] == "dance" and len(own.aliases) == 401 + len(W.STARTER_ALIASES) - 1
    found = {(mode, raw): rest for mode, raw, *rest in tags.resolution(own)}
    assert found["image", "tag-1-0"] == ["tag-1-0", None, None, []] and found["video", "old-1-0"] == ["tag-1-0", "c1", 4, []]
    rows = spark.createDataFrame([(["Skiing", "tag-0-1", "tag 4 0", "tag-1-3", "old 2 5", "nothing"], "image"), (["tag-0-1", "tag-0-2", "old-1-3", None], "video"), (None, "image"), ([], "none")], "tags array<string>, mode string")
    got = [(r.kept, r.dropped) for r in tags.normalize_tags(rows, own).collect()]
    assert got == [(["tag-0-0", "tag-2-5", W.MARKER], ["tag-1-3", "nothing"]), (["tag-0-1", "tag-1-3", W.MARKER], []), ([W.MARKER], []), ([W.MARKER], [])]


def test_accepted_candidates_join_their_categories(spark):
    own = vocabulary.Vocabulary([vocabulary.Category("a", ["x"]), vocabulary.Category("b", ["y"])], {"z": "x"})
    added = spark.createDataFrame([("#New Tag", "a"), ("new-tag", "a"), ("X", "a"), ("x", "b"), ("!!", "b"), (None, "a"), ("q", "none"), ("c", "b")], "tag string, category string")
    new = vocabulary.with_tags(own, added)
    assert [c.tags for c in new.categories] == [["x", "new-tag"], ["y", "c", "x"]] and new.aliases == own.aliases and own.categories[0].tags == ["x"]
    rows = spark.createDataFrame([(["New Tag", "c", "q"], "image")], "tags array<string>, mode string")
    assert tags.normalize_tags(rows, new).first().kept == ["new-tag", "c", W.MARKER]


def test_time_of_tags_does_not_grow_with_the_vocabulary(spark):
    rows = spark.range(40_000).select(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.concat(F.lit("t"), ((F.col("id") * 7 + k) % 390).cast("string"))).alias("tags"), F.lit("image").alias("mode"))
    took = []
    for n in (400, 4_000, 400, 4_000):
        own = vocabulary.Vocabulary([vocabulary.Category(f"c{c}", [f"t{k}" for k in range(c, n, 20)]) for c in range(20)])
        made = tags.normalize_tags(rows, own).select(F.sum(F.size("kept")))
        began = time.time()
        made.collect()
        took.append(time.time() - began)
    assert took[3] < 3 * took[2] + 3, took


def walked(feeds, known, cursor, order, limit, streak_of, most):
    """A run post by post."""
    known, got, out = set(known), 0, []
    for c in order:
        streak = n = 0
        for pos, pk, outcome in feeds[c]:
            if c == "liked" and ((limit and n >= limit) or (pk and pk == cursor)):
                break
            n += 1
            out.append((c, pos, pk, pk != "" and pk not in known))
            if not pk:
                continue
            if pk in known:
                streak += 1
                if streak >= streak_of:
                    break
                continue
            streak = 0
            if outcome != "failed":
                known.add(pk)
            if outcome == "skipped":
                continue
            got += outcome == "downloaded"
            if most and got >= most:
                break
    return sorted(out)


@pytest.mark.parametrize("seed, most, part", [(1, 0, 5), (2, 30, 1 << 16), (3, 12, 7), (4, 3, 4)])
def test_a_run_over_all_feeds(spark, seed, most, part):
    """Posts of earlier feeds are known, and the run's cap holds over all feeds, against a walk post by post."""
    rng = random.Random(seed)
    names = ["x", "liked", "y", "z"]
    feeds = {c: [(p, rng.choice(["", *(f"k{n}" for n in range(25))]) if rng.random() < 0.6 else f"{c}{p}", rng.choice(["downloaded"] * 3 + ["skipped", "failed"])) for p in range(1, 41)] for c in names}
    known = {f"k{n}" for n in range(0, 25, 4)}
    table = spark.createDataFrame([(c, *r) for c in names for r in feeds[c]], "collection_pk string, pos long, pk string, outcome string")
    order = spark.createDataFrame(list(zip(names, range(4))), "collection_pk string, place int")
    found = feed.feed_walk(table, spark.createDataFrame([(k,) for k in known], "pk string"), spark.createDataFrame([("liked", "liked33")], "collection_pk string, cursor string"), 25, 0, 4, 30, part, order, most)
    assert sorted(tuple(r) for r in found.collect()) == walked(feeds, known, "liked33", names, 30, 4, most)


def test_done_posts_are_not_given_up(spark):
    log = [(1, "a", "success", ""), *((k, "a", "fail", "x") for k in range(2, 6)), *((k, "b", "fail", "x") for k in range(3)), (3, "b", "retry", ""), *((k, "b", "fail", "y") for k in range(4, 7))]
    got = {r.pk: (r.attempts, r.gave_up) for r in feed.failure_lifecycle(spark.createDataFrame(log, "seq long, pk string, event string, error string")).collect()}
    assert got == {"a": (4, False), "b": (3, True)}


@pytest.mark.parametrize("parts", [1, 7])
def test_numbers_within_a_large_group(spark, parts):
    rng = random.Random(4)
    rows = [("big", k, rng.random()) for k in range(900)] + [(rng.choice(["a", None, "c"]), k, 0.5) for k in range(900, 1000)]
    rng.shuffle(rows)
    got = ranks.numbered(spark.createDataFrame(rows, "g string, k long, x double"), ["g"], ["k"], parts=parts).collect()
    want = {}
    for g in ("big", "a", None, "c"):
        want |= {k: n for n, k in enumerate(sorted(k for h, k, _ in rows if h == g))}
    assert {r.k: r.place for r in got} == want and len(got) == 1000
    got = ranks.numbered(spark.createDataFrame(rows, "g string, k long, x double"), [], ["k"], parts=parts).collect()
    assert sorted((r.k, r.place) for r in got) == [(k, k) for k in range(1000)]


def ids(df, column="id"):
    return sorted(r[column] for r in df.collect())


def test_folder_tree_and_the_apps_folders(spark):
    rows = [("r1", "Other", None, 0), ("r2", "third", None, 2), ("a", " APP ", "r1", 5), ("b", "x", "a", 0), ("c", "app", "r2", 0), ("d", "y", "c", 1), ("e", "z", "d", 0), ("f", "w", "c", 0), ("g", None, "f", 0)]
    tree = readers.scan_folders(spark.createDataFrame(rows, "id string, name string, parent string, pos int"))
    assert {r.id: r.depth for r in tree.collect()} == {"r1": 0, "r2": 0, "a": 1, "c": 1, "b": 2, "d": 2, "f": 2, "e": 3, "g": 3}
    assert ids(readers.find_folder(tree, "app")) == ["a"] and ids(readers.find_folder(tree, " THIRD")) == ["r2"] and ids(readers.find_folder(tree, "no")) == []
    assert ids(readers.find_folder(tree, "APP", "r2")) == ["c"] and ids(readers.find_folder(tree, "x", "r2")) == []
    assert [r.id for r in tree.orderBy("path").collect()] == ["r1", "a", "b", "r2", "c", "f", "g", "d", "e"]
    assert ids(readers.app_folders(tree, "Third")) == ["c", "r2"] and ids(readers.app_folders(tree, "APP")) == ["a", "b"] and ids(readers.app_folders(tree, "no")) == []
    with_root = readers.scan_folders(spark.createDataFrame([*rows, ("z", "App", None, 9)], "id string, name string, parent string, pos int"))
    assert ids(readers.find_folder(with_root, "app")) == ["z"]  # a root before any other
    assert readers.scan_folders(spark.createDataFrame([], "id string, name string, parent string")).count() == 0


def test_sidecar_files(spark, tmp_path):
    """Broken files are left out, records may go over lines, and a file goes with the longest stem that it begins with."""
    (tmp_path / "a b.json").write_text(json.dumps({"pk": "1", "caption": "x\ny", "author": {"username": "u"}}, indent=2))
    (tmp_path / "a b_2.json").write_text('{"code": "c", "unknown": [1]}')
    (tmp_path / "bad.json").write_text('{"pk": "3", ')
    (tmp_path / "list.json").write_text("nothing")
    (tmp_path / "note.txt").write_text('{"pk": "5"}')
    got = {r.stem: (r.pk, r.caption, r.author and r.author.username) for r in sidecars.read_files(spark, str(tmp_path)).collect()}
    assert got == {"a b": ("1", "x\ny", "u"), "a b_2": ("a b_2", None, None)}
    disk = spark.createDataFrame([(f"/m/{f}",) for f in ("a b_1.mp4", "a b.JPG", "a b_2.jpg", "a b_22.mp4", "a b_2.txt", "xa b.jpg", "a b_7.mp4", "a")], "path string")
    found = readers.scan_sidecars(sidecars.read_files(spark, str(tmp_path)).select("stem", "pk"), disk, spark.createDataFrame([("/m/a b_7.mp4",)], "path string"))
    assert sorted((r.pk, r.path) for r in found.collect()) == [("1", "/m/a b.JPG"), ("1", "/m/a b_1.mp4"), ("a b_2", "/m/a b_2.jpg"), ("a b_2", "/m/a b_22.mp4")]


def test_items_by_folder_and_their_push(spark):
    snapshot = spark.createDataFrame([("u1", ["f1"]), ("u2", [])], "key string, folders array<string>")
    imports = spark.createDataFrame([("3", "c1")], "media_pk string, collection_pk string")
    rows = [("1", "c1", "f1", "u1/"), ("1", "c2", "f2", "u1"), ("1", "c3", "", "u1"), ("2", "c1", "f1", "u2"), ("2", "c3", None, "u2"), ("3", "c1", "f1", "u3"), ("3", "c2", "f2", "u3"), ("4", "c2", "f2", None)]
    shelves = spark.createDataFrame(rows, "media_pk string, collection_pk string, folder_id string, url string")
    present = library.in_library_by_folder(shelves, snapshot, imports)
    assert {(r.media_pk, r.collection_pk) for r in present.where("present").collect()} == {("1", "c1"), ("1", "c3"), ("2", "c3"), ("3", "c1")}
    files = spark.createDataFrame([(pk, k, f"{pk}_{k}") for pk in "123" for k in range(3)], "media_pk string, idx int, path string")
    review = spark.createDataFrame([("2", None), ("1", "kept")], "media_pk string, decided string")
    sent, marks = library.push_by_folder(shelves, files, review, present, 4)
    assert sorted((r.folder_id, r.path, r.batch) for r in sent.collect()) == [("f2", f"{pk}_{k}", 0 if pk == "1" or k == 0 else 1) for pk in "13" for k in range(3)]
    assert sorted(tuple(r) for r in marks.collect()) == [("1", "c2", "f2"), ("3", "c2", "f2")]


def test_a_push_takes_the_folders_that_lack_the_post(spark):
    """Of a collection's two folders only the one without the item gets it; present has the shelves, so they aren't joined again."""
    snapshot = spark.createDataFrame([("u1", ["f1"])], "key string, folders array<string>")
    shelves = spark.createDataFrame([("1", "c1", "f1", "u1"), ("1", "c1", "f9", "u1")], "media_pk string, collection_pk string, folder_id string, url string")
    present = library.in_library_by_folder(shelves, snapshot, spark.createDataFrame([], "media_pk string, collection_pk string"))
    files, review = spark.createDataFrame([("1", 0, "a")], "media_pk string, idx int, path string"), spark.createDataFrame([], "media_pk string, decided string")
    for seen in (present, present.drop("folder_id")):
        sent, marks = library.push_by_folder(shelves.where("folder_id = 'f9'") if seen is not present else shelves, files, review, seen)
        assert [(r.folder_id, r.path, r.batch) for r in sent.collect()] == [("f9", "a", 0)]
        assert [tuple(r) for r in marks.collect()] == [("1", "c1", "f9")]


def test_cleanup_and_backlog(spark):
    candidates = spark.createDataFrame([("1", "u1/"), ("2", "u2"), ("3", "")], "pk string, url string")
    files = spark.createDataFrame([("1", "a", "video"), ("1", "b", "thumb"), ("1", "c", "other"), ("1", "gone", "photo"), ("2", "d", "photo")], "media_pk string, path string, kind string")
    disk = spark.createDataFrame([(x,) for x in "abcd"], "path string")
    for urls, want in ((["u1", ""], (["a", "b"], ["1"])), ([""], ([], [])), ([], ([], []))):
        confirmed = library.cleanup_confirmed(candidates, spark.createDataFrame([(u,) for u in urls], "url string"))
        delete, archive = library.cleanup_manifest(confirmed, files, disk)
        assert (ids(delete, "path"), ids(archive, "pk")) == want
    disk_queue = spark.createDataFrame([("a", 1, "p", dt.datetime(2024, 1, 2)), ("a", 0, "p", dt.datetime(2024, 1, 2)), ("b", 0, "p", dt.datetime(2024, 1, 3)), ("c", 0, "p", None), ("s", 0, "p", dt.datetime(2025, 1, 1))], "media_pk string, idx int, path string, shown_at timestamp")
    matched = spark.createDataFrame([("i3", "d", 0), ("i1", "e", 0), ("i2", None, None), ("i0", "s", 0)], "id string, media_pk string, idx int")
    left_out = spark.createDataFrame([("s",)], "media_pk string")
    order = [(0, "b", 0), (0, "a", 0), (0, "a", 1), (0, "c", 0), (1, "e", 0), (1, "d", 0)]
    for budget in (0, 2, 5, 99):
        assert [tuple(r)[:3] for r in library.backlog(disk_queue, matched, left_out, budget).collect()] == order[:budget]


def test_duplicates_of_one_url(spark):
    """Thousands of copies of one item, their chunks, and the scope of folders."""
    rows = [(f"i{k:04}", "n", "u/" if k % 2 else "u", ["f"] if k % 3 else ["g", "h"], k % 7) for k in range(3000)] + [("x", None, "v", ["f"], 1), ("y", "", "v", ["f"], 0), ("z", "n", "", ["f"], 0)]
    items = spark.createDataFrame(rows, "id string, name string, url string, folders array<string>, modification_time long")
    got = library.duplicates(items).collect()
    assert len(got) == 3000 and {r.id for r in got} == {r[0] for r in rows} - {"i0000", "y", "z"} and max(r.chunk for r in got) == 59
    assert len(library.duplicates(items, spark.createDataFrame([("g",)], "id string")).collect()) == 999
    assert library.duplicates(items, spark.createDataFrame([], "id string")).collect() == []


def test_counters_are_taken_while_a_run_is_written(spark, tmp_path):
    rows = [("1", "downloaded", 2, 10, True, False), ("2", "downloaded", None, None, None, True), ("3", "filtered", 5, 7, False, None), ("4", "failed", 1, 1, None, None), ("5", "skipped", 1, 1, None, None)]
    manifest = spark.createDataFrame(rows, "pk string, outcome string, files int, bytes long, added boolean, held boolean")
    assert stats.run_counters(manifest, str(tmp_path / "run")).first().asDict() == {"scanned": 5, "downloaded": 2, "files": 2, "bytes": 10, "skipped": 1, "failed": 1, "added": 1, "filtered": 1, "to_review": 1}
    assert spark.read.parquet(str(tmp_path / "run")).count() == 5
    assert set(stats.run_counters(manifest.limit(0), str(tmp_path / "none")).first()) == {0}


def test_holds_and_proposals(spark):
    found = spark.createDataFrame([("1", "9", 2, 3), ("2", "8", 5, 2), ("3", "7", 1, 1)], "pk string, known_pk string, distance long, hits long")
    media = spark.createDataFrame([("9", "ann", "u9"), ("8", "", None)], "pk string, username string, url string")
    held = spark.createDataFrame([("3",), ("3",)], "pk string")
    for action, told in (("review", "review"), ("skip", "skip"), ("import", "import"), ("tell", "import")):
        got = {r.pk: (r.action, r.note) for r in similarity.dupe_hold(found, media, held, action).collect()}
        assert got == {"1": (told, "looks like @ann (distance 2) u9"), "2": (told, "looks like 8 (distance 5)")}
    assert similarity.dupe_hold(found, media, held, "off").collect() == []
    review = spark.createDataFrame([("1", "skip", "model", None), ("2", "download", "model", None), ("3", "skip", "rules", None), ("4", "skip", "model", "kept"), ("5", None, "model", None)], "media_pk string, verdict string, source string, decided string")
    files = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "c"), ("4", "d")], "media_pk string, path string")
    decisions, agreement, skips, gone = merge.accept_proposals(review, files)
    assert {r.media_pk: r.decided for r in decisions.collect()} == {"1": "dropped", "2": "kept", "5": "kept"}
    assert sorted((r.media_pk, r.proposed, r.decided) for r in agreement.collect()) == [("1", "skip", "dropped"), ("2", "download", "kept"), ("5", None, "kept")]
    assert ids(skips, "media_pk") == ["1"] and ids(gone, "path") == ["a", "b"]


def test_collections_by_their_switches(spark):
    table = spark.createDataFrame([("all_saved",), ("liked",), ("1",), ("2",)], "pk string")
    for options, want in (({}, ["1", "2"]), ({"liked": True}, ["1", "2", "liked"]), ({"all_saved": True, "everything": False}, ["all_saved"]), ({"everything": False, "enabled": [2]}, ["2"]), ({"named": ["liked", 1], "everything": False}, ["1", "liked"])):
        assert ids(posts.pick_collections(table, **options), "pk") == want


def bits(rng, n=24):
    return sum(1 << b for b in rng.sample(range(64), n))


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_dealt_hashes_are_not_broadcast(spark):
    """Keys are dealt out by a stated number of tasks, and no side of them goes through the driver, though the hashes before them are few bytes."""
    rows = spark.range(400).select(F.col("id").cast("string").alias("pk"), F.xxhash64("id").alias("hash"))
    index = similarity.index_of(rows, 8, 10)
    near = similarity.near_hashes(rows.select(F.col("hash").alias("h")), index)
    assert near.count() >= 200
    near.collect()
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan
    assert re.search(r"SortMergeJoin \[keep#\w+, key#\w+, _a_no", plan) and not re.search(r"Broadcast\w+Join \[keep#\w+, key#\w+, _a_no", plan)
    assert plan.count("REPARTITION_BY_NUM") >= 4


@pytest.mark.parametrize("bands, few, most", [(9, 0, 4096), (10, 0, 3), (11, 0, 50), (12, 0, 7), (None, 0, 4096), (None, 10**6, 4096)])
def test_near_hashes_are_those_of_all_pairs(spark, bands, few, most):
    """Clusters around a few hashes, so that some keys have hundreds, split or not, with any number of bands."""
    rng = random.Random(8)
    centres = [bits(rng) for _ in range(4)]
    flipped = lambda x, n: x ^ sum(1 << b for b in rng.sample(range(64), n))
    known = {flipped(rng.choice(centres), rng.randrange(7)) for _ in range(400)} | {bits(rng) for _ in range(100)} | {centres[0]}
    asked = {flipped(rng.choice(centres), rng.randrange(9)) for _ in range(150)} | {flipped(rng.choice(sorted(known)), 8) for _ in range(50)}
    rows = [(f"k{n}", signed(h)) for n, h in enumerate(sorted(known))] + [(f"c{n}", signed(centres[0])) for n in range(500)]  # one hash in half the posts
    index = similarity.index_of(spark.createDataFrame(rows, "pk string, hash long"), 8, bands)
    got = [tuple(r) for r in similarity.near_hashes(spark.createDataFrame([(signed(h),) for h in asked], "h long"), index, few, most).collect()]
    fit = [h for h in known if 12 <= h.bit_count() <= 52]
    want = {(signed(h), signed(g), (h ^ g).bit_count()) for h in asked for g in fit if (h ^ g).bit_count() <= 8}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 5_000


def test_bands_go_with_the_number_of_hashes():
    assert [similarity.best_bands(n, asked, 8) for n, asked in ((10, 10), (100_000, 1_000), (1_000_000, 10_000), (300_000, 300_000), (10**7, 10**7), (10**9, 10**9))] == [9, 9, 9, 10, 11, 12]


def test_streamed_feed_has_each_post_once(spark, tmp_path):
    """Posts that come again in a later batch add nothing, and a second run over the same checkpoint adds only what is new."""
    from medialib.streaming import jobs

    def batch(rows):
        spark.createDataFrame(rows, "collection_pk string, pos long, pk string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        jobs.stream_feed(jobs.read(spark, str(tmp_path / "in"), "collection_pk string, pos long, pk string", 1), str(tmp_path / "out"), str(tmp_path / "check"), lambda new: new.withColumn("judged", F.lit(True)))
        return sorted((r.pk, r.collection_pk, r.pos, r.judged) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    batch([("a", 2, "1"), ("b", 1, "1"), ("a", 1, ""), ("a", 3, "2")])
    batch([("a", 1, "2"), ("a", 9, "3")])
    assert run() == [("1", "b", 1, True), ("2", "a", 3, True), ("3", "a", 9, True)]
    batch([("a", 1, "3"), ("c", 1, "4")])
    assert run() == [("1", "b", 1, True), ("2", "a", 3, True), ("3", "a", 9, True), ("4", "c", 1, True)]


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_every_query_runs(spark, name):
    """Each registered query builds and counts at the smallest scale, with its SQL's columns."""
    found = registry.QUERIES[name](spark, SMALL)
    found.write.format("noop").mode("overwrite").save()
    if name in registry.ORACLE_SQL:
        assert {c.lower() for c in found.columns} == {c[0].lower() for c in duck().execute(f"SELECT * FROM ({registry.ORACLE_SQL[name]}) LIMIT 0").description}


def duck():
    connection = duckdb.connect()
    for path in Path(SMALL).iterdir():
        connection.execute(f"CREATE VIEW {path.name.removesuffix('.parquet')} AS SELECT * FROM '{path}{'/*' * path.is_dir()}'")
    return connection


@pytest.mark.parametrize("width, height", [(18, 16), (20, 11), (9, 8)])
def test_hash_of_whole_frames_is_that_of_their_points(spark, width, height):
    own = random.Random(width)
    shots = {n: bytes(own.choice([own.randrange(256), 7]) for _ in range(width * height)) for n in range(300)}
    points = [(n, 0, k % width, k // width, b) for n in range(9) for k, b in enumerate(shots[n])]
    by_point = {r.media_pk: r.hash for r in frames.difference_hash(spark.createDataFrame(points, "media_pk long, frame_no int, x int, y int, luma int"), width, height).collect()}
    rows = spark.createDataFrame([*shots.items(), (900, None)], "media_pk long, pixels binary").coalesce(1)
    made = {r.media_pk: r.hash for r in rows.select("media_pk", frames.frame_hash(F.col("pixels"), width, height).alias("hash")).collect()}
    assert made[900] is None and {n: made[n] for n in by_point} == by_point and len(made) == 301


def test_frame_hash_queries_shuffle_posts_alone(spark):
    for name in ("dhash", "fingerprint_job"):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Window" not in plan and "HashAggregate" not in plan


def test_free_names_of_asked_names_by_windows_and_by_ranges(spark):
    own = random.Random(9)
    wanted = [(f"/old/{k:03}", "/x/", own.choice(["a", "a", "a", "b", "c", "c_2"]), ".jpg") for k in range(120)]
    disk = spark.createDataFrame([(f"/x/{n}.jpg",) for n in ("a", "a_2", "a_7", "b_3", "zz_9", "plain")], "path string")
    rows = spark.createDataFrame(wanted, "path string, folder string, stem string, ext string")
    made = [{r.path: r.final for r in library.free_names(rows, disk, ["path"], most).collect()} for most in (1, 40, 1000)]
    assert made[0] == made[1] == made[2] and len(set(made[0].values())) == 120



def test_free_names_pass_names_that_the_disk_lists_twice(spark):
    rows = spark.createDataFrame([(f"/old/{k}", "/x/", "a", ".jpg") for k in range(4)], "path string, folder string, stem string, ext string")
    disk = spark.createDataFrame([(f"/x/{n}.jpg",) for n in ("a", "a", "a_3", "a_3", "b_2", "b_2")], "path string")
    for most in (1, 1000):
        assert sorted(r.final for r in library.free_names(rows, disk, ["path"], most).collect()) == [f"/x/a_{n}.jpg" for n in (2, 4, 5, 6)]


def test_free_names_of_a_name_that_a_sample_finds_heavy(spark, monkeypatch):
    """which names are numbered by ranges is told by a sample; the numbers are the same."""
    rows = spark.range(5000).select(F.format_string("/old/%05d", "id").alias("path"), F.lit("/x/").alias("folder"), F.when(F.col("id") % 50 == 0, "b").otherwise("a").alias("stem"), F.lit(".jpg").alias("ext"))
    disk = spark.createDataFrame([(f"/x/{n}.jpg",) for n in ("a", "a_7", "a_7", "a_900", "b_3")], "path string")
    whole = {r.path: r.final for r in library.free_names(rows, disk, ["path"]).collect()}
    calls, numbered = [], library.numbered
    monkeypatch.setattr(library, "numbered", lambda *args: calls.append(1) or numbered(*args))
    assert {r.path: r.final for r in library.free_names(rows, disk, ["path"], 2000).collect()} == whole
    assert len(calls) == 3 and len(set(whole.values())) == 5000


def test_names_are_parted_at_their_last_dot(spark):
    """as the patterns did, but for a line's end within a name, which they lost."""
    paths = ["/l/a.b.jpg", "a", "/l/.hidden", "/l/.a.b", "/l/a.", "/l/..", "/l/", "/l.d/é_2", "/l/a_2\n"]
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    made = {r.path: (r.folder, r.stem, r.ext) for r in library._parted(rows, "path").collect()}
    assert list(made.values()) == [("/l/", "a.b", ".jpg"), ("", "a", ""), ("/l/", ".hidden", ""), ("/l/", ".a", ".b"), ("/l/", "a", "."), ("/l/", ".", "."), ("/l/", "", ""), ("/l.d/", "é_2", ""), ("/l/", "a_2\n", "")]
    asked = spark.createDataFrame([("/old", "/l/", "a", "")], "path string, folder string, stem string, ext string")
    assert library.free_names(asked, spark.createDataFrame([("/l/a",), ("/l/a_2\n",)], "path string"), ["path"]).first().final == "/l/a_2"


def test_rename_plan_of_companions_that_posts_share_is_that_of_each_path(spark):
    own = random.Random(11)
    files = [(f"/l/{own.choice('xyz')}/{k % 9}{own.choice(['.mp4', '.jpg'])}", str(own.randrange(8)), own.randrange(3)) for k in range(40)]
    names = {str(k): own.choice(["new", "new b", f"own_{k}"]) for k in range(7)}
    disk = {p for p, *_ in files if own.random() < 0.8} | {f"/t/{k}.jpg" for k in range(7)} | {"/t/new.jpg", "/l/x/new_02.mp4", "/l/y/own_3.jpg"}
    stem = lambda path: path.rsplit("/", 1)[1].rsplit(".", 1)[0]
    wanted = []
    for m in names:
        kept = sorted((idx, path) for path, post, idx in files if post == m and path in disk)
        for n, (_, path) in enumerate(kept, 1):
            wanted.append(("file", path, path.rsplit("/", 1)[0] + "/" + names[m] + (f"_{n:02}" if len(kept) > 1 else "") + path[-4:]))
    beside = {}
    for path, post, _ in files:
        if post in names and (thumb := f"/t/{stem(path)}.jpg") in disk:
            beside[thumb] = min(beside.get(thumb, "~"), f"/t/{names[post]}.jpg")
    wanted += [("thumb", p, to) for p, to in beside.items()]
    moves, used, expected = sorted(x for x in wanted if x[1] != x[2]), set(disk), []
    asked = {to for _, _, to in moves}
    for kind, path, to in sorted(moves, key=lambda x: (x[2], x[1])):
        n, name = 1, to
        while name in used or n > 1 and name in asked:
            n += 1
            name = f"{to[:-4]}_{n}{to[-4:]}"
        used.add(name)
        expected.append((kind, path, name, True))
    expected += [(kind, path, to, False) for kind, path, to in wanted if path == to]
    table = spark.createDataFrame(files, "path string, media_pk string, idx int")
    plan = library.rename_plan(table, spark.createDataFrame(list(names.items()), "media_pk string, base string"), spark.createDataFrame([(d,) for d in disk], "path string"), {"thumb": ("/t", ".jpg")})
    by_place = lambda rows: sorted((kind, path, target.rsplit("/", 1)[0], renamed) for kind, path, target, renamed in rows)
    made = [tuple(r) for r in plan.collect()]
    assert by_place(made) == by_place(expected) and sorted(r[2] for r in made) == sorted(r[2] for r in expected)


def test_rename_manifest_leaves_no_shuffles_and_two_tables_behind(spark):
    """what a written step was made from goes with it, and the rest is one shuffle of the names."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    kept = lambda: {f: Path(f).stat().st_size for f in files.getAllFiles().mkString("|").split("|") if "shuffle_" in f and Path(f).exists()}
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    rows = lambda: {str(p.parent): p.parent for p in shared.rglob("*.parquet") if p.stat().st_size > 5000}
    before, tables = kept(), rows()
    made = registry.QUERIES["rename_manifest"](spark, "/root/testdata/sf0.001")
    assert sum(n for f, n in kept().items() if f not in before) < 20_000  # counts of rows; the steps' own have over a megabyte
    assert sorted(spark.read.parquet(p).columns for p in rows().keys() - tables.keys()) == [["kind", "path", "_shared", "folder", "stem", "ext"], ["path"]]
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_rename_manifest_in_rounds_has_the_same_rows(spark, monkeypatch):
    """large tables go through a step's shuffle in three rounds."""
    whole = {tuple(r) for r in registry.QUERIES["rename_manifest"](spark, "/root/testdata/sf0.001").collect()}
    sizes, rounds = [], library._rounds
    monkeypatch.setattr(library, "_rounds", lambda rows, *by: sizes.append(rows) or rounds(30_000_000, *by))
    made = registry.QUERIES["rename_manifest"](spark, "/root/testdata/sf0.001").collect()
    assert len(sizes) == 3 and len(made) == len(whole) and {tuple(r) for r in made} == whole
    assert [len(rounds(n, "path")) for n in (1, 9_999_999, 10_000_000, 10**10)] == [1, 1, 2, 3]


def test_push_marks_number_no_files(spark, monkeypatch):
    def refuse(*args):
        raise AssertionError("marks need no numbers")

    monkeypatch.setattr(library, "numbered", refuse)
    assert registry.QUERIES["push_marks"](spark, "/root/testdata/sf0.001").columns == ["media_pk", "collection_pk", "folder_id"]


def test_names_work_out_their_caption_twice_at_most(spark):
    rows = spark.range(1).select(F.lit("2024-01-01").cast("timestamp").alias("t"), F.col("id").cast("string").alias("u"))
    made = T.render_template("{date}_{user}_{title}_{code}", F.col("t"), F.col("u"), F.col("u"), F.lit("video"), F.col("u"), F.lit(""), F.rand(1).cast("string"))
    plan = rows.select(made.alias("name"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("rand(1)") <= 2  # its lines, and the whole where no line has words



def test_tags_are_folded_by_one_small_function(spark):
    rows = spark.createDataFrame([(["Close Up", None, "#calm"], None), (["calm", "calm", "zz", "zz"], "image")], "tags array<string>, mode string")
    made = rows.select(F.inline(F.array(tags.normalized(F.col("tags"), F.col("mode"), vocabulary.starter()))))
    assert [(r.kept, r.dropped) for r in made.collect()] == [([W.MARKER], ["close-up", "calm"]), (["calm", W.MARKER], ["zz", "zz"])]
    assert "ArrowEvalPython" in made._jdf.queryExecution().executedPlan().toString()


def test_frames_that_fit_are_told_by_a_division(spark):
    """no list of all numbers of frames is made, which for this many would be an error; the rest as the ladder gave it."""
    rows = [(2_147_483_647, 896, 8000), (20, 896, 3500), (20, 896, 1000), (5, 500, 5500), (3, 896, 3700), (24, 896, 8400), (24, 700, 12000), (4, 896, None), (None, 896, 9000)]
    got = [(r.fit_count, r.fit_side) for r in frames.fit_plan(spark.createDataFrame(rows, "count int, side int, context int")).collect()]

    def ladder(count, side, context):
        cost = lambda s: round((max(32, s) / 32) * (max(32, s) * 9 / 16 / 32))
        sides = [side]
        while sides[-1] > 512:
            sides.append(max(512, sides[-1] - 128))
        steps = [(count, s) for s in sides] + [(c, sides[-1]) for c in range(count - 1, 2, -1)]
        return next((x for x in steps if x[0] * cost(x[1]) + 3500 <= context), steps[-1])

    assert got == [(31, 512), *(ladder(*x) for x in rows[1:-2]), (3, 512), (None, 512)]


def test_blanks_at_the_ends_are_those_of_the_pattern(spark):
    """F8: texts are stripped without a pattern; every letter below 0x11000 counts as a blank where the pattern has it as one."""
    rows = spark.createDataFrame([(c, chr(c)) for c in range(1, 0x11000) if not 0xD800 <= c < 0xE000], "c int, x string").select("c", F.concat("x", "x", F.lit("a"), "x", F.lit("b"), "x", F.lit("\n")).alias("x"))
    assert rows.where(T.stripped(F.col("x")) != F.regexp_replace("x", r"(?U)^\s+|\s+$", "")).count() == 0
    assert one(spark, T.stripped(F.col("a")), a=" 　\n") == "" and one(spark, T.stripped(F.col("a")), a=None) is None
    assert "regexp" not in str(T.stripped(F.col("x"))._jc)


def test_places_are_filled_as_one_after_the_other(spark):
    """F8: the lists go in last where that gives the same text; examples are rendered once for all posts."""
    long = "x" * 40
    cases = [
        ("{kind} {taxonomy} {mode}", "reel", long), ("{kind} {taxonomy}", "{taxonomy}", long), ("{mo{taxonomy}de}", "reel", ""), ("{taxonomy}", "reel", long + "{kind}"), ("{{taxonomy}}", "reel", "mode"),
        ("{taxonomy{kind}}", "", long), ("{taxonomy}{taxonomy}", "reel", long + "}"), ("none", "reel", long),
    ]
    rows = spark.createDataFrame(cases, "template string, kind string, lists string")
    got = rows.select("*", prompts.prompt(F.col("template"), F.lit(2), F.col("kind"), F.lit("image"), F.col("lists"), F.array(F.lit("e"))).alias("x"), prompts.render_examples(F.array(F.lit("e"))).alias("e")).collect()
    assert len(got) == len(cases)
    for r in got:
        assert r.x == r.template.replace("{taxonomy}", r.lists).replace("{examples}", r.e).replace("{frames}", "2").replace("{kind}", r.kind or "post").replace("{mode}", "IMAGE")
    posts_ = spark.createDataFrame([("1", "bob", "c", "reel", "image", 2, None, "{examples}|{taxonomy}", "", "s", "d", "")], "pk string, username string, caption string, kind string, mode string, frames int, profiles array<string>, template string, transcript string, summary string, description string, screen_text string")
    made = prompts.request_batch(posts_, spark.createDataFrame([("1", "h", False)], "media_pk string, hint string, tutorial boolean"), [" e  e "], vocabulary.starter())
    assert "slice(" not in made._jdf.queryExecution().toString()
    row = made.first()
    assert row.told == "Account: @bob\nCaption: c\nh" and row.request.startswith(f'\n{prompts.EXAMPLES_HEADER}\n- "e e"\n|') and row.request.endswith("\n\n" + row.told)


def test_forgotten_posts_are_met_by_hash(spark):
    """keys that are gone may repeat, and neither the table nor they are sorted."""
    base = spark.createDataFrame([("1", 1), ("1", 2), ("2", 3), (None, 4)], "media_pk string, n int")
    left = merge.forget({"files": base, "media": base.withColumnRenamed("media_pk", "pk")}, spark.createDataFrame([("1",), ("1",), ("3",)], "media_pk string"))
    for rows in left.values():
        assert sorted(r.n for r in rows.collect()) == [3, 4]
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and "Sort" not in plan


def test_a_run_goes_no_further_than_its_feeds_stop(spark):
    """what is behind the stops isn't judged; with short parts, several of which are taken, the walk is the same."""
    asked, rng = spark.sparkContext.accumulator(0), random.Random(5)

    def counted(x):
        asked.add(1)
        return x

    rows = [(c, p, str(rng.randrange(400)) if rng.random() > 0.05 else "", rng.choice(["downloaded", "failed", "skipped"])) for c in ("liked", "saved", "shelf") for p in range(1, 301)]
    table = spark.createDataFrame(rows, "collection_pk string, pos long, pk string, outcome string")
    known = spark.createDataFrame([(str(k),) for k in range(0, 400, 3)], "pk string")
    none = spark.createDataFrame([], "collection_pk string, cursor string")
    order = spark.createDataFrame([("liked", 0), ("saved", 1), ("shelf", 2)], "collection_pk string, place int")
    for limit, most in ((0, 30), (40, 0)):
        walks = [{tuple(r) for r in feed.feed_walk(table, known, none, scan_limit=limit, stop_after_known=0, max_items=most, part=part, order=order).collect()} for part in (2, 1 << 16)]
        assert walks[0] == walks[1] and walks[0]
    long = table.unionByName(spark.range(1000, 3000).select(F.explode(F.array(*map(F.lit, ("liked", "saved", "shelf")))).alias("collection_pk"), F.col("id").alias("pos"), F.lit("x").alias("pk"), F.lit("failed").alias("outcome")))
    long = long.withColumn("outcome", F.udf(counted)("outcome"))
    feed.feed_walk(long, known, none, scan_limit=40, stop_after_known=0, part=64, order=order).collect()
    assert asked.value < 900
