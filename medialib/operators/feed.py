"""Order-dependent operators: how far a feed is walked, and what a post's events come to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged


def _stops(rows: DataFrame, liked_limit: int, scan_limit: int, stop_after_known: int, cursor_limit: int, max_items: int) -> DataFrame:
    """collection_pk, before, after, got: where each feed stops (before a place, after a place, or not), and the downloads up to there.

    rows: collection_pk, pos, pk, known, outcome, cursor, earlier (downloads of
    the feeds before) and _part. What is met within a part is told by windows,
    what the parts before come to by a row for each of them.
    """
    liked, fresh = F.col("collection_pk") == "liked", F.col("known") == F.lit(False)
    within = Window.partitionBy("collection_pk", "_part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("seen", F.count(F.lit(1)).over(within)).withColumn("met", F.count(F.when(F.col("known"), 1)).over(within))
    rows = rows.withColumn("fresh", F.max(F.when(fresh, F.col("met"))).over(within)).withColumn("got", F.count(F.when(fresh & (F.col("outcome") == "downloaded"), 1)).over(within))
    before = Window.partitionBy("collection_pk").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("collection_pk", "_part").agg(*[F.max(c).alias(c) for c in ("seen", "met", "fresh", "got")])
    parts = parts.select("collection_pk", "_part", "fresh", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("seen", "met", "got")])
    parts = parts.withColumn("fresh_before", F.coalesce(F.max(F.col("met_before") + F.col("fresh")).over(before), F.lit(0))).drop("fresh")
    rows = rows.join(parts, ["collection_pk", "_part"])
    limit = F.when(liked & F.col("cursor").isNotNull(), F.greatest(F.lit(liked_limit), F.lit(cursor_limit))).when(liked, F.lit(liked_limit)).otherwise(F.lit(scan_limit))
    stop = ((limit > 0) & (F.col("seen_before") + F.col("seen") > limit)) | (liked & (F.col("pk") == F.col("cursor")))
    # a streak ends at a new post; blank rows are in no streak and end none
    streak = F.col("met_before") + F.col("met") - F.coalesce(F.col("met_before") + F.col("fresh"), F.col("fresh_before"))
    late = F.col("known") & (streak >= stop_after_known) if stop_after_known > 0 else F.lit(False)
    got = F.col("got_before") + F.col("got")
    full = fresh & (F.col("outcome") != "skipped") & (F.col("earlier") + got >= max_items) if max_items > 0 else F.lit(False)
    ends = rows.groupBy("collection_pk").agg(F.min(F.when(stop, F.col("pos"))).alias("before"), F.min(F.when(late | full, F.col("pos"))).alias("after"))
    rows = rows.select("collection_pk", "pos", got.alias("got")).join(ends, "collection_pk")
    return rows.groupBy("collection_pk", "before", "after").agg(F.coalesce(F.max(F.when(_scanned(), F.col("got"))), F.lit(0)).alias("got"))


def _scanned() -> Column:
    return (F.col("before").isNull() | (F.col("pos") < F.col("before"))) & (F.col("after").isNull() | (F.col("pos") <= F.col("after")))


def feed_walk(
    feed: DataFrame, known: DataFrame, cursor: DataFrame, liked_limit: int = 50, scan_limit: int = 0, stop_after_known: int = 40, cursor_limit: int = 1000, part: int = 1 << 16,
    order: DataFrame | None = None, max_items: int = 0,
) -> DataFrame:
    """The rows of each feed that a run scans, with new (to be processed).

    feed: collection_pk, pos, pk, and if it has one outcome: what processing a
    new post comes to (downloaded, skipped by a rule, failed); known: pk;
    cursor: collection_pk, cursor. A feed stops before the scan limit's end and
    before the cursor's post, and after a streak of known posts; a post met
    earlier in the feed, and not failed there, is known. A feed is gone through
    in parts of as many places.

    order (collection_pk, place) makes it one run over the feeds in that order:
    posts processed in a feed before are known too, and a feed stops after the
    processed post with which the run has max_items downloads (0: no limit), or
    after its first one if the feeds before have them already. Where a feed
    stops changes what later ones know and how much is left for them, so all
    feeds are walked at once with what the last pass says of the others, until
    no stop moves; the first feeds of the order settle first, so there are at
    most as many passes as feeds, and one. A run's feeds are first walked over
    their first part alone; what is behind a feed's stop changes nothing, so
    sixteen times as much is taken only while a feed has neither stopped nor ended.
    """
    rows = feed if "outcome" in feed.columns else feed.withColumn("outcome", F.lit("downloaded"))
    rows = rows.select("collection_pk", "pos", "pk", "outcome")
    limits = (liked_limit, scan_limit, stop_after_known, cursor_limit, max_items)
    if order is None:
        walked = _judged(rows, known, cursor, part).withColumn("known", F.col("base"))
        ends = _stops(walked.withColumn("earlier", F.lit(0)), *limits)
    else:
        reach = part
        while True:
            near = _judged(rows.where(F.col("pos").isNull() | (F.col("pos") <= reach)), known, cursor, part)
            walked, ends = _run(staged(near.join(order.select("collection_pk", "place"), "collection_pk")), order, limits)
            going = order.select("collection_pk").join(ends.where("before is not null or after is not null"), "collection_pk", "left_anti")
            if going.isEmpty() or rows.where(F.col("pos") > reach).join(F.broadcast(going), "collection_pk", "left_semi").isEmpty():
                break
            reach *= 16
    kept = walked.join(ends, "collection_pk").where(_scanned())
    return kept.select("collection_pk", "pos", "pk", F.coalesce(~F.col("known"), F.lit(False)).alias("new"))


def _judged(rows: DataFrame, known: DataFrame, cursor: DataFrame, part: int) -> DataFrame:
    """rows with cursor, base (known before the run, or met earlier in the feed; null if blank), own (where the feed first has the post, not failed) and _part."""
    blank = F.col("pk") == ""
    rows = rows.join(known.select("pk", F.lit(True).alias("base")).distinct(), "pk", "left").join(cursor, "collection_pk", "left")
    done = F.when(F.col("outcome") != "failed", F.col("pos"))
    rows = rows.withColumn("own", F.min(done).over(Window.partitionBy("collection_pk", "pk", F.when(blank, F.col("pos"))))).withColumn("_part", F.floor(F.col("pos") / part))
    return rows.withColumn("base", F.when(~blank, F.coalesce("base", F.lit(False)) | F.coalesce(F.col("own") < F.col("pos"), F.lit(False))))


def _run(rows: DataFrame, order: DataFrame, limits: tuple[int, ...]) -> tuple[DataFrame, DataFrame]:
    """rows with known as the run over the feeds has it, and where they stop."""
    walked, ends = rows.withColumn("known", F.col("base")), None
    while True:
        last = ends
        if last is not None:
            processed = rows.join(last, "collection_pk").where(_scanned()).where((F.col("base") == F.lit(False)) & (F.col("own") == F.col("pos")))
            first = processed.groupBy("pk").agg(F.min("place").alias("_first"))
            walked = rows.join(first, "pk", "left").withColumn("known", F.col("base") | F.when(F.col("pk") != "", F.coalesce(F.col("_first") < F.col("place"), F.lit(False))))
        earlier = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)  # a row for a feed
        got = order.select("collection_pk", "place").join(last.select("collection_pk", "got"), "collection_pk", "left") if last is not None else order.select("collection_pk", "place", F.lit(0).alias("got"))
        got = got.select("collection_pk", F.coalesce(F.sum("got").over(earlier), F.lit(0)).alias("earlier"))
        ends = staged(_stops(walked.join(got, "collection_pk"), *limits))
        if last is not None and ends.exceptAll(last).isEmpty():
            return walked, ends


def run_gaps(runs: DataFrame, hour: int = 3600, part: int = 1 << 16) -> DataFrame:
    """id, wait: seconds that a run would have had to wait for an hour's distance from the last finish before it; runs: id (numbered), started_at, finished_at.

    Runs are gone through in parts of as many ids; the last finish before a part is told from the parts' own.
    """
    rows = runs.withColumn("_part", F.floor(F.col("id") / part))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for a part
    parts = rows.groupBy("_part").agg(F.max("finished_at").alias("_last")).select("_part", F.max("_last").over(earlier).alias("_earlier"))
    within = Window.partitionBy("_part").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(parts, "_part").withColumn("_before", F.greatest(F.max("finished_at").over(within), F.col("_earlier")))
    left = F.lit(hour).cast("long") - (F.unix_timestamp("started_at") - F.unix_timestamp("_before"))
    return rows.select(F.col("id").cast("long").alias("id"), F.when(F.col("_before").isNull(), F.lit(0).cast("long")).otherwise(F.greatest(F.lit(0).cast("long"), left)).alias("wait"))


def liked_cursor(scanned: DataFrame) -> DataFrame:
    """The next cursor of each feed: its first post that has a pk."""
    return scanned.where("pk <> ''").groupBy("collection_pk").agg(F.min_by("pk", "pos").alias("cursor"))


def failure_lifecycle(log: DataFrame, most: int = 3) -> DataFrame:
    """pk, attempts since the last success or retry, gave_up, last_error (300 characters); log: seq, pk, event, error.

    A post that has once been done (or archived) isn't given up.
    """
    last = log.where("event in ('success', 'retry')").groupBy("pk").agg(F.max("seq").alias("reset"))
    fails = log.where("event = 'fail'").join(last, "pk", "left").where("reset is null or seq > reset")
    counted = fails.groupBy("pk").agg(F.count(F.lit(1)).alias("attempts"), F.max_by(F.substring("error", 1, 300), "seq").alias("last_error"))
    posts = log.groupBy("pk").agg(F.bool_or(F.col("event").isin("success", "archive")).alias("_done")).join(counted, "pk", "left")
    gave_up = (F.coalesce("attempts", F.lit(0)) >= most) & ~F.coalesce("_done", F.lit(False))
    return posts.select("pk", F.coalesce("attempts", F.lit(0)).alias("attempts"), gave_up.alias("gave_up"), F.coalesce("last_error", F.lit("")).alias("last_error"))


def next_status(status: Column, event: Column, attempts: Column, most: int) -> Column:
    return (
        F.when(event == "success", "done").when((event == "archive") & (status == "done"), "archived").when(event == "skip", "skipped")
        .when((event == "retry") & (status == "gave_up"), "pending")
        .when((event == "fail") & ~status.isin("done", "archived"), F.when(attempts >= most, "gave_up").otherwise("failed")).otherwise(status)
    )


def status_lifecycle(log: DataFrame, most: int = 3) -> DataFrame:
    """pk, status after all of a post's events in order, from pending."""
    events = log.groupBy("pk").agg(F.array_sort(F.collect_list(F.struct("seq", "event"))).alias("events"))
    start = F.struct(F.lit("pending").alias("status"), F.lit(0).alias("attempts"))

    def step(state: Column, e: Column) -> Column:
        attempts = F.when(e["event"].isin("success", "retry"), F.lit(0)).when(e["event"] == "fail", state["attempts"] + 1).otherwise(state["attempts"])
        return F.struct(next_status(state["status"], e["event"], attempts, most).alias("status"), attempts.alias("attempts"))

    return events.select("pk", F.aggregate("events", start, step, lambda s: s["status"]).alias("status"))


def scene_cuts(frames: DataFrame) -> DataFrame:
    """frames (media_pk, frame_no, hist, luma) with diff to the one before, and cut: over median + 4 MAD, and over 0.3."""
    by = Window.partitionBy("media_pk").orderBy("frame_no")
    before = F.lag("hist").over(by)
    diff = F.aggregate(F.zip_with("hist", before, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x)
    rows = frames.withColumn("diff", F.when(before.isNotNull(), diff))
    mid = rows.groupBy("media_pk").agg(F.median("diff").alias("mid"))
    mad = rows.join(mid, "media_pk").groupBy("media_pk", "mid").agg(F.median(F.abs(F.col("diff") - F.col("mid"))).alias("mad"))
    level = F.col("mid") + 4 * F.when(F.col("mad") == 0, 1e-6).otherwise(F.col("mad"))
    return rows.join(mad, "media_pk").withColumn("cut", F.coalesce((F.col("diff") > level) & (F.col("diff") > 0.3), F.lit(False))).drop("mid", "mad")


def scene_frames(cuts: DataFrame, count: int = 6, dark: float = 14.0) -> DataFrame:
    """media_pk, frame_no: one frame from the middle of each of the longest scenes; dark frames are in none.

    Too few scenes are topped up from the quarter, then three-quarter points of
    scenes of three frames or more, the longest first.
    """
    scene = F.sum(F.col("cut").cast("int")).over(Window.partitionBy("media_pk").orderBy("frame_no"))
    lit = cuts.withColumn("scene", scene).where(F.col("luma") >= dark)
    scenes = lit.groupBy("media_pk", "scene").agg(F.array_sort(F.collect_list("frame_no")).alias("f")).withColumn("n", F.size("f"))

    def at(share: str) -> Column:
        return F.element_at("f", F.expr(f"cast(floor(n * {share}) as int)") + 1)

    offers = F.array(
        F.struct(F.lit(0).alias("step"), at("0.5").alias("frame_no")),
        F.when(F.col("n") >= 3, F.struct(F.lit(1).alias("step"), at("0.25").alias("frame_no"))),
        F.when(F.col("n") >= 3, F.struct(F.lit(2).alias("step"), at("0.75").alias("frame_no"))),
    )
    rows = scenes.select("media_pk", "scene", "n", F.explode(F.filter(offers, lambda o: o.isNotNull())).alias("o"))
    rank = F.struct((F.col("o.step") > 0).alias("late"), -F.col("n"), "scene", "o.step")
    first = rows.groupBy("media_pk", F.col("o.frame_no").alias("frame_no")).agg(F.min(rank).alias("rank"))
    return first.withColumn("no", F.row_number().over(Window.partitionBy("media_pk").orderBy("rank"))).where(F.col("no") <= count).select("media_pk", "frame_no")
