"""Joins of posts, files and the asset library."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import asset_name
from ..functions.wordlists import TUTORIAL_MARKS
from ..sources.staging import scratch, staged
from .posts import described, url_key
from .ranks import numbered


def existing(files: DataFrame, disk: DataFrame) -> DataFrame:
    return files.where("kind in ('video', 'photo')").join(disk.select("path"), "path", "left_semi")


def library_posts(media: DataFrame, files: DataFrame, disk: DataFrame, membership: DataFrame, ai_meta: DataFrame) -> DataFrame:
    """pk, n_files, paths, collections, described: posts with files on disk, each once, with what belongs to them."""
    own = existing(files, disk).groupBy("media_pk").agg(F.count(F.lit(1)).alias("n_files"), F.array_sort(F.collect_list(F.struct("idx", "path")))["path"].alias("paths"))
    told = ai_meta.where("description <> ''").groupBy("media_pk").agg(F.count(F.lit(1)).alias("described"))
    return (
        media.select(F.col("pk").alias("media_pk")).join(own, "media_pk").join(membership_lists(membership), "media_pk", "left").join(told, "media_pk", "left")
        .select("media_pk", "n_files", "paths", F.coalesce("collections", F.array().cast("array<string>")).alias("collections"), F.coalesce("described", F.lit(0)).alias("described"))
    )


def membership_lists(membership: DataFrame) -> DataFrame:
    """media_pk, collections in the order they were seen in."""
    named = membership.where("collection_pk <> ''")
    return named.groupBy("media_pk").agg(F.array_sort(F.collect_list(F.struct("seen_at", "collection_pk")))["collection_pk"].alias("collections"))


def undescribed_files(media: DataFrame, files: DataFrame, disk: DataFrame, ai_meta: DataFrame, limit: int = 0) -> DataFrame:
    """Done posts' files on disk without a description of their own slide; with a limit, as many of the newest (by shown_at), a post's slides in order."""
    told = ai_meta.where("coalesce(description, '') <> ''").select("media_pk", F.coalesce("idx", F.lit(0)).alias("idx"))
    done = media.where("status = 'done'").select(F.col("pk").alias("media_pk"), F.coalesce("downloaded_at", "first_seen").alias("shown_at"))
    rows = existing(files, disk).withColumn("idx", F.coalesce("idx", F.lit(0))).join(done, "media_pk").join(told, ["media_pk", "idx"], "left_anti").select("media_pk", "idx", "path", "shown_at")
    return rows.orderBy(F.desc_nulls_last("shown_at"), "media_pk", "idx").limit(limit) if limit else rows


def cleanup_candidates(media: DataFrame, files: DataFrame, imports: DataFrame, review: DataFrame) -> DataFrame:
    """Done, with a file, imported, and not waiting for review."""
    return (
        media.where("status = 'done'").join(files.select(F.col("media_pk").alias("pk")), "pk", "left_semi")
        .join(imports.select(F.col("media_pk").alias("pk")), "pk", "left_semi")
        .join(review.where("decided is null").select(F.col("media_pk").alias("pk")), "pk", "left_anti")
    )


def cleanup_confirmed(candidates: DataFrame, items: DataFrame) -> DataFrame:
    """pk, confirmed: whether a candidate's url is in the library; an empty library confirms nothing by itself."""
    urls = items.select(url_key(F.col("url")).alias("key")).where("key <> ''").distinct().withColumn("there", F.lit(True))
    return candidates.select("pk", url_key(F.col("url")).alias("key")).join(urls, "key", "left").select("pk", F.coalesce("there", F.lit(False)).alias("confirmed"))


def cleanup_manifest(confirmed: DataFrame, files: DataFrame, disk: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a cleanup does: files to delete (pk, path), those of confirmed posts that are on disk, thumbs too; and posts to mark as archived (pk).

    Posts that wait for the library to show them have neither; nor has any post if the listing was empty.
    """
    done = confirmed.where("confirmed").select("pk")
    own = files.where("kind in ('video', 'photo', 'thumb')").select(F.col("media_pk").alias("pk"), "path")
    return own.join(done, "pk", "left_semi").join(disk.select("path"), "path", "left_semi").select("pk", "path"), done


def library_snapshot(items: DataFrame) -> DataFrame:
    """key (url without end slashes), folders (distinct, sorted) and the lowest item id of each url in the library."""
    folders = F.filter(F.split("folders", r"\|"), lambda x: x != "")
    return (
        items.select(url_key(F.col("url")).alias("key"), folders.alias("folders"), "id").where("key <> ''").groupBy("key")
        .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("folders")))).alias("folders"), F.min("id").alias("item_id"))
    )


def items_of_posts(posts: DataFrame, imports: DataFrame, items: DataFrame) -> DataFrame:
    """media_pk and the items (id, url, …) of each of posts (media_pk, url): the one that an import names by id, else all that have the post's url."""
    stored = imports.where("item_id <> ''").groupBy("media_pk").agg(F.max("item_id").alias("id"))
    by_id = stored.join(items, "id").select("media_pk", *items.columns)
    rest = posts.select("media_pk", url_key(F.col("url")).alias("_key")).where("_key <> ''").join(by_id.select("media_pk"), "media_pk", "left_anti")
    by_url = rest.join(items.withColumn("_key", url_key(F.col("url"))), "_key").select("media_pk", *items.columns)
    return by_id.unionByName(by_url)


def repair_imports(snapshot: DataFrame, media: DataFrame, imports: DataFrame) -> DataFrame:
    """New import rows for posts whose url the library has and no import row does."""
    posts = media.select(F.col("pk").alias("media_pk"), url_key(F.col("url")).alias("key")).where("key <> ''")
    return (
        posts.join(snapshot, "key").join(imports.select("media_pk").distinct(), "media_pk", "left_anti")
        .select("media_pk", F.lit("").alias("collection_pk"), F.coalesce(F.get("folders", F.lit(0)), F.lit("")).alias("folder_id"), "item_id")
    )


def in_library(media: DataFrame, snapshot: DataFrame, imports: DataFrame) -> DataFrame:
    """pk, present: by the snapshot, else by our own imports (one item per post)."""
    own = imports.select(F.col("media_pk").alias("pk")).distinct().withColumn("own", F.lit(True))
    there = snapshot.select("key", F.lit(True).alias("there"))
    return (
        media.select("pk", url_key(F.col("url")).alias("key")).join(there, "key", "left").join(own, "pk", "left")
        .select("pk", (F.coalesce("there", F.lit(False)) | F.coalesce("own", F.lit(False))).alias("present"))
    )


def in_library_by_folder(shelves: DataFrame, snapshot: DataFrame, imports: DataFrame) -> DataFrame:
    """media_pk, collection_pk, folder_id, present for shelves (media_pk, collection_pk, folder_id, url), where a post has an item in each collection's folder.

    A shelf has its item if the library has one with the url in the shelf's
    folder (in any, if it has no folder), or if the import of that post from
    that collection is on record.
    """
    own = imports.select("media_pk", "collection_pk").distinct().withColumn("own", F.lit(True))
    rows = shelves.withColumn("key", url_key(F.col("url"))).join(snapshot.select("key", "folders"), "key", "left").join(own, ["media_pk", "collection_pk"], "left")
    folder = F.coalesce("folder_id", F.lit(""))
    there = F.col("folders").isNotNull() & ((folder == "") | F.array_contains("folders", folder))
    return rows.select("media_pk", "collection_pk", "folder_id", (F.coalesce(there, F.lit(False)) | F.coalesce("own", F.lit(False))).alias("present"))


def push_plan(library: DataFrame, review: DataFrame, present: DataFrame) -> DataFrame:
    """Library posts that are to be added: not waiting for review, not there yet."""
    waiting = review.where("decided is null").select("media_pk")
    return library.join(waiting, "media_pk", "left_anti").join(present.where("present").select(F.col("pk").alias("media_pk")), "media_pk", "left_anti")


def push_by_folder(shelves: DataFrame, files: DataFrame, review: DataFrame, present: DataFrame, batch: int = 40) -> tuple[DataFrame, DataFrame]:
    """A push with an item for each shelf: files to send (folder_id, media_pk, collection_pk, idx, path, batch) and imports to note (media_pk, collection_pk, folder_id).

    files are those on disk. Posts that wait for review stay out, and shelves that the library has
    (present, of in_library_by_folder() over these shelves: it names their folders, so they aren't read again).
    Batches are numbered within a folder.
    """
    new = _missing_shelves(shelves, review, present)
    rows = new.join(files.select("media_pk", F.coalesce("idx", F.lit(0)).alias("idx"), "path"), "media_pk").select("folder_id", "media_pk", "collection_pk", "idx", "path")
    sent = numbered(rows, ["folder_id"], ["media_pk", "collection_pk", "idx", "path"], "batch").withColumn("batch", F.floor(F.col("batch") / batch).cast("long"))
    return sent, push_marks(shelves, files, review, present)


def push_marks(shelves: DataFrame, files: DataFrame, review: DataFrame, present: DataFrame) -> DataFrame:
    """The imports that push_by_folder() notes, without its files and their numbers."""
    return _missing_shelves(shelves, review, present).join(files.select("media_pk"), "media_pk", "left_semi")


def _missing_shelves(shelves: DataFrame, review: DataFrame, present: DataFrame) -> DataFrame:
    rows = present.where("not present")
    if "folder_id" not in present.columns:
        rows = shelves.join(rows.select("media_pk", "collection_pk"), ["media_pk", "collection_pk"], "left_semi")
    rows = rows.join(review.where("decided is null").select("media_pk"), "media_pk", "left_anti")
    return rows.select("media_pk", "collection_pk", "folder_id")


def duplicates(items: DataFrame, scope: DataFrame | None = None, batch: int = 50) -> DataFrame:
    """id, key, name, chunk of later items of one url and name; the oldest of them stays. scope (id): only items in one of these folders.

    items: id, name, url, folders (array), modification_time. Copies of one
    item, however many, are told from the oldest by a join, without an order
    among them; the doomed ones are numbered into chunks over all.
    """
    rows = items.withColumn("key", url_key(F.col("url"))).where("key <> ''").withColumn("name", F.coalesce("name", F.lit("")))
    if scope is not None:
        inside = rows.select("id", F.explode("folders").alias("_folder")).join(F.broadcast(scope.select(F.col("id").alias("_folder"))), "_folder").select("id").distinct()
        rows = rows.join(inside, "id", "left_semi")
    age = F.struct("modification_time", "id")
    oldest = rows.groupBy("key", "name").agg(F.min(age).alias("_oldest"))
    doomed = rows.join(oldest, ["key", "name"]).where(age != F.col("_oldest")).select("id", "key", "name")
    return numbered(doomed, [], ["key", "name", "id"], "chunk").withColumn("chunk", F.floor(F.col("chunk") / batch).cast("long"))


def backlog(disk: DataFrame, matched: DataFrame, ai_left_out: DataFrame, budget: int) -> DataFrame:
    """queue (0 disk, 1 library), media_pk, idx, id: the budget's descriptions, the disk's first, newest first; what is left goes to the library's items.

    disk: media_pk, idx, path, shown_at of undescribed_files(); matched: id, media_pk, idx of library items
    without a description; ai_left_out: media_pk of posts that are described nowhere. One top-k over
    both queues shares the budget.
    """
    first = disk.select(F.lit(0).alias("queue"), "media_pk", F.col("idx").cast("long").alias("idx"), F.lit("").alias("id"), "shown_at")
    then = matched.where("media_pk is not null").select(F.lit(1).alias("queue"), "media_pk", F.col("idx").cast("long").alias("idx"), "id", F.lit(None).cast("timestamp").alias("shown_at"))
    due = first.unionByName(then).join(ai_left_out.select("media_pk").distinct(), "media_pk", "left_anti")
    return due.orderBy("queue", F.desc_nulls_last("shown_at"), F.when(F.col("queue") == 1, F.col("id")), "media_pk", "idx").limit(max(0, budget)).select("queue", "media_pk", "idx", "id")


def import_queue(new: DataFrame, order: str = "collection_pk") -> DataFrame:
    """One row per post, from its first collection in order."""
    return new.groupBy("media_pk").agg(F.min(order).alias("collection_pk"))


def match_items(items: DataFrame, files: DataFrame, media: DataFrame) -> DataFrame:
    """id, media_pk, idx: by the item's name as a file's stem, else by url (slide 0)."""
    stems = files.select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("name"), "path", "media_pk", "idx").groupBy("name").agg(F.max_by(F.struct("media_pk", "idx"), "path").alias("f"))
    urls = media.select(url_key(F.col("url")).alias("key"), "pk").where("key <> ''").groupBy("key").agg(F.max("pk").alias("pk"))
    return (
        items.withColumn("key", url_key(F.col("url"))).join(stems, "name", "left").join(urls, "key", "left")
        .select("id", F.coalesce("f.media_pk", "pk").alias("media_pk"), F.coalesce(F.col("f.idx").cast("long"), F.when(F.col("pk").isNotNull(), 0)).alias("idx"), "annotation")
    )


def stale_descriptions(matched: DataFrame, ai_meta: DataFrame, current: str) -> DataFrame:
    """Described items whose stored prompt hash isn't the current one."""
    told = matched.where(described(F.col("annotation"))).where("media_pk is not null")
    return told.join(ai_meta.select("media_pk", F.col("idx").cast("long").alias("idx"), "prompt_hash"), ["media_pk", "idx"]).where(F.col("prompt_hash") != current)


def ai_for_slide(files: DataFrame, ai_meta: DataFrame) -> DataFrame:
    """The description of a file's slide, else of the post as a whole (idx 0)."""
    meta = ai_meta.select("media_pk", "idx", "description")
    own = meta.select("media_pk", "idx", F.col("description").alias("own"))
    whole = meta.where("idx = 0").select("media_pk", F.col("description").alias("whole"))
    return files.join(own, ["media_pk", "idx"], "left").join(whole, "media_pk", "left").withColumn("description", F.coalesce("own", "whole")).drop("own", "whole")


def path_conflicts(plan: DataFrame) -> DataFrame:
    """Rows of a plan (media_pk, target) whose target another post takes first; owner is the lowest post."""
    own = plan.groupBy("target").agg(F.min("media_pk").alias("owner"))
    return plan.join(own, "target").where("media_pk <> owner")


def unique_names(names: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """final: name, or name_2, name_3 … for the later of equal names in a folder; names on disk count as earlier ones."""
    n = F.row_number().over(Window.partitionBy("folder", "name").orderBy("media_pk", "idx"))
    rows = names.withColumn("n", n)
    if taken is not None:
        rows = rows.join(taken.groupBy("folder", "name").agg(F.count(F.lit(1)).alias("before")), ["folder", "name"], "left").withColumn("n", F.col("n") + F.coalesce("before", F.lit(0))).drop("before")
    return rows.withColumn("final", F.when(F.col("n") == 1, F.col("name")).otherwise(F.concat("name", F.lit("_"), F.col("n").cast("string")))).drop("n")


_KEY = ["folder", "stem", "ext"]


def _rounds(rows: int, *by: str) -> list[Column]:
    """Conditions that part rows by a hash of columns, up to three for large tables: a step goes through them one by one, so that a part of its shuffle lies on disk at a time."""
    n = min(3, 1 + rows // 10_000_000)
    return [F.pmod(F.xxhash64(*by), F.lit(n)) == k for k in range(n)] if n > 1 else [F.lit(True)]


def _dealt(table: DataFrame, rows: int, *by: str) -> DataFrame:
    """table dealt out by columns, a million rows a task at most as far as they are even: a task then sorts them without spilling; adaptive execution goes by compressed bytes."""
    return table.repartition(max(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // 1_000_000)), *by)


def _parted(rows: DataFrame, path: Column | str) -> DataFrame:
    """rows with folder, stem and ext of a path, in steps that work each part out once; regular expressions cost more than all else here."""
    rows = rows.withColumn("_path", path if isinstance(path, Column) else F.col(path))
    rows = rows.withColumn("_name", F.substring_index("_path", "/", -1)).withColumn("_length", F.length("_name"))
    rows = rows.withColumn("_dot", F.col("_length") - F.length(F.substring_index("_name", ".", -1)))  # where the last one is; 0: none
    rows = rows.withColumn("_stem", F.when(F.col("_dot") > 1, F.col("_dot") - 1).otherwise(F.col("_length")))
    folder = F.substring(F.col("_path"), F.lit(1), F.length("_path") - F.col("_length"))
    stem, ext = F.substring(F.col("_name"), F.lit(1), F.col("_stem")), F.substring(F.col("_name"), F.col("_stem") + 1, F.col("_length"))
    return rows.withColumns({"folder": folder, "stem": stem, "ext": ext}).drop("_path", "_name", "_length", "_dot", "_stem")


def _numbers(wanted: DataFrame, disk: DataFrame) -> DataFrame:
    """The rows of free_names() (_row 1), and the numbers (_n, _row 0) that names of disk, and those asked for with a number from 2 on, take of a name."""

    def later(names: DataFrame) -> DataFrame:
        names = names.withColumn("_tail", F.substring_index("stem", "_", -1)).withColumn("_digits", F.length("_tail"))
        number = (F.col("_digits") < 10) & (F.col("_digits") < F.length("stem")) & F.col("_tail").rlike(r"^([2-9]|[1-9][0-9]+)\z")
        root = F.substring(F.col("stem"), F.lit(1), F.length("stem") - F.col("_digits") - 1)
        return names.withColumn("_later", F.when(number, F.struct(root.alias("stem"), F.col("_tail").cast("long").alias("_n"))))

    names = later(_parted(disk.select("path"), "path").drop("path"))
    own = F.struct("stem", F.lit(1).cast("long").alias("_n"))
    both = names.withColumn("_taken", F.when(F.col("_later").isNull(), F.array(own)).otherwise(F.array(own, "_later")))
    taken = both.select("folder", "ext", F.inline_outer("_taken"))  # never empty; inline would filter by all of it first
    asked = later(wanted.select(*_KEY)).where("_later IS NOT NULL").select("folder", "ext", "_later.stem", "_later._n")
    return wanted.withColumn("_row", F.lit(1)).unionByName(taken.unionByName(asked).withColumn("_row", F.lit(0)), allowMissingColumns=True)


def free_names(wanted: DataFrame, disk: DataFrame, order: list[str], most: int = 100_000) -> DataFrame:
    """Rows of wanted (folder, stem, ext and others) with final: the first of stem, stem_2, stem_3 … that is free for each, in the given order.

    Names of disk (path) aren't free, nor those that earlier rows get, nor, for
    stem_2 and on, those that other rows ask for. A row with r rows before it
    gets the free number that has r free ones below it: rows by r and taken
    numbers by the free ones below them, numbered together, give it. Names that
    up to about `most` rows ask for or take are numbered in windows; for the
    others all is numbered by ranges, so that no task has all rows of a name.
    Which they are is told by counts of a sample; every row is numbered.
    """
    mark, every = F.xxhash64(*_KEY), max(1, most // 1000)  # equal marks of different names only make one of the others
    some = _numbers(wanted, disk) if every == 1 else _numbers(wanted.sample(1 / every, seed=1), disk.sample(1 / every, seed=2))
    many = staged(some.groupBy(mark.alias("_mark")).agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > most / every).select("_mark"))
    rows, count = _numbers(wanted, disk), wanted.count() + 2 * disk.count()  # a name of disk takes two numbers at most
    placed = []
    if not many.isEmpty():
        rest = staged(rows.withColumn("_mark", mark).join(F.broadcast(many), "_mark", "left_semi").drop("_mark"))
        taken = numbered(rest.where("_row = 0").select(*_KEY, "_n", "_row").distinct(), _KEY, ["_n"], "_below").select(*_KEY, (F.col("_n") - 1 - F.col("_below")).alias("_at"), "_row")
        ranked = numbered(rest.where("_row = 1").drop("_n"), _KEY, order, "_at").unionByName(taken, allowMissingColumns=True)
        placed.append(numbered(ranked, _KEY, ["_at", "_row"], "_place").where("_row = 1").drop("_at", "_row"))
        rows = rows.withColumn("_mark", mark).join(F.broadcast(many), "_mark", "left_anti").drop("_mark")
    *before, last = _rounds(count, *_KEY)
    placed += [staged(_placed(rows.where(part), count // (len(before) + 1), order)) for part in before]
    placed = reduce(DataFrame.unionByName, [*placed, _placed(rows.where(last), count // (len(before) + 1), order)])
    plain = F.concat("folder", "stem", "ext")
    final = F.when(F.col("_place") == 0, plain).otherwise(F.concat("folder", "stem", F.lit("_"), (F.col("_place") + 1).cast("string"), "ext"))
    return placed.withColumn("final", final).drop("_place")


def _placed(rows: DataFrame, count: int, order: list[str]) -> DataFrame:
    """The rows of free_names() with their place among all numbers of their name.

    Rows and taken numbers meet in one shuffle; numbers of names that no row
    asks for go at once. Rows are sorted by stem first, which tells most apart.
    """
    rows = _dealt(rows, count, *_KEY)
    name = Window.partitionBy("stem", "folder", "ext")
    each = name.orderBy("_row", "_n", *order)  # the taken numbers, then those that ask
    whole, so_far = (each.rowsBetween(Window.unboundedPreceding, end) for end in (Window.unboundedFollowing, 0))
    asked, again = F.last("_row").over(whole) == 1, (F.col("_row") == 0) & F.lag("_n").over(each).eqNullSafe(F.col("_n"))
    below = F.when(F.col("_row") == 0, F.col("_n") - F.dense_rank().over(each)).otherwise(F.sum("_row").over(so_far) - 1)
    rows = rows.withColumns({"_at": below, "_asked": asked, "_again": again}).where("_asked AND NOT _again")
    place = F.row_number().over(name.orderBy("_at", "_row")) - 1
    return rows.withColumn("_place", place.cast("long")).where("_row = 1").drop("_row", "_n", "_at", "_asked", "_again")


def rename_plan(files: DataFrame, names: DataFrame, disk: DataFrame, companions: dict[str, tuple[str, str]]) -> DataFrame:
    """kind, path, target, renamed: each file on disk, and its thumbnail and sidecar, with the name that its post's base gives it.

    names has media_pk and base; companions has a kind's folder and extension.
    Files of a post with several are numbered by idx. A companion goes by the
    file's stem and gets the base. Names in use before the job aren't given out,
    those that are about to be left included, so moves can run in any order.
    """
    return rename_moves(rename_targets(files, names, disk, companions), disk)


def rename_targets(files: DataFrame, names: DataFrame, disk: DataFrame, companions: dict[str, tuple[str, str]]) -> DataFrame:
    """kind, path and folder, stem, ext of what each is to be called: the first half of rename_plan(), written, after which files and names are of no more use.

    What goes through a shuffle is narrow: paths meet the disk before they get
    their base, and what is behind a step goes when it is written.
    """
    with scratch(files.sparkSession) as folder:
        present = _present(files, disk, companions, folder)
        count = max(present.count(), names.count())
        parts = _rounds(count, "media_pk")
        plan = [staged(_named(present.where(part), names.where(part), count // len(parts), companions)) for part in parts]
    plan = reduce(DataFrame.unionByName, plan)
    least = plan.where("_shared").groupBy("kind", "path").agg(F.min(F.concat(*_KEY)).alias("_to"))
    return plan.where("NOT _shared").drop("_shared").unionByName(staged(_parted(least, "_to").drop("_to")))


def rename_moves(plan: DataFrame, disk: DataFrame) -> DataFrame:
    """kind, path, target, renamed: what rename_targets() wants, past names that are in use."""
    to = F.concat(*_KEY)
    moves = free_names(plan.where(F.col("path") != to), disk, ["path"])
    kept = plan.where(F.col("path") == to).select("kind", "path", F.col("path").alias("target"), F.lit(False).alias("renamed"))
    return moves.select("kind", "path", F.col("final").alias("target"), F.lit(True).alias("renamed")).unionByName(kept)


def _present(files: DataFrame, disk: DataFrame, companions: dict[str, tuple[str, str]], within: str) -> DataFrame:
    """kind, path, media_pk, idx, _shared: files and companions that are on disk, and whether a companion is asked for several times."""
    asked = [F.struct(F.lit("file").alias("kind"), F.col("path"), F.col("idx"))]
    asked += [F.struct(F.lit(kind).alias("kind"), F.concat(F.lit(f"{folder}/"), "stem", F.lit(suffix)).alias("path"), F.lit(None).cast(files.schema["idx"].dataType).alias("idx")) for kind, (folder, suffix) in companions.items()]
    rows = _parted(files.where("media_pk IS NOT NULL"), "path").select("media_pk", F.inline_outer(F.array(*asked)))
    rows = rows.unionByName(disk.select("path"), allowMissingColumns=True)
    count = len(asked) * files.count() + disk.count()
    same = Window.partitionBy("_name", "path")  # names are quick to sort by, and rows with like names next to each other are small when written
    there, several = F.max(F.col("kind").isNull()).over(same), F.count_if(F.col("kind") != "file").over(same) > 1
    parts = _rounds(count, "path")
    found = [_dealt(rows.where(part), count // len(parts), "path").withColumn("_name", F.substring_index("path", "/", -1)) for part in parts]
    found = [x.withColumns({"_there": there, "_shared": (F.col("kind") != "file") & several}).where("_there AND kind IS NOT NULL") for x in found]
    return reduce(DataFrame.unionByName, [staged(x.select("kind", "path", "media_pk", "idx", "_shared"), within) for x in found])


def _named(present: DataFrame, names: DataFrame, count: int, companions: dict[str, tuple[str, str]]) -> DataFrame:
    """kind, path, _shared and folder, stem, ext of what each is to be called; rows are count at most, as are names."""
    main = F.col("kind") == "file"
    order = ["media_pk", "kind", "idx", "path"]
    rows, bases = _dealt(present, count, "media_pk").sortWithinPartitions(*order), _dealt(names.select("media_pk", "base"), count, "media_pk")
    own = rows.join(bases.hint("shuffle_hash"), "media_pk")  # keeps the order, where a merge would sort again; a broadcast would let bases through a shuffle
    each = Window.partitionBy("media_pk", "kind").orderBy("idx", "path")  # the files of one post
    several = F.count(F.lit(1)).over(each.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) > 1
    beside = [F.coalesce(near("path").over(each) == F.col("path"), F.lit(False)) for near in (F.lag, F.lead)]
    shared = ~main & (F.col("_shared") | beside[0] | beside[1])
    own = _parted(own.withColumns({"_at": F.when(several, F.row_number().over(each)), "_shared": shared}), "path")
    to = F.when(main, F.concat("folder", asset_name(F.col("base"), F.col("_at"), F.col("ext"))))
    for kind, (folder, suffix) in companions.items():
        to = to.when(F.col("kind") == kind, F.concat(F.lit(f"{folder}/"), "base", F.lit(suffix)))
    return _parted(own.select("kind", "path", "_shared", to.alias("_to")), "_to").drop("_to")


def collection_hint(membership: DataFrame, collections: DataFrame) -> DataFrame:
    """media_pk, hint, tutorial: the names of at most four collections, and whether they tell of a tutorial."""
    named = membership.join(collections.select(F.col("pk").alias("collection_pk"), "name"), "collection_pk").where("trim(name) <> ''")
    lists = named.groupBy("media_pk").agg(F.slice(F.array_sort(F.collect_list(F.struct("seen_at", "collection_pk", "name"))), 1, 4)["name"].alias("names"))
    joined = F.array_join("names", ", ")
    tutorial = F.lit(False)
    for mark in TUTORIAL_MARKS:
        tutorial = tutorial | F.lower(joined).contains(mark)
    return lists.select("media_pk", F.concat(F.lit("Saved by the owner in collection: "), joined, F.lit(".")).alias("hint"), tutorial.alias("tutorial"))
