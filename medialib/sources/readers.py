"""Readers of feeds, listings, sidecars and state tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .staging import staged

#: Endings of media files.
MEDIA_ENDS = [".mp4", ".mov", ".m4v", ".webm", ".jpg", ".jpeg", ".png", ".webp", ".heic"]


def scan_state(table: DataFrame, schema: StructType, defaults: dict | None = None) -> DataFrame:
    """A state table in its present schema: columns that an older one lacks get their defaults, null otherwise."""
    fill = defaults or {}
    columns = []
    for field in schema:
        value = F.col(field.name) if field.name in table.columns else F.lit(None)
        columns.append(F.coalesce(value.cast(field.dataType), F.lit(fill.get(field.name)).cast(field.dataType)).alias(field.name))
    return table.select(*columns)


def scan_feed(pages: DataFrame) -> DataFrame:
    """collection_pk, pos, pk of feed pages (collection_pk, page, items array<struct<pk>>, cursor); a feed ends after a page without a cursor or two empty ones.

    Only a page's size goes through the order of its feed; the items are placed by what stands on the pages before theirs.
    """
    by = Window.partitionBy("collection_pk").orderBy("page")
    sizes = pages.select("collection_pk", "page", F.greatest(F.size("items"), F.lit(0)).cast("long").alias("n"), F.col("cursor").isNull().alias("last"))
    ends = F.col("last") | ((F.col("n") == 0) & F.coalesce(F.lag(F.col("n") == 0).over(by), F.lit(False)))
    walked = sizes.withColumn("_ends", F.lag(ends.cast("int"), 1, 0).over(by)).withColumn("_over", F.sum("_ends").over(by)).where("_over = 0")
    placed = walked.select("collection_pk", "page", (F.sum("n").over(by) - F.col("n")).alias("_before"))
    each = pages.join(placed, ["collection_pk", "page"]).select("collection_pk", "_before", F.posexplode("items").alias("at", "item"))
    return each.select("collection_pk", (F.col("_before") + F.col("at") + 1).alias("pos"), F.coalesce("item.pk", F.lit("")).alias("pk"))


def scan_library(pages: DataFrame) -> DataFrame:
    """Items of listing pages (page, pos, id, …) that may overlap: each id once, where it comes first; items without id all stay."""
    first = F.row_number().over(Window.partitionBy("id").orderBy("page", "pos"))
    named = pages.where("coalesce(id, '') <> ''").withColumn("_n", first).where("_n = 1").drop("_n")
    return named.unionByName(pages.where("coalesce(id, '') = ''"))


def scan_folders(folders: DataFrame) -> DataFrame:
    """id, name, parent, depth, path of a folder list (id, name, parent, and pos, the place among its siblings, if it has one).

    The tree is walked from the roots, a written table for each level; path has
    the places on the way, so that its order is that of a walk folder by folder.
    """
    rows = folders if "pos" in folders.columns else folders.withColumn("pos", F.col("id"))
    rows = rows.select("id", "name", "parent", F.struct("pos", "id").alias("_place"))
    level = staged(rows.where("parent is null").select("id", "name", "parent", F.lit(0).alias("depth"), F.array("_place").alias("path")))
    out = level
    while not level.isEmpty():
        above = level.select(F.col("id").alias("parent"), "depth", F.col("path").alias("_above"))
        level = staged(rows.join(above, "parent").select("id", "name", "parent", (F.col("depth") + 1).alias("depth"), F.concat("_above", F.array("_place")).alias("path")))
        out = out.unionByName(level)
    return out


def find_folder(tree: DataFrame, name: str, parent=None) -> DataFrame:
    """id of the folder of a name, whatever its case: among the roots, else the first in the tree; or among a parent's own. At most one row."""
    same = tree.where(F.lower(F.trim(F.coalesce("name", F.lit("")))) == name.strip().lower())
    if parent is not None:
        same = same.where(F.col("parent") == parent)
    return same.orderBy(F.col("depth") > 0, "path").limit(1).select("id")


def app_folders(tree: DataFrame, name: str) -> DataFrame:
    """id of the app's folder and of those right below it; none if there is no such folder."""
    root = find_folder(tree, name)
    return root.unionByName(tree.join(root.withColumnRenamed("id", "parent"), "parent").select("id"))


def scan_sidecars(records: DataFrame, disk: DataFrame, known: DataFrame) -> DataFrame:
    """stem, pk, path: sidecar records (stem, pk) with the media files on disk that begin with their stem and that no table knows.

    A file that begins with several stems goes with the longest. File names are
    met by their beginnings of those lengths that stems have, a few hundred at most.
    """
    lengths = [r.n for r in records.select(F.length("stem").alias("n")).where("n between 1 and 255").distinct().orderBy("n").collect()]
    file = disk.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("_file")).where(F.lower(F.regexp_extract("_file", r"(\.[^.]+)$", 1)).isin(MEDIA_ENDS))
    begins = F.transform(F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length("_file")), lambda n: F.substring(F.col("_file"), F.lit(1), n))
    own = file.join(known.select("path"), "path", "left_anti").select("path", F.explode(begins).alias("stem")).join(records, "stem")
    return own.groupBy("path").agg(F.max_by(F.struct("stem", "pk"), F.length("stem")).alias("r")).select("r.stem", "r.pk", "path")


def scan_answers(spark: SparkSession, path: str) -> DataFrame:
    """A log of model answers, a JSON record per line."""
    return spark.read.schema("media_pk string, idx int, model string, prompt_hash string, frames int, answer_text string").json(path)
