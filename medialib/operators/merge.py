"""Set-based upserts: a table and a batch of changes to a new snapshot of the table.

Changes to one key are folded in event order (seq) before they meet the table,
so a batch shuffles once by key whatever it repeats.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import numbered


def latest(changes: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """The last change of each key."""
    rest = [c for c in changes.columns if c not in keys]
    packed = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_last"))
    return packed.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])


def upsert_replace(base: DataFrame, changes: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """Last write wins, whole rows; columns that a change lacks are null."""
    new = latest(changes, keys, order).drop(order)
    return base.join(new, keys, "left_anti").unionByName(new, allowMissingColumns=True)


def upsert_keep(base: DataFrame, changes: DataFrame, keys: list[str], keep: list[str], order: str = "seq") -> DataFrame:
    """Last write wins, but a row that is there keeps the columns in keep."""
    new = latest(changes, keys, order).drop(order)
    old, fresh = base.withColumn("_old", F.lit(True)), new.withColumn("_new", F.lit(True))
    both = old.alias("o").join(fresh.alias("n"), keys, "full_outer")
    out = [F.col(k) for k in keys]
    for c in [c for c in base.columns if c not in keys]:
        if c in keep or c not in new.columns:
            one = F.when(F.col("_old"), F.col(f"o.{c}"))
            out.append((one.otherwise(F.col(f"n.{c}")) if c in new.columns else one).alias(c))
        else:
            out.append(F.when(F.col("_new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
    return both.select(*out)


def insert_ignore(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the rows whose key isn't there yet, each once."""
    return base.unionByName(changes.dropDuplicates(keys).join(base.select(*keys), keys, "left_anti"))


def without(base: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """base without the rows whose key is gone. A task holds its different keys that are gone, and neither sorts nor holds rows of base."""
    return base.join(gone.select(key).hint("shuffle_hash"), key, "left_anti")


def mapped(base: DataFrame, moves: DataFrame, column: str) -> DataFrame:
    """base with the values of a column replaced by the map (old, new)."""
    return (
        base.join(moves.select(F.col("old").alias(column), "new"), column, "left")
        .withColumn(column, F.coalesce("new", column)).drop("new")
    )


def count_candidates(base: DataFrame, dropped: DataFrame, decisions: list[str]) -> DataFrame:
    """Rejected tags (tag, seen_at) counted into (tag, hits, first_seen, last_seen, state); a state that is there stays."""
    new = (
        dropped.where(~F.col("tag").isin(decisions)).groupBy("tag")
        .agg(F.count(F.lit(1)).alias("n"), F.min("seen_at").alias("from_"), F.max("seen_at").alias("to_"))
    )
    return base.join(new, "tag", "full_outer").select(
        "tag", (F.coalesce("hits", F.lit(0)) + F.coalesce("n", F.lit(0))).cast("long").alias("hits"),
        F.least("first_seen", "from_").alias("first_seen"), F.greatest("last_seen", "to_").alias("last_seen"),
        F.coalesce("state", F.lit("new")).alias("state"),
    )


def set_item_id(imports: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Fills item_id where it is blank."""
    return (
        imports.join(found.select(*keys, F.col("item_id").alias("_id")), keys, "left")
        .withColumn("item_id", F.coalesce(F.nullif("item_id", F.lit("")), "_id", "item_id")).drop("_id")
    )


def decide_review(review: DataFrame, keys: DataFrame | None, decision: str, source: str | None = None) -> DataFrame:
    """Pending rows decided: those of keys (media_pk), or all, of one source if named; closed says which."""
    rows = review.join(keys.select("media_pk").distinct().withColumn("_asked", F.lit(True)), "media_pk", "left") if keys is not None else review.withColumn("_asked", F.lit(True))
    due = F.col("decided").isNull() & F.coalesce("_asked", F.lit(False))
    if source:
        due = due & (F.coalesce("source", F.lit("rules")) == source)
    return rows.withColumn("closed", due).withColumn("decided", F.when(due, decision).otherwise(F.col("decided"))).drop("_asked")


def import_manifest(files: DataFrame, batch: int = 40) -> DataFrame:
    """Files to import, numbered into batches within a folder by (media_pk, idx); a folder of any size is numbered by many tasks."""
    return numbered(files, ["folder_id"], ["media_pk", "idx"], "batch").withColumn("batch", F.floor(F.col("batch") / batch).cast("long"))


def forget(tables: dict[str, DataFrame], gone: DataFrame, key: str = "media_pk") -> dict[str, DataFrame]:
    """Every table of a library without the rows of forgotten posts (key); media has it as pk."""
    return {name: without(table, gone.select(F.col(key).alias("pk")), "pk") if name == "media" else without(table, gone, key) for name, table in tables.items()}


def accept_proposals(review: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The model's word taken for all that waits by it: decisions (media_pk, decided), agreement (media_pk, proposed, decided), skip marks (media_pk) and files to delete (media_pk, path).

    What it proposes to drop (verdict skip) is dropped with its files and marked as skipped, the rest is kept.
    """
    decided = F.when(F.coalesce("verdict", F.lit("")) == "skip", "dropped").otherwise("kept")
    rows = review.where("decided is null and source = 'model'").select("media_pk", F.col("verdict").alias("proposed"), decided.alias("decided"))
    drops = rows.where("decided = 'dropped'").select("media_pk")
    return rows.select("media_pk", "decided"), rows, drops, files.select("media_pk", "path").join(drops, "media_pk", "left_semi")
