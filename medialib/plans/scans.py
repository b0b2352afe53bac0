"""Queries on the readers, over listings that the views give."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from ..operators import library
from ..sources import readers, sidecars, vocabulary
from .query import query


@query("SELECT media_pk, idx::BIGINT AS idx, 'x' AS extra FROM ai_meta WHERE idx > 0 UNION ALL SELECT media_pk, 0, 'x' FROM ai_meta WHERE idx = 0")
def scan_state(v):
    """An old table, without slide numbers, brought up to date; and one that has them."""
    schema = StructType().add("media_pk", StringType()).add("idx", IntegerType()).add("extra", StringType())
    old = readers.scan_state(v.ai_meta.where("idx = 0").select("media_pk"), schema, {"idx": 0, "extra": "x"})
    new = readers.scan_state(v.ai_meta.where("idx > 0").select("media_pk", "idx"), schema, {"idx": 0, "extra": "x"})
    return old.unionByName(new).withColumn("idx", F.col("idx").cast("long"))


@query("SELECT collection_pk, row_number() OVER (PARTITION BY collection_pk ORDER BY pos) AS pos, pk FROM feed")
def scan_feed(v):
    pages = v.feed.withColumn("page", F.floor((F.col("pos") - 1) / 20)).groupBy("collection_pk", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "pk"))), lambda x: F.struct(x["pk"].alias("pk"))).alias("items"))
    return readers.scan_feed(pages.withColumn("cursor", F.lit("next"))).withColumn("pos", F.col("pos").cast("long"))


@query("SELECT id, count(*) AS n FROM library_items GROUP BY id")
def scan_library(v):
    """Listing pages of 50 that overlap by two."""
    rows = v.library_items.select("id", F.col("modification_time").alias("pos"))
    pages = rows.withColumn("page", F.explode(F.array(F.floor(F.col("pos") / 50), F.floor((F.col("pos") + 2) / 50)))).distinct()
    return readers.scan_library(pages).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH RECURSIVE f AS (SELECT l_orderkey AS id, CASE WHEN l_orderkey >= 8 THEN l_orderkey // 8 END AS parent FROM (SELECT DISTINCT l_orderkey FROM lineitem)),
g AS (SELECT id, 0 AS depth FROM f WHERE parent IS NULL UNION ALL SELECT f.id, depth + 1 FROM f JOIN g ON f.parent = g.id) SELECT id, depth::BIGINT AS depth FROM g""")
def scan_folders(v):
    rows = v.lineitem.select(F.col("l_orderkey").alias("id")).distinct().withColumn("parent", F.when(F.col("id") >= 8, F.floor(F.col("id") / 8))).withColumn("name", F.lit("f"))
    return readers.scan_folders(rows).select("id", F.col("depth").cast("long").alias("depth"))


@query("""SELECT media_pk AS pk, path FROM files JOIN disk_inventory USING (path) WHERE k % 2 = 1""")
def scan_sidecars(v):
    """The sidecars of all posts, written as JSON with some broken lines among them, with the files that only they tell of."""
    from .streams import folder

    path = folder(v)
    sidecars.write(v.media, library.membership_lists(v.membership), path)
    v.media.where("k % 50 = 0").select(F.concat(F.lit('{"pk": "'), "pk").alias("value")).write.mode("append").text(path)
    records = sidecars.read(v.spark, path).select(F.col("pk").alias("stem"), "pk")
    return readers.scan_sidecars(records, v.disk_inventory, v.files.where("k % 2 = 0")).select("pk", "path")


@query("""SELECT tag, CASE tag WHEN 'neon-lit' THEN 'Light' WHEN 'soft-light' THEN 'Light' ELSE 'mood' END AS title, CASE WHEN tag IN ('soft-light', 'neon-lit') THEN 'what is lit' ELSE '' END AS note, n
          FROM (SELECT unnest(string_split(tags, chr(10))) AS tag, count(*) AS n FROM ai_meta GROUP BY 1) WHERE tag IN ('soft-light', 'neon-lit', 'calm')""")
def scan_vocab(v):
    """A vocabulary file of two categories, and how often their tags are used."""
    from .streams import folder

    path = folder(v)
    text = '{"version": 2, "categories": [{"key": "light", "title": "Light", "note": "what is lit", "tags": ["Soft light", "#neon_lit"]},\n {"key": "mood", "tags": ["calm", ""]}]}'
    v.spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    own = vocabulary.read(v.spark, path)
    tags = vocabulary.tables(v.spark, own).select("tag", "title", "note")
    return v.ai_meta.select(F.explode(F.split("tags", "\n")).alias("tag")).join(F.broadcast(tags), "tag").groupBy("tag", "title", "note").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT media_pk, idx::BIGINT AS idx, length(answer_text)::BIGINT AS n FROM model_answers")
def scan_answers(v):
    """The answers written as JSON lines and read again."""
    from .streams import folder

    path = folder(v)
    v.model_answers.select("media_pk", F.col("idx").cast("int").alias("idx"), "answer_text").write.json(path)
    return readers.scan_answers(v.spark, path).select("media_pk", F.col("idx").cast("long").alias("idx"), F.length("answer_text").cast("long").alias("n"))
