"""Frame hashes and the search for reposts by Hamming distance."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged

#: A 64-bit hash of an embedding's signs; the highest bit makes the number negative.
BITS_SQL = "(" + " + ".join(f"(CASE WHEN embedding[{i + 1}] > 0 THEN {2**i if i < 63 else -(2**63)}::HUGEINT ELSE 0 END)" for i in range(64)) + ")"


def fingerprints(embeddings: DataFrame) -> DataFrame:
    """media_pk, idx, hash of embeddings of 64 numbers, five to a post."""
    bits = F.aggregate(
        F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"),
        lambda acc, i: acc.bitwiseOR(F.when(F.get("embedding", i) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))),
    )
    return embeddings.select(F.floor(F.col("vec_id") / 5).cast("long").cast("string").alias("media_pk"), (F.col("vec_id") % 5).alias("idx"), bits.alias("hash"))


def informative(value: Column) -> Column:
    """Neither nearly empty nor nearly full: 12 to 52 bits set."""
    return F.bit_count(value).between(12, 52)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def readable(rows: DataFrame, column: str = "hex") -> DataFrame:
    """Rows whose hash is hexadecimal and informative."""
    value = F.conv(F.col(column), 16, -10).cast("long")
    return rows.where(F.col(column).rlike("^[0-9a-fA-F]{1,16}$")).where(informative(value))


#: What a hash dealt out under a key costs, by the cost of a pair that meets under one: it goes through two shuffles.
KEY_COST = 20


def best_bands(known: int, asked: int, distance: int) -> int:
    """Into how many bands to cut hashes: what has the fewest keys of all hashes, and pairs that meet under them, together."""
    keys = {m: comb(m, m - distance) for m in range(distance + 1, distance + 5)}
    return min(keys, key=lambda m: keys[m] * (KEY_COST * (known + asked) + known * asked / 2 ** (64 * (m - distance) / m)))


@dataclass
class Index:
    """Known posts as a search needs them: answers (known_pk, theirs), and their hashes dealt out under their keys (g, keep, upto, key)."""

    answers: DataFrame
    dealt: DataFrame
    distance: int
    bands: int


def _edges(bands: int) -> list[int]:
    return [64 * b // bands for b in range(bands + 1)]


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def _spread(rows: DataFrame, *by: str) -> DataFrame:
    """rows dealt out to as many tasks as a shuffle has: what follows costs by keys and pairs, which the bytes of a shuffle don't tell."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def _dealt(hashes: DataFrame, value: str, distance: int, bands: int) -> DataFrame:
    """A row for each choice of bands that agree at least: keep (the bands as bits), upto (all bands up to its last) and key, the hash's bits in them."""
    edges = _edges(bands)
    of_band = [((1 << edges[b + 1]) - 1) ^ ((1 << edges[b]) - 1) for b in range(bands)]
    rows = []
    for chosen in combinations(range(bands), bands - distance):
        rows.append(f"named_struct('keep', {sum(1 << b for b in chosen)}, 'upto', {(2 << chosen[-1]) - 1}, 'bits', CAST('{_signed(sum(of_band[b] for b in chosen))}' AS BIGINT))")
    each = _spread(hashes, value).select(value, F.explode(F.expr(f"array({', '.join(rows)})")).alias("_k"))
    return each.select(value, "_k.keep", "_k.upto", F.col(value).bitwiseAND(F.col("_k.bits")).alias("key"))


def _posts(rows: DataFrame, all_of: str) -> DataFrame:
    return rows.where(informative(F.col("hash"))).groupBy("pk").agg(F.array_sort(F.expr(f"{all_of}(hash)")).alias("hashes"))


def index_of(known: DataFrame, distance: int = 8, bands: int | None = None, asked: int | None = None, write: bool = False) -> Index:
    """The index of known posts (pk, hash); written, it serves many searches.

    Of posts with the same hashes the two lowest can be an answer (the second
    for the first itself). Hashes are dealt out as different values, whatever
    number of posts has them. The number of bands goes with the number of
    different hashes, and with how many are asked at once (as many, if that isn't said).
    """
    lowest = F.row_number().over(Window.partitionBy("hashes").orderBy("pk"))
    answers = _posts(known, "collect_set").withColumn("_no", lowest).where("_no <= 2").select(F.col("pk").alias("known_pk"), F.col("hashes").alias("theirs"))
    answers = staged(answers) if write or not bands else answers
    hashes = answers.select(F.explode("theirs").alias("g")).distinct()
    if not bands:
        n = hashes.count()
        bands = best_bands(n, n if asked is None else asked, distance)
    if bands <= distance:
        raise ValueError("more bands than distance are needed")
    dealt = _dealt(hashes, "g", distance, bands)
    return Index(answers, staged(dealt) if write else dealt, distance, bands)


def _met(asked: DataFrame, index: Index, most: int) -> DataFrame:
    """Pairs h, g under equal keys; under a key that many have on either side they meet in parts of about `most` by `most`.

    Both sides are dealt out by key and part: Spark takes a side for as small as its hashes were before they had keys, and would broadcast it.
    """
    keys = ["keep", "key"]
    of = lambda rows, a: rows.select(*keys, F.lit(a).alias("_a"), F.lit(1 - a).alias("_b"))
    sizes = of(asked, 1).unionByName(of(index.dealt, 0)).groupBy(*keys).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    hot = sizes.where(((F.col("_a") > most) | (F.col("_b") > most)) & (F.col("_a") > 0) & (F.col("_b") > 0)).select(*keys, *[F.ceil(F.col(c) / most).cast("int").alias(c) for c in ("_a", "_b")])

    def salted(rows: DataFrame, value: str, own: str, other: str) -> DataFrame:
        rows = rows.join(hot, keys, "left")
        place, copies = F.pmod(F.xxhash64(value), F.coalesce(own, F.lit(1))), F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)
        return _spread(rows.withColumn(f"{own}_no", place.cast("int")).withColumn(f"{other}_no", F.explode(copies)).drop("_a", "_b"), *meet)

    meet = [*keys, "_a_no", "_b_no"]
    return salted(asked.drop("upto"), "h", "_a", "_b").join(salted(index.dealt, "g", "_b", "_a").hint("merge"), meet)


def near_hashes(asked: DataFrame, index: Index, few: int = 64, most: int = 4096) -> DataFrame:
    """h, g, d: the known hashes within the distance of each asked one (h, distinct), each pair once.

    Hashes within `distance` bits agree in bands - distance of the bands at
    least, so they meet under a key of that many; a pair is told under the key of
    its first equal bands. A few asked hashes are compared with all known ones
    instead: they are counted, and then sent to where those lie.
    """
    d = hamming(F.col("h"), F.col("g"))
    if asked.limit(few + 1).count() <= few:
        known = index.answers.select(F.explode("theirs").alias("g")).distinct()
        return known.join(F.broadcast(asked), d <= index.distance).select("h", "g", d.alias("d"))
    edges, differ = _edges(index.bands), F.col("h").bitwiseXOR(F.col("g"))
    equal = F.lit(0)
    for b in range(index.bands):
        bits = _signed(((1 << edges[b + 1]) - 1) ^ ((1 << edges[b]) - 1))
        equal = equal + F.when(differ.bitwiseAND(F.lit(bits).cast("long")) == 0, 1 << b).otherwise(0)
    met = _met(_dealt(asked, "h", index.distance, index.bands), index, most)
    return met.where((d <= index.distance) & (equal.bitwiseAND(F.col("upto")) == F.col("keep"))).select("h", "g", d.alias("d"))


def similar_posts(query: DataFrame, known: DataFrame | Index, distance: int = 8, bands: int | None = None, few: int = 64, most: int = 4096) -> DataFrame:
    """pk, known_pk, distance, hits: the nearest known post of each queried one.

    query and known: (pk, hash), or the index of known. A post is accepted with
    two hits or a distance of 2; ties go to the lowest pk. A hash repeated within
    the query counts each time. Queried posts with the same hashes are searched
    once, unless one of them is an answer of the index itself.
    """
    index = known if isinstance(known, Index) else index_of(known, distance, bands, None if bands else query.count())
    asked = _posts(query, "collect_list").join(index.answers.select(F.col("known_pk").alias("pk"), F.col("known_pk").alias("itself")), "pk", "left")
    groups = asked.groupBy("hashes", "itself").agg(F.min("pk").alias("asks"))
    one = groups.select("asks", "itself", F.posexplode("hashes").alias("q", "h"))
    near = near_hashes(one.select("h").distinct(), index, few, most)
    pairs = one.join(near, "h").join(index.answers.select("known_pk", F.explode("theirs").alias("g")), "g").where("itself is null or itself <> known_pk")
    best = pairs.groupBy("asks", "q", "known_pk").agg(F.min("d").alias("d"))
    found = best.groupBy("asks", "known_pk").agg(F.min("d").alias("distance"), F.count(F.lit(1)).alias("hits")).where("hits >= 2 or distance <= 2")
    order = F.struct("distance", -F.col("hits"), "known_pk")
    nearest = groups.join(found.groupBy("asks").agg(F.min_by(F.struct("known_pk", "distance", "hits"), order).alias("b")), "asks").drop("asks")
    return asked.join(nearest, (asked["hashes"] == nearest["hashes"]) & asked["itself"].eqNullSafe(nearest["itself"])).select(
        asked["pk"], "b.known_pk", F.col("b.distance").cast("long").alias("distance"), "b.hits"
    )


def dupe_hold(found: DataFrame, media: DataFrame, held: DataFrame, action: str = "review") -> DataFrame:
    """pk, action (skip, review, import), note of posts that look like known ones; those already held (pk) are left out, and with action off all.

    found: of similar_posts(). The note names the known post's author, the distance and the known post's url, as far as media (pk, username, url) has them.
    """
    if action == "off":
        return found.limit(0).select("pk", F.lit("").alias("action"), F.lit("").alias("note"))
    posts = media.select(F.col("pk").alias("known_pk"), "username", "url")
    who = F.coalesce(F.concat(F.lit("@"), F.nullif("username", F.lit(""))), "known_pk")
    note = F.concat(F.lit("looks like "), who, F.lit(" (distance "), F.col("distance").cast("string"), F.lit(")"), F.coalesce(F.concat(F.lit(" "), F.nullif("url", F.lit(""))), F.lit("")))
    return found.join(held.select("pk").distinct(), "pk", "left_anti").join(posts, "known_pk", "left").select("pk", F.lit(action if action in ("skip", "review") else "import").alias("action"), note.alias("note"))
