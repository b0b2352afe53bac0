"""What the corpus operators share: words, hashes and written tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII upper case to lower case; every other ASCII character but digits and letters to a space.
ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: The folder, within the shared one, of what is written in a scratch().
_SCRATCH: ContextVar[str] = ContextVar("scratch", default="")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, one of our own, which only one machine alone can share."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/medialib-checkpoints"
    return f"{folder.rstrip('/')}/medialib-{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str, within: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: cuts the lineage and survives lost executors.

    The shuffle files behind it are of no more use once it is written, so Spark
    is told to remove them then. within names a folder other than the scratch's.
    """
    spark = df.sparkSession
    path = "/".join(x for x in (shared_dir(spark), _SCRATCH.get() if within is None else within, f"{name}-{uuid.uuid4().hex}") if x)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession, within: str = "") -> None:
    """Removes every table that written() left for this application, or those within a folder; call it when the results are stored."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{within}".rstrip("/"))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What written() writes in the block goes when it ends; results have to be stored before, elsewhere."""
    name = f"scratch-{uuid.uuid4().hex}"
    token = _SCRATCH.set(name)
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        clear(spark, name)


def picked(docs: DataFrame, text_col: str = "text", **columns: str) -> DataFrame:
    """The named columns, by new name, and text (null: empty); all others, clashing names included, stay out."""
    return docs.select(
        *[F.col(old).alias(new) for new, old in columns.items()], F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """A column of strings as UTF-8."""
    column = batch.column(name)
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def alnum_words(text: bytes) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and non-ASCII characters."""
    return text.translate(ALNUM).split()


def hashed(words: list[bytes]) -> np.ndarray:
    """64-bit hashes that are the same in every process."""
    return np.array(list(map(xxhash.xxh3_64_intdigest, words)), dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: spreads 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word windows, by the first word; empty for shorter texts."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    found = hashes[:count].copy()
    for k in range(1, n):
        found *= np.uint64(0x9E3779B97F4A7C15)
        found += hashes[k : k + count]
    return mixed(found)


_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_RANGE = 1 << 20
#: A random number for each byte (white space: 0) and the powers of an odd number: a word's hash is that of its polynomial.
_BYTES = np.where(_WHITE, np.uint64(0), mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def _powers(base: int, n: int) -> np.ndarray:
    found, done = np.ones(n, np.uint64), 1
    while done < n:
        found[done : 2 * done] = found[: min(done, n - done)] * np.uint64(pow(base, done, 2**64))
        done *= 2
    return found


_BASE = 0xD6E8FEB86659FD93
_UP, _DOWN = _powers(_BASE, 2 * _RANGE), _powers(pow(_BASE, -1, 2**64), 2 * _RANGE)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column without nulls, one after the other, and where each begins (with the end)."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def word_starts(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """Where the words begin; gap tells of each of the 256 bytes whether it stands between words."""
    dark = ~gap[data]
    first = dark.copy()
    first[1:] &= ~dark[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    first[heads] = dark[heads]  # a text begins a word, whatever the one before ends with
    return np.flatnonzero(first)


def hashes_at(data: np.ndarray, starts: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words that begin at starts; numbers has one for each byte, 0 for those between words.

    The words are gone through in ranges of about a megabyte; a longer one is
    summed by pieces of a megabyte, and the sums are put together to its hash.
    """
    cuts = -(-np.diff(np.append(starts, len(data))) // _RANGE)
    long = bool((cuts > 1).any())
    nth = ranges(np.zeros(len(starts), np.int64), cuts) if long else None
    begins = np.repeat(starts, cuts) + nth * _RANGE if long else starts
    out, at = [np.empty(0, np.uint64)], 0
    while at < len(begins):
        begin = int(begins[at])
        last = max(at + 1, int(np.searchsorted(begins, begin + _RANGE)))
        part = numbers[data[begin : int(begins[last]) if last < len(begins) else len(data)]]
        own = begins[at:last] - begin
        out.append(np.add.reduceat(part * _UP[: len(part)], own) * _DOWN[own])
        at = last
    sums = np.concatenate(out)
    if long:
        sums = np.add.reduceat(sums * _powers(pow(_BASE, _RANGE, 2**64), int(cuts.max()))[nth], np.cumsum(cuts) - cuts)
    return mixed(sums)


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words [^\\x20\\x09-\\x0D]+ of all texts of a column without nulls, one a word, and where each text's begin."""
    data, offsets = flat(column)
    starts = word_starts(data, offsets, _WHITE)
    return hashes_at(data, starts, _BYTES), np.searchsorted(starts, offsets)


def row_groups(column: pa.Array, most_bytes: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about most_bytes of text at most, a row at least."""
    sizes = np.cumsum(pa.compute.binary_length(column).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < len(sizes):
        before = sizes[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(sizes, before + most_bytes, side="right")))
        yield begin, end
        begin = end


def ranges(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each begin on, one after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(begins - before, sizes) + np.arange(int(sizes.sum()))


class Rows:
    """Gathers rows of a task and gives them out as Arrow batches of bounded size."""

    def __init__(self, schema: pa.Schema, most: int = 20_000, most_bytes: int = 16 << 20):
        self.schema, self.most, self.most_bytes = schema, most, most_bytes
        self.columns: list[list] = [[] for _ in schema]
        self.bytes = 0

    def add(self, *values, size: int = 0) -> None:
        for column, value in zip(self.columns, values, strict=True):
            column.append(value)
        self.bytes += size

    def full(self) -> bool:
        return len(self.columns[0]) >= self.most or self.bytes >= self.most_bytes

    def batch(self) -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays(
            [pa.array(c, type=f.type) for c, f in zip(self.columns, self.schema, strict=True)], schema=self.schema
        )
        self.columns, self.bytes = [[] for _ in self.schema], 0
        return made

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.columns[0]:
            yield self.batch()
