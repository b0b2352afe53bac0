"""Quality rules, judged by host: rule failures by domain, shrunk with an empirical beta prior.

Each text gets its rule figures in one pass; a host's failure rate is drawn to
the rate of all hosts by a beta prior fitted to the hosts' own rates (method of
moments), so that a host of three documents isn't judged by chance; the verdict
on a host then holds for its documents. Only the hosts that fail are joined back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rows, picked, texts, written

WHITE, SYMBOLS = b" \t\n\r\v\f", b"#*$%&|<>"
FIGURES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("host", pa.string()),
        *[(k, pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")],
    ]
)


def repeated_words(words: list[bytes], window: int = 5) -> int:
    """Words that lie in a window whose words stand at two places or more of the text, first place included."""
    count = len(words) - window + 1
    if count < 2:
        return 0
    ids = {w: k for k, w in enumerate(dict.fromkeys(words))}
    seq = np.array(list(map(ids.__getitem__, words)), dtype=np.int64)
    key, top = seq[:count], len(ids)
    for k in range(1, window):
        if top * len(ids) >= 2**62:
            values, key = np.unique(key, return_inverse=True)
            top = len(values)
        key = key * len(ids) + seq[k : k + count]
        top *= len(ids)
    _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
    again = times[inverse] > 1
    if not again.any():
        return 0
    edges = np.zeros(len(words) + 1, np.int64)
    edges[:count] += again
    edges[window : window + count] -= again
    return int((np.cumsum(edges) > 0).sum())


def figures(text: bytes) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of a text; lines count if they have a word."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    chars = len(text) if text.isascii() else len(text.decode())
    return (
        len(words),
        chars - len(text) + len(text.translate(None, WHITE)),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def _figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = Rows(FIGURES)
    for batch in batches:
        for key, host, text in zip(
            batch.column("doc_id").to_pylist(), batch.column("host").to_pylist(), texts(batch), strict=True
        ):
            rows.add(key, host, *figures(text))
            if rows.full():
                yield rows.batch()
    yield from rows.rest()


def rule_figures(docs: DataFrame, id_col="doc_id", text_col="text", host_col="source") -> DataFrame:
    """A row per document with the figures that the rules are stated in; a null text counts as empty, a null host as ''."""
    chosen = picked(docs, text_col, doc_id=id_col, host=host_col).withColumn("host", F.coalesce("host", F.lit("")))
    return chosen.mapInArrow(
        _figures,
        "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long",
    )


def base_failed():
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def any_failed():
    """The base rules, and too many symbols or repeated lines: what a host is judged by."""
    return (
        base_failed()
        | (100 * F.col("n_symbols") > 20 * F.col("n_words"))
        | (100 * F.col("n_dup_lines") > 30 * F.col("n_lines"))
    )


def host_verdicts(found: DataFrame, max_rate: float = 0.5) -> DataFrame:
    """host, n_docs, n_failed, rate (shrunk), host_ok for the hosts in a table of rule_figures().

    With mean m and strength s of the prior, rate = (n_failed + m s) / (n_docs + s);
    s = m (1 - m) / v - 1, where v is the variance of the hosts' rates without
    what chance alone would give them; s stays within 2 and 10,000.
    """
    hosts = found.groupBy("host").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(any_failed().cast("long")).alias("n_failed")
    )
    raw = F.col("n_failed") / F.col("n_docs")
    m, spread, per_doc = hosts.agg(
        F.sum("n_failed") / F.sum("n_docs"), F.var_pop(raw), F.avg(1 / F.col("n_docs"))
    ).first()
    m = m or 0.0
    s = max(2.0, min(1e4, m * (1 - m) / max((spread or 0) - m * (1 - m) * (per_doc or 0), 1e-9) - 1))
    return hosts.withColumn("rate", (F.col("n_failed") + m * s) / (F.col("n_docs") + s)).select(
        "host", "n_docs", "n_failed", "rate", (F.col("rate") <= max_rate).alias("host_ok")
    )


def host_rules(docs: DataFrame, id_col="doc_id", text_col="text", host_col="source", max_rate=0.5) -> DataFrame:
    """The figures of each document and kept: false if a base rule fails, or if its host is judged bad.

    Repeated rows are judged row by row; an empty table gives an empty one;
    other columns of docs play no part. A very long text is held whole in a task
    with its words, lines and windows, some thirty times its length.
    """
    found = written(rule_figures(docs, id_col, text_col, host_col), "rule-figures")
    bad = host_verdicts(found, max_rate).where(~F.col("host_ok")).select("host", F.lit(True).alias("bad_host"))
    return found.join(bad, "host", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"),
        (~base_failed() & F.col("bad_host").isNull()).alias("kept"),
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT r, i, w[i:i+4] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) > 5)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, range(0, 5) AS s(k) GROUP BY r),
f AS (
  SELECT doc_id, host, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM l LEFT JOIN cov USING (r)),
j AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f),
h AS (
  SELECT host, count(*) AS n_docs,
         sum((base_failed OR 100 * n_symbols > 20 * n_words OR 100 * n_dup_lines > 30 * n_lines)::INT) AS n_failed
  FROM j GROUP BY host),
p AS (SELECT sum(n_failed) / sum(n_docs) AS m, var_pop(n_failed / n_docs) AS spread, avg(1 / n_docs) AS per_doc FROM h),
s AS (SELECT m, greatest(2.0, least(1e4, m * (1 - m) / greatest(spread - m * (1 - m) * per_doc, 1e-9) - 1)) AS s FROM p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (n_failed + m * s) / (n_docs + s) <= 0.5 AS kept
FROM j JOIN h USING (host), s
"""
