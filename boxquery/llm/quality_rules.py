"""Quality rules at host level: rule failures by domain, shrunk with an empirical beta prior."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxquery.llm._common import blocks, table, text_bytes, written
from boxquery.llm._text import BASES, SPACE, mix, prefix_hash, runs_of, span_hash, window_starts, words

MIN_WORDS = 50
REPEAT_PERCENT = 50
#: A host is bad if its shrunk failure rate is above this.
HOST_RATE = 0.5
#: Hosts that may be broadcast; more are joined by a shuffle.
BROADCAST_HOSTS = 50_000

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_TAIL = np.zeros(256, bool)  # bytes that continue a UTF-8 character
_TAIL[0x80:0xC0] = True
_NEWLINE = np.zeros(256, bool)
_NEWLINE[0x0A] = True

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[offsets[1:]] - total[offsets[:-1]]


def text_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts that the rules read, one value a text."""
    texts = len(offsets) - 1
    starts, ends, at = words(data, offsets, ~SPACE)
    in_word = ~SPACE[data]
    prefix = prefix_hash(data, BASES[0])
    hashes = span_hash(prefix, starts, ends, BASES[0])

    # 3-word windows found twice or more in their text
    first, _, owner = window_starts(at, 3)
    repeated = np.zeros(len(starts) + 1, np.int64)
    if len(first):
        key = mix(hashes[first] * np.uint64(5) + mix(hashes[first + 1] * np.uint64(3) + mix(hashes[first + 2]))) + mix(owner.astype(np.uint64))
        order = np.argsort(key, kind="stable")
        key = key[order]
        twin = np.zeros(len(key), bool)
        same = key[1:] == key[:-1]
        twin[1:] |= same
        twin[:-1] |= same
        hit = first[order[twin]]
        np.add.at(repeated, hit, 1)
        np.add.at(repeated, hit + 3, -1)
    repeated = np.cumsum(repeated[:-1]) > 0

    # lines with a word that equal an earlier line of their text; the bytes between \n are the line
    line_starts, line_ends = runs_of(~_NEWLINE[data], offsets)
    has_word = np.concatenate([[0], np.cumsum(in_word)])
    worded = has_word[line_ends] > has_word[line_starts]
    line_starts, line_ends = line_starts[worded], line_ends[worded]
    line_owner = np.searchsorted(offsets, line_starts, side="right") - 1
    key = mix(span_hash(prefix, line_starts, line_ends, BASES[0])) + mix(line_owner.astype(np.uint64))
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[order[1:]] = key[order[1:]] == key[order[:-1]]
    return {
        "n_words": np.diff(at),
        "word_chars": _sums(in_word & ~_TAIL[data], offsets),
        "n_symbols": _sums(_SYMBOL[data], offsets),
        "n_dup_lines": np.bincount(line_owner[again], minlength=texts)[:texts],
        "n_repeat_words": _sums(repeated, at),
    }


def base_counts(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host and the counts of every whole text (null: no words); one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            got = text_counts(*text_bytes(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(2).cast(pa.string()), *(pa.array(got[c].astype(np.int64)) for c in COUNTS)], names=["doc_id", "host", *COUNTS])

    return docs.select("doc_id", "text", F.col(host).cast("string").alias("host")).mapInArrow(run, "doc_id long, host string, " + ", ".join(f"{c} long" for c in COUNTS))


def fails() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(REPEAT_PERCENT) * F.col("n_words"))


def host_rates(rows: DataFrame) -> DataFrame:
    """One row a non-null host: documents, failures and the shrunk failure rate.

    The prior is Beta(m*s, (1-m)*s): m is the failure rate of all documents with a
    host, s comes from the hosts' rates by moments: with v the variance of the rates
    around m, weighted by documents, and h the mean of 1/n so weighted, the binomial
    part m(1-m)h is taken off v, and s = m(1-m)/(v - m(1-m)h) - 1, held in 1..1000.
    Shrunk rate: (failures + m*s) / (documents + s).
    """
    hosts = rows.where(F.col("host").isNotNull()).groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    hosts = written(hosts, "hosts")
    total = hosts.agg(F.sum("n").cast("double").alias("docs"), (F.sum("failed") / F.sum("n")).alias("m"), F.count(F.lit(1)).cast("double").alias("hosts"), F.sum(F.col("failed").cast("double") * F.col("failed") / F.col("n")).alias("sq"))
    m = F.col("m")
    spread = F.col("sq") / F.col("docs") - m * m - m * (1 - m) * F.col("hosts") / F.col("docs")
    strength = F.when(spread > 0, F.least(F.lit(1000.0), F.greatest(F.lit(1.0), F.try_divide(m * (1 - m), spread) - 1))).otherwise(F.lit(1000.0))
    prior = total.select("m", strength.alias("s"))
    return hosts.join(F.broadcast(prior)).select("host", "n", "failed", ((F.col("failed") + F.col("m") * F.col("s")) / (F.col("n") + F.col("s"))).alias("rate"))


def host_verdicts(docs: DataFrame, host: str = "source", most_rate: float = HOST_RATE) -> DataFrame:
    """Counts, base verdict and the host's verdict of each document.

    A document is kept if it passes the base rules and its host isn't bad. A null host
    is no host: such documents count for no rate, and the base rules decide alone.
    Null and empty texts fail (too few words). Rows that repeat count each.
    """
    rows = written(base_counts(docs, host).withColumn("base_failed", fails()), "rule-counts")
    hosts = host_rates(rows)
    bad = written(hosts.where(F.col("rate") > most_rate).select("host", F.lit(True).alias("bad")), "bad-hosts")
    if bad.count() <= BROADCAST_HOSTS:
        bad = F.broadcast(bad)
    return rows.join(bad, "host", "left").withColumn("kept", ~F.col("base_failed") & F.col("bad").isNull()).drop("bad")


def op10_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = host_verdicts(table(spark, sf_dir, "documents"))
    return got.select("doc_id", *COUNTS, "base_failed", "kept")


ORACLE_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
wins AS (SELECT rid, unnest(range(1, len(w) - 1)) AS k, unnest(list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2])) AS g FROM docs WHERE len(w) >= 3),
twins AS (SELECT rid, k FROM (SELECT rid, k, count(*) OVER (PARTITION BY rid, g) AS c FROM wins) WHERE c >= 2),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([k, k + 1, k + 2]) AS p FROM twins) GROUP BY rid),
counted AS (SELECT doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM docs LEFT JOIN cov USING (rid)),
failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted),
hosts AS (SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS f FROM failed WHERE source IS NOT NULL GROUP BY 1),
tot AS (SELECT sum(n) AS d, sum(f) / sum(n) AS m, count(*) AS h, sum(f * f / n) AS sq FROM hosts),
spread AS (SELECT m, sq / d - m * m - m * (1 - m) * h / d AS v FROM tot),
prior AS (SELECT m, CASE WHEN v > 0 THEN least(1000, greatest(1, m * (1 - m) / v - 1)) ELSE 1000 END AS s FROM spread),
bad AS (SELECT source FROM hosts, prior WHERE (f + m * s) / (n + s) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(source NOT IN (SELECT source FROM bad), true) AS kept FROM failed
"""
