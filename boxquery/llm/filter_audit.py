"""Audit of filters that interact: what each removes, alone and in every order.

Filters over a text give bits of a mask. The one that asks for repeated texts is a
fingerprint-routed RDD: rows go to partitions by xxhash, where collision chains keep
each full text with its smallest id and emit the rows of other ids. Counts of masks
are merged by source, and every order of the filters is read off them.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from boxquery.llm._common import arrow_schema, blocks, table, written

MIN_WORDS = 200
DISTINCT_PERCENT = 50
CAPITAL_PERCENT = 2
LETTERS = "ABCDE"
COPY = LETTERS.index("E")
#: Fingerprints that are sent to every task at most (8 bytes each); more meet their rows by a shuffle.
BROADCAST_FINGERPRINTS = 1_000_000

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SIGN = re.compile(r"[#$%&*|]")
_CAPITALS = bytes(range(0x41, 0x5B))

#: Rows on their way: those of doc_id and part with this mask are ``n``; open ones still have a text to be compared.
SCHEMA = "open boolean, doc_id long, part string, mask int, n long, fp long, lane int, text string"
RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def text_mask(text: str) -> int:
    """Bits of the filters A to D that fail."""
    words, raw = _WORD.findall(text), text.encode()
    failed = (
        len(words) < MIN_WORDS,
        100 * len(set(words)) < DISTINCT_PERCENT * len(words),
        100 * (len(raw) - len(raw.translate(None, _CAPITALS))) > CAPITAL_PERCENT * len(text),
        _SIGN.search(text) is not None,
    )
    return sum(bit << k for k, bit in enumerate(failed))


def _order(doc_id: int | None) -> tuple[bool, int]:
    return doc_id is None, doc_id or 0


class Chains:
    """By fingerprint a chain of entries: full text, smallest id, and how many rows of each part and mask have it."""

    def __init__(self) -> None:
        self.chains: dict[int, list[list]] = {}

    def add(self, fp: int, text: str, doc_id: int | None, held: Counter) -> tuple[int | None, Counter] | None:
        """Take rows in; returns those, if any, that turn out to have a larger id than another of their text."""
        chain = self.chains.setdefault(fp, [])
        for entry in chain:
            if entry[0] == text:
                if _order(doc_id) > _order(entry[1]):
                    return doc_id, held
                if doc_id == entry[1]:
                    entry[2] += held
                    return None
                out = entry[1], entry[2]
                entry[1:] = doc_id, held
                return out
        chain.append([text, doc_id, held])
        return None

    def entries(self) -> Iterator[tuple[int, str, int | None, Counter]]:
        for fp, chain in self.chains.items():
            for text, doc_id, held in chain:
                yield fp, text, doc_id, held


def _copies(out: tuple[int | None, Counter] | None) -> Iterator[tuple]:
    """Rows of a text that a smaller id has."""
    if out is not None:
        for (part, mask), n in out[1].items():
            yield False, out[0], part, mask | 1 << COPY, n, None, None, None


def _routed(rows: DataFrame, lanes: int | None) -> DataFrame:
    """Send the open rows to partitions by fingerprint (and lane), compare there, write what came out."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def chained(records: Iterable[tuple[int, Row]]) -> Iterator[tuple]:
        chains = Chains()
        for _, r in records:
            yield from _copies(chains.add(r.fp, r.text, r.doc_id, Counter({(r.part, r.mask): r.n})))
        for fp, text, doc_id, held in chains.entries():
            for (part, mask), n in held.items():
                yield (False, doc_id, part, mask, n, None, None, None) if lanes is None else (True, doc_id, part, mask, n, fp, None, text)

    key = (lambda r: r.fp) if lanes is None else (lambda r: r.fp + r.lane % lanes * 0x9E3779B9)
    routed: RDD = rows.where("open").rdd.keyBy(key).partitionBy(parts, lambda k: k)
    return written(spark.createDataFrame(routed.mapPartitions(chained), SCHEMA), "routed")


def masks(docs: DataFrame, part: str = "source") -> DataFrame:
    """doc_id, part, mask and n: how many rows of the id and the part have the mask.

    Texts whose fingerprint occurs once have no copy. Of the others a task keeps each text once, with its
    smallest id; tasks' texts meet in lanes, the square root of their number, and the lanes' at
    last, so that no partition gets more of a text than that root, however many rows have it. Full texts are
    compared throughout.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.xxhash64(text).alias("fp"))
    often = written(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fp", F.lit(True).alias("often")), "repeated-fingerprints")
    if often.count() <= BROADCAST_FINGERPRINTS:
        often = F.broadcast(often)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        schema, lane, chains = arrow_schema(SCHEMA), TaskContext.get().partitionId(), Chains()

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

        for batch in blocks(batches):
            found = []
            for doc_id, text, part, fp, often in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                mask = text_mask(text)
                if often:
                    found += _copies(chains.add(fp, text, doc_id, Counter({(part, mask): 1})))
                else:
                    found.append((False, doc_id, part, mask, 1, None, None, None))
            if found:
                yield batch_of(found)
        for fp, text, doc_id, held in chains.entries():
            yield batch_of([(True, doc_id, part, mask, n, fp, lane, text) for (part, mask), n in held.items()])

    first = written(rows.join(often, "fp", "left").select("doc_id", "text", "part", "fp", "often").mapInArrow(run, SCHEMA), "masks")
    tasks = first.where("open").agg(F.max("lane")).first()[0]
    lanes = _routed(first, math.isqrt(tasks or 0) + 1)
    last = _routed(lanes, None)
    settled = [f.where("not open").select("doc_id", "part", "mask", "n") for f in (first, lanes, last)]
    return settled[0].unionByName(settled[1]).unionByName(settled[2])


_SETS = range(1 << len(LETTERS))
#: Row (set, filter): the masks that fail the filter and none of the set.
_FIRST = np.array([[[m >> f & 1 and not m & s for m in _SETS] for f in range(len(LETTERS))] for s in _SETS], np.int64)
#: How many orders have just this set before a filter outside it.
_BEFORE = np.array([math.factorial(s.bit_count()) * math.factorial(max(0, len(LETTERS) - 1 - s.bit_count())) for s in _SETS])
ORDERS = ["".join(p) for p in itertools.permutations(LETTERS)]


def audit_rows(part: str, vector: np.ndarray) -> Iterator[tuple]:
    """All orders and steps of a part; ``vector``: documents, good ones and toxic ones by mask."""
    hit = _FIRST @ vector  # set, filter, kind
    fails = hit[0, :, 0]
    shapley = [int(sum(_BEFORE[s] * hit[s, f, 0] for s in _SETS if not s >> f & 1)) for f in range(len(LETTERS))]
    for order in ORDERS:
        kept, before = int(vector[:, 0].sum()), 0
        for step, letter in enumerate(order, 1):
            f = LETTERS.index(letter)
            removed, good, toxic = map(int, hit[before, f])
            kept -= removed
            yield part, order, step, kept, removed, int(fails[f]) - removed, int(vector[1 << f, 0]), good, toxic, shapley[f]
            before |= 1 << f


def filter_audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """One row a part, order of the five filters and step.

    A null text is empty, a null part the empty string. A null id comes after all others
    and has no label; a document that any of its label rows calls good (toxic) is. Rows that
    repeat count each and are no copies of one another, having one id. Columns of other
    names are ignored; an empty table has no parts. Very long texts are taken whole.
    """
    found = masks(docs, part).groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"), F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic"))
    rows = found.join(marks, "doc_id", "left").select("part", "mask", "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))

    def grown(vector: np.ndarray, r: Row) -> np.ndarray:
        vector[r.mask] += (r.n, r.n * r.good, r.n * r.toxic)
        return vector

    vectors = rows.rdd.keyBy(lambda r: r.part).combineByKey(lambda r: grown(np.zeros((len(_SETS), 3), np.int64), r), grown, np.add)
    return docs.sparkSession.createDataFrame(vectors.flatMap(lambda kv: audit_rows(*kv)), RESULT)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE_SQL = r"""
WITH RECURSIVE docs AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
bits AS (SELECT doc_id, part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t),
  regexp_matches(t, '[#$%&*|]'), doc_id > min(doc_id) OVER (PARTITION BY t)] AS f FROM docs),
marked AS (SELECT b.part, f, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic FROM bits b
  LEFT JOIN (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1) l ON l.doc_id = b.doc_id),
counts AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM marked GROUP BY ALL),
orders AS (SELECT '' AS o UNION ALL SELECT o || c FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c) WHERE NOT contains(o, c)),
steps AS (SELECT o AS filter_order, unnest(range(1, 6)) AS step FROM orders WHERE length(o) = 5),
read AS (SELECT part, n, good, toxic, filter_order, step, f[ascii(filter_order[step]) - 64] AS fails,
  len(list_filter(range(1, step), lambda k: f[ascii(filter_order[k]) - 64])) > 0 AS gone, len(list_filter(f, lambda x: x)) = 1 AS alone FROM counts, steps),
res AS (SELECT part, filter_order, step::INT AS step, filter_order[step] AS letter,
  coalesce(sum(n) FILTER (WHERE NOT gone AND NOT fails), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE NOT gone AND fails), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (WHERE gone AND fails), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (WHERE fails AND alone), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (WHERE NOT gone AND fails), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (WHERE NOT gone AND fails), 0)::BIGINT AS toxic_lost
  FROM read GROUP BY part, filter_order, step)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM res
"""
