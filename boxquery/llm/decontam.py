"""Benchmark decontamination by suffix arrays over the training text.

Each run of training documents is a shard. Its word suffixes that may match (all
words of their first window occur in some item) are sorted into a suffix array;
every suffix of every benchmark item is looked up in it by binary search. Item
windows that follow each other in the item and in the document are one match, as
long as both agree; of each document and item the longest is kept with its places.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxquery.llm._common import blocks, table, text_bytes
from boxquery.llm._text import ALNUM, BASES, LOWER, prefix_hash, span_hash, words

WINDOW = 10
#: Words of benchmark items that are broadcast at once; a larger benchmark is taken in blocks.
BLOCK_WORDS = 4_000_000


@dataclass
class Items:
    """One block of the benchmark: the distinct words, and the items' words as numbers."""

    vocabulary: np.ndarray
    words: np.ndarray
    starts: np.ndarray  # first word of each suffix that is a window
    begins: np.ndarray  # the same, counted within the item
    lengths: np.ndarray
    owner: np.ndarray
    ids: list[str]


def _hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = LOWER[data]
    starts, ends, at = words(data, offsets, ALNUM)
    return span_hash(prefix_hash(data, BASES[0]), starts, ends, BASES[0]), at


def prepare(ids: list[str], texts: list[str | None], window: int = WINDOW) -> Items:
    hashes, at = _hashed_words(*text_bytes(pa.array(texts, pa.string())))
    vocabulary, numbers = np.unique(hashes, return_inverse=True)
    sizes = np.diff(at)
    counts = np.maximum(sizes - window + 1, np.minimum(sizes, 1))
    owner = np.repeat(np.arange(len(sizes)), counts)
    starts = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + at[:-1][owner]
    return Items(vocabulary, numbers.astype(np.int64), starts, starts - at[:-1][owner], np.minimum(sizes, window)[owner], owner, ids)


class Shard:
    """A suffix array of a shard's words, by prefix doubling to the depth of a window.

    ``numbers`` are the words as numbers (-1: in no item); suffixes of other words are left out.
    """

    def __init__(self, numbers: np.ndarray, ends: np.ndarray, least: int):
        known = numbers >= 0
        breaks = np.where(known, len(numbers), np.arange(len(numbers)))
        reach = np.minimum.accumulate(breaks[::-1])[::-1]
        self.room = np.minimum(reach, ends) - np.arange(len(numbers))  # words of a suffix before its end or an unknown word
        inside = np.zeros(len(numbers) + 1, np.int64)
        at = np.flatnonzero(self.room >= least)
        np.add.at(inside, at, 1)
        np.add.at(inside, at + self.room[at], -1)
        self.place = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
        self.room = self.room[self.place]
        self.ranks = {1: numbers[self.place]}
        self.keys: dict[int, np.ndarray] = {}

    def _pairs(self, ranks: np.ndarray, shift: int) -> np.ndarray:
        later = np.full(len(ranks), -1, np.int64)
        later[: max(len(ranks) - shift, 0)] = ranks[shift:]
        return (ranks << 31) | (later + 1)

    def rank(self, depth: int) -> np.ndarray:
        """Ranks of the suffixes by their first ``depth`` words (only of use where there is room)."""
        if depth not in self.ranks:
            half = 1 << ((depth - 1).bit_length() - 1)
            self.keys[depth], self.ranks[depth] = np.unique(self._pairs(self.rank(half), depth - half), return_inverse=True)
        return self.ranks[depth]

    def _search(self, items: Items, depth: int, cache: dict[int, np.ndarray]) -> np.ndarray:
        """The rank of each item suffix's first ``depth`` words among the shard's, or -1."""
        if depth == 1:
            return items.words
        if depth not in cache:
            self.rank(depth)
            half = 1 << ((depth - 1).bit_length() - 1)
            near = self._search(items, half, cache)
            far = np.full(len(near), -1, np.int64)
            far[: max(len(near) - (depth - half), 0)] = near[depth - half :]
            keys, want = self.keys[depth], (near << 31) | (far + 1)
            at = np.minimum(np.searchsorted(keys, want), max(len(keys) - 1, 0))
            cache[depth] = np.where((near >= 0) & (far >= 0) & (keys[at] == want if len(keys) else False), at, -1)
        return cache[depth]

    def matches(self, items: Items) -> tuple[np.ndarray, np.ndarray]:
        """Word positions in the shard and numbers of the item suffixes, of all occurrences of item windows."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        cache: dict[int, np.ndarray] = {}
        for depth in np.unique(items.lengths):
            depth = int(depth)
            mine = np.flatnonzero(items.lengths == depth)
            ranks = self.rank(depth)
            fits = np.flatnonzero(self.room >= depth)
            order = fits[np.argsort(ranks[fits], kind="stable")]  # the suffix array at this depth
            want = self._search(items, depth, cache)[items.starts[mine]]
            low, high = np.searchsorted(ranks[order], want, "left"), np.searchsorted(ranks[order], want, "right")
            n = np.where(want >= 0, high - low, 0)
            which = np.repeat(np.arange(len(mine)), n)
            at = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[which]]
            found.append((self.place[at], mine[which]))
        if not found:
            return (np.zeros(0, np.int64),) * 2
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


@dataclass
class Found:
    """What one block of items has in a run of texts; of each text a list."""

    spans: list[np.ndarray]  # the merged spans (start, end, ...) of its hit words
    longest: list[list[tuple[str, int, int, int]]]  # item, its word, the text's word, length: the longest match with each item


def _fresh(*keys: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from the row before."""
    out = np.zeros(len(keys[0]), bool)
    out[:1] = True
    for key in keys:
        out[1:] |= key[1:] != key[:-1]
    return out


def extended(start: np.ndarray, suffix: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal matches: positions, item numbers, the items' words, lengths.

    Windows on one diagonal, each a word after the other, are one match; it can grow neither way.
    """
    item, begin = items.owner[suffix], items.begins[suffix]
    order = np.lexsort((start, start - begin, item))
    start, item, begin, length = start[order], item[order], begin[order], items.lengths[suffix][order]
    first = np.flatnonzero(_fresh(item, start - begin, start - np.arange(len(start))))
    last = np.append(first[1:], len(start))[: len(first)] - 1
    return start[first], item[first], begin[first], start[last] - start[first] + length[last]


def find(hashes: np.ndarray, at: np.ndarray, items: Items) -> Found:
    """``hashes``: the texts' words one after the other; ``at``: where each text's begin, and the end."""
    texts = len(at) - 1
    out = Found([np.zeros(0, np.int64)] * texts, [[] for _ in range(texts)])
    if not len(items.starts) or not len(hashes):
        return out
    near = np.minimum(np.searchsorted(items.vocabulary, hashes), len(items.vocabulary) - 1)
    numbers = np.where(items.vocabulary[near] == hashes, near, -1)
    owner = np.repeat(np.arange(texts), np.diff(at))
    shard = Shard(numbers, at[1:][owner], int(items.lengths.min()))
    start, item, begin, length = extended(*shard.matches(items), items)
    depth = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(depth, start, 1)
    np.add.at(depth, start + length, -1)
    hit = np.cumsum(depth[:-1]) > 0
    text = owner[start]
    for k in np.unique(text):
        out.spans[k] = np.flatnonzero(np.diff(np.concatenate([[False], hit[at[k] : at[k + 1]], [False]]).astype(np.int8)))
    order = np.lexsort((begin, start, -length, item, text))
    for j in order[_fresh(text[order], item[order])]:
        out.longest[text[j]].append((items.ids[item[j]], int(begin[j]), int(start[j] - at[text[j]]), int(length[j])))
    return out


def benchmark_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[tuple[Items, bool]]:
    """The items in blocks of about ``block_words`` words, each small enough to be broadcast; and whether more follow."""
    texts = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    length = texts.agg(F.sum(F.coalesce(F.length("text"), F.lit(0)))).first()[0] or 0
    count = 1 + length // (block_words * 4)
    for k in range(count):
        rows = texts.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k).collect()
        yield prepare([r["item_id"] or "" for r in rows], [r["text"] for r in rows]), k < count - 1


MATCH = pa.struct([("item", pa.string()), ("item_start", pa.int64()), ("start", pa.int64()), ("length", pa.int64())])


def contamination(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, ``spans`` of hit words (start, end, start, ...), ``items`` (ids as text, sorted) and ``matches``.

    ``matches`` has each of the items once: item, item_start, start and length, in words, of the longest
    verbatim match of the two; of equally long ones the first in the document, then in the item.

    Null or empty documents have no words. Items without words match nothing; items of
    one id count once; a null id is the empty text. Rows that repeat are answered each. Texts of any
    length are one document in one task; other columns of the documents, whatever their names, are left out.
    A benchmark of several blocks is looked up block by block; words are hashed for the first of them, hashes
    and answers travel with the rows, and spans are merged as they come.
    """
    spark = docs.sparkSession
    empty = lambda kind: F.array().cast(f"array<{kind}>")
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", empty("long").alias("words"), F.lit(0).cast("long").alias("n_words"), empty("long").alias("spans"), empty("struct<item:string,item_start:long,start:long,length:long>").alias("matches"))
    schema = "doc_id long, text string, words array<long>, n_words long, spans array<long>, matches array<struct<item:string,item_start:long,start:long,length:long>>"
    for k, (items, more) in enumerate(benchmark_blocks(benchmark, block_words)):
        sent = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, first=k == 0, more=more) -> Iterator[pa.RecordBatch]:
            mine = sent.value
            for batch in blocks(batches):
                if first:
                    hashes, at = _hashed_words(*text_bytes(batch.column(1)))
                else:
                    at = batch.column(2).offsets.to_numpy().astype(np.int64)
                    hashes, at = batch.column(2).values.to_numpy()[at[0] : at[-1]].view(np.uint64), at - at[0]
                found = find(hashes, at, mine)
                spans = [_merged(a, b) for a, b in zip(batch.column(4).to_pylist(), found.spans, strict=True)]
                matches = [_longest(a, b) for a, b in zip(batch.column(5).to_pylist(), found.longest, strict=True)]
                none = pa.nulls(len(batch), pa.string())
                kept = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(hashes.view(np.int64))) if more else pa.nulls(len(batch), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), none, kept, pa.array(np.diff(at), pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(matches, pa.list_(MATCH))], names=batch.schema.names)

        out = out.mapInArrow(run, schema)
    return out.select("doc_id", "n_words", "spans", F.transform("matches", lambda m: m["item"]).alias("items"), "matches")


def _longest(had: list[dict], found: list[tuple[str, int, int, int]]) -> list[dict]:
    """One match an item, the longest, the items in order."""
    best = {m["item"]: m for m in had}
    for row in found:
        new = dict(zip(("item", "item_start", "start", "length"), row, strict=True))
        old = best.setdefault(row[0], new)
        best[row[0]] = min(old, new, key=lambda m: (-m["length"], m["start"], m["item_start"]))
    return [best[i] for i in sorted(best)]


def longest_by_item(found: DataFrame) -> DataFrame:
    """Per item that occurs: item, n_docs (rows), and doc_id, start, item_start and length of its longest match in all documents.

    ``found``: what ``contamination`` gives. Of equally long matches the one of the smallest doc_id (null last) and first place stands.
    """
    each = found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")
    order = F.struct(-F.col("length"), F.col("doc_id").isNull(), "doc_id", "start", "item_start")
    best = each.groupBy("item").agg(F.count(F.lit(1)).alias("n_docs"), F.min_by(F.struct("doc_id", "start", "item_start", "length"), order).alias("b"))
    return best.select("item", "n_docs", "b.*")


def _merged(a: list[int], b: np.ndarray) -> list[int]:
    """Two lists of disjoint spans as one."""
    if not a or not len(b):
        return list(a) or list(b)
    out: list[int] = []
    for start, end in sorted([*zip(a[::2], a[1::2], strict=True), *zip(b[::2], b[1::2], strict=True)]):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], int(end))
        else:
            out += [int(start), int(end)]
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents, all columns, in which no item window occurs."""
    where = docs.columns.index("text")
    for items, _ in benchmark_blocks(benchmark, block_words):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in blocks(batches):
                found = find(*_hashed_words(*text_bytes(batch.column(where))), sent.value)
                yield batch.filter(pa.array([not len(x) for x in found.spans], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)
    best = F.array_min(F.transform("matches", lambda m: F.struct((-m["length"]).alias("n"), m["start"].alias("start"), m["item"].alias("item"), m["item_start"].alias("item_start"))))
    got = got.withColumn("best", best)
    longest = [F.coalesce(-F.col("best.n"), F.lit(0)).cast("long").alias("longest"), F.col("best.start").alias("longest_start"), F.col("best.item").alias("longest_item"), F.col("best.item_start").alias("longest_item_start")]
    return got.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort("items")).cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), *longest)


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bl AS (SELECT *, least(len(ws), 10) AS k FROM b WHERE len(ws) > 0),
bw AS (SELECT DISTINCT item_id, k, i AS j, array_to_string(ws[i:i + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(ws) - k + 2)) AS i FROM bl)),
ks AS (SELECT DISTINCT k FROM bl),
dw AS (SELECT id, i, k, array_to_string(ws[i:i + k - 1], ' ') AS g FROM (SELECT id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, ks WHERE len(ws) >= k)),
hits AS (SELECT id, i, dw.k, item_id, j FROM dw JOIN bw ON dw.g = bw.g AND dw.k = bw.k),
pos AS (SELECT id, count(DISTINCT p) AS n_hit FROM (SELECT id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY id),
runs AS (SELECT id, item_id::VARCHAR AS item, min(i) AS i, min(j) AS j, max(i) - min(i) + k AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY id, item_id, k, i - j ORDER BY i) AS r FROM hits) GROUP BY id, item_id, k, i - j, r),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, i, item, j) = 1),
its AS (SELECT id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS joined FROM (SELECT DISTINCT id, item_id::VARCHAR AS s FROM hits) GROUP BY id)
SELECT w.id AS doc_id, len(w.ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  coalesce(best.n, 0)::BIGINT AS longest, (best.i - 1)::BIGINT AS longest_start, best.item AS longest_item, (best.j - 1)::BIGINT AS longest_item_start
FROM w LEFT JOIN pos ON pos.id = w.id LEFT JOIN its ON its.id = w.id LEFT JOIN best ON best.id = w.id
"""
