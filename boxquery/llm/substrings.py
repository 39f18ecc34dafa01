"""Substring dedup by seed and extend, on words.

Documents meet on winnowed seeds of a few words. A seed extends to all windows of
the threshold length around it that chose it; equal extensions are collapsed, and
where extensions of one seed differ the windows are matched one by one, so that the
match grows left and right as far as it goes. What stands later is removed; the runs
that remain marked are the maximal repeats over the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxquery.llm import anchors
from boxquery.llm._common import blocks, table, text_bytes
from boxquery.llm._text import BASES, SPACE, WINDOW_BASES, covered, prefix_hash, rolling_hash, span_hash, words

WINDOW = 20
SEED = 5
#: Bytes of spans that are compared at once, and classes of one anchor at most; an anchor of more has its windows matched as rows.
GROUP_BYTES = 1 << 20
GROUP_CLASSES = 20_000


def _kernel(window: int, seed: int) -> anchors.Kernel:
    def run(data: np.ndarray, offsets: np.ndarray) -> tuple:
        starts, ends, at = words(data, offsets, ~SPACE)
        hashes = span_hash(prefix_hash(data, BASES[0]), starts, ends, BASES[0])
        base = WINDOW_BASES[0]
        prefix = prefix_hash(hashes, base)
        seeds = rolling_hash(prefix, seed, base)

        def signature(a: np.ndarray, z: np.ndarray) -> np.ndarray:
            return span_hash(prefix, a, z, base)

        def contents(start: np.ndarray, end: np.ndarray) -> pa.Array:
            n = end - start - (window - 1)
            ends_at = np.cumsum(n)
            each = np.arange(n.sum()) - np.repeat(ends_at - n, n) + np.repeat(start, n)
            return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends_at]).astype(np.int32)), pa.array(span_hash(prefix, each, each + window, base).view(np.int64)))

        return at, seeds, signature, contents

    return run


def _in_groups(rows: DataFrame, window: int) -> DataFrame:
    """id, th, start, end (words) of the windows of an anchor that stand in another of its spans before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in anchors.whole_groups(batches, GROUP_BYTES):
            anchor, ids, hashes, pos = (part.column(c).to_numpy() for c in ("anchor", "id", "th", "pos"))
            content = part.column("content").combine_chunks()
            sizes = np.diff(content.offsets.to_numpy())
            row = np.repeat(np.arange(len(pos)), sizes)
            at = pos[row].astype(np.int64) + np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            w = content.values.to_numpy()
            w = w[content.offsets[0].as_py() : content.offsets[-1].as_py()]
            order = np.lexsort((at, hashes[row], ids[row], w, anchor[row]))
            again = np.zeros(len(row), bool)
            again[order] = ~anchors._fresh(anchor[row][order], w[order])
            edge = np.flatnonzero(again & anchors._fresh(row, again, at - np.arange(len(at))))
            last = np.flatnonzero(again & np.append(anchors._fresh(row, again, at - np.arange(len(at)))[1:], True))
            take = row[edge]
            yield pa.RecordBatch.from_arrays([pa.array(ids[take]), pa.array(hashes[take]), pa.array(at[edge].astype(np.int32)), pa.array((at[last] + window).astype(np.int32))], names=["id", "th", "start", "end"])

    rows = rows.select("anchor", "id", "th", "pos", "content").repartition("anchor").sortWithinPartitions("anchor")
    return rows.mapInArrow(run, "id long, th long, start int, end int")


def _by_window(rows: DataFrame, window: int) -> DataFrame:
    """The same for anchors of very many differing spans: the windows are rows, with map-side minima."""
    each = rows.select("anchor", "id", "th", "pos", F.posexplode("content").alias("j", "w")).select("anchor", "w", "id", "th", (F.col("pos") + F.col("j")).alias("pos"))
    here = F.struct("id", "th", "pos")
    first = each.groupBy("anchor", "w").agg(F.count(F.lit(1)).alias("c"), F.min(here).alias("first")).where("c > 1").drop("c")
    return each.join(first, ["anchor", "w"]).where(here != F.col("first")).select("id", "th", F.col("pos").alias("start"), (F.col("pos") + window).alias("end"))


def later_windows(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """id, th, start and end (words) of what repeats an earlier window; spans may overlap. ``docs``: keyed."""
    scheme = anchors.Scheme(_kernel(window, seed), window, seed)
    found = anchors.spans(docs, scheme)
    of = anchors.classes(found)
    # of equal spans all but the first go
    again = found.join(of.where("c > 1").select("anchor", "sig", "first"), ["anchor", "sig"])
    start = F.col("pos") + F.when(F.struct("id", "th", "pos") == F.col("first"), F.col("n")).otherwise(0)
    again = again.select("id", "th", start.alias("start"), (F.col("pos") + F.col("n") * F.col("k") + (window - 1)).alias("end"), (F.col("pos") + F.col("n") * F.col("k")).alias("stop")).where("start < stop").drop("stop")
    # of spans that differ the windows are compared
    several = anchors.differing(docs, of, scheme, "array<long>", GROUP_CLASSES)
    return again.unionByName(_in_groups(several.where("not hot"), window)).unionByName(_by_window(several.where("hot"), window))


def _cut(docs: DataFrame, window: int, seed: int, schema: str, each) -> DataFrame:
    """``each`` of the words' starts and ends, what goes, and the text's bytes, for every document."""
    whole = anchors.keyed(docs.select("doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            data, offsets = text_bytes(batch.column(0))
            starts, ends, at = words(data, offsets, ~SPACE)
            raw, out = data.tobytes(), []
            for k, gone in enumerate(batch.column(2)):
                a, z = at[k], at[k + 1]
                spans = gone.values.to_numpy() if gone.is_valid else np.zeros(0, np.int32)
                out.append(each(raw, starts[a:z], ends[a:z], covered(z - a, spans[::2], spans[1::2])))
            fields = [pa.array(x, t.type) for x, t in zip(zip(*out, strict=True), list(_fields(schema))[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.int64()), *fields], schema=pa.schema(list(_fields(schema))))

    return anchors.by_document(whole, later_windows(whole, window, seed).withColumn("far", F.lit(True)), run, schema)


def _fields(schema: str) -> Iterator[pa.Field]:
    kinds = {"long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    for part in schema.split(", "):
        name, kind = part.split()
        yield pa.field(name, kinds[kind])


def substring_dedup(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, ``removed`` (word spans: start, end, start, ...; maximal) and ``kept`` (words joined by a space).

    Null and empty texts have no words. A document is an id with a text: rows that repeat
    both are one document, each answered alike; texts that share an id stand in the order
    of a hash; a null id comes last. Shorter texts than a window lose nothing.
    """

    def each(raw: bytes, starts: np.ndarray, ends: np.ndarray, gone: np.ndarray) -> tuple:
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
        return len(starts), edges.tolist(), b" ".join(raw[a:z] for a, z in zip(starts[~gone], ends[~gone], strict=True)).decode()

    return _cut(docs, window, seed, "doc_id long, n_words long, removed array<long>, kept string", each)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = substring_dedup(table(spark, sf_dir, "documents"))
    gone = F.aggregate(F.transform("removed", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return got.select("doc_id", "n_words", gone.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 19], ' ')) AS g FROM (SELECT *, unnest(range(1, len(ws) - 18)) AS i FROM d WHERE len(ws) >= 20)),
f AS (SELECT g, min((doc_id, i)) AS first FROM w GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM w JOIN f USING (g) WHERE (doc_id, i) <> first),
words AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS k, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
