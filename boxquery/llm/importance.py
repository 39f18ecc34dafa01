"""Importance resampling towards a target distribution, with a dictionary of distinct features.

Feature strings are counted in each block of documents and then globally; each distinct
string is hashed once, in the dictionary; buckets are aggregated from it; and the gains of the
buckets go back, by string and block, to the per-document feature counts of the blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boxquery.llm._common import blocks, drop_written, table, text_bytes, written
from boxquery.llm._text import ALNUM, LOWER, words

MAX_WORDS = 1
BUCKETS = 10_000
SEED = 2024
MIN_WORDS = 20
DRAW_PERCENT = 10
#: Bytes of text whose counts make one row.
BLOCK_BYTES = 1 << 23

_BLOCK = "block long, ids array<long>, n_words array<long>, n_features array<long>, pairs int, packed binary, strings array<string>, totals array<long>"


def ngrams(data: np.ndarray, offsets: np.ndarray, most: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Text and string of every run of 1 to ``most`` words, and the number of words of each text."""
    low = LOWER[data]
    starts, ends, at = words(low, offsets, ALNUM)
    sizes, owner = np.diff(at), np.repeat(np.arange(len(at) - 1), np.diff(at))
    # the words' bytes, one after another: what parts them is ASCII, so each is UTF-8 by itself
    ends_of = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    single = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends_of), pa.py_buffer(low[ALNUM[low]]))
    owners, strings, run = [owner], [single], single
    for n in range(2, most + 1):
        run = pc.binary_join_element_wise(run[: max(0, len(single) - n + 1)], single[n - 1 :], pa.scalar(" ", pa.large_string()))
        whole = owner[n - 1 :] == owner[: max(0, len(owner) - n + 1)]
        owners.append(owner[n - 1 :][whole])
        strings.append(run.filter(pa.array(whole)))
    return np.concatenate(owners), pa.concat_arrays(strings), sizes


def feature_blocks(docs: DataFrame, id: str, most: int = MAX_WORDS) -> DataFrame:
    """Feature counts, written: a row holds the documents of a block, its distinct strings and the counts by document.

    A count belongs to the key document * strings + string, both by number within the block;
    ``packed`` holds the ``pairs`` many differences of the sorted keys, then the counts, compressed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in blocks(batches, BLOCK_BYTES):
            owner, strings, sizes = ngrams(*text_bytes(batch.column(1)), most)
            coded = pc.dictionary_encode(strings)
            code, n = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)
            key, count = np.unique(owner * n + code, return_counts=True)
            packed = pa.compress(np.concatenate([np.diff(key, prepend=0), count]).astype("<i8").tobytes(), "zstd", asbytes=True)
            one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind) if isinstance(values, np.ndarray) else values.cast(kind))
            columns = [
                pa.array([block], pa.int64()), one(batch.column(0), pa.int64()), one(sizes, pa.int64()), one(np.bincount(owner, minlength=batch.num_rows), pa.int64()),
                pa.array([len(key)], pa.int32()), pa.array([packed], pa.binary()), one(coded.dictionary, pa.string()), one(np.bincount(code, minlength=n), pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[part.split()[0] for part in _BLOCK.split(", ")])
            block += 1

    return written(docs.select(F.col(id).cast("long"), "text").mapInArrow(run, _BLOCK), "feature-blocks")


def dictionary(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """feature, bucket and how often the string stands in the source (s) and in the target (t); written."""
    each = lambda df, s, t: df.select(F.explode(F.arrays_zip("strings", "totals")).alias("f")).select(F.col("f.strings").alias("feature"), (F.col("f.totals") * s).alias("s"), (F.col("f.totals") * t).alias("t"))
    counted = each(source, 1, 0).unionByName(each(target, 0, 1)).groupBy("feature").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    return written(counted.select("feature", F.pmod(F.crc32(F.encode("feature", "UTF-8")), F.lit(buckets)).cast("int").alias("bucket"), "s", "t"), "feature-dictionary")


def bucket_gains(features: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket and gain, floor(1000 * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets)))); at most ``buckets`` rows."""
    per = features.groupBy("bucket").agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t"))
    total = per.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))  # one row
    ratio = (F.col("t") + 1) * (F.col("all_s") + buckets) / ((F.col("s") + 1) * (F.col("all_t") + buckets))
    return per.join(F.broadcast(total)).select("bucket", F.floor(F.lit(1000.0) * F.ln(ratio)).alias("gain"))


def weights(docs: DataFrame, target: DataFrame, id: str = "doc_id", target_id: str = "item_id", most: int = MAX_WORDS, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features and weight, the floored mean gain over all features of the document (none: 0)."""
    source, wanted = feature_blocks(docs, id, most), feature_blocks(target, target_id, most)
    features = dictionary(source, wanted, buckets)
    gains = features.where("s > 0").join(F.broadcast(bucket_gains(features, buckets)), "bucket").select("feature", "gain")
    # a string is once in a block, so a very frequent one has as many rows as there are blocks
    strings = source.select("block", F.posexplode("strings").alias("k", "feature")).join(gains, "feature")
    # a gain and its string's number in the block as one number
    back = strings.groupBy("block").agg(F.collect_list(F.shiftleft(F.col("k").cast("long"), 32) + F.col("gain") + F.lit(1 << 31)).alias("gains"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ids, n_words, n_features = (batch.column(c)[r].values for c in range(3))
                pairs, packed, gains = batch.column(3)[r].as_py(), batch.column(4)[r].as_py(), batch.column(5)[r].values
                coded = np.zeros(0, np.int64) if gains is None else gains.to_numpy()
                gain = np.zeros(max(1, len(coded)), np.int64)
                gain[coded >> 32] = (coded & 0xFFFFFFFF) - (1 << 31)
                both = np.frombuffer(pa.decompress(packed, 16 * pairs, "zstd"), "<i8")
                key = np.cumsum(both[:pairs])
                total = np.concatenate([[0], np.cumsum(gain[key % len(gain)] * both[pairs:])])
                at, n = np.searchsorted(key, np.arange(len(ids) + 1) * len(gain)), n_features.to_numpy()
                weight = (total[at[1:]] - total[at[:-1]]) // np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays([ids, n_words, n_features, pa.array(weight, pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])

    rows = source.join(back, "block", "left").select("ids", "n_words", "n_features", "pairs", "packed", "gains")
    out = written(rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long"), "weights")
    drop_written(source, wanted, features)
    return out


def with_noise(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """``score``: weight plus floor(1000 * Gumbel noise) of the seed and the id alone, so a rerun draws the same."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(hashed, 1, 8), 16, 10).cast("double")
    return rows.withColumn("score", F.col("weight") + F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0)))))


def drawn(rows: DataFrame, percent: int = DRAW_PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """``rows`` (written) with rank: 1, 2, 3... of the floor(percent * N / 100) highest scores of the N rows with enough words.

    Scores are counted first, in spans of 256 and then one by one, which gives the rank before each score; rows
    are sorted only within one score. There are at most some 10**5 scores (logarithms of
    64-bit counts, in thousandths), and one holds no more than 0.04 % of different ids, the noise's density.
    """
    able = F.col("n_words") >= min_words
    span = F.floor(F.col("score") / 256)
    counts = rows.where(able).groupBy("score").agg(F.count(F.lit(1)).alias("n")).withColumn("span", span)
    spans = counts.groupBy("span").agg(F.sum("n").alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    higher = F.coalesce(F.sum("n").over(W.orderBy(F.desc("span")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # some hundreds of rows
    take = F.floor(F.sum("n").over(W.partitionBy()) * percent / 100)
    spans = spans.select("span", higher.alias("higher"), take.alias("take"))
    ahead = counts.join(F.broadcast(spans), "span").select("score", (F.col("higher") + before(W.partitionBy("span"))).alias("ahead"), "take").where("ahead < take")
    ahead = F.broadcast(written(ahead, "ranks-ahead"))
    place = F.col("ahead") + F.row_number().over(W.partitionBy("score").orderBy(F.asc_nulls_last("doc_id")))
    top = rows.where(able).join(ahead, "score").withColumn("rank", place).withColumn("rank", F.when(F.col("rank") <= F.col("take"), F.col("rank")).cast("long")).drop("ahead", "take")
    rest = rows.where(~able).unionByName(rows.where(able).join(ahead, "score", "left_anti").select(rows.columns)).withColumn("rank", F.lit(None).cast("long"))
    return top.select(*rows.columns, "rank").unionByName(rest.select(*rows.columns, "rank"))


def resample(docs: DataFrame, target: DataFrame, id: str = "doc_id", target_id: str = "item_id", most: int = MAX_WORDS, buckets: int = BUCKETS, seed: int = SEED, percent: int = DRAW_PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """One row a document: doc_id, n_words, n_features, weight, score, rank (null: not drawn).

    Null and empty texts have no features and weight 0; so has a table without target texts
    no gain but that of its own counts. Rows that repeat are rows each, with one score; equal rows part their
    ranks among them. A null id draws by the empty text and comes last among ties. Other columns
    are ignored, whatever their names. A very long text is a block of its own.
    """
    return drawn(written(with_noise(weights(docs, target, id, target_id, most, buckets), seed), "scores"), percent, min_words)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


ORACLE_SQL = r"""
WITH RECURSIVE fold AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents, fold),
bw AS (SELECT regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark, fold),
df AS (SELECT unnest(w) AS f, doc_id FROM dw), bf AS (SELECT unnest(w) AS f FROM bw),
n AS (SELECT f, sum(s) AS s, sum(t) AS t FROM (SELECT f, 1 AS s, 0 AS t FROM df UNION ALL SELECT f, 0, 1 FROM bf) GROUP BY f),
tb AS (SELECT i, i::BIGINT AS c, 0 AS k FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM tb WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS c FROM tb WHERE k = 8),
hx AS (SELECT n.*, hex(encode(f)) AS h FROM n),
cr AS (SELECT f, s, t, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(h) // 2), lambda k: ('0x' || substr(h, k * 2 + 1, 2))::BIGINT)), lambda a, b: xor(a // 256, tab.c[(xor(a, b) & 255) + 1])), 4294967295) % 10000 AS b FROM hx, tab),
bk AS (SELECT b, sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t FROM cr GROUP BY b),
gn AS (SELECT b, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM bk) + 10000) / ((s + 1) * ((SELECT sum(t) FROM bk) + 10000))))::BIGINT AS g FROM bk),
wt AS (SELECT doc_id, floor(sum(g) / count(*))::BIGINT AS weight FROM df JOIN cr USING (f) JOIN gn USING (b) GROUP BY doc_id),
sc AS (SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM dw LEFT JOIN wt USING (doc_id)),
rk AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM sc WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 10 * n // 100 THEN r END AS rank FROM sc LEFT JOIN rk USING (doc_id)
"""
