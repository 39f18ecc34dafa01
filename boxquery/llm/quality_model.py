"""Quality classifier: hashed word n-gram logistic regression, trained with FTRL-Proximal.

Tokens are maximal runs of one class of bytes (letters and non-ASCII, digits,
other printable signs); white space parts them. Features are the hashed distinct
1- and 2-grams of a text's tokens, plus the shape of each letter run (all upper
case, capitalised, other) and the pattern of a token said three times running, each of weight 1/sqrt(number of features), and a bias.
Scores are sparse dot products through the logistic function.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxquery.llm._common import blocks, table, text_bytes
from boxquery.llm._text import BASES, mix, prefix_hash, span_hash

BITS = 18
#: Rows that the model is fitted on at most: those whose doc_id has the smallest crc32.
TRAIN_ROWS = 8_000
#: Passes over the sample: more over a small one, so that about this many steps are made.
STEPS = 60_000
THRESHOLD = 0.3

_KIND = np.full(256, 3, np.uint8)
_KIND[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
_KIND[0x30:0x3A] = 2
_KIND[0x41:0x5B] = 1
_KIND[0x61:0x7B] = 1
_KIND[0x80:] = 1
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers of each text, and the n + 1 offsets of the texts' features."""
    texts = len(offsets) - 1
    if len(data) == 0:
        return np.zeros(0, np.int32), np.zeros(texts + 1, np.int64)
    kind = _KIND[data]
    edge = np.empty(len(data), bool)
    edge[0] = True
    edge[1:] = kind[1:] != kind[:-1]
    edge[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(edge)
    ends = np.append(starts[1:], len(data))
    real = kind[starts] > 0
    starts, ends = starts[real], ends[real]
    owner = np.searchsorted(offsets, starts, side="right") - 1
    hashes = span_hash(prefix_hash(data, BASES[0]), starts, ends, BASES[0])
    caps = np.concatenate([[0], np.cumsum(_UPPER[data])])
    n_caps = caps[ends] - caps[starts]
    shape = np.where(kind[starts] != 1, kind[starts] + 2, np.where((n_caps > 1) & (n_caps * 2 > ends - starts), 1, (n_caps > 0) * 2)).astype(np.uint64)
    same = np.flatnonzero(owner[1:] == owner[:-1])
    thrice = np.flatnonzero((owner[2:] == owner[:-2]) & (hashes[2:] == hashes[1:-1]) & (hashes[1:-1] == hashes[:-2]))
    mask = np.uint64((1 << bits) - 1)
    grams = np.concatenate([
        hashes,
        mix(hashes[same] * np.uint64(3) + hashes[same + 1]),
        mix(shape + np.uint64(1_000_003)),
        mix(shape[same] * np.uint64(64) + shape[same + 1] + np.uint64(2_000_003)),
        mix(np.full(len(thrice), 3_000_003, np.uint64)),
    ]) & mask
    of = np.concatenate([owner, owner[same], owner, owner[same], owner[thrice]]).astype(np.uint64)
    both = np.unique((of << np.uint64(bits)) | grams)
    at = np.searchsorted(both >> np.uint64(bits), np.arange(texts + 1, dtype=np.uint64))
    return (both & mask).astype(np.int32), at.astype(np.int64)


def train_ftrl(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, steps: int = STEPS, alpha: float = 5.0, beta: float = 1.0, l1: float = 0.0, l2: float = 0.01) -> np.ndarray:
    """Weights of per-coordinate FTRL-Proximal on distinct-feature rows; the last weight is the bias."""
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    order = np.random.default_rng(0)
    # the rarer class weighs more, by the root of how much rarer it is
    share = np.clip(labels.mean(), 1e-3, 1 - 1e-3) if len(labels) else 0.5
    weigh = (max(1.0, np.sqrt(share / (1 - share))), max(1.0, np.sqrt((1 - share) / share)))
    for _ in range(min(40, max(4, round(steps / max(len(rows), 1))))):
        for k in order.permutation(len(rows)):
            at = rows[k]
            x = 1.0 / np.sqrt(max(len(at), 1))
            at = np.append(at, size - 1)
            value = np.full(len(at), x)
            value[-1] = 1.0
            zi, ni = z[at], n[at]
            w = np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(ni)) / alpha + l2))
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ value, -35, 35)))
            g = (p - labels[k]) * weigh[int(labels[k])] * value
            z[at] += g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[at] += g * g
    return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))


def scores(weights: np.ndarray, at: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Logistic scores of rows given as distinct features."""
    sizes = np.diff(offsets)
    some = np.flatnonzero(sizes)  # each row is summed by itself, so that its score doesn't depend on its neighbours
    dots = np.zeros(len(sizes))
    dots[some] = np.add.reduceat(weights[at], offsets[some]) / np.sqrt(sizes[some]) if len(some) else 0.0
    return 1.0 / (1.0 + np.exp(-np.clip(dots + weights[-1], -35, 35)))


def held_out(doc_id: str | object = "doc_id") -> object:
    """Whether crc32 of the id's decimal text leaves 0 modulo 5; a null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = TRAIN_ROWS) -> np.ndarray:
    """Weights learnt from at most ``most`` labelled documents that aren't held out.

    The sample is the labelled ids of the smallest crc32: the same at each run, and
    bounded, so it is broadcast and its features come to the driver. Of an id labelled
    twice one label counts (the larger), of an id with several texts that whose features
    come first as bytes. Without any labelled row the weights are 0.
    """
    spark = docs.sparkSession
    chosen = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    chosen = chosen.orderBy(F.crc32(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(most)
    ids = chosen.collect()  # at most `most` rows
    if not ids:
        return np.zeros((1 << BITS) + 1)
    of = {r["doc_id"]: r["y"] for r in ids}
    picked = F.broadcast(spark.createDataFrame([(k,) for k in of], "doc_id long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            at, offsets = features(*text_bytes(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([at[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())], names=["doc_id", "features"])

    got = docs.select("doc_id", "text").join(picked, "doc_id", "left_semi").mapInArrow(run, "doc_id long, features binary").toPandas()
    got = got.sort_values(["doc_id", "features"]).drop_duplicates("doc_id")
    if not len(got):
        return np.zeros((1 << BITS) + 1)
    return train_ftrl([np.frombuffer(x, np.int32) for x in got["features"]], np.array([of[k] for k in got["doc_id"]], float))


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id and score of every whole text; null and empty texts get the bias's score. One narrow pass."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(weights.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value.astype(float)
        for batch in blocks(batches):
            p = scores(w, *features(*text_bytes(batch.column(1))))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(p)], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns, whose score is at least ``threshold``.

    The score is made row by row beside the whole row, so repeated ids keep their own verdict.
    """
    weights = docs.sparkSession.sparkContext.broadcast(fit(docs, labels).astype(np.float32))
    names = docs.columns
    where = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value.astype(float)
        for batch in blocks(batches):
            p = scores(w, *features(*text_bytes(batch.column(where))))
            yield batch.filter(pa.array(p >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
