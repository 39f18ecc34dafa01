"""Near-duplicate documents by MinHash bands and odd sketches.

Documents of one shingle set are one class. A class's first MinHash samples make the
keys of bands. Classes that share a band with another get an odd sketch: all samples
folded into a bitmap of parities, so that the population count of two sketches'
exclusive or estimates how alike two sets are. Of the classes of a bucket (equal keys)
each is first compared with one leader; then, only where a bucket still holds several
components, those outside the main one (the rests) meet all its members, and a pair is
made only if sizes and sketches allow the threshold, in the first band that it shares.
Pairs are confirmed on the whole sets; components come from the confirmed links.

With 36 bands of 4 rows a pair at the threshold of 0.75 shares no band with
probability (1 - 0.75**4)**36, about one in a million.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boxquery.llm import anchors
from boxquery.llm._common import blocks, table, text_bytes, written
from boxquery.llm._text import BASES, LOWER, SPACE, WINDOW_BASES, mix, prefix_hash, span_hash, window_starts, words
from boxquery.llm.components import components

SHINGLE = 5
PERCENT = 75
BANDS = 36
ROWS = 4
#: Samples and bits of a sketch. At 75 % about 806 of 4096 bits differ, with a deviation of about 31.
SAMPLES = 2048
SKETCH_LONGS = 64
#: Pairs whose sketches differ in more bits are passed over: four deviations beyond the threshold.
SKETCH_MOST = 930
#: Members of a bucket's main component, about, that its rests meet before they meet all.
LEADERS = 4
#: Rests that a bucket compares with all its members; a bucket of more is parted by a second band first.
RESTS = 2000

_RANDOM = np.random.default_rng(20_240_229)
_FACTORS = _RANDOM.integers(0, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _RANDOM.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct hashes of each text's shingles, and the n + 1 offsets of the texts."""
    data = LOWER[data]
    starts, ends, at = words(data, offsets, ~SPACE)
    prefix = prefix_hash(span_hash(prefix_hash(data, BASES[0]), starts, ends, BASES[0]), WINDOW_BASES[0])
    first, end, owner = window_starts(at, k, short=True)
    hashes = span_hash(prefix, first, end, WINDOW_BASES[0])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])])[: len(hashes)]
    return hashes[new], np.searchsorted(owner[new], np.arange(len(offsets)))


def samples(shingles: np.ndarray, count: int = SAMPLES) -> np.ndarray:
    """The first MinHash samples of one set that isn't empty."""
    out = np.full(count, np.iinfo(np.uint64).max, np.uint64)
    step = max(1, (1 << 17) // count)
    for i in range(0, len(shingles), step):
        np.minimum(out, (shingles[i : i + step, None] * _FACTORS[:count] + _OFFSETS[:count]).min(axis=0), out=out)
    return out


def band_keys(sample: np.ndarray) -> np.ndarray:
    key = np.arange(BANDS, dtype=np.uint64)
    for row in sample.reshape(BANDS, ROWS).T:
        key = mix(key + row)
    return key


def odd_sketch(sample: np.ndarray) -> np.ndarray:
    """Parities of the samples that fall to each of the sketch's bits."""
    bits = SKETCH_LONGS * 64
    place = mix(sample + np.arange(len(sample), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(bits)
    return np.packbits((np.bincount(place.astype(np.int64), minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def _digests(hashes: np.ndarray, at: np.ndarray) -> list[bytes | None]:
    """The class of each set: a digest, or None of an empty one."""
    return [hashlib.blake2b(hashes[a:z].tobytes(), digest_size=16).digest() if z > a else None for a, z in zip(at[:-1], at[1:], strict=True)]


def signatures(docs: DataFrame) -> DataFrame:
    """id, th, n, cid (digest of the shingle set; null without shingles) and bands of keyed documents; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            hashes, at = shingle_sets(*text_bytes(batch.column(0)))
            cids, bands = _digests(hashes, at), []
            for a, z in zip(at[:-1], at[1:], strict=True):
                if a == z:
                    bands.append(None)
                    continue
                bands.append(band_keys(samples(hashes[a:z], BANDS * ROWS)).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(np.diff(at), pa.int64()), pa.array(cids, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["id", "th", "n", "cid", "bands"])

    return written(docs.select("text", "id", "th").mapInArrow(run, "id long, th long, n long, cid binary, bands array<long>"), "signatures")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """cid, sketch and shingles (the whole set) of the documents ``wanted`` (id, th), made in one pass and written.

    The documents are found by a bitmap of bounded size, so texts aren't shuffled (more than
    it holds are joined); other classes may come along by chance, and a class more than once.
    """
    places = written(wanted.select("id", "th", F.xxhash64("id", "th").alias("place")), "places")
    sieve = anchors.bitmap(places.select("place"))
    sent = docs.sparkSession.sparkContext.broadcast(sieve)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            if sent.value:
                on = np.flatnonzero(sent.value.has(batch.column(3).to_numpy()))
                if not len(on):
                    continue
                batch = batch.take(pa.array(on))
            hashes, at = shingle_sets(*text_bytes(batch.column(0)))
            sketches = pa.array([odd_sketch(samples(hashes[a:z])) if z > a else None for a, z in zip(at[:-1], at[1:], strict=True)], pa.list_(pa.int64()))
            sets = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(_digests(hashes, at), pa.binary()), sketches, sets], names=["cid", "sketch", "shingles"])

    keyed = docs.select("text", "id", "th", F.xxhash64("id", "th").alias("place"))
    if sieve is None:
        keyed = keyed.join(places.select("id", "th"), ["id", "th"], "left_semi").select("text", "id", "th", "place")
    return written(keyed.mapInArrow(run, "cid binary, sketch array<long>, shingles array<long>"), "sets")


def _alike(n_a: str, s_a: str, n_b: str, s_b: str, percent: int) -> Column:
    """Whether sizes and sketches allow two sets to reach the threshold."""
    apart = sum((F.bit_count(F.get(s_a, F.lit(i)).bitwiseXOR(F.get(s_b, F.lit(i)))) for i in range(SKETCH_LONGS)), F.lit(0))
    return (F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * percent) & (apart <= SKETCH_MOST)


class _Links:
    """Confirms pairs of classes on whole sets (cid, shingles) and keeps the links."""

    def __init__(self, sets: DataFrame, percent: int):
        self.sets, self.percent = sets.select("cid", "shingles"), percent
        self.found: DataFrame | None = None

    def confirm(self, pairs: DataFrame) -> bool:
        """Add the links among ``pairs`` (a, na, b, nb); whether there were any pairs."""
        pairs = written(pairs.distinct(), "candidate-pairs")
        if pairs.isEmpty():
            return False
        both = pairs.join(self.sets.select(F.col("cid").alias("a"), F.col("shingles").alias("x")), "a").join(self.sets.select(F.col("cid").alias("b"), F.col("shingles").alias("y")), "b")
        common = F.size(F.array_intersect("x", "y")).cast("long")
        both = both.withColumn("common", common).where(F.col("common") * 100 >= (F.col("na") + F.col("nb") - F.col("common")) * self.percent)
        links = written(both.select(F.col("a").alias("u"), F.col("b").alias("v")), "confirmed")
        self.found = links if self.found is None else self.found.unionByName(links)
        return True

    def labelled(self, classes: DataFrame) -> DataFrame:
        """``classes`` with the component of each so far."""
        if self.found is None:
            return classes.withColumn("comp", F.col("cid"))
        self.found = components(self.found)  # a star each component: what it links, and no more
        comps = self.found.select(F.col("u").alias("cid"), F.col("v").alias("root"))
        return classes.join(comps, "cid", "left").select(*classes.columns, F.coalesce("root", "cid").alias("comp"))


def _compare(buckets: DataFrame, links: _Links, facts: DataFrame, again: bool = True) -> None:
    """Find all links between classes of one bucket (key, band, cid), up to links within a component.

    ``facts``: cid, n, sketch and bands of the classes in any bucket.
    """
    # each class and the leader that it shares most buckets with; a leader is a bucket's smallest class
    lead = buckets.groupBy("key").agg(F.min("cid").alias("lead"), F.max("cid").alias("last")).where("lead < last").drop("last")
    often = buckets.join(lead, "key").where("cid <> lead").groupBy("cid", "lead").agg(F.count(F.lit(1)).alias("c"))
    pairs = often.groupBy("cid").agg(F.max_by("lead", F.struct("c", "lead")).alias("lead"))
    side = lambda c, k: facts.select(F.col("cid").alias(c), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}"))
    pairs = pairs.join(side("cid", "a"), "cid").join(side("lead", "b"), "lead").where(_alike("na", "sa", "nb", "sb", links.percent))
    links.confirm(pairs.select(F.col("cid").alias("a"), "na", F.col("lead").alias("b"), "nb"))

    # what is outside a bucket's main component meets a few members of that, drawn by hash, and then all members
    opened = _opened(buckets, facts, links)
    if opened.isEmpty():
        return
    turn = F.greatest(F.lit(1).cast("bigint"), F.floor(F.col("mains") / LEADERS))
    few = opened.where((F.col("comp") == F.col("main")) & (F.pmod(F.xxhash64("cid", "key"), turn) == 0))
    if links.confirm(_met(opened, few.join(facts, "cid"), facts, links.percent, first_band=False)):
        opened = _opened(opened.select("key", "band", "cid"), facts, links)
        if opened.isEmpty():
            return
    if again:
        many = opened.where(F.col("rests") > RESTS)
        if not many.isEmpty():
            parted = many.join(facts.select("cid", "bands"), "cid").select("cid", F.col("key").alias("k"), F.posexplode("bands").alias("band", "second")).where("k <> second")
            _compare(_shared(parted.select(F.xxhash64("k", "second").alias("key"), F.lit(0).alias("band"), "cid")), links, facts, again=False)
            opened = opened.where(F.col("rests") <= RESTS)
    links.confirm(_met(opened, opened.join(facts, "cid"), facts, links.percent))


def _opened(buckets: DataFrame, facts: DataFrame, links: _Links) -> DataFrame:
    """The rows of buckets that hold several components, with comp, main (the largest), mains (its members) and rests (others); written."""
    known = written(links.labelled(facts.select("cid")), "labels")
    labelled = buckets.join(known, "cid")
    per = labelled.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
    main = per.groupBy("key").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.count(F.lit(1)).alias("comps"), F.max("c").alias("mains"), (F.sum("c") - F.max("c")).alias("rests")).where("comps > 1")
    return written(labelled.join(main.select("key", "main", "mains", "rests"), "key"), "open-buckets")


def _met(opened: DataFrame, members: DataFrame, facts: DataFrame, percent: int, first_band: bool = True) -> DataFrame:
    """Pairs (a, na, b, nb) of the rests of ``opened`` with ``members`` (with facts) of their buckets that sizes and sketches allow."""
    rests = opened.where("comp <> main").join(facts, "cid").select("key", "band", *(F.col(c).alias(f"r_{c}") for c in ("cid", "comp", "n", "sketch", "bands")))
    # two rests meet once, by their order; with first_band only the first shared band makes the pair
    once = (F.col("comp") != F.col("r_comp")) & ((F.col("comp") == F.col("main")) | (F.col("cid") < F.col("r_cid")))
    earlier = F.exists(F.sequence(F.lit(1), F.greatest(F.col("band"), F.lit(1))), lambda i: (i <= F.col("band")) & (F.get("bands", i - 1) == F.get("r_bands", i - 1)))
    allowed = once & _alike("n", "sketch", "r_n", "r_sketch", percent)
    met = members.join(rests, ["key", "band"]).where(allowed & ~earlier if first_band else allowed)
    first = F.col("cid") < F.col("r_cid")
    return met.select(F.least("cid", "r_cid").alias("a"), F.when(first, F.col("n")).otherwise(F.col("r_n")).alias("na"), F.greatest("cid", "r_cid").alias("b"), F.when(first, F.col("r_n")).otherwise(F.col("n")).alias("nb"))


def _shared(rows: DataFrame) -> DataFrame:
    """The rows (key, band, cid) whose key has two classes at least (and some others by chance); written."""
    shared = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key"), "band-keys")
    sieve = anchors.bitmap(shared)
    if sieve is None:
        return written(rows.select("key", "band", "cid").join(shared, "key", "left_semi"), "buckets")
    sent = rows.sparkSession.sparkContext.broadcast(sieve)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(sent.value.has(batch.column(0).to_numpy())))

    return written(rows.select("key", "band", "cid").mapInArrow(run, "key long, band int, cid binary"), "buckets")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """id, th (tells texts of one id apart), n_shingles, component (smallest id linked with it) and part, a row each document.

    ``part`` tells components apart that have the same smallest id; it is null without shingles.

    Null texts, empty ones and those without words have no shingles and stand alone. A null
    doc_id is 2**63 - 1 here, after all others. Rows that repeat are answered each; texts
    that share an id are told apart by their hash.
    """
    whole = anchors.keyed(docs.select("doc_id", "text"))
    made = signatures(whole)
    # a class is answered for by its smallest document
    least = made.where("cid is not null").groupBy("cid").agg(F.min(F.struct("id", "th")).alias("f"))
    heads = least.select("cid", F.col("f.id").alias("id"), F.col("f.th").alias("th"))
    classes = written(made.join(heads, ["cid", "id", "th"]).select("cid", "id", "th", "n", "bands").dropDuplicates(["cid"]), "classes")
    buckets = _shared(classes.select(F.posexplode("bands").alias("band", "key"), "cid"))
    some = classes.join(buckets.select("cid").distinct(), "cid", "left_semi").select("id", "th")
    sets = _sets(whole, some)
    facts = written(classes.select("cid", "n", "bands").join(sets.select("cid", "sketch").dropDuplicates(["cid"]), "cid"), "facts")
    links = _Links(sets, percent)
    _compare(buckets, links, facts)
    rows = links.labelled(classes.select("cid", "id"))
    smallest = rows.groupBy("comp").agg(F.min("id").alias("component"))
    named = written(rows.join(smallest, "comp").select("cid", "component", F.col("comp").alias("part")), "components")
    return made.select("id", "th", "n", "cid").join(named, "cid", "left").select("id", "th", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component"), "part")


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One document of each component, with all columns: that of the smallest id, of one id that whose key of the text is smallest.

    Of rows that repeat id and text one stays (the first by a hash of all columns).
    Documents without shingles are linked with nothing and all stay. Nulls as in
    ``near_duplicates``: documents without an id come last, each with its own text.
    """
    found = near_duplicates(docs, percent).select("id", "th", "part")
    kept = found.where("part is not null").groupBy("part").agg(F.min(F.struct("id", "th")).alias("k")).select("k.*")
    kept = kept.unionByName(found.where("part is null").select("id", "th")).distinct()
    id, th = anchors.document_key(docs)
    rows = docs.withColumns({"_kept_id": id, "_kept_th": th})
    rows = rows.join(kept.select(F.col("id").alias("_kept_id"), F.col("th").alias("_kept_th")), ["_kept_id", "_kept_th"], "left_semi")
    several = rows.where(F.length(F.trim(F.coalesce("text", F.lit("")))) > 0).groupBy("_kept_id", "_kept_th").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select("_kept_id", "_kept_th")
    several = written(several, "repeated-rows")
    if several.isEmpty():
        return rows.select(*docs.columns)
    hashed = F.xxhash64(*docs.columns)
    once = rows.join(several, ["_kept_id", "_kept_th"], "left_semi").withColumn("_kept_n", F.row_number().over(W.partitionBy("_kept_id", "_kept_th").orderBy(hashed))).where("_kept_n = 1")
    return rows.join(several, ["_kept_id", "_kept_th"], "left_anti").select(*docs.columns).unionByName(once.select(*docs.columns))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = near_duplicates(table(spark, sf_dir, "documents"))
    named = lambda c: F.when(F.col(c) != anchors.NO_ID, F.col(c))
    return got.select(named("id").alias("doc_id"), "n_shingles", named("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
