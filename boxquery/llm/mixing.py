"""Mixing sources to target weights, in DataFrame operations only.

The words of a source, its documents one after the other, are packed into blocks
of one length (to a word). A source's target says how many slots of the mix it
fills. The slots of all sources together are put in one pseudorandom order and cut
into output shards of one length; so a shard's counts of the sources are a
multinomial draw, given the totals. Slots are numbered per source and mapped through
the source's index permutation to a block; a document finds the slots of its blocks
by the inverse, so that texts are shuffled once. The mixture is written with its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boxquery.llm._common import table, written

#: Words in a block; slots in an output shard (the last may have fewer).
BLOCK_WORDS = 512
SHARD_SLOTS = 4096
#: The mix is this share of all words; a source is repeated so often at most.
SHARE = 1.5
MOST_PASSES = 2
WEIGHTS = (3, 1, 2)
#: Documents of a source are numbered within buckets of about so many rows.
BUCKET_ROWS = 4096
LEAST_BUCKETS = 512
#: Slots that one generated range holds.
RANGE_SLOTS = 4096
#: Blocks of a source at most, so that products of two block numbers fit a long; a source of more words has longer blocks.
MOST_BLOCKS = 2_000_000_000
#: A prime that numbers are spread by, and what it is multiplied with.
PRIME, FACTOR = 2_147_483_647, 48_271
#: Odd multipliers of the order of all slots, below 2^31; an order holds 2^61 slots at most.
ROUNDS = (740_179_053, 695_872_825, 1_597_334_677, 1_103_515_245)

WORD = r"[^\x20\x09-\x0D]+"


def _identified(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))


def _size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def _bucketed(rows: DataFrame, buckets: int) -> DataFrame:
    spread = F.pmod(F.pmod("doc_id", F.lit(PRIME)) * FACTOR, F.lit(PRIME))
    return rows.withColumn("bucket", F.pmod(F.coalesce(spread, F.pmod("h", F.lit(PRIME))), F.lit(buckets)))


def document_sizes(docs: DataFrame) -> tuple[DataFrame, int]:
    """doc_id, source, size in words, h (hash of the text) and the bucket that the row is numbered in, written once; the number of buckets."""
    sized = written(_identified(docs).select("doc_id", "source", _size().alias("size"), F.xxhash64("text").alias("h")), "mix-sizes")
    buckets = max(LEAST_BUCKETS, -(-sized.count() // BUCKET_ROWS))
    return _bucketed(sized, buckets), buckets


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, passes: int = MOST_PASSES) -> DataFrame:
    """One row a source: sid (order by code point, null last), source_size, target.

    Targets fill like water: sources by size over weight; up to some source all take
    ``passes`` times their size, the others share the rest by weight.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    sid = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.pmod(F.col("sid"), F.lit(len(weights))) + 1)
    per = per.withColumn("sid", sid).withColumn("weight", weight)
    fill = W.orderBy(F.col("source_size") / F.col("weight"), "sid")
    before = F.coalesce(F.sum("source_size").over(fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) * passes
    left = F.sum("weight").over(fill.rowsBetween(0, W.unboundedFollowing))
    everything = W.orderBy("sid").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    per = per.withColumn("level", (F.sum("source_size").over(everything) * F.lit(share) - before) / left)
    free = F.when(F.col("level") * F.col("weight") <= F.col("source_size") * F.lit(float(passes)), F.struct((F.col("source_size") / F.col("weight")).alias("r"), F.col("sid").alias("s"), F.col("level").alias("v")))
    per = per.withColumn("level", F.min(free).over(everything)["v"])
    return per.select("source", "sid", "source_size", F.least(F.col("source_size") * F.lit(float(passes)), F.col("level") * F.col("weight")).alias("target"))


def with_blocks(sources: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Adds n_blocks, base and extra: block i starts at i*base + min(i, extra); and step, the multiplier of the source's permutation.

    The step is the first number without a common divisor with n_blocks from the golden
    section of it on, so that neighbouring slots get blocks far apart, in each source others.
    """
    n = F.least(F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.lit(block_words))), F.lit(MOST_BLOCKS)).cast("long")
    sources = sources.withColumn("n_blocks", n).withColumns({"base": F.expr("source_size div n_blocks"), "extra": F.expr("source_size % n_blocks")})
    divisor = "aggregate(sequence(1, 48), named_struct('r', n_blocks, 's', x), (a, k) -> if(a.s = 0, a, named_struct('r', a.s, 's', a.r % a.s))).r"
    near = "transform(sequence(0L, 63L), k -> floor(n_blocks * 0.6180339887498949D) + 1 + k)"
    return sources.withColumn("step", F.expr(f"filter({near}, x -> {divisor} = 1)[0]"))


def runs(sources: DataFrame, passes: int = MOST_PASSES, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The sources by pass: filled and n_slots, and ahead and total, the slots before them and those of the whole mix."""
    each = sources.withColumn("pass", F.explode(F.array(*(F.lit(p) for p in range(passes)))))
    each = each.withColumn("want", F.least(F.greatest(F.round("target").cast("long") - F.col("pass") * F.col("source_size"), F.lit(0)), F.col("source_size"))).where("want > 0")
    each = each.withColumn("filled", F.col("want").cast("double") * F.col("n_blocks") / F.col("source_size"))
    each = each.withColumn("n_slots", F.least(F.ceil("filled").cast("long"), F.col("n_blocks")))
    # a last slot whose share comes to no word is none
    last = F.col("n_slots") - 1
    each = each.withColumn("n_slots", last + (_slot_words(_block(last), last) > 0).cast("long"))
    order = W.orderBy("sid", "pass")
    before = F.coalesce(F.sum("n_slots").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("n_slots").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return each.withColumns({"ahead": before, "total": total, "shard_slots": F.lit(shard_slots).cast("long")}).where("n_slots > 0")


def shuffled(number: str, total: str) -> Column:
    """The place of a number below ``total`` in one pseudorandom order of them all.

    Rounds of multiplication and shift permute the next power of two; a result beyond
    ``total`` goes through them again. The upper and the lower 31 bits are multiplied apart, so that no product overflows.
    """
    # b: the bits of the order, z: a number on its way, y: one that a round has multiplied; each is worked out once
    upper = "shiftleft((shiftright(a, 31) * m) & shiftright(b.mask, 31), 31)"
    mixed = f"({upper} + (a & 2147483647L) * m + 1013904223L) & b.mask"
    once = f"aggregate(array({', '.join(f'{m}L' for m in ROUNDS)}), {{}}, (a, m) -> transform(array({mixed}), y -> y ^ shiftright(y, b.half))[0])"
    again = f"aggregate(sequence(1, 63), z, (x, k) -> if(x < {total}, x, {once.format('x')}))"
    bits = f"transform(array(greatest(1, length(bin({total} - 1)))), n -> named_struct('mask', shiftleft(1L, n) - 1, 'half', (n + 1) div 2))"
    found = F.expr(f"transform({bits}, b -> transform(array({once.format(number)}), z -> if(z < {total}, z, {again}))[0])[0]")
    return F.when(found < F.col(total), found).otherwise(F.raise_error(F.lit("no place found")).cast("long"))


def _dealt(rows: DataFrame) -> DataFrame:
    """Adds shard and position in it."""
    rows = rows.withColumn("place", F.col("ahead") + F.col("slot"))
    rows = rows.withColumn("place", shuffled("place", "total"))
    return rows.withColumns({"shard": F.expr("place div shard_slots"), "position": F.expr("place % shard_slots")})


def _block(slot: Column) -> Column:
    return (slot * F.col("step") + (F.col("sid") + 1) * 7919 + F.col("pass") * 104729) % F.col("n_blocks")


def _slot_words(block: Column, slot: Column) -> Column:
    """Words that a slot takes of its block: all, or a share in the last slot of a pass."""
    length = F.col("base") + (block < F.col("extra")).cast("long")
    return F.when(slot + 1 <= F.col("filled"), length).otherwise(F.floor((F.col("filled") - slot) * length).cast("long"))


def slots(sources: DataFrame, passes: int = MOST_PASSES, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """sid, pass, slot, shard, position, block and words (taken from the block's start), a row each filled slot.

    Ranges of slots are made first and dealt out, so that no task makes all slots of a large source.
    """
    ranges = runs(sources, passes, shard_slots).withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_slots") - 1, F.lit(RANGE_SLOTS).cast("long"))))
    ranges = ranges.repartition("sid", "pass", "start")
    made = ranges.withColumn("slot", F.explode(F.sequence("start", F.least(F.col("start") + RANGE_SLOTS, F.col("n_slots")) - 1)))
    made = made.withColumn("block", _block(F.col("slot")))
    made = made.withColumn("words", _slot_words(F.col("block"), F.col("slot")))
    return _dealt(made).select("sid", "pass", "slot", "shard", "position", "block", "words")


def placed(rows: DataFrame, sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Sized rows, with or without texts, with their source's numbers and ``start``, the first word's position in the source.

    Positions are summed within buckets and over buckets, so a large source is spread
    over many groups; (sid, bucket, rn) is unique even where doc_ids repeat.
    """
    named = F.broadcast(sources.withColumnRenamed("source", "s"))
    sums = sized.join(named, F.col("source").eqNullSafe(F.col("s"))).groupBy("sid", "bucket").agg(F.sum("size").alias("bucket_size"))
    ahead = W.partitionBy("sid").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0))).drop("bucket_size")
    in_bucket = W.partitionBy("sid", "bucket").orderBy("doc_id", "size", "h")
    numbered = rows.join(named, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    numbered = numbered.withColumns({"rn": F.row_number().over(in_bucket), "before": F.sum("size").over(in_bucket.rowsBetween(W.unboundedPreceding, 0)) - F.col("size")})
    return numbered.join(sums, ["sid", "bucket"]).withColumn("start", F.col("bucket_start") + F.col("before")).drop("bucket_start", "before")


def _block_of(position: str) -> str:
    return f"if({position} < extra * (base + 1), {position} div (base + 1), extra + ({position} - extra * (base + 1)) div base)"


#: The step's inverse modulo n_blocks, by Euclid's algorithm (46 steps at most for numbers of 31 bits).
_INVERSE = """pmod(aggregate(sequence(1, 48), named_struct('r', n_blocks, 's', step % n_blocks, 't', 0L, 'u', 1L),
  (a, k) -> if(a.s = 0, a, named_struct('r', a.s, 's', a.r % a.s, 't', a.u, 'u', a.t - (a.r div a.s) * a.u))).t, n_blocks)"""


def _pieces(rows: DataFrame, sources: DataFrame, shard_slots: int) -> DataFrame:
    """What each slot takes of each document: the slot, ``at`` (first word in the block), n and the words as text."""
    each = runs(sources, shard_slots=shard_slots).withColumn("inverse", F.expr(_INVERSE)).select("sid", "pass", "filled", "n_slots", "ahead", "total", "shard_slots", "inverse")
    cut = rows.where("size > 0").join(F.broadcast(each), "sid")

    def piece(block: Column) -> Column:
        first = block * F.col("base") + F.least(block, F.col("extra"))
        slot = F.pmod(block - (F.col("sid") + 1) * 7919 - F.col("pass") * 104729, F.col("n_blocks")) * F.col("inverse") % F.col("n_blocks")
        words = F.when(slot < F.col("n_slots"), _slot_words(block, slot)).otherwise(0)
        low = F.greatest(F.col("start"), first)
        n = F.greatest(F.least(F.col("start") + F.col("size"), first + words) - low, F.lit(0))
        text = F.array_join(F.slice("tokens", (low - F.col("start") + 1).cast("int"), n.cast("int")), " ")
        return F.struct(slot.alias("slot"), block.alias("block"), words.alias("words"), (low - first).alias("at"), n.alias("n"), text.alias("text"))

    found = F.transform(F.sequence(F.expr(_block_of("start")), F.expr(_block_of("(start + size - 1)"))), piece)
    cut = cut.select("sid", "source", "pass", "ahead", "total", "shard_slots", "bucket", "rn", F.explode(found).alias("piece"))
    return cut.select("*", "piece.*").drop("piece").where("n > 0")


def _joined(pieces: DataFrame, by: list[str]) -> DataFrame:
    """Pieces of one slot put together: ``p``, in order, as at, text and parts (bucket, rn, n)."""
    return pieces.groupBy(*by).agg(F.array_sort(F.collect_list("piece")).alias("p"), F.sum("n").alias("n"), F.min("at").alias("at")).withColumns({"text": F.array_join(F.transform("p", lambda x: x["text"]), " "), "parts": F.flatten(F.transform("p", lambda x: x["parts"]))}).drop("p")


def _mixture(docs: DataFrame, block_words: int, shard_slots: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    sized, buckets = document_sizes(docs)
    sources = written(with_blocks(source_targets(sized), block_words), "mix-sources")
    texts = _bucketed(_identified(docs).withColumns({"size": _size(), "h": F.xxhash64("text")}), buckets)
    rows = placed(texts, sized, sources).withColumn("tokens", F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))).drop("text")
    slot = ["sid", "source", "pass", "slot", "block", "words"]
    pieces = _pieces(rows, sources, shard_slots).withColumn("piece", F.struct("at", "text", F.array(F.struct("bucket", "rn", "n")).alias("parts")))
    # a bucket is one run of words, so all but its first and last block are put together where its documents are
    near = _joined(pieces, [*slot, "bucket", "ahead", "total", "shard_slots"])
    names = [*slot, "shard", "position", "at", "n", "text", "parts"]
    near = written(_dealt(near).select(*names), "mixture")
    edges = near.where("n < words").withColumn("piece", F.struct("at", "text", "parts"))
    edges = written(_joined(edges, [*slot, "shard", "position"]).select(*names), "mixture-edges")
    return near.where("n = words").unionByName(edges), sized, sources


def mixture(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The mix itself, written: shard, position in it, source, pass, block, words (their number) and text, a row each slot.

    Words stand one space apart. Rows are in no order; shard and position say it.
    """
    return _mixture(docs, block_words, shard_slots)[0].select("shard", "position", "source", "pass", "block", "words", "text")


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """Per document: doc_id, size, source_size, target and taken (words that the written mixture has of it).

    Null texts have no words; a null source is a source of its own, the last; rows that
    repeat are documents each; other columns are ignored. A pass takes a word once at
    most and there are two, so no document is taken more than twice. Nothing depends
    on the order or the partitions of the input.
    """
    mixed, sized, sources = _mixture(docs, block_words, shard_slots)
    got = mixed.select("sid", F.explode("parts").alias("d")).groupBy("sid", "d.bucket", "d.rn").agg(F.sum("d.n").alias("taken"))
    rows = placed(sized, sized, sources).select("sid", "bucket", "rn", "doc_id", "size", "source_size", "target")
    return rows.join(got, ["sid", "bucket", "rn"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


ORACLE_SQL = rf"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS sid FROM sized GROUP BY source),
weighed AS (SELECT *, CASE sid % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight FROM per),
levels AS (SELECT *, source_size / weight AS ratio, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(source_size) OVER (ORDER BY source_size / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 2)
  / sum(weight) OVER (ORDER BY source_size / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
chosen AS (SELECT level AS l FROM levels WHERE level * weight <= source_size * 2.0::DOUBLE ORDER BY ratio, sid LIMIT 1),
src AS (SELECT source, sid, source_size, least(source_size * 2.0::DOUBLE, l * weight) AS target, greatest(1, ceil(source_size / {BLOCK_WORDS}))::BIGINT AS nb FROM levels, chosen),
blocked AS (SELECT *, source_size // nb AS base, source_size % nb AS extra, list_filter(list_transform(range(0, 64), lambda k: floor(nb * 0.6180339887498949::DOUBLE)::BIGINT + 1 + k), lambda x: gcd(x, nb) = 1)[1] AS step FROM src),
buckets AS (SELECT greatest({LEAST_BUCKETS}, ceil(count(*) / {BUCKET_ROWS}))::BIGINT AS n FROM sized),
placed AS (SELECT z.doc_id, z.size, b.*, sum(z.size) OVER (PARTITION BY b.sid ORDER BY (z.doc_id % {PRIME}) * {FACTOR} % {PRIME} % n, z.doc_id, z.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT - z.size AS start
  FROM sized z JOIN blocked b ON z.source IS NOT DISTINCT FROM b.source, buckets),
wants AS (SELECT *, p, least(greatest(round(target)::BIGINT - p * source_size, 0), source_size) AS want FROM blocked, (SELECT unnest([0, 1]) AS p)),
filled AS (SELECT *, want::DOUBLE * nb / source_size AS f FROM wants WHERE want > 0),
made AS (SELECT *, unnest(range(0, least(ceil(f)::BIGINT, nb))) AS slot FROM filled),
mapped AS (SELECT *, (slot * step + (sid + 1) * 7919 + p * 104729) % nb AS block FROM made),
drawn AS (SELECT sid, block, CASE WHEN slot + 1 <= f THEN base + (block < extra)::BIGINT ELSE floor((f - slot) * (base + (block < extra)::BIGINT))::BIGINT END AS words FROM mapped),
spans AS (SELECT d.sid, b.base * d.block + least(d.block, b.extra) AS a, b.base * d.block + least(d.block, b.extra) + d.words AS z FROM drawn d JOIN blocked b USING (sid)),
got AS (SELECT p.doc_id, p.sid, p.start, sum(least(p.start + p.size, s.z) - greatest(p.start, s.a)) AS taken FROM placed p JOIN spans s ON s.sid = p.sid AND s.a < p.start + p.size AND s.z > p.start GROUP BY ALL)
SELECT p.doc_id, p.size, p.source_size, p.target, coalesce(g.taken, 0)::BIGINT AS taken
FROM placed p LEFT JOIN got g ON g.doc_id = p.doc_id AND g.sid = p.sid AND g.start = p.start AND p.size > 0
"""
