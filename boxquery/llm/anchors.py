"""Winnowed anchors: how equal windows of different documents are brought together.

A window is ``width`` symbols (bytes or words) of one document; its anchor is the
``seed``-gram in it of the smallest hash (the last of equal ones), so equal windows
have equal anchors at equal places. Consecutive windows of one anchor occurrence are
one span. Anchors that occur once can't lie in a repeated window; the others are
kept as a bitmap of bounded size, so that spans of single anchors are mostly never
shuffled (what passes the bitmap by chance does no harm). More values than a bitmap
holds well are joined instead. Spans of the same anchor and content are one class.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxquery.llm._common import blocks, drop_written, text_bytes, written
from boxquery.llm._text import sliding_argmin

#: Bits of a bitmap for each value, and values at most (32 MB); more of them are joined.
BITS_PER_VALUE = 16
MOST_VALUES = 1 << 24
#: Bits of a segment, as the built-in bitmap aggregate has them, and where a value's second part begins.
_SEGMENT = 15
_SECOND = 28
#: A null id stands for one document after all others.
NO_ID = (1 << 63) - 1


@dataclass
class Spans:
    """Runs of windows of one anchor occurrence; positions count the block's symbols."""

    anchor: np.ndarray  # hash
    start: np.ndarray  # first window
    windows: np.ndarray  # number of windows
    end: np.ndarray  # of the content: the last window's end and what is asked beyond it, within the text
    owner: np.ndarray  # text
    at: np.ndarray  # where the anchor stands


def winnow(seeds: np.ndarray, symbol_offsets: np.ndarray, width: int, seed: int, beyond: int = 0) -> Spans:
    """``seeds``: a hash of each seed-gram of the symbols, in order; contents go ``beyond`` symbols past the last window."""
    none = np.zeros(0, np.int64)
    sizes = np.diff(symbol_offsets)
    texts = np.flatnonzero(sizes >= width)
    if not len(texts):
        return Spans(none.astype(np.uint64), none, none, none, none, none)
    at = sliding_argmin(seeds, width - seed + 1)
    opens, closes = symbol_offsets[texts], symbol_offsets[texts + 1] - width + 1
    change = np.flatnonzero(at[1:] != at[:-1]) + 1
    edges = np.unique(np.concatenate([change, opens, closes]))
    start, end = edges[:-1], edges[1:]
    k = np.searchsorted(opens, start, side="right") - 1
    inside = (k >= 0) & (start < closes[k])
    start, end, k = start[inside], end[inside], k[inside]
    content = np.minimum(end + (width - 1 + beyond), symbol_offsets[texts[k] + 1])
    return Spans(seeds[at[start]], start, end - start, content, texts[k], at[start].astype(np.int64))


def _fresh(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before in some column."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def document_key(docs: DataFrame) -> tuple[Column, Column]:
    """id (null: after all others) and th, which tells texts of one id apart: the text's hash, or 0 where no id repeats."""
    id = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    unique = docs.select(id.alias("i")).groupBy("i").agg(F.count(F.lit(1)).alias("c")).where("c > 1").isEmpty()
    return id, F.lit(0).cast("long") if unique else F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def keyed(docs: DataFrame) -> DataFrame:
    """Adds the key (id, th), and makes a null text empty: a document is an id with a text."""
    id, th = document_key(docs)
    return docs.withColumns({"id": id, "th": th, "text": F.coalesce(F.col("text"), F.lit(""))})


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


#: What a kernel returns for a block: the symbols' offsets of the texts, the seeds, and what makes signatures and contents of [start, end).
Kernel = Callable[[np.ndarray, np.ndarray], tuple]
BLOCK_BYTES = 1 << 18


@dataclass
class Scheme:
    """Windows of ``width`` symbols with seeds of ``seed``; a span's content goes ``beyond`` symbols past its last window."""

    kernel: Kernel
    width: int
    seed: int
    beyond: int = 0

    def read(self, texts: pa.Array) -> tuple:
        """The spans of a block, the symbols' offsets, and the makers of signatures and contents."""
        offsets, seeds, signature, contents = self.kernel(*text_bytes(texts))
        return winnow(seeds, offsets, self.width, self.seed, self.beyond), offsets, signature, contents


def repeated_anchors(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """The hashes of anchors that occur twice or more, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, BLOCK_BYTES):
            anchor = scheme.read(batch.column(0))[0].anchor
            third = np.zeros(len(anchor), bool)  # of an anchor said many times running, two are enough
            third[2:] = (anchor[2:] == anchor[1:-1]) & (anchor[1:-1] == anchor[:-2])
            yield pa.RecordBatch.from_arrays([_signed(anchor[~third])], names=["anchor"])

    found = docs.select("text").mapInArrow(run, "anchor long")
    return written(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("anchor"), "anchors")


@dataclass
class Bitmap:
    """A set of 64-bit values by two of their parts; it may answer yes for others (about one in a hundred)."""

    flags: np.ndarray
    bits: int

    def has(self, values: np.ndarray) -> np.ndarray:
        out = np.ones(len(values), bool)
        for part in (values.view(np.uint64), values.view(np.uint64) >> np.uint64(_SECOND)):
            place = part & np.uint64((1 << self.bits) - 1)
            out &= ((self.flags[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
        return out


def bitmap(values: DataFrame) -> Bitmap | None:
    """Of one long column, made by segments on the executors; None if there are more values than 32 MB hold well."""
    count = values.count()
    if count > MOST_VALUES:
        return None
    bits = max(_SEGMENT, int(count * BITS_PER_VALUE).bit_length())
    value = F.col(values.columns[0])
    mask = F.lit((1 << bits) - 1).cast("long")
    places = F.array(value.bitwiseAND(mask), F.shiftrightunsigned(value, _SECOND).bitwiseAND(mask))
    rows = values.select(F.explode(places).alias("place")).select(F.shiftright("place", _SEGMENT).alias("segment"), F.col("place").bitwiseAND(F.lit((1 << _SEGMENT) - 1)).alias("bit"))
    made = rows.repartition("segment").groupBy("segment").agg(F.bitmap_construct_agg("bit").alias("bits"))
    whole = np.zeros(1 << (bits - 3), np.uint8)
    size = 1 << (_SEGMENT - 3)
    for row in made.collect():
        whole[row["segment"] * size : (row["segment"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return Bitmap(whole, bits)


def spans(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """anchor, sig (of the content), id, th, pos (first window), n (windows), m (symbols of the content) and k of spans whose anchor may repeat; written.

    A row stands for k equal spans one after the other, as periodic text has them.
    """
    repeated = repeated_anchors(docs, scheme)
    sieve = bitmap(repeated)
    sent = docs.sparkSession.sparkContext.broadcast(sieve)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, BLOCK_BYTES):
            got, offsets, signature, _ = scheme.read(batch.column(0))
            on = sent.value.has(got.anchor) if sent.value else np.ones(len(got.anchor), bool)
            anchor, start, n, owner, end = got.anchor[on], got.start[on], got.windows[on], got.owner[on], got.end[on]
            sig = signature(start, end)
            new = _fresh(anchor, sig, owner, start - np.arange(len(n)) * n)
            first = np.flatnonzero(new)
            k = np.diff(np.append(first, len(n)))
            take = pa.array(owner[first])
            yield pa.RecordBatch.from_arrays(
                [_signed(anchor[first]), _signed(sig[first]), batch.column(1).take(take), batch.column(2).take(take), *(pa.array(x.astype(np.int32)) for x in ((start - offsets[owner])[first], n[first], (end - start)[first], k))],
                names=["anchor", "sig", "id", "th", "pos", "n", "m", "k"],
            )

    found = docs.select("text", "id", "th").mapInArrow(run, "anchor long, sig long, id long, th long, pos int, n int, m int, k int")
    out = written(found if sieve else found.join(repeated, "anchor", "left_semi"), "spans")
    drop_written(repeated)
    return out


def classes(found: DataFrame) -> DataFrame:
    """A row for each class of equal spans: how many there are, and the first of them; written."""
    first = F.min(F.struct("id", "th", "pos")).alias("first")
    return written(found.groupBy("anchor", "sig").agg(F.sum("k").alias("c"), first), "classes")


def _place(sig: Column, id: Column, th: Column, pos: Column) -> Column:
    """A value of a span occurrence of which ``_places`` makes the same in numpy: shifts and exclusive ors, which can't overflow."""
    v = sig.bitwiseXOR(th).bitwiseXOR(F.shiftleft(id, 5)).bitwiseXOR(F.shiftleft(pos.cast("long"), 13))
    v = v.bitwiseXOR(F.shiftleft(v, 21))
    v = v.bitwiseXOR(F.shiftrightunsigned(v, 35))
    return v.bitwiseXOR(F.shiftleft(v, 4))


def _places(sig: np.ndarray, id: np.ndarray, th: np.ndarray, pos: np.ndarray) -> np.ndarray:
    v = (sig.view(np.int64) ^ th ^ (id << 5) ^ (pos << 13)).view(np.uint64)
    v = v ^ (v << np.uint64(21))
    v = v ^ (v >> np.uint64(35))
    return v ^ (v << np.uint64(4))


def differing(docs: DataFrame, of: DataFrame, scheme: Scheme, content: str, many: int) -> DataFrame:
    """anchor, id, th, pos, at (the anchor, from pos on), n, hot and content of each class's first span, of anchors that have several classes; written.

    Some other spans of repeated classes may come along by chance. ``hot`` is true of all spans
    of an anchor that has more than ``many`` classes, and by chance of others.
    """
    several = written(of.groupBy("anchor").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "several")
    first = written(of.join(several, "anchor").select("anchor", "sig", F.col("first.id").alias("id"), F.col("first.th").alias("th"), F.col("first.pos").alias("pos"), (F.col("m") > many).alias("hot")), "firsts")
    context = docs.sparkSession.sparkContext
    firsts, hots = bitmap(first.select(_place(F.col("sig"), F.col("id"), F.col("th"), F.col("pos")).alias("place"))), bitmap(several.where(F.col("m") > many).select("anchor"))
    schema = f"anchor long, id long, th long, pos int, at int, n int, hot boolean, content {content}"

    def rows(got: Spans, contents: Callable, pos: np.ndarray, on: np.ndarray, hot: np.ndarray, batch: pa.RecordBatch) -> pa.RecordBatch:
        start, owner = got.start[on], pa.array(got.owner[on])
        numbers = (pos[on], got.at[on] - start, got.windows[on])
        return pa.RecordBatch.from_arrays([_signed(got.anchor[on]), batch.column(1).take(owner), batch.column(2).take(owner), *(pa.array(x.astype(np.int32)) for x in numbers), pa.array(hot), contents(start, got.end[on])], names=["anchor", "id", "th", "pos", "at", "n", "hot", "content"])

    def by_bitmap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, BLOCK_BYTES):
            got, offsets, signature, contents = scheme.read(batch.column(0))
            ids, hashes = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            pos = got.start - offsets[got.owner]
            on = np.flatnonzero(firsts_sent.value.has(_places(signature(got.start, got.end), ids[got.owner], hashes[got.owner], pos)))
            yield rows(got, contents, pos, on, hots_sent.value.has(got.anchor[on]), batch)

    def by_list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, BLOCK_BYTES):
            got, offsets, _, contents = scheme.read(batch.column(0))
            pos = got.start - offsets[got.owner]
            wanted = batch.column(3)
            sizes = np.diff(wanted.offsets.to_numpy())
            code = np.repeat(np.arange(batch.num_rows), sizes) << 33 | wanted.flatten().to_numpy()  # pos and hot in one number
            code = np.sort(code)
            near = np.searchsorted(code, (got.owner << 33) | (pos << 1))
            have = code[np.minimum(near, len(code) - 1)]
            on = np.flatnonzero((have >> 1) == ((got.owner << 32) | pos))
            yield rows(got, contents, pos, on, (have[on] & 1).astype(bool), batch)

    if firsts and hots:
        firsts_sent, hots_sent = context.broadcast(firsts), context.broadcast(hots)
        found = docs.select("text", "id", "th").mapInArrow(by_bitmap, schema)
    else:
        lists = first.groupBy("id", "th").agg(F.collect_list(F.col("pos").cast("long") * 2 + F.col("hot").cast("long")).alias("wanted"))
        found = docs.select("text", "id", "th").join(lists, ["id", "th"]).select("text", "id", "th", "wanted").mapInArrow(by_list, schema)
    out = written(found, "differing")
    drop_written(several, first)
    return out


def whole_groups(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Rows sorted by column 0 in tables of about ``most`` bytes that part no group."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        whole = pa.Table.from_batches([*held, batch])
        key = whole.column(0).to_numpy()
        each = max(1, whole.nbytes // whole.num_rows)
        groups = np.flatnonzero(_fresh(key))
        start = 0
        for g in groups[1:]:  # the last group may go on
            if (g - start) * each >= most:
                yield whole.slice(start, g - start)
                start = g
        held = whole.slice(start).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def by_document(docs: DataFrame, removed: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``run`` over batches of text, doc_id, gone and noted: a document's spans (start, end, start, ...), unsorted and overlapping, or null.

    ``removed`` has id, th, start, end and far; spans with far are in ``gone``, the others in ``noted``.
    Only documents that may have any (by a bitmap) are shuffled to their spans; the
    others are read and answered in one step, by one Python worker a task.
    """
    listed = lambda which: F.flatten(F.collect_list(F.when(which, F.array("start", "end"))))
    lists = written(removed.groupBy("id", "th").agg(listed(F.col("far")).alias("gone"), listed(~F.col("far")).alias("noted")), "gone")
    sieve = bitmap(lists.select(F.xxhash64("id", "th").alias("place")))
    names = ["text", "doc_id", "gone", "noted"]
    if sieve is None:
        return docs.join(lists, ["id", "th"], "left").select(*names).mapInArrow(run, schema)
    sent = docs.sparkSession.sparkContext.broadcast(sieve)
    placed = docs.select(F.xxhash64("id", "th").alias("place"), "text", "doc_id", "id", "th")

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(sent.value.has(batch.column(0).to_numpy())))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = batch.filter(pa.array(~sent.value.has(batch.column(0).to_numpy())))
            nothing = pa.nulls(rest.num_rows, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([rest.column(1), rest.column(2), nothing, nothing], names=names)

    hit = placed.mapInArrow(some, placed.schema).join(lists, ["id", "th"], "left").select(*names).mapInArrow(run, schema)
    return hit.unionByName(placed.select("place", "text", "doc_id").mapInArrow(lambda batches: run(others(batches)), schema))
