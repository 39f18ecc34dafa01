"""Verbatim repeats over bytes, by a run-length index.

Spans of text that share a winnowed anchor are gathered in blocks; a block's text is
indexed by the runs of its Burrows-Wheeler transform, with the suffix array sampled
at run ends. From the samples the matching statistics of the whole block (the longest
match of each suffix with any other) are streamed: between samples they fall by one a
byte. Suffixes that match far enough are marked; the same statistics answer for two
lengths, one at which bytes are removed and a shorter one at which they are noted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxquery.llm import anchors
from boxquery.llm._common import blocks, table, text_bytes, written
from boxquery.llm._text import BASES, WINDOW_BASES, covered, mix, prefix_hash, rolling_hash, span_hash

WINDOW = 400
#: Matches of this length are noted, and not removed: about forty words, so that repeated passages of fifty show though they are short of a window.
NOTED = 256
SEED = 64  # longer than a piece
#: Bytes that one index covers, and classes of one anchor that it takes; an anchor of more has pieces of its spans matched by hash.
INDEX_BYTES = 1 << 17
INDEX_CLASSES = 1000
#: Windows of a piece of such an anchor's spans.
PIECE = 16


class RunLengthIndex:
    """The run-compressed transform of some texts, each closed by a sign of its own (an earlier text's is the smaller).

    ``own``, if given, says for each text how many of its first places are places of
    its own; the rest of it is context that other texts may have as their own. ``repeats``
    then tells for these places alone which ``length`` bytes stand at another of them.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, own: np.ndarray | None = None, length: int = 0):
        texts = len(offsets) - 1
        self.n = len(data) + texts
        if self.n >= 1 << 21:
            raise ValueError("the texts of one index are too long")
        at = np.arange(len(data)) + np.repeat(np.arange(texts), np.diff(offsets))
        self.starts = offsets[:-1] + np.arange(texts)
        ends = offsets[1:] + np.arange(texts)
        symbols = np.zeros(self.n, np.int64)  # signs are 0 here, and told apart by their place
        symbols[at] = data.astype(np.int64) + 1
        room = np.repeat(ends, np.diff(offsets) + 1) - np.arange(self.n) + 1  # of each suffix, its sign included
        order = self._suffix_array(symbols, room)
        symbols[ends] = -np.arange(1, texts + 1)
        transform = symbols[order - 1]
        change = transform[1:] != transform[:-1]
        self.heads = np.concatenate([[0], np.flatnonzero(change) + 1])  # rows where runs start
        self.run_symbols = transform[self.heads]
        self.prefix = prefix_hash(symbols, WINDOW_BASES[1])
        # of the suffix array the samples at run ends are kept: where a run ends and the next begins, one match answers for both
        last, first = order[self.heads[1:] - 1], order[self.heads[1:]]
        matched = self._common(last, first, room)
        self.before = self._by_place(np.append(order[0], first), np.append(0, matched))
        self.after = self._by_place(np.append(last, order[-1]), np.append(matched, 0))
        if own is not None:
            self.repeats = self._among(order, ends, own, length)

    def _among(self, order: np.ndarray, ends: np.ndarray, own: np.ndarray, length: int) -> np.ndarray:
        """Which places have ``length`` bytes in common with a neighbour among the own places, in the order of suffixes."""
        place = np.zeros(self.n, bool)
        edge = np.zeros(self.n + 1, np.int64)
        np.add.at(edge, self.starts, 1)
        np.add.at(edge, np.minimum(self.starts + own, np.maximum(ends - length + 1, self.starts)), -1)
        mine = order[np.cumsum(edge[:-1])[order] > 0]
        h = span_hash(self.prefix, mine, mine + length, WINDOW_BASES[1])
        same = np.flatnonzero(h[1:] == h[:-1])
        place[mine[same]] = place[mine[same + 1]] = True
        return place

    @staticmethod
    def _suffix_array(symbols: np.ndarray, room: np.ndarray) -> np.ndarray:
        """Suffixes in order, by prefix doubling; ``room``: symbols from each place to the end of its text.

        Keys carry the place in their low bits, so one sort of numbers gives order and
        ranks; what lies behind a sign counts nothing, and equal tails go by their place.
        """
        n = len(symbols)
        place = np.arange(n, dtype=np.uint64)
        bits = np.uint64(max(1, (n - 1).bit_length()))
        mask = (np.uint64(1) << bits) - np.uint64(1)

        def later(x: np.ndarray, by: int) -> np.ndarray:
            out = np.zeros(n, np.uint64)
            if by < n:
                np.multiply(x[by:], room[: n - by] > by, out=out[: n - by], casting="unsafe")
            return out

        used = np.zeros(257, bool)
        used[symbols] = True
        code = (np.cumsum(used) - 1).astype(np.uint64)[symbols] + np.uint64(1)
        width = np.uint64(int(code.max()).bit_length())
        depth = max(1, (64 - int(bits)) // int(width))
        key = code
        for k in range(1, depth):
            key = (key << width) | later(code, k)
        longest = int(room.max())
        wide = np.uint64(n.bit_length())  # of a rank, 1 to n
        while True:
            row = np.sort((key << bits) | place)
            order = (row & mask).astype(np.int64)
            row >>= bits
            rank_sorted = np.cumsum(np.concatenate([[False], row[1:] != row[:-1]]))
            if depth >= longest or rank_sorted[-1] == n - 1:
                return order
            rank = np.empty(n, np.uint64)
            rank[order] = rank_sorted.astype(np.uint64) + np.uint64(1)
            key = (rank << wide) | later(rank, depth)
            depth *= 2

    @staticmethod
    def _by_place(places: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Samples in text order: places, and how far each matches the neighbour across the run's end."""
        order = np.argsort(places, kind="stable")
        return places[order], length[order]

    def _common(self, a: np.ndarray, b: np.ndarray, room: np.ndarray) -> np.ndarray:
        """Longest common prefix of the suffixes at a and b, by halving on hashes; signs differ, so none passes a text's end."""
        low = np.zeros(len(a), np.int64)
        high = np.minimum(room[a], room[b]) - 1
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            mid = (low[open_] + high[open_] + 1) // 2
            x, y = a[open_], b[open_]
            same = span_hash(self.prefix, x, x + mid, WINDOW_BASES[1]) == span_hash(self.prefix, y, y + mid, WINDOW_BASES[1])
            low[open_] = np.where(same, mid, low[open_])
            high[open_] = np.where(same, high[open_], mid - 1)

    def matching_statistics(self) -> np.ndarray:
        """For each place of the texts (signs included) the longest match with another place."""
        place = np.arange(self.n)
        out = np.zeros(self.n, np.int64)
        for sampled, length in (self.before, self.after):
            k = np.searchsorted(sampled, place, side="right") - 1
            out = np.maximum(out, length[k] - (place - sampled[k]))
        return out


def _kernel(seed: int) -> anchors.Kernel:
    def run(data: np.ndarray, offsets: np.ndarray) -> tuple:
        prefix = prefix_hash(data, BASES[0])
        seeds = rolling_hash(prefix, seed, BASES[0])

        def signature(a: np.ndarray, z: np.ndarray) -> np.ndarray:
            return span_hash(prefix, a, z, BASES[0])

        def contents(start: np.ndarray, end: np.ndarray) -> pa.Array:
            raw = data.tobytes()
            return pa.array([raw[a:z] for a, z in zip(start.tolist(), end.tolist(), strict=True)], pa.binary())

        return offsets, seeds, signature, contents

    return run


SPANS = "id long, th long, start int, end int, far boolean"


def _indexed(rows: DataFrame, lengths: tuple[int, int]) -> DataFrame:
    """id, th, start, end (bytes) and far of the windows of an anchor's spans that match in another of them, of the two lengths (far: the first)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in anchors.whole_groups(batches, INDEX_BYTES):
            content = part.column("content").to_pylist()
            number: dict[bytes, int] = {}
            of = np.array([number.setdefault(x, len(number)) for x in content])
            sizes, pos = np.array([len(x) for x in content]), part.column("pos").to_numpy().astype(np.int64)
            row = np.empty(len(number), np.int64)
            row[of] = np.arange(len(of))
            index = RunLengthIndex(np.frombuffer(b"".join(number), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in number])]).astype(np.int64), part.column("n").to_numpy()[row], lengths[1])
            # equal spans repeat all their windows; of the others the index says which
            alone = np.bincount(of) == 1
            same = np.flatnonzero(~alone[of])
            # only a span's own windows begin a short match: the context behind them is another span's
            for which, (length, far) in enumerate(zip(lengths, (index.matching_statistics() >= lengths[0], index.repeats), strict=True)):
                edge = np.flatnonzero(np.diff(np.concatenate([[False], far, [False]]).astype(np.int8)))
                a, z = edge[::2], edge[1::2]
                text = np.searchsorted(index.starts, a, side="right") - 1
                equal = same[sizes[same] >= length]
                a, z, text = a[alone[text]], z[alone[text]], text[alone[text]]
                owner = np.concatenate([row[text], equal])
                start = np.concatenate([pos[row[text]] + a - index.starts[text], pos[equal]])
                end = np.concatenate([pos[row[text]] + z - index.starts[text] + length - 1, pos[equal] + sizes[equal]])
                take = pa.array(owner)
                yield pa.RecordBatch.from_arrays([part.column("id").combine_chunks().take(take), part.column("th").combine_chunks().take(take), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(np.full(len(owner), which == 0))], names=["id", "th", "start", "end", "far"])

    rows = rows.select("anchor", "id", "th", "pos", "n", "content").repartition("anchor").sortWithinPartitions("anchor")
    return rows.mapInArrow(run, SPANS)


def _pieces(rows: DataFrame, window: int) -> DataFrame:
    """Runs of PIECE windows at equal places to the anchor: anchor, core (hash of the bytes that all windows of the whole run have), h (of all bytes), id, th, pos, n and w (of each window); written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                prefix = prefix_hash(np.frombuffer(row["content"], np.uint8), WINDOW_BASES[0])
                w = rolling_hash(prefix, window, WINDOW_BASES[0])[: row["n"]].view(np.int64)
                if not len(w):
                    continue
                piece = (row["at"] - np.arange(len(w))) // PIECE
                first = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
                end = np.append(first[1:], len(w))
                place = mix(piece[first].astype(np.uint64))
                last = row["at"] - piece[first] * PIECE  # of the whole run, which the span may hold a part of
                core = span_hash(prefix, last, last - (PIECE - 1) + window, WINDOW_BASES[0]) ^ place
                h = span_hash(prefix, first, end + (window - 1), WINDOW_BASES[0]) ^ place
                out += [(row["anchor"], g, x, row["id"], row["th"], row["pos"] + a, z - a, w[a:z]) for g, x, a, z in zip(core.view(np.int64).tolist(), h.view(np.int64).tolist(), first.tolist(), end.tolist(), strict=True)]
            kinds = (*(pa.int64(),) * 5, pa.int32(), pa.int32(), pa.list_(pa.int64()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["anchor", "core", "h", "id", "th", "pos", "n", "w"])

    return written(rows.select("anchor", "id", "th", "pos", "at", "n", "content").mapInArrow(run, "anchor long, core long, h long, id long, th long, pos int, n int, w array<long>"), "pieces")


def _by_piece(rows: DataFrame, window: int) -> DataFrame:
    """id, th, start and end for anchors of very many classes, by hash and with map-side sums.

    Spans are cut to pieces; equal pieces repeat all their windows. A window that some
    other piece has is in pieces of one core, so only where a core has several classes of
    pieces the windows of one of each class are compared.
    """
    pieces = _pieces(rows, window)
    of = written(pieces.groupBy("anchor", "core", "h").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("id", "th", "pos")).alias("first")), "piece-classes")
    copies = pieces.join(of.where("c > 1").select("anchor", "core", "h"), ["anchor", "core", "h"], "left_semi").select("id", "th", F.col("pos").alias("start"), (F.col("pos") + F.col("n") + (window - 1)).alias("end"))
    several = of.groupBy("anchor", "core").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("anchor", "core")
    first = of.join(several, ["anchor", "core"], "left_semi").select("anchor", "core", "h", F.col("first.id").alias("id"), F.col("first.th").alias("th"), F.col("first.pos").alias("pos"))
    each = pieces.join(first, ["anchor", "core", "h", "id", "th", "pos"], "left_semi").select("anchor", "id", "th", "pos", F.posexplode("w").alias("j", "w"))
    shared = each.groupBy("anchor", "w").agg(F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    more = each.join(shared, ["anchor", "w"], "left_semi").select("id", "th", (F.col("pos") + F.col("j")).alias("start"), (F.col("pos") + F.col("j") + window).alias("end"))
    return copies.unionByName(more)


def repeated_spans(docs: DataFrame, window: int = WINDOW, noted: int = NOTED, seed: int = SEED) -> DataFrame:
    """id, th, start, end (bytes) and far of all that a repeated window covers; spans may overlap. ``docs``: keyed.

    far: by strings of ``window`` bytes; else by those of ``noted``. Anchors are those of the
    shorter strings; a span's content goes on far enough to hold the longer ones that begin in it.
    """
    scheme = anchors.Scheme(_kernel(seed), noted, seed, window - noted)
    found = anchors.spans(docs, scheme)
    of = anchors.classes(found)
    copies = found.join(of.where("c > 1").select("anchor", "sig"), ["anchor", "sig"], "left_semi")
    near = copies.select("id", "th", F.col("pos").alias("start"), (F.col("pos") + F.col("n") * F.col("k") + (noted - 1)).alias("end"), F.lit(False).alias("far"))
    far = copies.where(F.col("m") >= window).select("id", "th", F.col("pos").alias("start"), (F.col("pos") + F.col("n") * (F.col("k") - 1) + F.col("m")).alias("end"), F.lit(True).alias("far"))
    several = anchors.differing(docs, of, scheme, "binary", INDEX_CLASSES)
    hot = several.where("hot")
    out = near.unionByName(far).unionByName(_indexed(several.where("not hot"), (window, noted)))
    return out.unionByName(_by_piece(hot, noted).withColumn("far", F.lit(False))).unionByName(_by_piece(hot, window).withColumn("far", F.lit(True)))


def remove_repeats(docs: DataFrame, window: int = WINDOW, noted: int = NOTED, seed: int = SEED) -> DataFrame:
    """doc_id, n_bytes, ``removed`` (byte spans: start, end, start, ...; maximal), ``noted`` (likewise, by the shorter length) and ``kept`` (bytes).

    Every copy goes, the first too. Null and empty texts have no bytes; texts shorter than
    a window lose nothing. A document is an id with a text, and rows that repeat both are
    counted each: they are copies of one another and lose all their windows. What is
    removed is noted as well.
    """
    if not seed <= noted <= window:
        raise ValueError("seed, noted and window must not fall")
    whole = anchors.keyed(docs.select("doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            data, offsets = text_bytes(batch.column(0))
            sizes, removed, near, kept = [], [], [], []
            for k, (gone, some) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                mine = data[offsets[k] : offsets[k + 1]]
                off, edges = _edges(len(mine), gone)
                sizes.append(len(mine))
                removed.append(edges)
                near.append(_edges(len(mine), some)[1])
                kept.append(mine[~off].tobytes())
            lists = (pa.array(x, pa.list_(pa.int64())) for x in (removed, near))
            yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.int64()), pa.array(sizes, pa.int64()), *lists, pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "removed", "noted", "kept"])

    return anchors.by_document(whole, repeated_spans(whole, window, noted, seed), run, "doc_id long, n_bytes long, removed array<long>, noted array<long>, kept binary")


def _edges(n: int, spans: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """Which of n bytes lie in any of the spans, and the maximal runs of them."""
    flat = spans.values.to_numpy() if spans.is_valid else np.zeros(0, np.int32)
    off = covered(n, flat[::2], flat[1::2])
    return off, np.flatnonzero(np.diff(np.concatenate([[False], off, [False]]).astype(np.int8)))


def op1_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = remove_repeats(table(spark, sf_dir, "documents"))
    total = lambda spans: F.aggregate(F.transform(spans, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return got.select("doc_id", "n_bytes", total("removed").alias("n_removed"), (F.size("removed") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), total("noted").alias("n_noted"))

