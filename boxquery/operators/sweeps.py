"""Sweeps over thresholds and area ranges, in which a detection is one row.

What happens to a detection in all combinations of the sweep is told by bits of one row, not by a
row for each combination: greedy matching takes all of them in one pass over the pairs, and precision is
counted for all of them in one pass over the ranked detections. So what is shuffled and written goes with the detections,
however many thresholds and ranges there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from boxquery.operators import overlaps
from boxquery.operators.matching import candidates_of, class_free_match
from boxquery.operators.overlaps import busy, by_group, few_in_order, greedy_choice, new_groups, whole_groups
from boxquery.sources.scratch import parked

#: Rows whose bits are counted together.
CHUNK = 1 << 18
#: Ranges of the score that precision is counted in.
RANGES = 1024

Batches = Iterator[pa.RecordBatch]


def _bytes(n: int) -> int:
    return (n + 7) // 8


def _bits(column: pa.Array, n: int) -> np.ndarray:
    """A row of ``n`` flags for each value."""
    return np.unpackbits(np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), _bytes(n)), axis=1, count=n, bitorder="little")


def _schema(df: DataFrame, columns: Sequence[str], more: str) -> StructType:
    return StructType([*(df.schema[c] for c in columns), *StructType.fromDDL(more)])


def score_range() -> Column:
    """The range of a score, from the best to the worst; those without a score are beyond the last."""
    return F.coalesce(F.greatest(F.lit(0), F.least(F.lit(RANGES - 1), F.floor((1 - F.col("score")) * RANGES))), F.lit(RANGES)).cast("int")


# matching


def _in_turn(dets: DataFrame, gts: DataFrame, keys: Sequence[str], least: float, also: Sequence[str], of_gts: Sequence[str], within: Sequence[str], run: Callable[[Batches], Batches], schema: StructType, counted: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame | None]:
    """``run`` over the pairs of ``least`` or more by group (keys and ``within``) and rank of the detection, the best first, whole detections
    in a batch; one without pairs is a row without gt_id. Groups too large for one task are left out, and their keys returned.
    """
    many = busy(*counted, keys)
    keyed = F.lit(True)
    for k in keys:
        keyed = keyed & F.col(k).isNotNull()
    part = lambda df, how: (df if many is None else df.join(many.select(*keys), list(keys), how)).where(keyed)
    pairs = lambda how, cells: candidates_of(part(dets, how), part(gts, how), keys, least, also, of_gts, cells, outer=not cells).withColumn("_w", -F.col("iou"))
    order, groups = ["_s", "det_id", "_w", "gt_id"], [*keys, *within]
    few = pairs("left_anti", False)

    def alone(df: DataFrame) -> DataFrame:
        df, known = df.withColumn("_s", F.coalesce(-F.col("score"), F.lit(float("inf")))), {*groups, *also, "det_id", "_s"}
        return df.select(*(F.col(c) if c in known else F.lit(None).cast(t).alias(c) for c, t in few.dtypes))

    out = few_in_order(few, keys, [*within, *order], run, schema)
    out = out.unionByName(alone(dets.where(~keyed)).mapInArrow(run, schema))  # of no group, however many they are
    if many is None:
        return out, None
    crowd = many.where(F.col("_a") > overlaps.CROWD).select(*keys)
    crowd = None if crowd.isEmpty() else crowd
    met = pairs("left_semi", True).unionByName(alone(part(dets, "left_semi")))
    if crowd is not None:
        met = met.join(crowd, list(keys), "left_anti").select(*met.columns)

    def by_detection(batches: Iterator[tuple[pa.RecordBatch, np.ndarray]]) -> Batches:
        last = None

        def flagged() -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
            nonlocal last
            for batch, _ in batches:
                yield batch, new_groups(batch, [*groups, "det_id"], last)
                last = batch.slice(batch.num_rows - 1, 1)

        return run(whole_groups(flagged()))

    return out.unionByName(by_group(met, groups, order, by_detection, schema)), crowd


def _detections(batches: Batches, groups: Sequence[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, list[bool]]]:
    """The batches, where their detections begin (and the last one ends), and which of those begin a group."""
    last = None
    for batch in batches:
        if batch.num_rows:
            new = new_groups(batch, groups, last)
            starts = np.flatnonzero(new_groups(batch, [*groups, "det_id"], None))
            last = batch.slice(batch.num_rows - 1, 1)
            yield batch, np.append(starts, batch.num_rows), new[starts].tolist()


def _passed(batch: pa.RecordBatch, thresholds: Sequence[float]) -> list[int]:
    """How many of the sorted thresholds each pair passes."""
    iou = pc.if_else(batch.column("gt_id").is_valid(), batch.column("iou"), -float("inf")).to_numpy(zero_copy_only=False)
    return np.searchsorted(np.array(thresholds), iou, "right").tolist()


def ranged_bits(dets: DataFrame, gts: DataFrame, thresholds: Sequence[float], ranges: dict[str, tuple[float, float]], also: Sequence[str] = (), counted: DataFrame | None = None) -> DataFrame:
    """category_id, det_id, score, columns ``also``, hit and skip: every detection, with a bit for each range and (sorted) threshold.

    hit: takes a truth box that counts; skip: is ignored. Truth boxes out of the range are ignored; a detection prefers those that
    count, one that takes an ignored box is ignored, and so is an unmatched one whose own area is out of range. ``counted``: a table
    that holds all of dets and is cheaper to count.
    """
    keys, ts = ["image_id", "category_id"], sorted(min(t, 1 - 1e-10) for t in thresholds)
    assert len(ranges) < 63, "too many ranges"
    area = F.col("w") * F.col("h")
    out_of = [F.when(F.coalesce((area >= a) & (area <= b), F.lit(False)), F.lit(0)).otherwise(F.lit(1 << k)).cast("long") for k, (a, b) in enumerate(ranges.values())]
    off = out_of[0]
    for more in out_of[1:]:
        off = off + more
    dets, gts = dets.withColumn("_off", off), gts.withColumn("_off", off)
    n, size, columns = len(ts) * len(ranges), _bytes(len(ts) * len(ranges)), ["category_id", "det_id", "score", *also]
    schema = _schema(dets, columns, "hit binary, skip binary")
    every = lambda mask: sum(((1 << len(ts)) - 1) << k * len(ts) for k in range(len(ranges)) if mask >> k & 1)
    whole = every(-1)
    fits = [sum(((1 << m) - 1) << k * len(ts) for k in range(len(ranges))) for m in range(len(ts) + 1)]

    def run(batches: Batches) -> Batches:
        spread: dict[int, int] = {}
        taken: dict[int, int] = {}
        for batch, cuts, fresh in _detections(batches, keys):
            passed, gt = _passed(batch, ts), batch.column("gt_id").to_pylist()
            out = [spread.get(m) or spread.setdefault(m, every(m)) for m in batch.column("_off").to_pylist()]
            outs = [m and (spread.get(m) or spread.setdefault(m, every(m))) for m in batch.column("gt__off").to_pylist()]
            hits, skips, starts = [], [], cuts.tolist()
            for k, first in enumerate(fresh):
                if first:
                    taken = {}
                a, b, free, hit, ignored = starts[k], starts[k + 1], whole, 0, 0
                for counts in (True, False):
                    for i in range(a, b):
                        if passed[i]:
                            g = gt[i]
                            held = taken.get(g, 0)
                            can = fits[passed[i]] & (~outs[i] if counts else outs[i]) & free & ~held
                            if can:
                                taken[g], free = held | can, free ^ can
                                if counts:
                                    hit |= can
                                else:
                                    ignored |= can
                hits.append(hit.to_bytes(size, "little"))
                skips.append((ignored | out[a] & free).to_bytes(size, "little"))
            rows = batch.take(pa.array(cuts[:-1]))
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in columns), pa.array(hits, pa.binary()), pa.array(skips, pa.binary())], names=schema.names)

    found, crowd = _in_turn(dets, gts, keys, ts[0], ["score", "_off", *also], ["_off"], [], run, schema, (dets if counted is None else counted, gts))
    if crowd is None:
        return found
    table = F.broadcast(dets.sparkSession.createDataFrame([(k * len(ts) + m, k, t) for k in range(len(ranges)) for m, t in enumerate(ts)], "_c int, _a int, _t double"))
    big = dets.join(crowd, keys, "left_semi")
    pairs = candidates_of(big, gts.join(crowd, keys, "left_semi"), keys, ts[0], of_gts=["_off"]).crossJoin(table).where("iou >= _t")
    pairs = pairs.select("_c", *keys, "det_id", "gt_id", "iou", "_s", F.expr("(gt__off & shiftleft(1L, _a)) <> 0").alias("ign"))
    chosen = greedy_choice(pairs, ["_c", *keys], "det_id", "gt_id", [F.col("_s")], [F.col("ign"), -F.col("iou")], crowd)
    lists = chosen.groupBy("det_id").agg(F.collect_list(F.when(~F.col("ign"), F.col("_c"))).alias("_hits"), F.collect_list(F.when(F.col("ign"), F.col("_c"))).alias("_ignored"))

    def told(batches: Batches) -> Batches:
        for batch in batches:
            hits, ignored = ([sum(1 << c for c in v or ()) for v in batch.column(name).to_pylist()] for name in ("_hits", "_ignored"))
            skips = [i | every(o) & ~(h | i) for h, i, o in zip(hits, ignored, batch.column("_off").to_pylist(), strict=True)]
            bits = [pa.array([v.to_bytes(size, "little") for v in values], pa.binary()) for values in (hits, skips)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *bits], names=schema.names)

    return found.unionByName(big.join(lists, "det_id", "left").select(*columns, "_off", "_hits", "_ignored").mapInArrow(told, schema))


def two_mode_bits(dets: DataFrame, gts: DataFrame, thresholds: Sequence[float], by: str, relabel_at: float, cap: int) -> DataFrame:
    """mode, ``by``, category_id, det_id, score and hit: every detection, class-aware and class-agnostic, with a bit for each (sorted) threshold.

    dets: ``by``, image_id, category_id, det_id, score and box, as a table. Class-agnostic: it first takes the class of the truth box that it
    matches at ``relabel_at``. Only the ``cap`` best of an image and class, in the class that they have then, are there.
    """
    ts, groups = sorted(thresholds), ["image_id", by]
    size, full = _bytes(len(ts)), (1 << len(ts)) - 1
    least = min(relabel_at, ts[0])
    schema = StructType([*StructType.fromDDL("mode string"), *_schema(dets, [by, "category_id", "det_id", "score"], "hit binary")])

    def run(batches: Batches) -> Batches:
        used: set = set()
        places: dict = {}
        held: tuple[dict, dict] = ({}, {})
        for batch, cuts, fresh in _detections(batches, groups):
            passed, near, gt, of, own = _passed(batch, ts), _passed(batch, [relabel_at]), batch.column("gt_id").to_pylist(), batch.column("gt_category_id").to_pylist(), batch.column("category_id").to_pylist()
            starts = cuts.tolist()
            rows: tuple[list, list] = ([], [])
            classes: tuple[list, list] = ([], [])
            hits: tuple[list, list] = ([], [])
            for k, first in enumerate(fresh):
                if first:
                    used, places, held = set(), {}, ({}, {})
                a, b = starts[k], starts[k + 1]
                free = own[a]
                for i in range(a, b):
                    if near[i] and gt[i] not in used:
                        used.add(gt[i])
                        free = own[a] if of[i] is None else of[i]
                        break
                for mode, c in enumerate((own[a], free)):
                    place = places[mode, c] = places.get((mode, c), 0) + 1
                    if place > cap:
                        continue
                    hit, taken = 0, held[mode]
                    if c is not None:
                        for i in range(a, b):
                            if passed[i] and of[i] == c:
                                before = taken.get(gt[i], 0)
                                can = ((1 << passed[i]) - 1) & ~before & ~hit & full
                                if can:
                                    taken[gt[i]], hit = before | can, hit | can
                    rows[mode].append(a)
                    classes[mode].append(c)
                    hits[mode].append(hit.to_bytes(size, "little"))
            kind = batch.column("category_id").type
            for mode, name in enumerate(("aware", "agnostic")):
                kept = batch.take(pa.array(rows[mode], pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([name] * kept.num_rows, pa.string()), kept.column(by), pa.array(classes[mode], kind), kept.column("det_id"), kept.column("score"), pa.array(hits[mode], pa.binary())], names=schema.names)

    found, crowd = _in_turn(dets, gts, ["image_id"], least, [by, "category_id", "score"], ["category_id"], [by], run, schema, (dets, gts))
    if crowd is None:
        return found
    # images too crowded for one task: one class after another by rounds, a row for each threshold
    big = dets.join(crowd, ["image_id"], "left_semi")
    pairs = parked(candidates_of(big, gts.join(crowd, ["image_id"], "left_semi"), ["image_id"], least, [by], ["category_id"]), "pairs")
    near = class_free_match(pairs, [by], relabel_at, crowd)
    agnostic = big.join(near, [by, "det_id"], "left").withColumn("category_id", F.coalesce("_cat", "category_id")).drop("_cat")
    both = big.withColumn("mode", F.lit("aware")).unionByName(agnostic.withColumn("mode", F.lit("agnostic")))
    rank = F.row_number().over(overlaps.Window.partitionBy("mode", *groups, "category_id").orderBy(F.coalesce(-F.col("score"), F.lit(float("inf"))), "det_id"))
    both = parked(both.withColumn("_place", rank).where(F.col("_place") <= cap).drop("_place"), "ranked-methods")
    table = F.broadcast(dets.sparkSession.createDataFrame(list(enumerate(ts)), "_c int, _t double"))
    known = pairs.where(F.col("iou") >= ts[0]).join(both.select("mode", by, "det_id", "category_id"), [by, "det_id"]).where("category_id = gt_category_id")
    tried = known.crossJoin(table).where("iou >= _t").select("mode", by, "_c", "image_id", "category_id", "det_id", "gt_id", "iou", "_s")
    chosen = greedy_choice(tried, ["mode", by, "_c", "image_id", "category_id"], "det_id", "gt_id", [F.col("_s")], [-F.col("iou")], crowd)
    lists = chosen.groupBy("mode", by, "det_id").agg(F.collect_list("_c").alias("_hits"))

    def told(batches: Batches) -> Batches:
        for batch in batches:
            bits = pa.array([sum(1 << c for c in v or ()).to_bytes(size, "little") for v in batch.column("_hits").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in schema.names[:-1]), bits], names=schema.names)

    return found.unionByName(both.join(lists, ["mode", by, "det_id"], "left").select(*schema.names[:-1], "_hits").mapInArrow(told, schema))


# counting


def bit_counts(rows: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    """by, _hits and _rows: how many of the rows have each of the ``n`` bits in hit, and not in skip; several rows a group, which add up.

    rows: by, hit, skip (null: no bit).
    """
    schema = _schema(rows, by, "_hits array<int>, _rows array<int>")

    def counted(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        table = table.take(pc.sort_indices(table, sort_keys=[(c, "ascending") for c in by])).combine_chunks()
        batch = table.to_batches()[0]
        starts = np.flatnonzero(new_groups(batch, by, None))
        sums = [np.add.reduceat(flags, starts, axis=0, dtype=np.int32) for flags in _flags(batch, n)]
        ends = pa.array(np.arange(len(starts) + 1, dtype=np.int32) * n)
        first = batch.take(pa.array(starts))
        return pa.RecordBatch.from_arrays([*(first.column(c) for c in by), *(pa.ListArray.from_arrays(ends, pa.array(s.ravel())) for s in sums)], names=schema.names)

    def run(batches: Batches) -> Batches:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= CHUNK:
                yield counted(held)
                held, size = [], 0
        if size:
            yield counted(held)

    return rows.select(*by, "hit", "skip").mapInArrow(run, schema)


def _flags(batch: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which bits of each row are hit, and which count."""
    return _bits(batch.column("hit"), n), 1 - _bits(batch.column("skip").fill_null(bytes(_bytes(n))), n)


def _ahead(counts: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    """by, _range, and _hits and _rows of all better ranges, from ``bit_counts`` by range."""
    schema = _schema(counts, [*by, "_range"], "_hits array<long>, _rows array<long>")
    parts = ("_hits", "_rows")

    def scan(running: bool) -> Callable[[Iterator[tuple[pa.RecordBatch, np.ndarray]]], Batches]:
        """Sums of equal ranges; then, running, what all ranges before hold."""

        def run(batches: Iterator[tuple[pa.RecordBatch, np.ndarray]]) -> Batches:
            total, key = np.zeros((2, n), np.int64), None
            out = lambda key, value: pa.RecordBatch.from_arrays([*key, *(pa.array([v.tolist()], pa.list_(pa.int64())) for v in value)], names=schema.names)
            for batch, new in batches:
                values = np.stack([batch.column(c).flatten().to_numpy().reshape(batch.num_rows, n) for c in parts], axis=1)
                for k, first in enumerate(new.tolist()):
                    at = [batch.column(c).slice(k, 1) for c in (*by, "_range")]
                    if first:
                        if not running and key is not None:
                            yield out(key, total)
                        total = np.zeros((2, n), np.int64)
                    if running:
                        yield out(at, total)
                    key, total = at, total + values[k]
            if not running and key is not None:
                yield out(key, total)

        return run

    whole = by_group(counts, [*by, "_range"], [], scan(False), schema)
    return by_group(whole, by, ["_range"], scan(True), schema)


def best_points_of_bits(rows: DataFrame, truths: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    """by, _c, _k, _prec and _rec: the best precision at each of the 101 recalls that is reached, for every bit; several rows a point, of which the best counts.

    rows, as a table: by, score, det_id, hit, skip; truths: by, _c, npos. Detections are ranked and counted within ranges of the score, from what the better
    ranges hold; precision is best where a detection hits, so only those are points.
    """
    ranged = rows.withColumn("_range", score_range())
    ahead = _ahead(bit_counts(ranged, [*by, "_range"], n), by, n)
    of = truths.where("npos > 0").groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_c", F.col("npos").cast("long")))).alias("_m"))
    of = of.select(*by, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda c: F.coalesce(F.try_element_at("_m", c), F.lit(0).cast("long"))).alias("_npos"))
    heads = ahead.join(of, list(by)).select(*by, "_range", F.concat("_hits", "_rows", "_npos").alias("_head"))
    both = ranged.select(*by, "_range", "score", "det_id", "hit", "skip").unionByName(heads, allowMissingColumns=True)
    schema = _schema(rows, by, "_c int, _k int, _prec double, _rec double")
    groups = [*by, "_range"]

    def run(batches: Iterator[tuple[pa.RecordBatch, np.ndarray]]) -> Batches:
        head = None
        for batch, new in batches:
            cuts = np.append(np.flatnonzero(np.append(True, new[1:])), batch.num_rows).tolist()
            at, parts = [], []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                start = a
                if new[a]:
                    head = batch.column("_head")[a].as_py()
                    if head is not None:
                        head, start = np.array(head, np.int64).reshape(3, n), a + 1
                if head is None or start == b:
                    continue
                flags = _flags(batch.slice(start, b - start), n)
                hit, counts = (np.cumsum(f, axis=0, dtype=np.int64) for f in flags)
                c, k = np.nonzero(flags[0].T & (head[2] > 0)[:, None])
                if len(c):
                    tp = hit[k, c] + head[0][c]
                    rec, prec = tp / head[2][c], tp / (counts[k, c] + head[1][c])
                    k = np.floor(rec * 100)
                    k = np.where((k + 1) / 100.0 <= rec, k + 1, np.where(k / 100.0 <= rec, k, k - 1)).astype(np.int32)
                    first = np.flatnonzero(np.append(True, (c[1:] != c[:-1]) | (k[1:] != k[:-1])))
                    at += [a] * len(first)
                    parts.append((c[first].astype(np.int32), k[first], np.maximum.reduceat(prec, first), np.maximum.reduceat(rec, first)))
                head[0] += hit[-1]
                head[1] += counts[-1]
            if parts:
                keys = batch.select(list(by)).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*keys.columns, *(pa.array(np.concatenate(p)) for p in zip(*parts, strict=True))], names=schema.names)

    return by_group(both, groups, [F.col("_head").isNull(), F.desc("score"), F.col("det_id")], run, schema)
