"""Overlap joins by cells, and greedy selection over the pairs that they find.

A box is looked for in cells of its own size: of a pair, one box stands in the cell of
its centre, the other in all cells where such a centre may lie, so a pair is met once, and a
crowded image is as many groups as it has cells. Sequential operators read the
pairs, sorted, in one pass; groups too large for one task are worked off in rounds.
Matching needs no cells in groups of a few boxes: they meet by their keys alone, and the task that
joins them chooses among the pairs too, so pairs aren't shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxquery.functions.geometry import centroid_in_sql, iou_sql
from boxquery.sources.scratch import parked

BOX = ("x", "y", "w", "h")
#: Sides are measured in 2**-20 of a unit, so boxes of a normalised frame have cells too.
FINE = 20
#: Below this overlap a box may meet others of any size, and cells would be smaller than what they hold.
LEAST_BY_CELLS = 0.02
#: Groups of at most so many boxes on either side meet without cells when matched: copies for cells would cost more than the tests they save.
FEW = 256
#: Groups of more boxes than this are worked off in rounds of all tasks; others are read by one task each.
CROWD = 100_000
#: Rounds before what is left goes to one task a group after all.
MOST_ROUNDS = 40


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select([F.col(c).alias(f"{prefix}{c}") for c in df.columns])


def _level_sql(side: str) -> str:
    """The smallest l with 2**l >= side, in fine units; exact, by the length of the binary number."""
    return f"length(bin(greatest(ceil({side} * {1 << FINE}D), 1) - 1))"


def _size_sql(level: str) -> str:
    """Side of a cell: twice the longest side of the boxes that belong to it."""
    return f"pow(2D, {level} + {1 - FINE})"


def _solid_sql(p: str) -> str:
    """Whether a box has an area and an end; others overlap nothing."""
    return f"{p}w > 0D and {p}h > 0D and abs({p}x) < 1e12D and abs({p}y) < 1e12D and {p}w < 1e12D and {p}h < 1e12D"


def _at_centre(df: DataFrame, p: str) -> DataFrame:
    """Each box once, in the cell of its centre."""
    size = _size_sql("_l")
    return df.withColumn("_l", F.expr(f"case when {_solid_sql(p)} then {_level_sql(f'greatest({p}w, {p}h)')} end")).withColumns({"_cx": F.expr(f"floor(({p}x + {p}w / 2D) / {size})"), "_cy": F.expr(f"floor(({p}y + {p}h / 2D) / {size})")})


def _around(df: DataFrame, p: str, threshold: float, centres: DataFrame) -> DataFrame:
    """Each box in all cells that hold the centre of a box which it may overlap by ``threshold``.

    Overlap bounds the ratio of the sides from both ends by the threshold, and so the levels; of these only the
    ones that ``centres`` has are filled. On either axis the boxes share the threshold's part of the longer side at least, and
    so the centre of a side of m at most is no farther out than m / 2 less that part.
    """
    t = min(threshold, 1.0) * (1 - 1e-9)
    slack = 0.9 * t  # far from rounding
    side, size = f"greatest({p}w, {p}h)", _size_sql("_l")

    def range_of(v: str, n: str) -> Column:
        most = f"least({size} / 2D, {p}{n} * {1.0 if slack >= 0.5 else 1 / slack}D)"
        out = f"({most} / 2D - {slack}D * greatest({most}, {p}{n}))"
        return F.expr(f"explode(sequence(floor(({p}{v} - {out}) / {size}), floor(({p}{v} + {p}{n} + {out}) / {size})))")

    levels = df.where(_solid_sql(p)).withColumn("_l", F.expr(f"explode(sequence({_level_sql(f'{side} * {t}D')}, {_level_sql(f'{side} / {t}D')}))"))
    held = F.broadcast(centres.select(F.col("_l").alias("_held")).distinct())  # 64 at most
    levels = levels.join(held, F.col("_l") == F.col("_held"), "left_semi")
    return levels.withColumn("_cx", range_of("x", "w")).withColumn("_cy", range_of("y", "h"))


def _centre_join(left: DataFrame, right: DataFrame, on: list[Column], of: str, within: str) -> DataFrame:
    """Pairs where the centre of a box of ``of`` lies in the box of ``within``, whatever their sizes."""
    outer, inner = (left, right) if within == "a_" else (right, left)
    size = _size_sql("_l")
    outer = outer.withColumn("_l", F.expr(f"case when abs({within}x) < 1e12D and abs({within}y) < 1e12D and {within}w < 1e12D and {within}h < 1e12D then {_level_sql(f'greatest({within}w, {within}h)')} end"))
    levels = F.broadcast(outer.select("_l").distinct().where("_l is not null"))  # 64 at most
    range_of = lambda v, n: F.expr(f"explode(sequence(floor({within}{v} / {size}), floor(({within}{v} + greatest({within}{n}, 0D)) / {size})))")
    outer = outer.where("_l is not null").withColumn("_cx", range_of("x", "w")).withColumn("_cy", range_of("y", "h"))
    inner = inner.crossJoin(levels).withColumns({"_cx": F.expr(f"floor(({of}x + {of}w / 2D) / {size})"), "_cy": F.expr(f"floor(({of}y + {of}h / 2D) / {size})")})
    o, i = outer.alias("_o"), inner.alias("_i")
    cell = [F.col(f"_o.{c}") == F.col(f"_i.{c}") for c in ("_l", "_cx", "_cy")]
    met = o.join(i, [*on, *cell, F.expr(centroid_in_sql(of, within))])
    return met.select(*left.columns, *right.columns)


def iou_join(a: DataFrame, b: DataFrame, keys: Sequence[str], threshold: float, ordered: str | Sequence[str] | None = None, centroid: str | None = None, cells: bool = True, outer: bool = False) -> DataFrame:
    """Pairs (columns a_*, b_*) of equal keys that overlap by ``threshold`` or more, with ``iou``.

    ``ordered``: columns by which a comes before b (self-joins take each pair once).
    ``centroid``: "or" also takes pairs where a centre lies in the other box, "and" takes
    only those. The join hashes on the keys and a cell; without ``cells``, for groups of a few boxes, on the keys alone; ``outer`` then
    returns boxes of a that meet none too, with nulls. Boxes without an area, a null or not finite
    side or place overlap nothing; repeated rows are pairs each. A threshold of 0 or less takes all pairs of a key.
    """
    if centroid not in (None, "or", "and"):
        raise ValueError(f"centroid is 'or' or 'and', not {centroid!r}")
    left, right = prefixed(a, "a_"), prefixed(b, "b_")
    on = [F.col(f"a_{k}") == F.col(f"b_{k}") for k in keys]
    if ordered:
        names = [ordered] if isinstance(ordered, str) else list(ordered)
        first, second = ([F.col(p + n) for n in names] for p in ("a_", "b_"))
        on.append(first[0] < second[0] if len(names) == 1 else F.struct(*(c.alias(f"k{i}") for i, c in enumerate(first))) < F.struct(*(c.alias(f"k{i}") for i, c in enumerate(second))))
    near = iou_sql("a_", "b_")
    test = F.expr(f"{near} >= {float(threshold)}D")
    inside = [centroid_in_sql("a_", "b_"), centroid_in_sql("b_", "a_")]
    if centroid == "and":
        test = test & F.expr(f"({inside[0]} or {inside[1]})")
    columns = [*left.columns, *right.columns]
    if threshold < LEAST_BY_CELLS or not cells:
        if threshold > 0:
            test = test & F.expr(f"{_solid_sql('a_')} and {_solid_sql('b_')}")
        if not cells:
            left = left.hint("merge")
        extra = F.expr(f"({inside[0]} or {inside[1]})") if centroid == "or" else F.lit(False)
        return left.join(right, [*on, test | extra], "left" if outer else "inner").select(*columns).withColumn("iou", F.expr(near))
    # a size that is guessed before boxes are put into their cells must not make a broadcast of them
    centres = _at_centre(left, "a_")
    l, r = centres.hint("merge").alias("_p"), _around(right, "b_", threshold, centres).alias("_q")  # noqa: E741
    cell = [F.col(f"_p.{c}") == F.col(f"_q.{c}") for c in ("_l", "_cx", "_cy")]
    out = l.join(r, [*on, *cell, test]).select(*columns)
    if centroid == "or":
        apart = F.coalesce(F.expr(f"{near} < {float(threshold)}D"), F.lit(True))
        out = out.unionByName(_centre_join(left, right, on, "a_", "b_").where(apart))
        out = out.unionByName(_centre_join(left, right, on, "b_", "a_").where(apart & ~F.expr(inside[0])))
    return out.withColumn("iou", F.expr(near))


def overlapped(a: DataFrame, b: DataFrame, keys: Sequence[str], threshold: float, differ: str | None = None) -> DataFrame:
    """Rows of ``a`` that some row of ``b`` overlaps; ``differ``: a column in which the two must differ."""
    left, right = a.withColumns({f"_a_{c}": F.col(c) for c in BOX}), prefixed(b, "b_")
    on = [F.col(f"_p.{k}") == F.col(f"b_{k}") for k in keys]
    if differ:
        on.append(F.col(f"_p.{differ}") != F.col(f"b_{differ}"))
    on.append(F.expr(f"{iou_sql('_a_', 'b_')} >= {float(threshold)}D"))
    if threshold > 0:
        on.append(F.expr(f"{_solid_sql('_a_')} and {_solid_sql('b_')}"))
    if threshold >= LEAST_BY_CELLS:
        centres = _at_centre(left, "_a_")
        left, right = centres.hint("merge"), _around(right, "b_", threshold, centres)
        on += [F.col(f"_p.{c}") == F.col(f"_q.{c}") for c in ("_l", "_cx", "_cy")]
    return left.alias("_p").join(right.alias("_q"), on, "left_semi").select(*a.columns)


def new_groups(batch: pa.RecordBatch, keys: Sequence[str], last: pa.RecordBatch | None) -> np.ndarray:
    """Which rows of a sorted batch are the first of their keys; ``last``: the row before it."""
    new = np.zeros(batch.num_rows, bool)
    for k in keys:
        column = batch.column(k)
        if last is not None:
            column = pa.concat_arrays([last.column(k), column])
        differs = pc.fill_null(pc.not_equal(column[1:], column[:-1]), True).to_numpy(zero_copy_only=False)
        new[len(new) - len(differs) :] |= differs
    if last is None:
        new[0] = True
    return new


def by_group(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column], run: Callable[[Iterator[tuple[pa.RecordBatch, np.ndarray]]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``run`` over each task's rows, sorted by keys and order, with the flags of the first rows of groups."""

    def flagged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        last = None
        for batch in batches:
            if batch.num_rows:
                yield batch, new_groups(batch, keys, last)
                last = batch.slice(batch.num_rows - 1, 1)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(lambda batches: run(flagged(batches)), schema)


def crowded(boxes: DataFrame, keys: Sequence[str]) -> DataFrame | None:
    """The keys of groups too large for one task; None if there are none."""
    large = boxes.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > CROWD).drop("_n")
    return None if large.isEmpty() else parked(large, "crowded")


def busy(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame | None:
    """keys, _a and _b, the boxes of either side, of the groups that have more than ``FEW`` on one; None if there are none."""
    side = lambda df, p, q: df.select(*keys, F.lit(p).alias("_a"), F.lit(q).alias("_b"))
    counts = side(a, 1, 0).union(side(b, 0, 1)).groupBy(*keys).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    many = counts.where(F.greatest("_a", "_b") > min(FEW, CROWD))
    return None if many.isEmpty() else parked(many, "busy")


def _take_first(who: str, what: str) -> Callable[[Iterator[tuple[pa.RecordBatch, np.ndarray]]], Iterator[pa.RecordBatch]]:
    """Of each chooser, in order, the first pair whose chosen one is free."""

    def run(pairs: Iterator[tuple[pa.RecordBatch, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        taken: set = set()
        chooser, free = None, True
        for batch, new in pairs:
            keep = np.zeros(batch.num_rows, bool)
            for k, (one, other, first) in enumerate(zip(batch.column(who).to_pylist(), batch.column(what).to_pylist(), new.tolist(), strict=True)):
                if first:
                    taken = set()
                if first or one != chooser:
                    chooser, free = one, True
                if free and other not in taken:
                    taken.add(other)
                    keep[k], free = True, False
            yield batch.filter(pa.array(keep))

    return run


def greedy_choice(pairs: DataFrame, keys: Sequence[str], who: str, what: str, rank: Sequence[Column], preference: Sequence[Column], crowd: DataFrame | None = None) -> DataFrame:
    """The pairs that come of choosing in turn: each ``who``, by rank, takes of its pairs the first free ``what`` by preference.

    Rank and preference ascend; they end in the two ids, so the result doesn't depend on the
    partitions. A task reads its groups' pairs once, in order, and holds the taken ids of one group; pairs are shuffled
    as they are, so leave out columns that nothing needs.
    Groups of ``crowd`` (some of the keys) go by rounds: a pair is settled when its ``what`` is the best one left to ``who``
    and ``who`` is the first left of all that have a pair with ``what``; nobody who comes earlier can take it then.
    """
    scan = lambda df: by_group(df.select(*pairs.columns), keys, [*rank, who, *preference, what], _take_first(who, what), pairs.schema)
    if crowd is None:
        return scan(pairs)
    out = scan(pairs.join(crowd, crowd.columns, "left_anti"))
    ranks, wants = [f"_r{i}" for i in range(len(rank))], [f"_w{i}" for i in range(len(preference))]
    rows = pairs.withColumns({**dict(zip(ranks, rank, strict=True)), **dict(zip(wants, preference, strict=True)), "_who": F.col(who), "_what": F.col(what)})
    left = parked(rows.join(crowd, crowd.columns, "left_semi").select(*rows.columns), "pairs")
    for _ in range(MOST_ROUNDS):
        if left.isEmpty():
            return out
        best = left.groupBy(*keys, "_who").agg(F.min_by("_what", F.struct(*wants, "_what")).alias("_what"))
        first = left.groupBy(*keys, "_what").agg(F.min_by("_who", F.struct(*ranks, "_who")).alias("_who"))
        won = parked(best.join(first, [*keys, "_who", "_what"]), "settled")
        out = out.unionByName(left.join(won, [*keys, "_who", "_what"], "left_semi").select(*pairs.columns))
        left = parked(left.join(won, [*keys, "_who"], "left_anti").join(won, [*keys, "_what"], "left_anti").select(*rows.columns), "pairs")
    return out.unionByName(scan(left))


def whole_groups(batches: Iterator[tuple[pa.RecordBatch, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """The rows, cut where groups begin."""
    held: list[pa.RecordBatch] = []
    for batch, new in batches:
        starts = np.flatnonzero(new)
        if len(starts):  # all groups before the last one that begins here are whole
            held.append(batch.slice(0, starts[-1]))
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, batch = [], batch.slice(starts[-1])
        held.append(batch)
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _whole_sorted(batches: Iterator[tuple[pa.RecordBatch, np.ndarray]], keys: Sequence[str], order: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """The rows of whole groups, sorted within each by ``order``, ascending, nulls first and NaN last as Spark sorts."""
    for batch in whole_groups(batches):
        by = {"group": pa.array(np.cumsum(new_groups(batch, keys, None)))}
        for k, column in enumerate(batch.column(c) for c in order):
            if column.null_count:
                by[f"valid{k}"] = column.is_valid().cast(pa.int8())
            by[f"order{k}"] = column
        yield batch.take(pc.sort_indices(pa.RecordBatch.from_pydict(by), sort_keys=[(c, "ascending") for c in by]))


def few_in_order(rows: DataFrame, keys: Sequence[str], order: Sequence[str], run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``run`` over rows whose ``keys`` have few boxes, whole groups in a batch, sorted within each by ``order``; rows that come of a join on the keys are neither shuffled nor sorted by Spark."""
    # the window's count keeps a group in one task also where a skewed join would be split
    rows = rows.withColumn("_size", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    return by_group(rows, keys, [], lambda batches: run(_whole_sorted(batches, keys, order)), schema)


def choice_of_few(pairs: DataFrame, keys: Sequence[str], within: Sequence[str], who: str, what: str, rank: Sequence[Column], preference: Sequence[Column]) -> DataFrame:
    """``greedy_choice`` by keys and ``within``, of pairs whose ``keys`` have few boxes; a task holds the pairs of one of their groups.

    Pairs that come of a join on the keys are chosen from where they are: neither shuffled nor sorted by Spark.
    """
    ranks, wants = [f"_r{i}" for i in range(len(rank))], [f"_w{i}" for i in range(len(preference))]
    rows = pairs.withColumns({**dict(zip(ranks, rank, strict=True)), **dict(zip(wants, preference, strict=True))})
    names, order = pairs.columns, [*within, *ranks, who, *wants, what]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flagged = ((b, new_groups(b, [*keys, *within], None)) for b in batches if b.num_rows)
        return (b.select(names) for b in _take_first(who, what)(flagged))

    return few_in_order(rows, keys, order, run, pairs.schema)


def _drop_later(pairs: Iterator[tuple[pa.RecordBatch, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Of pairs (earlier, later), sorted by the later one: those later ones that a kept earlier one drops, once each."""
    dropped: set = set()
    for batch, new in pairs:
        gone = []
        for early, late, first in zip(batch.column("_early").to_pylist(), batch.column("_late").to_pylist(), new.tolist(), strict=True):
            if first:
                dropped = set()
            if early not in dropped and late not in dropped:
                dropped.add(late)
                gone.append(late)
        yield pa.RecordBatch.from_arrays([pa.array(gone, batch.column("_late").type)], names=["_late"])


def suppressed(pairs: DataFrame, keys: Sequence[str], early: str, late: str, rank: Sequence[Column], crowd: DataFrame | None = None) -> DataFrame:
    """Column _late: the ids that an earlier kept one suppresses; ``rank``: of the later one, ascending, ending in its id.

    Groups of ``crowd`` go by rounds: who has no earlier pair left is kept, whom they pair with is dropped.
    """
    ranks = [f"_r{i}" for i in range(len(rank))]
    rows = pairs.select(*keys, F.col(early).alias("_early"), F.col(late).alias("_late"), *(c.alias(n) for c, n in zip(rank, ranks, strict=True)))
    scan = lambda df: by_group(df, keys, ranks, _drop_later, rows.select("_late").schema)
    if crowd is None:
        return scan(rows)
    out = scan(rows.join(crowd, crowd.columns, "left_anti").select(*rows.columns))
    left = parked(rows.join(crowd, crowd.columns, "left_semi").select(*rows.columns), "pairs")
    for _ in range(MOST_ROUNDS):
        if left.isEmpty():
            return out
        free = left.join(left.select(*keys, F.col("_late").alias("_early")).distinct(), [*keys, "_early"], "left_anti")
        gone = parked(free.select(*keys, "_late").distinct(), "suppressed")
        out = out.unionByName(gone.select("_late"))
        as_early = gone.withColumnRenamed("_late", "_early")
        left = parked(left.join(gone, [*keys, "_late"], "left_anti").join(as_early, [*keys, "_early"], "left_anti").select(*rows.columns), "pairs")
    return out.unionByName(scan(left))
