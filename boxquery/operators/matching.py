"""Greedy operators and components over overlapping boxes.

Candidate pairs come from an overlap join by cells; the sequential operators read them.
All orders end in a unique id, so results don't depend on the partitions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxquery.operators import overlaps
from boxquery.operators.overlaps import BOX, busy, by_group, choice_of_few, crowded, greedy_choice, iou_join, overlapped, suppressed
from boxquery.sources.scratch import parked


def greedy_dedup(boxes: DataFrame, keys: Sequence[str], order: Sequence[Column], id: str, threshold: float) -> DataFrame:
    """Of each group the boxes that overlap no box kept before by ``threshold`` or more.

    ``order`` are sort keys, ascending; the id parts ties. Serves as cross-source dedup
    (order by source rank, then score) and as non-maximum suppression (order by score).
    Work goes with the pairs that overlap, not with the square of a group.
    """
    ranks = [f"_o{i}" for i in range(len(order))]
    narrow = boxes.withColumns(dict(zip(ranks, order, strict=True))).select(*keys, *ranks, id, *BOX)
    pairs = iou_join(narrow, narrow, keys, threshold, [*ranks, id])
    pairs = pairs.select(*(F.col(f"a_{k}").alias(k) for k in keys), f"a_{id}", f"b_{id}", *(f"b_{r}" for r in ranks))
    gone = suppressed(pairs, keys, f"a_{id}", f"b_{id}", [*(F.col(f"b_{r}") for r in ranks), F.col(f"b_{id}")], crowded(boxes, keys))
    return boxes.join(gone.select(F.col("_late").alias(id)), id, "left_anti")


def _least_labels(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges and the smallest node of the component of each: hook to the smaller label, halve the paths."""
    nodes, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    a, b, label = at[: len(i)], at[len(i) :], np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        new = new[new]
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def _labelled(edges: DataFrame, keys: Sequence[str], id: str) -> DataFrame:
    """keys, id and _label, the smallest id of the component, of all nodes of the groups' edges (_i, _j).

    A task holds the labels of one group's nodes; edges pass by.
    """
    schema = edges.select(*keys, F.col("_i").cast("long").alias(id), F.col("_j").cast("long").alias("_label")).schema

    def run(batches: Iterator[tuple[pa.RecordBatch, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        nodes = label = np.zeros(0, np.int64)
        key = None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([v] * len(nodes), f.type) for v, f in zip(key, fields, strict=True)), pa.array(nodes), pa.array(label)], names=[*keys, id, "_label"])

        for batch, new in batches:
            fields = [batch.schema.field(k) for k in keys]
            i, j = (batch.column(c).cast(pa.int64()).to_numpy() for c in ("_i", "_j"))
            cuts = np.concatenate([[0], np.flatnonzero(new), [batch.num_rows]])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if new[a]:
                    if key is not None:
                        yield done()
                    nodes = label = np.zeros(0, np.int64)
                    key = [batch.column(k)[int(a)].as_py() for k in keys]
                nodes, label = _least_labels(np.concatenate([nodes, i[a:b]]), np.concatenate([label, j[a:b]]))
        if key is not None:
            yield done()

    return by_group(edges, keys, [], run, schema)


def _edges(boxes: DataFrame, keys: Sequence[str], id: str, threshold: float, centroid: str | None = None) -> DataFrame:
    narrow = boxes.select(*keys, id, *BOX)
    return iou_join(narrow, narrow, keys, threshold, id, centroid).select(*(F.col(f"a_{k}").alias(k) for k in keys), F.col(f"a_{id}").alias("_i"), F.col(f"b_{id}").alias("_j"), "iou")


def components(boxes: DataFrame, keys: Sequence[str], id: str, threshold: float, centroid: str | None = None) -> DataFrame:
    """``boxes`` with ``cluster``, the smallest id of its component in the group's overlap graph."""
    labels = _labelled(_edges(boxes, keys, id, threshold, centroid), keys, id).select(id, "_label")
    return boxes.join(labels, id, "left").withColumn("cluster", F.coalesce("_label", id)).drop("_label")


def component_sweep(boxes: DataFrame, keys: Sequence[str], id: str, thresholds: Sequence[float]) -> DataFrame:
    """t, id and cluster for every threshold: one join at the lowest, and its edges taken by each."""
    table = F.broadcast(boxes.sparkSession.createDataFrame([(float(t),) for t in thresholds], "t double"))
    edges = _edges(boxes, keys, id, min(thresholds)).crossJoin(table).where("iou >= t")
    labels = _labelled(edges, ["t", *keys], id).select("t", id, "_label")
    return boxes.select(id).crossJoin(table).join(labels, ["t", id], "left").select("t", id, F.coalesce("_label", id).alias("cluster"))


def candidates_of(dets: DataFrame, gts: DataFrame, keys: Sequence[str], threshold: float, also: Sequence[str] = (), of_gts: Sequence[str] = (), cells: bool = True, outer: bool = False) -> DataFrame:
    """keys, det_id, gt_id, iou and _s (the score turned round; null: last) of all pairs of ``threshold`` or more, with columns ``also`` of the detections and, as gt_*, ``of_gts`` of the truth boxes; ``outer``: see ``iou_join``."""
    pairs = iou_join(dets.select(*dict.fromkeys([*keys, *also, "det_id", "score", *BOX])), gts.select(*dict.fromkeys([*keys, *of_gts, "gt_id", *BOX])), keys, threshold, cells=cells, outer=outer)
    return pairs.select(*(F.col(f"a_{k}").alias(k) for k in (*keys, *also)), F.col("a_det_id").alias("det_id"), F.col("b_gt_id").alias("gt_id"), "iou", F.coalesce(-F.col("a_score"), F.lit(float("inf"))).alias("_s"), *(F.col(f"b_{c}").alias(f"gt_{c}") for c in of_gts))


def candidates(dets: DataFrame, gts: DataFrame, keys: Sequence[str], threshold: float) -> DataFrame:
    """The pairs that a matching at ``threshold`` or above chooses from."""
    return candidates_of(dets, gts, keys, threshold)


def greedy_match(dets: DataFrame, gts: DataFrame, keys: Sequence[str], threshold: float | None = None, thresholds: DataFrame | None = None, counted: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Each detection by falling score takes the best free truth box of its group, at ``threshold`` or more.

    dets: keys, det_id, x, y, w, h, score; gts: keys, gt_id, x, y, w, h. Returns keys,
    det_id, gt_id, iou of the matches. With ``thresholds`` (column t) it is done for each
    of them at once, from one join at the lowest, and t is returned too. Ties go by id; a
    null score comes last. Groups of a few boxes meet by keys and are matched where they meet, others go by cells;
    ``counted``: tables that hold all of dets and gts and are cheaper to count.
    """
    extra, least = [], threshold
    if thresholds is not None:
        extra, least = ["t"], thresholds.agg(F.min("t")).first()[0]

    def pairs(how: str | None, cells: bool) -> DataFrame:
        d, g = (df if how is None else df.join(many.select(*keys), list(keys), how) for df in (dets, gts))
        found = candidates_of(d, g, keys, least, cells=cells)
        return found if thresholds is None else found.crossJoin(F.broadcast(thresholds.select("t"))).where("iou >= t")

    rank, preference, columns = [F.col("_s")], [-F.col("iou")], [*keys, *extra, "det_id", "gt_id", "iou"]
    many = busy(*(counted or (dets, gts)), keys)
    found = choice_of_few(pairs(None if many is None else "left_anti", False), keys, extra, "det_id", "gt_id", rank, preference).select(*columns)
    if many is None:
        return found
    crowd = many.where(F.col("_a") > overlaps.CROWD).select(*keys)
    rest = greedy_choice(pairs("left_semi", True), [*keys, *extra], "det_id", "gt_id", rank, preference, None if crowd.isEmpty() else crowd)
    return found.unionByName(rest.select(*columns))


def class_free_match(pairs: DataFrame, by: Sequence[str], relabel_at: float, crowd: DataFrame | None = None) -> DataFrame:
    """by, det_id and _cat: the class of the truth box that each detection takes at ``relabel_at`` in its image, whatever the classes.

    pairs: by, image_id, det_id, gt_id, iou, _s, gt_category_id; as a table, what is made of them doesn't match again.
    """
    near = pairs.where(F.col("iou") >= relabel_at).select(*by, "image_id", "det_id", "gt_id", "iou", "_s", "gt_category_id")
    found = greedy_choice(near, [*by, "image_id"], "det_id", "gt_id", [F.col("_s")], [-F.col("iou")], crowd)
    return parked(found.select(*by, "det_id", F.col("gt_category_id").alias("_cat")), "classes")


def relabel(dets: DataFrame, matches: DataFrame, gts: DataFrame) -> DataFrame:
    """Detections with the class of the truth box they matched; the others keep theirs."""
    to = matches.select("det_id", "gt_id").join(gts.select("gt_id", F.col("category_id").alias("_cat")), "gt_id").select("det_id", "_cat")
    return dets.join(to, "det_id", "left").withColumn("category_id", F.coalesce("_cat", "category_id")).drop("_cat")


def two_phase_match(dets: DataFrame, gts: DataFrame, image: str, threshold: float) -> DataFrame:
    """Matches of equal class first, then of what is left of any class: image, det_id, gt_id, iou, phase."""
    first = greedy_match(dets, gts, [image, "category_id"], threshold).select(image, "det_id", "gt_id", "iou", F.lit(1).alias("phase"))
    rest_d = dets.join(first.select("det_id"), "det_id", "left_anti")
    rest_g = gts.join(first.select("gt_id"), "gt_id", "left_anti")
    second = greedy_match(rest_d, rest_g, [image], threshold, counted=(dets, gts)).select(image, "det_id", "gt_id", "iou", F.lit(2).alias("phase"))
    return first.unionByName(second)


def membership(fused: DataFrame, raw: DataFrame, keys: Sequence[str], id: str, set_column: str, threshold: float) -> DataFrame:
    """id and ``n_sets``, in how many sets of raw detections the fused box has a match (0 too)."""
    pairs = iou_join(fused.select(*keys, id, *BOX), raw.select(*keys, set_column, *BOX), keys, threshold)
    counts = pairs.groupBy(F.col(f"a_{id}").alias(id)).agg(F.count_distinct(f"b_{set_column}").alias("n_sets"))
    return fused.select(id).join(counts, id, "left").select(id, F.coalesce("n_sets", F.lit(0)).cast("long").alias("n_sets"))


def coverage(gts: DataFrame, sources: dict[str, DataFrame], keys: Sequence[str], threshold: float) -> DataFrame:
    """gt_id and a flag in_<name> for each source that has an overlapping box."""
    out = gts.select("gt_id")
    for name, boxes in sources.items():
        hit = overlapped(gts, boxes, keys, threshold).select("gt_id", F.lit(True).alias(f"in_{name}"))
        out = out.join(hit, "gt_id", "left").fillna(False, [f"in_{name}"])
    return out
