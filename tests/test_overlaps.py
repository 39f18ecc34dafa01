"""Overlap joins by cells and greedy selection in one pass or in rounds, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from boxquery.operators import ensemble, evaluate, matching, overlaps

DET = "det_id long, image_id long, category_id int, x double, y double, w double, h double, score double"
GT = "gt_id long, image_id long, category_id int, x double, y double, w double, h double"
KEYS = ["image_id", "category_id"]


def iou(a, b):
    w = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
    h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    inter = max(0.0, w) * max(0.0, h)
    union = a[2] * a[3] + b[2] * b[3] - inter
    return inter / union if union > 0 else 0.0


def centre_in(a, b):
    return b[0] <= a[0] + a[2] / 2 <= b[0] + b[2] and b[1] <= a[1] + a[3] / 2 <= b[1] + b[3]


def boxes(rng, n, scale=1.0, images=2, classes=2):
    out = []
    for k in range(n):
        side = scale * rng.choice([1, 2, 4, 8, 16, 50])
        x, y = (scale * rng.uniform(-60, 60) for _ in range(2))
        if k % 4 == 0 and out:  # near another one
            _, _, _, x, y, side, _, _ = rng.choice(out)
            x, y = x + side * rng.uniform(-0.2, 0.2), y + side * rng.uniform(-0.2, 0.2)
        out.append((k, rng.randrange(images), rng.randrange(classes), x, y, side * rng.uniform(0.5, 1), side * rng.choice([0.5, 1.0, 1.0]), round(rng.random(), 1)))
    return out


ODD = [(900, 0, 0, None, 0.0, 5.0, 5.0, 0.5), (901, 0, 0, 0.0, 0.0, 0.0, 5.0, 0.5), (902, 0, 0, 0.0, 0.0, float("inf"), 5.0, 0.5), (903, None, 0, 0.0, 0.0, 5.0, 5.0, 0.5), (904, 1, 1, 0.0, 0.0, -5.0, 5.0, None)]


@pytest.mark.parametrize("threshold", [0.0, 0.01, 0.03, 0.1, 0.5, 0.75, 1.0])
@pytest.mark.parametrize("scale", [1.0, 0.001, 1000.0])
def test_cells_lose_no_pair_and_repeat_none(spark, threshold, scale):
    rows = boxes(random.Random(5), 150, scale) + [(800, 0, 0, 8.0, 8.0, 8.0, 8.0, 0.1), (801, 0, 0, 8.0, 8.0, 8.0, 8.0, 0.1), (802, 0, 0, 8.0, 8.0, 4.0, 8.0, 0.1)]
    df = spark.createDataFrame(rows + (ODD if threshold else []), DET)
    got = matching.iou_join(df, df, ["image_id"], threshold, "det_id").select("a_det_id", "b_det_id").collect()
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and iou(a[3:7], b[3:7]) >= threshold}
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == want
    hit = overlaps.overlapped(df, df, KEYS, threshold, "score")
    assert sorted(r.det_id for r in hit.collect()) == sorted(a[0] for a in rows if any(a[1:3] == b[1:3] and a[7] != b[7] and iou(a[3:7], b[3:7]) >= threshold for b in rows))


@pytest.mark.parametrize("mode", ["or", "and"])
def test_centres(spark, mode):
    rows = boxes(random.Random(6), 120)
    df = spark.createDataFrame(rows, DET)
    got = matching.iou_join(df, df, ["image_id"], 0.3, "det_id", mode).select("a_det_id", "b_det_id").collect()
    test = {"or": lambda o, c: o or c, "and": lambda o, c: o and c}[mode]
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and test(iou(a[3:7], b[3:7]) >= 0.3, centre_in(a[3:7], b[3:7]) or centre_in(b[3:7], a[3:7]))}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def sequential(dets, gts, threshold):
    out, taken = [], set()
    for d in sorted(dets, key=lambda d: (-d[7] if d[7] is not None else 1e9, d[0])):
        free = [(-iou(d[3:7], g[3:7]), g[0]) for g in gts if g[0] not in taken and g[1:3] == d[1:3] and iou(d[3:7], g[3:7]) >= threshold]
        if free:
            taken.add(min(free)[1])
            out.append((d[0], min(free)[1]))
    return sorted(out)


def jittered(rng, rows):
    return [(k, i, c, x + rng.uniform(-2, 2), y + rng.uniform(-2, 2), w, h) for k, i, c, x, y, w, h, _ in rows]


@pytest.mark.parametrize("crowd, rounds", [(100_000, 40), (0, 40), (20, 1), (0, 0)])
def test_matching_in_one_pass_and_in_rounds(spark, monkeypatch, crowd, rounds):
    monkeypatch.setattr(overlaps, "CROWD", crowd)
    monkeypatch.setattr(overlaps, "MOST_ROUNDS", rounds)
    rng = random.Random(7)
    dets = boxes(rng, 160)
    gts = jittered(rng, dets)[::2]
    d, g = spark.createDataFrame(dets + ODD, DET).repartition(3), spark.createDataFrame(gts, GT)
    got = matching.greedy_match(d, g, KEYS, 0.2)
    assert sorted((r.det_id, r.gt_id) for r in got.collect()) == sequential(dets, gts, 0.2)
    each = matching.greedy_match(d, g, KEYS, thresholds=evaluate.threshold_table(spark, [0.2, 0.6])).collect()
    for t in (0.2, 0.6):
        assert sorted((r.det_id, r.gt_id) for r in each if r.t == t) == sequential(dets, gts, t)


@pytest.mark.parametrize("few, batch, split", [(256, 7, False), (40, 10_000, False), (0, 10_000, False), (256, 50, True)])
def test_groups_of_few_and_of_many_boxes_match_alike(spark, monkeypatch, few, batch, split):
    """Of four images one is full; batches end within groups; joins of skewed keys would be split."""
    monkeypatch.setattr(overlaps, "FEW", few)
    conf = {"spark.sql.execution.arrow.maxRecordsPerBatch": batch}
    if split:
        conf |= {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k"}
    rng = random.Random(12)
    dets = [(k, min(i, 3), *rest) for k, i, *rest in boxes(rng, 160, images=9)]
    gts = jittered(rng, dets)[::2]
    odd = [(950, 0, 0, *dets[0][3:7], None), (951, 0, 0, *dets[0][3:7], float("nan")), (None, 0, 0, *dets[0][3:7], 0.5)]
    d, g = spark.createDataFrame(dets + ODD + odd[:1], DET).repartition(5), spark.createDataFrame(gts, GT).repartition(3)
    strange, again = d.unionByName(spark.createDataFrame(odd[1:], DET)), g.unionByName(g.limit(9))
    try:
        for name, value in conf.items():
            spark.conf.set(name, value)
        got = matching.greedy_match(d, g, KEYS, 0.2).collect()
        each = matching.greedy_match(d, g, KEYS, thresholds=evaluate.threshold_table(spark, [0.2, 0.6])).collect()
        both = [matching.greedy_match(strange, again, KEYS, 0.2).collect()]
    finally:
        for name in conf:
            spark.conf.unset(name)
    monkeypatch.setattr(overlaps, "FEW", 0)
    both.append(matching.greedy_match(strange, again, KEYS, 0.2).collect())
    want = sequential(dets + [(*r[:7], -1.0) for r in odd[:1]], gts, 0.2)
    assert sorted((r.det_id, r.gt_id) for r in got) == want
    assert sorted((r.det_id, r.gt_id) for r in each if r.t == 0.2) == want
    assert sorted(both[0], key=repr) == sorted(both[1], key=repr) and both[0]


@pytest.mark.parametrize("crowd, rounds", [(100_000, 40), (0, 40), (0, 1)])
def test_suppression_in_one_pass_and_in_rounds(spark, monkeypatch, crowd, rounds):
    monkeypatch.setattr(overlaps, "CROWD", crowd)
    monkeypatch.setattr(overlaps, "MOST_ROUNDS", rounds)
    rows = boxes(random.Random(8), 200)
    kept = []
    for d in sorted(rows, key=lambda d: (-d[7], d[0])):
        if not any(k[1] == d[1] and iou(k[3:7], d[3:7]) >= 0.2 for k in kept):
            kept.append(d)
    got = matching.greedy_dedup(spark.createDataFrame(rows, DET), ["image_id"], [-F.col("score")], "det_id", 0.2)
    assert sorted(r.det_id for r in got.collect()) == sorted(k[0] for k in kept)


def test_components_over_many_groups_and_batches(spark):
    rows = boxes(random.Random(9), 400, images=9)
    least = {r[0]: r[0] for r in rows}
    edges = [(a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and a[0] < b[0] and iou(a[3:7], b[3:7]) >= 0.1]
    while True:
        before = dict(least)
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
        if before == least:
            break
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = matching.components(spark.createDataFrame(rows, DET), ["image_id"], "det_id", 0.1).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.det_id: r.cluster for r in got} == least


def test_an_image_of_thousands_of_boxes(spark):
    """As many boxes as the fullest image of the largest public set has; pairs that overlap are few."""
    rng = random.Random(10)
    n = 7599
    dets = [(k, 1, 1, float(k % 100 * 30 + rng.randrange(6)), float(k // 100 * 30 + rng.randrange(6)), 25.0, 25.0, rng.random()) for k in range(n)]
    gts = jittered(rng, dets)
    d, g = spark.createDataFrame(dets, DET), spark.createDataFrame(gts, GT)
    met = matching.candidates(d, g, KEYS, 0.5).count()
    assert met < 2 * n
    got = {(r.det_id, r.gt_id) for r in matching.greedy_match(d, g, KEYS, 0.5).collect()}
    assert got == {(k, k) for k, a in enumerate(dets) if iou(a[3:7], gts[k][3:7]) >= 0.5}
    assert matching.greedy_dedup(d, ["image_id"], [-F.col("score")], "det_id", 0.5).count() == n


def test_no_boxes_at_all(spark):
    d, g = spark.createDataFrame([], DET), spark.createDataFrame([], GT)
    assert matching.greedy_match(d, g, KEYS, 0.5).count() == matching.greedy_dedup(d, KEYS, [], "det_id", 0.5).count() == matching.components(d, KEYS, "det_id", 0.5).count() == 0
    assert ensemble.assign_fused(d, g.withColumnRenamed("gt_id", "cluster"), KEYS, "det_id").count() == 0
