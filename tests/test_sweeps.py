"""Sweeps that keep a detection one row, against plain versions, and what they send on."""

import random

import pytest
from pyspark.sql import functions as F

from boxquery.operators import evaluate, overlaps, sweeps

DET = "det_id long, image_id long, category_id int, x double, y double, w double, h double, score double"
GT = "gt_id long, image_id long, category_id int, x double, y double, w double, h double"
RANGES = {"all": (0.0, 1e10), "small": (0.0, 700.0), "large": (700.0, 1e10)}
TS = [0.75, 0.3, 0.5]


def made(n, images, seed, odd=True):
    rng = random.Random(seed)
    side = lambda: float(20 + rng.randrange(15))
    boxes = lambda: [(k, rng.randrange(images), rng.randrange(2), float(rng.randrange(40)), float(rng.randrange(40)), side(), side()) for k in range(n)]
    dets = [(*b, rng.choice([0.1, 0.5, 0.9])) for b in boxes()]
    if odd:
        dets += [(n, 0, 0, 5.0, 5.0, 20.0, 20.0, None), (n + 1, 0, 1, 5.0, 5.0, None, 20.0, 0.5), (n + 2, images, 0, 5.0, 5.0, 20.0, 20.0, 0.5), (n + 3, 0, None, 5.0, 5.0, 20.0, 20.0, 0.5), (n + 4, None, 1, 5.0, 5.0, 20.0, 20.0, 0.5)]
    return dets, boxes()


def iou(a, b):
    if None in a[3:7]:
        return 0.0
    inter = max(0.0, min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3])) * max(0.0, min(a[4] + a[6], b[4] + b[6]) - max(a[4], b[4]))
    return inter / (a[5] * a[6] + b[5] * b[6] - inter)


def in_order(dets):
    return sorted(dets, key=lambda d: (float("inf") if d[7] is None else -d[7], d[0]))


def plain(dets, gts, t, lo, hi):
    """det_id: True (hit), False (false alarm) or None (ignored)."""
    out_of = lambda b: None in b[5:7] or not lo <= b[5] * b[6] <= hi
    used, told = set(), {}
    for d in in_order(dets):
        found = [(out_of(g), -iou(d, g), g[0]) for g in gts if d[1:3] == g[1:3] and g[0] not in used and iou(d, g) >= t]
        if found:
            ign, _, g = min(found)
            used.add(g)
            told[d[0]] = None if ign else True
        else:
            told[d[0]] = None if out_of(d) else False
    return told


@pytest.mark.parametrize("few, crowd", [(256, 100_000), (10, 100_000), (10, 25), (0, 0)])
def test_bits_of_all_ranges_are_those_of_one_match_after_another(spark, monkeypatch, few, crowd):
    monkeypatch.setattr(overlaps, "FEW", few)
    monkeypatch.setattr(overlaps, "CROWD", crowd)
    dets, gts = made(150, 4, 1)
    got = sweeps.ranged_bits(spark.createDataFrame(dets, DET), spark.createDataFrame(gts, GT), TS, RANGES).collect()
    assert sorted(r.det_id for r in got) == sorted(d[0] for d in dets)
    bit = lambda v, c: bool(v[c // 8] >> c % 8 & 1)
    for k, (lo, hi) in enumerate(RANGES.values()):
        for m, t in enumerate(sorted(TS)):
            c = k * len(TS) + m
            assert {r.det_id: None if bit(r.skip, c) else bit(r.hit, c) for r in got} == plain(dets, gts, t, lo, hi)


@pytest.mark.parametrize("few, crowd", [(256, 100_000), (10, 100_000), (10, 50)])
def test_two_modes_by_bits(spark, monkeypatch, few, crowd):
    monkeypatch.setattr(overlaps, "FEW", few)
    monkeypatch.setattr(overlaps, "CROWD", crowd)
    dets, gts = made(150, 4, 2)
    df = spark.createDataFrame(dets, DET)
    both = df.withColumn("method", F.lit("a")).unionByName(df.where("det_id % 3 > 0").withColumn("method", F.lit("b")))
    got = sweeps.two_mode_bits(both, spark.createDataFrame(gts, GT), TS, "method", 0.1, 12).collect()
    want = {}
    for method, ds in (("a", dets), ("b", [d for d in dets if d[0] % 3])):
        used, free = set(), []
        for d in in_order(ds):
            near = [(-iou(d, g), g[0], g[2]) for g in gts if d[1] == g[1] and g[0] not in used and iou(d, g) >= 0.1]
            used |= {min(near)[1]} if near else set()
            free.append((*d[:2], min(near)[2] if near else d[2], *d[3:]))
        for mode, ds in (("aware", in_order(ds)), ("agnostic", free)):
            kept = [d for k, d in enumerate(ds) if sum(e[1:3] == d[1:3] for e in ds[:k]) < 12]
            assert len(kept) < len(ds)
            told = [plain(kept, gts, t, 0.0, 1e10) for t in sorted(TS)]
            want |= {(mode, method, d[0]): (d[2], sum(1 << m for m, x in enumerate(told) if x[d[0]])) for d in kept}
    assert len(got) == len(want) and {(r.mode, r.method, r.det_id): (r.category_id, int.from_bytes(r.hit, "little")) for r in got} == want


def test_precision_of_all_bits_is_that_of_one_after_another(spark):
    dets, gts = made(150, 4, 3)
    dets += [(900, 1, 0, 1.0, 1.0, 20.0, 20.0, 1.5), (901, 1, 0, 1.0, 1.0, 20.0, 20.0, -2.0)]
    d, g = spark.createDataFrame(dets, DET), spark.createDataFrame(gts, GT)
    got = {(r.category_id, r.t, r.area): (r.ap, r.recall) for r in evaluate.ap_by_class_and_size(d, g, evaluate.threshold_table(spark, TS), RANGES).collect()}
    rows = [(x[2], t, a, x[7], x[0], told[x[0]]) for a, (lo, hi) in RANGES.items() for t in TS for told in [plain(dets, gts, t, lo, hi)] for x in dets]
    truths = [(c, t, a, sum(lo <= b[5] * b[6] <= hi for b in gts if b[2] == c)) for c in (0, 1) for t in TS for a, (lo, hi) in RANGES.items()]
    plainly = evaluate.average_precision(spark.createDataFrame(rows, "category_id int, t double, area string, score double, det_id long, tp boolean"), spark.createDataFrame(truths, "category_id int, t double, area string, npos long"), ["category_id", "t", "area"])
    want = {(r.category_id, r.t, r.area): (r.ap, r.recall) for r in plainly.collect()}
    assert got.keys() == want.keys() and len(want) == 18 and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def _shuffled(spark, run):
    """How many rows ``run`` shuffles."""
    sc = spark.sparkContext
    store, jvm = sc._jsc.sc(), sc._jvm

    def records():
        store.listenerBus().waitUntilEmpty()
        stages = store.statusStore().stageList(None, False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(k) for k in range(stages.size()))}

    before = records()
    run()
    return sum(v for k, v in records().items() if k not in before)


def test_a_detection_is_not_shuffled_for_each_threshold_and_range(spark):
    dets, gts = made(2000, 40, 4, odd=False)
    d, g = spark.createDataFrame(dets, DET), spark.createDataFrame(gts, GT)
    sent = _shuffled(spark, lambda: evaluate.coco_metrics(d, g, (1, 10, 100), ranges=RANGES).collect())
    assert 0 < sent < 15 * len(dets), sent


def test_methods_are_compared_without_sending_their_pairs(spark):
    dets, gts = made(2000, 20, 5, odd=False)
    d, g = spark.createDataFrame(dets, DET), spark.createDataFrame(gts, GT)
    sent = _shuffled(spark, lambda: evaluate.method_comparison({"a": d, "b": d.where("det_id % 2 = 0")}, g).collect())
    assert 0 < sent < 15 * len(dets), sent
