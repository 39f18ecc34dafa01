"""Order statistics, quotas, percentiles, distributions, fusion scores and numbering on small inputs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from boxquery.operators import dataset, ensemble, policy, selection, stats


def values(rng, kind, n):
    return {
        "even": [rng.random() for _ in range(n)],
        "equal": [0.25] * n,
        "few": [rng.choice([0.1, 0.5, -3.0]) for _ in range(n)],
        "steep": [10.0 ** rng.uniform(-300, 300) for _ in range(n)],
        "null": [rng.choice([None, rng.random()]) for _ in range(n)],
    }[kind]


KINDS = ["even", "equal", "few", "steep", "null"]


@pytest.mark.parametrize("parts, passes", [(1024, 3), (2, 3), (3, 0)])
def test_nth_values(spark, monkeypatch, parts, passes):
    monkeypatch.setattr(selection, "PARTS", parts)
    monkeypatch.setattr(selection, "PASSES", passes)
    rng = random.Random(1)
    groups = {k: values(rng, k, 120) for k in KINDS}
    rows = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "g string, v double")
    ranks = [-1, 0, 1, 59, 100, 119, 120]
    got = selection.nth_values(rows, ["g"], "v", spark.createDataFrame([(k, r) for k in [*KINDS, "none"] for r in ranks], "g string, rank long"))
    want = []
    for k, vs in groups.items():
        have = sorted(v for v in vs if v is not None)
        want += [(k, r, have[r], sum(v < have[r] for v in have), have.count(have[r])) for r in ranks if 0 <= r < len(have)]
    assert sorted(tuple(r) for r in got.select("g", "rank", "value", "before", "equal").collect()) == sorted(want)


@pytest.mark.parametrize("seed", [None, 5])
def test_quota_is_the_head_of_the_order(spark, seed):
    rng = random.Random(2)
    rows = [(c * 1000 + k, c, v) for c, kind in enumerate(KINDS) for k, v in enumerate(values(rng, kind, 90))]
    want = {0: 10, 1: 33, 2: 40, 3: 0, 4: 88, 9: 5}
    keep = []
    for c, n in want.items():
        key = (lambda r: (r[2] is None, -(r[2] or 0), r[0])) if seed is None else (lambda r: ((r[0] * 2_654_435_761 + seed) % 2_147_483_647, r[0]))
        keep += [r[0] for r in sorted((r for r in rows if r[1] == c), key=key)[:n]]
    dets = spark.createDataFrame(rows, "det_id long, category_id int, score double").repartition(5)
    got = policy.quota(dets, spark.createDataFrame(list(want.items()), "category_id int, n long"), seed=seed)
    assert got.columns == dets.columns and sorted(r.det_id for r in got.collect()) == sorted(keep)


def test_percentiles_are_those_of_the_engine(spark):
    rng = random.Random(3)
    rows = spark.createDataFrame([(k, v) for k in KINDS for v in values(rng, k, 101)] + [("one", 4.0), ("none", None)], "g string, score double")
    points = [0.25, 0.5, 0.75, 0.95]
    want = {r.g: r.p for r in rows.groupBy("g").agg(F.percentile("score", points).alias("p")).collect()}
    for r in stats.score_stats(rows, ["g"]).collect():
        assert [r.p25, r.p50, r.p75, r.p95] == (pytest.approx(want[r.g]) if want[r.g] else [None] * 4)


@pytest.mark.parametrize("mode", ["borda", "score"])
def test_distribution_counts_absent_classes_in(spark, mode):
    rows = [(1, "b", 0.5), (1, "d", 0.5), (2, "c", -0.5), (3, "x", 1.0), (4, "a", 0.0), (5, "a", 0.1), (5, "b", 0.9), (5, "c", 0.4), (5, "d", 0.2)]
    names = ["a", "b", "c", "d"]
    got = ensemble.class_distribution(spark.createDataFrame(rows, "cluster long, class_name string, points double"), spark.createDataFrame([(n,) for n in names + ["a"]], "class_name string"), mode)
    for r in got.collect():
        points = [dict((c, p) for k, c, p in rows if k == r.cluster).get(n, 0.0) for n in names]
        if mode == "borda" and r.cluster == 2:
            continue  # points of this mode aren't negative
        w = [math.exp(p) for p in points] if mode == "score" else points
        p = [x / sum(w) if sum(w) else 1 / len(w) for x in w]
        assert [r.class_dist[n] for n in names] == pytest.approx(p)
        assert r.entropy == pytest.approx(-sum(x * math.log(x) for x in p if x > 0), abs=1e-12)
        assert r.winner == names[p.index(max(p))]


def test_fusion_scores(spark):
    boxes = [(1, 1, 0.0, 0.9, "a"), (2, 1, 0.0, 0.6, "b"), (3, 1, 0.0, 0.3, "b"), (4, 1, 500.0, None, "c"), (5, 2, 0.0, 0.5, "a")]
    df = spark.createDataFrame([(i, g, x, 0.0, 10.0, 10.0, s, m) for i, g, x, s, m in boxes], "det_id long, image_id long, x double, y double, w double, h double, score double, m string")
    want = {"mean": [0.6, 1.0, 0.5], "avg": [0.6, 1 / 3, 0.5], "max": [0.9, 1.0, 0.5], "box_and_model_avg": [0.4, 1 / 3, 0.5], "absent_model_aware_avg": [1.8 / 4, 1 / 3, 0.5]}
    for conf in ensemble.CONFIDENCES:
        got = {tuple(sorted(r.ids)): r.score for r in ensemble.wbf(df, ["image_id"], "det_id", 0.5, conf, "m").collect()}
        assert [got[1, 2, 3], got[4,], got[5,]] == pytest.approx(want[conf])
    frame = spark.createDataFrame([(1, 100, 8)], "id long, width int, height int")
    assert [(r.det_id, r.h) for r in ensemble.in_frame(df, frame).orderBy("det_id").collect()] == [(1, 8.0), (2, 8.0), (3, 8.0)]
    for bad in ({"conf": "best"}, {"conf": "avg"}):
        with pytest.raises(ValueError):
            ensemble.wbf(df, ["image_id"], "det_id", 0.5, **bad)


@pytest.mark.parametrize("most", [500_000, 7])
def test_numbers_follow_the_order_whatever_the_ranges(spark, monkeypatch, most):
    monkeypatch.setattr(dataset, "NUMBERED_ROWS", most)
    got = dataset.numbered(spark.range(100).withColumn("v", F.col("id") % 9).repartition(7), "n", ["v", "id"], 5)
    assert [(r.v, r.id) for r in got.orderBy("n").collect()] == sorted((k % 9, k) for k in range(100))
    assert sorted(r.n for r in got.collect()) == list(range(5, 105))
    assert dataset.numbered(spark.range(0), "n", ["id"], 1).count() == 0
