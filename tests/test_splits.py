"""Splits and samples against a plain version of the same search, and what they promise."""

import random

import pytest

from boxquery.functions.params import target_size
from boxquery.operators import splits

RATIOS = {"train": 0.7, "val": 0.1, "test": 0.2}
M = 2_147_483_647


def matrix(n=160):
    rng = random.Random(4)
    return {i: {} if i % 11 == 0 else {c: rng.randrange(1, 9) for c in range(1, 7) if rng.random() < 0.7 / c} for i in range(1000, 1000 + n)}


def frames(spark, m):
    notes = [(i, c) for i, cs in m.items() for c, n in cs.items() for _ in range(n)]
    images = spark.createDataFrame([(i,) for i in m], "id long").repartition(3)
    return splits.image_counts(spark.createDataFrame([*notes, (5, 1)], "image_id long, category_id int"), images)


def total(m, ids=None):
    out = {}
    for i in m if ids is None else ids:
        for c, n in m[i].items():
            out[c] = out.get(c, 0) + n
    return out


def draw(i, seed):
    return (i * 2_654_435_761 + seed * 40_503) % M


def change(now, totals, cs, ratio, sign):
    return sum(abs((now.get(c, 0) + sign * n) / totals[c] - ratio) - abs(now.get(c, 0) / totals[c] - ratio) for c, n in cs.items())


def plain_split(m, ratios, seed, rounds, batch):
    totals, names = total(m), list(ratios)
    out = {}
    for i in m:
        at = 0.0
        for s in names:
            at += ratios[s]
            if s == names[-1] or draw(i, seed) < int(at * M):
                out[i] = s
                break
    now = {s: total(m, [i for i in m if out[i] == s]) for s in names}
    for _ in range(rounds):
        found = []
        for i in m:
            options = [(round(change(now[out[i]], totals, m[i], ratios[out[i]], -1) + change(now[s], totals, m[i], ratios[s], 1), 12), k) for k, s in enumerate(names) if s != out[i]] if m[i] else []
            if options and min(options)[0] < -1e-12:
                found.append((min(options)[0], i, names[min(options)[1]]))
        made = 0
        for _, i, to in sorted(found)[:batch]:
            if change(now[out[i]], totals, m[i], ratios[out[i]], -1) + change(now[to], totals, m[i], ratios[to], 1) < -1e-12:
                made += 1
                for c, n in m[i].items():
                    now[out[i]][c] = now[out[i]].get(c, 0) - n
                    now[to][c] = now[to].get(c, 0) + n
                out[i] = to
        if not made:
            break
    return out


def badness(m, out):
    return sum(splits.share_deviation(total(m, [i for i in m if out[i] == s]), total(m), r) for s, r in RATIOS.items())


@pytest.mark.parametrize("seed, batch", [(0, 512), (3, 1)])
def test_split(spark, seed, batch):
    m = matrix()
    counts = frames(spark, m)
    got = {r.image_id: r.split for r in splits.optimized_split(counts, RATIOS, seed, 6, batch).collect()}
    want = plain_split(m, RATIOS, seed, 6, batch)
    drawn = {r.image_id: r.split for r in splits.optimized_split(counts, RATIOS, seed, 0).collect()}
    assert set(got) == set(m) and drawn == plain_split(m, RATIOS, seed, 0, 1)
    assert badness(m, got) < badness(m, drawn) and badness(m, got) == pytest.approx(badness(m, want), abs=1.0)
    if batch == 1:
        assert got == want
    assert all(got[i] == drawn[i] for i in m if not m[i])


def test_samples_have_their_size_nest_and_come_nearer(spark):
    m = matrix()
    counts = frames(spark, m)
    off = lambda ids, r: splits.share_deviation(total(m, ids), total(m), r)
    drawn = [r.image_id for r in splits.optimized_sample(counts, 0.2, rounds=0).collect()]
    assert sorted(drawn) == sorted(sorted(m, key=lambda i: (draw(i, 0), i))[: target_size(len(m), 0.2)])
    better = [r.image_id for r in splits.optimized_sample(counts, 0.2).collect()]
    assert len(set(better)) == len(drawn) and off(better, 0.2) < off(drawn, 0.2) / 2
    held = set()
    rows = splits.nested_samples(counts, [0.1, 0.2, 0.3]).collect()
    for r in (0.1, 0.2, 0.3):
        ids = {x.image_id for x in rows if x.ratio == r}
        assert held <= ids and len(ids) == target_size(len(m), r)
        held = ids
    some = counts.where("image_id < 1003").select("image_id")
    assert {1000, 1001, 1002} <= {r.image_id for r in splits.optimized_sample(counts, 0.1, some).collect()}
    with pytest.raises(ValueError):
        splits.optimized_sample(counts, 0.01, some)
    with pytest.raises(ValueError):
        splits.optimized_sample(counts, 0.1, spark.createDataFrame([(7,)], "image_id long"))


def test_best_of_seeds_and_coverage(spark):
    m = matrix()
    counts = frames(spark, m)
    best, report = splits.best_of_seeds(counts, 0.2, [1, 2])
    keys = [(r["missing"], r["short"], r["mean"], r["worst"], -r["size"], r["seed"]) for r in report]
    assert keys == sorted(keys) and best.count() == report[0]["size"] == target_size(len(m), 0.2)
    ids = [r.image_id for r in splits.covering_sample(counts, 9).collect()]
    assert len(set(ids)) == 9 and set(total(m, ids)) == set(total(m))


def test_no_images(spark):
    counts = frames(spark, {})
    assert splits.optimized_split(counts, RATIOS).count() == splits.covering_sample(counts, 3).count() == 0
    bare = frames(spark, {1: {}, 2: {}})
    assert splits.optimized_split(bare, RATIOS).count() == 2 and splits.optimized_sample(bare, 0.5).count() == 1
