"""What a step sends on grows with its input, by a small factor."""

import random

import pytest
from pyspark.sql import functions as F

from boxquery.functions import text
from boxquery.operators import matching, overlaps
from boxquery.plans import registry


@pytest.fixture(scope="module")
def boxes(spark):
    rng = random.Random(5)
    rows = [(k, k % 7, rng.random(), *(float(rng.randrange(97)) for _ in "xy"), *(float(20 + rng.randrange(23)) for _ in "wh")) for k in range(400)]
    return spark.createDataFrame(rows, "det_id long, image_id long, score double, x double, y double, w double, h double")


@pytest.mark.parametrize("threshold", [0.1, 0.5])
def test_boxes_of_like_size_fill_few_cells(boxes, threshold):
    right = overlaps.prefixed(boxes, "b_")
    cells = overlaps._around(right, "b_", threshold, overlaps._at_centre(overlaps.prefixed(boxes, "a_"), "a_"))
    assert cells.count() <= 8 * boxes.count()  # a hundred at 0.1 when every level was filled


@pytest.mark.parametrize("threshold", [0.02, 0.1, 0.3, 0.5, 0.51, 0.9, 1.0])
def test_no_pair_is_lost_between_sizes(spark, threshold):
    rng = random.Random(11)
    side = lambda: rng.choice([1.0, 2.0, 3.0, 8.0, 16.0, 17.0, 64.0])
    rows = [(k, float(rng.randrange(-20, 60)), float(rng.randrange(-20, 60)), side(), side()) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, x double, y double, w double, h double").withColumn("g", F.lit(1))

    def iou(a, b):
        inter = max(0.0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])) * max(0.0, min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2]))
        return inter / (a[3] * a[4] + b[3] * b[4] - inter)

    want = {(a[0], b[0]) for a in rows for b in rows if iou(a, b) >= threshold}
    got = [(r.a_id, r.b_id) for r in overlaps.iou_join(df, df, ["g"], threshold).select("a_id", "b_id").collect()]
    assert len(got) == len(want) and set(got) == want
    assert {r.id for r in overlaps.overlapped(df, df.where("id % 3 = 0"), ["g"], threshold).collect()} == {a for a, b in want if b % 3 == 0}


def test_pairs_are_shuffled_without_copies_of_their_columns(boxes):
    gts = boxes.withColumnRenamed("det_id", "gt_id").drop("score")
    pairs = matching.candidates(boxes, gts, ["image_id"], 0.3)
    found = overlaps.greedy_choice(pairs, ["image_id"], "det_id", "gt_id", [F.col("_s")], [-F.col("iou")])
    (sent,) = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "RepartitionByExpression" in line][:1]
    assert found.columns == pairs.columns and "_who" not in found._jdf.queryExecution().optimizedPlan().toString(), sent


def test_pairs_of_groups_of_a_few_boxes_are_matched_where_they_meet(boxes):
    gts = boxes.withColumnRenamed("det_id", "gt_id").drop("score")
    plan = matching.greedy_match(boxes, gts, ["image_id"], 0.1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Generate" not in plan, plan  # the boxes of either side, and neither copies for cells nor pairs


def test_a_payload_is_parsed_once_and_by_all_tasks(spark):
    plan = registry.QUERIES["p21_p23_payload"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1  # once for every entry, box, label and score when each began with the text
    assert plan.count("VariantType") < 200 and "RepartitionByExpression" in plan


def test_entries_found_at_once_are_those_found_one_by_one(spark):
    box, odd = '"label":"a","score":"0.5"', ['{"bbox":[1,2,3,4],"box_format":" COCO "}', '{"bbox":{"xyxy":[1,2,3,4]},"class":["",1]}', '{"x1":1,"y1":"2","x2":3,"y2":null,"box":[1,2,3,"x"],"xywh":[5,6,-7,8]}', '{"x":1,"y":2,"w":-3,"height":9,"h":"4"}', '{"coordinates":[1,2,3]}', '"text"', "[1,2,3,4]", "null"]
    payloads = [None, "no json", "[]", "{}", "7", "[1,2,3,4]", "[" + ",".join(odd) + "]", '{"objects":[' + ",".join(odd) + "]}", '{"items":5,"outputs":[{' + box + '}]}', "{" + box + ',"left":1,"top":2,"right":3,"bottom":4}']
    df = spark.createDataFrame(list(enumerate(payloads)), "id int, p string")
    found = df.select("id", F.posexplode(text.payload_found(F.col("p"))).alias("k", "f")).select("id", "k", "f.*")
    alone = df.select("id", F.posexplode(text.payload_entries(F.col("p"))).alias("k", "e")).select("id", "k", *(f(F.col("e")) for f in (text.payload_box, text.payload_label, text.payload_score)))
    got = sorted(map(tuple, found.collect()), key=repr)
    assert got == sorted(map(tuple, alone.collect()), key=repr) and len(got) == 2 * len(odd) + 6
    assert [r[2] for r in got if r[0] == 7] == [[1.0, 2.0, 4.0, 6.0], [1.0, 2.0, 3.0, 4.0], [5.0, 6.0, 5.0, 14.0], [1.0, 2.0, 1.0, 6.0], *[None] * 4]
    assert got[-1][2:] == ([1.0, 2.0, 3.0, 4.0], "a", 0.5)
