"""Operators over boxes on hand-made inputs."""

import pytest
from pyspark.sql import functions as F

from boxquery.functions import geometry, params, text
from boxquery.operators import calibrate, dataset, ensemble, evaluate, matching, policy, stats, tiling

DET = "det_id long, image_id long, category_id int, x double, y double, w double, h double, score double"
GT = "gt_id long, image_id long, category_id int, x double, y double, w double, h double"


def ids(df, column):
    return sorted(r[column] for r in df.select(column).collect())


def test_iou_half_overlap_and_empty(spark):
    df = spark.createDataFrame([(0.0, 0.0, 10.0, 10.0, 5.0, 0.0, 10.0, 10.0), (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)], "a_x double, a_y double, a_w double, a_h double, b_x double, b_y double, b_w double, b_h double")
    assert [round(r[0], 6) for r in df.select(geometry.iou("a_", "b_")).collect()] == [round(1 / 3, 6), 0.0]


def test_dedup_priority_beats_score_and_classes_stay_apart(spark):
    rows = [(1, 1, 1, 0.0, 0.0, 10.0, 10.0, 0.2, 0), (2, 1, 1, 0.0, 0.0, 10.0, 10.0, 0.9, 1), (3, 1, 2, 0.0, 0.0, 10.0, 10.0, 0.9, 1)]
    df = spark.createDataFrame(rows, DET + ", src int")
    assert ids(matching.greedy_dedup(df, ["image_id", "category_id"], [F.col("src"), -F.col("score")], "det_id", 0.5), "det_id") == [1, 3]


def test_match_uses_each_truth_once_and_threshold_is_inclusive(spark):
    d = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 10.0, 10.0, 0.9), (2, 1, 1, 0.0, 0.0, 10.0, 10.0, 0.8)], DET)
    g = spark.createDataFrame([(7, 1, 1, 0.0, 0.0, 10.0, 5.0)], GT)
    assert [(r.det_id, r.gt_id, r.iou) for r in matching.greedy_match(d, g, ["image_id", "category_id"], 0.5).collect()] == [(1, 7, 0.5)]


@pytest.mark.parametrize("parts", [1, 3])
def test_components_are_transitive_whatever_the_partitions(spark, parts):
    rows = [(k, 1, 1, 4.0 * k, 0.0, 10.0, 10.0, 0.5) for k in range(6)] + [(9, 1, 1, 500.0, 0.0, 10.0, 10.0, 0.5)]
    got = matching.components(spark.createDataFrame(rows, DET).repartition(parts), ["image_id"], "det_id", 0.3)
    assert {(r.det_id, r.cluster) for r in got.collect()} == {(k, 0) for k in range(6)} | {(9, 9)}
    with pytest.raises(ValueError):
        matching.components(got.drop("cluster"), ["image_id"], "det_id", 0.3, "xor")


def test_tiles_leave_out_a_touched_edge(spark):
    images = spark.createDataFrame([(1, 64, 64)], "id long, width int, height int")
    a = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 32.0, 32.0), (2, 1, 1, 16.0, 0.0, 32.0, 16.0)], GT)
    got = tiling.tiles(a, images, 32, 0.3).collect()
    assert sorted((r.gt_id, r.tile_col, r.tile_row, r.tx, r.tw, r.kept) for r in got) == [(1, 0, 0, 0.0, 32.0, True), (2, 0, 0, 16.0, 16.0, True), (2, 1, 0, 0.0, 16.0, True)]


def test_perfect_detections_have_ap_one_and_no_truth_is_undefined(spark):
    g = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 10.0, 10.0), (2, 2, 1, 0.0, 0.0, 40.0, 40.0)], GT)
    d = g.select(F.col("gt_id").alias("det_id"), "image_id", "category_id", "x", "y", "w", "h", F.lit(0.5).alias("score"))
    ap = evaluate.ap_by_class_and_size(d, g, evaluate.threshold_table(spark, evaluate.COCO_THRESHOLDS))
    row = evaluate.coco_summary(ap).first()
    assert (row.ap, row.ap50, row.ap_small, row.ap_medium, row.ap_large) == (1.0, 1.0, 1.0, 1.0, -1.0)


def test_one_false_alarm_before_the_hit_halves_precision(spark):
    g = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 10.0, 10.0)], GT)
    d = spark.createDataFrame([(1, 1, 1, 50.0, 0.0, 10.0, 10.0, 0.9), (2, 1, 1, 0.0, 0.0, 10.0, 10.0, 0.8)], DET)
    assert evaluate.ap_by_class(d, g, evaluate.threshold_table(spark, [0.5])).first().ap == pytest.approx(0.5)


def test_borda_prefers_the_class_ranked_high_by_most_sets(spark):
    rows = [(1, "s1", "a", 0.9), (1, "s1", "b", 0.8), (1, "s2", "b", 0.7), (1, "s3", "b", 0.6)]
    m = spark.createDataFrame([(c, s, k, v, 0.0, 0.0, 1.0, 1.0) for c, s, k, v in rows], "cluster long, prompt_set string, class_name string, score double, x double, y double, w double, h double")
    classes = spark.createDataFrame([("a",), ("b",), ("c",)], "class_name string")
    row = ensemble.ensemble(m, classes, "borda").first()
    assert (row.winner, row.n_cluster, row.n_cluster_total, row.contributing_sets) == ("b", 3, 4, ["s1", "s2", "s3"])
    with pytest.raises(ValueError):
        ensemble.class_scores(m, "best")


def test_weighted_fusion_of_two_equal_boxes(spark):
    d = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 10.0, 10.0, 0.6), (2, 1, 1, 0.0, 0.0, 10.0, 10.0, 0.4), (3, 1, 1, 90.0, 0.0, 10.0, 10.0, 0.1)], DET)
    assert sorted((r.n, r.score) for r in ensemble.wbf(d, ["image_id", "category_id"], "det_id", 0.5).collect()) == [(1, 0.1), (2, 0.5)]


def test_rescue_keeps_a_minimum_and_says_the_floor(spark):
    d = spark.createDataFrame([(k, 1, 1, 0.0, 0.0, 1.0, 1.0, k / 10) for k in range(10)], DET)
    got = policy.rescued(d, 0.85, 3)
    assert (ids(got, "det_id"), got.first().tau_eff) == ([7, 8, 9], 0.7)
    assert ids(policy.rejected_zones(d, got, 0.5), "det_id") == [5, 6]


def test_ece_of_sure_and_right_scores_is_zero(spark):
    rows = spark.createDataFrame([(1.0, 1), (0.0, 0), (2.0, 1)], "s double, t int")
    assert tuple(calibrate.binned_error(rows, "s", "t").first()) == (0.0, 3)


def test_lrp_of_nothing_is_zero_and_numbers_are_consecutive(spark):
    none = spark.createDataFrame([], "category_id int, kind string, id long, score double, iou double")
    assert calibrate.lrp(none, 0.5).first().lrp == 0.0
    got = dataset.numbered(spark.range(100).repartition(7), "n", ["id"], 1, 5)
    assert [(r.id, r.n) for r in got.orderBy("id").collect()] == [(k, k + 1) for k in range(100)]


def test_zone_only_on_labelled_images(spark):
    g = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 10.0, 10.0)], GT)
    d = spark.createDataFrame([(5, 2, 1, 0.0, 0.0, 10.0, 10.0, 0.9), (6, 2, 1, 50.0, 0.0, 10.0, 10.0, 0.2), (7, 3, 1, 0.0, 0.0, 10.0, 10.0, 0.2)], DET)
    got = dataset.merged(g, {"one": d}, 0.5, 0.5, d.where("score < 0.5"))
    assert sorted((r.kind, r.origin_id, r.is_exclusion) for r in got.collect()) == [("labeled", 1, False), ("pseudo", 5, False), ("zone", 6, True)]


def test_params():
    assert params.variant_name(0.08, 0.25) == "s0p080_t0p250"
    assert params.score_text_pairs("0.1:0.2, 0.1:0.2,0.3:0.4") == [(0.1, 0.2), (0.3, 0.4)]
    assert params.max_dets(0) == [1, 1, 1] and params.max_dets(800) == [100, 500, 800]
    assert params.target_size(10, 0.25) == 2 and params.grid(0.1, 0.3, 0.1) == [0.1, 0.2, 0.3]
    assert params.ratio_percent("r0.2") == 20 and params.ratio_percent("r30") == 30 and params.parse_dtype(" FP16") == "float16"
    for bad in ("", "0.1", "0.1:2"):
        with pytest.raises(ValueError):
            params.score_text_pairs(bad)
    with pytest.raises(ValueError):
        params.nested_ratios("0.2,0.1")


def test_labels(spark):
    df = spark.createDataFrame([("Café & Bar/Grill-42",)], "t string")
    row = df.select(text.normalize_label(F.col("t")), text.letter_tokens(F.col("t")), text.prompt_categories(F.lit("Car . car. big  bus ."))).first()
    assert tuple(row) == ("cafe and bar grill 42", ["caf", "bar", "grill"], ["Car", "big  bus"])
    got = df.select(text.payload_score(F.lit('{"score": "x", "prob": 0.25}')), text.payload_box(F.lit('{"x": 1, "y": 2, "w": 3}')), text.payload_box(F.lit("not json"))).first()
    assert tuple(got) == (0.25, None, None)


def test_payload_forms(spark):
    rows = [
        ('{"left": 1, "top": 2, "right": 3, "bottom": 4, "text": "a"}', [1.0, 2.0, 3.0, 4.0]),
        ('{"x": 1, "y": 2, "width": 3, "height": -4}', [1.0, 2.0, 4.0, 2.0]),
        ('{"bbox_xywh": [1, 2, 3, 4]}', [1.0, 2.0, 4.0, 6.0]),
        ('{"bbox": [1, 2, 3, 4], "box_format": "COCO"}', [1.0, 2.0, 4.0, 6.0]),
        ('{"coordinates": {"xmin": 1, "ymin": 2, "xmax": 3, "ymax": 4}}', [1.0, 2.0, 3.0, 4.0]),
        ('{"bbox": [1, 2, 3]}', None),
        ('{"x1": "x", "y1": 2, "x2": 3, "y2": 4}', None),
    ]
    df = spark.createDataFrame(rows, "p string, want array<double>")
    assert all(r.got == r.want for r in df.withColumn("got", text.payload_box(F.col("p"))).collect())
    entries = spark.createDataFrame([('[{"a": 1}]',), ('{"name": "x"}',), ('{"instances": [{"a": 1}, {"b": 2}]}',), ('{"other": []}',), ("broken",)], "p string")
    assert [len(r[0]) for r in entries.select(text.payload_entries(F.col("p"))).collect()] == [1, 1, 2, 0, 0]
    got = spark.createDataFrame([('{"car": [{"type": "box", "coords": [1, 2, 3, 4]}, [5, 6, 7, 8], "x"], " ": [[1, 2, 3, 4]]}',)], "p string").select(text.category_map_entries(F.col("p"))).first()[0]
    assert [(g.label, g.score, g.box) for g in got] == [("car", 1.0, [1.0, 2.0, 3.0, 4.0]), ("car", 1.0, [5.0, 6.0, 7.0, 8.0])]


def test_raw_boxes_supply_the_closing_sign(spark):
    out = "<|object_ref_start|> big car <|object_ref_end|><|box_start|><1><2><3><4>,<5><6>,<7><8><9><10>"
    got = spark.createDataFrame([(out,), (out + "<|box_end|><|im_end|><|box_start|>",), ("",)], "t string").select(text.raw_boxes(F.col("t"))).collect()
    assert [[(b.label, b.bins) for b in r[0]] for r in got] == [[("big car", [1, 2, 3, 4]), ("big car", [7, 8, 9, 10])]] * 2 + [[]]


def test_stats_of_empty_tables(spark):
    g = spark.createDataFrame([], GT)
    assert stats.dataset_stats(spark.createDataFrame([], "id long"), g).first().objects == 0
    assert stats.class_weights(g, spark.createDataFrame([(1,)], "category_id int")).first().weight == 1.0


def test_parameters_of_rows(spark):
    texts = ["0.1:0.2, 0.1:0.2,3e-1:0.4,", "0.5", "0.1:0.2,x:0.3", "0.1:1.5", "", None, "3.3:0.3", "0.3:0.3"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(params.pairs_of(F.col("t")).alias("p")).collect()
    assert [r.p and [tuple(x) for x in r.p] for r in rows] == [[(0.1, 0.2), (0.3, 0.4)], None, None, None, None, None, None, [(0.3, 0.3)]]
    one = spark.createDataFrame([(0.08, 0.25, 0, " BF16", 7), (None, 0.5, 800, "int8", 16)], "s double, t double, n int, d string, b int")
    got = one.select(params.variant_names(F.col("s"), F.col("t")), params.caps_of(F.col("n")), params.dtypes_of(F.col("d")), params.anchors_of(F.col("b"), [0.5, 1.5], [1.0, 2.0])).collect()
    assert [r[0] for r in got] == ["s0p080_t0p250", None] and [r[1] for r in got] == [[1, 1, 1], [100, 500, 800]] and [r[2] for r in got] == ["bfloat16", None]
    assert [tuple(x) for x in got[0][3]] == [(3, 1.0), (3, 2.0), (10, 1.0), (10, 2.0)]
    boxes = spark.createDataFrame([(1, 2.0, 3.0), (2, 0.0, 3.0), (3, -1.0, 3.0), (4, None, 3.0)], "id long, w double, h double")
    assert [(r.id, r.area) for r in tiling.solid(boxes).collect()] == [(1, 6.0)]
