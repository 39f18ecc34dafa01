"""Readers and writers on small files."""

import json

import pytest
from pyspark.sql import functions as F

from boxquery.operators import dataset
from boxquery.sources import readers, writers


def put(path, name, value):
    p = path / name
    p.write_text(value if isinstance(value, str) else json.dumps(value))
    return str(p)


def test_coco_round_trip(spark, tmp_path):
    doc = {"images": [{"id": 1, "file_name": "a.tif", "width": 9, "height": 9}], "annotations": [{"id": 0, "image_id": 1, "category_id": 2, "bbox": [1.0, 2.0, 3.0, 4.0], "area": 12.0, "iscrowd": 0}], "categories": [{"id": 2, "name": "b"}]}
    parts = readers.coco(spark, put(tmp_path, "c.json", doc))
    assert parts["annotations"].select("x", "y", "w", "h").first() == (1.0, 2.0, 3.0, 4.0)
    back = json.loads("".join(r.value for r in writers.coco_lines(parts["images"], parts["annotations"], parts["categories"]).collect()))
    assert back == doc
    none = [parts[k].limit(0) for k in ("images", "annotations", "categories")]
    writers.one_file(writers.coco_lines(*none), f"file://{tmp_path}/none.json")
    assert json.loads((tmp_path / "none.json").read_text()) == {"images": [], "annotations": [], "categories": []}


def test_a_long_document_is_one_file_in_order(spark, tmp_path):
    notes = spark.range(3000).repartition(9).select("id", F.lit(1).alias("image_id"), F.lit(2).alias("category_id"), *(F.lit(1.0).alias(c) for c in "xywh"))
    images = spark.createDataFrame([(1, "a", 9, 9)], "id long, file_name string, width int, height int")
    writers.one_file(writers.coco_lines(images, notes, spark.createDataFrame([(2, "b")], "id int, name string")), f"file://{tmp_path}/long.json")
    assert [a["id"] for a in json.loads((tmp_path / "long.json").read_text())["annotations"]] == list(range(3000))


def test_a_document_of_parts_is_written_and_read_by_all_tasks(spark, tmp_path):
    notes = spark.range(3000).select("id", F.lit(1).alias("image_id"), F.lit(2).alias("category_id"), *(F.lit(1.0).alias(c) for c in "xywh"))
    images = spark.createDataFrame([(1, 'a ",\n[{', 9, 9), (2, None, 8, 8)], "id long, file_name string, width int, height int")
    categories = spark.createDataFrame([(2, "b"), (3, None)], "id int, name string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        writers.coco_parts(images, notes, categories, f"file://{tmp_path}/doc")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted((tmp_path / "doc").glob("part=*/part-*.txt"))
    doc = json.loads("".join(f.read_text() for f in files))
    assert [a["id"] for a in doc["annotations"]] == list(range(3000)) and len(doc["images"]) == len(doc["categories"]) == 2
    got = readers.coco(spark, f"file://{tmp_path}/doc", parts=True)
    assert {k: sorted(map(tuple, df.collect())) for k, df in got.items()} == {"images": sorted(map(tuple, images.collect())), "annotations": [(k, 1, 2, 1.0, 0, 1.0, 1.0, 1.0, 1.0) for k in range(3000)], "categories": [(2, "b"), (3, None)]}
    assert max(f.stat().st_size for f in files) < 0.7 * sum(f.stat().st_size for f in files) and len(got["annotations"].inputFiles()) > 1


def test_an_empty_document_of_parts_and_a_broken_one(spark, tmp_path):
    none = [spark.createDataFrame([], s) for s in ("id long, file_name string, width int, height int", "id long, image_id long, category_id int, x double, y double, w double, h double", "id int, name string")]
    writers.coco_parts(*none, f"file://{tmp_path}/none")
    assert [df.count() for df in readers.coco(spark, f"file://{tmp_path}/none", parts=True).values()] == [0, 0, 0]
    (tmp_path / "broken" / "part=5-categories").mkdir(parents=True)
    (tmp_path / "broken" / "part=5-categories" / "part-0.txt").write_text('{"id":1,"name":"a"}\n,{"id":2,"na\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.coco(spark, f"file://{tmp_path}/broken", parts=True)["categories"].collect()


def test_splits_are_written_and_read_by_all_tasks(spark, tmp_path):
    notes = spark.range(3000).select("id", (F.col("id") % 30).alias("image_id"), F.lit(2).alias("category_id"), *(F.lit(1.0).alias(c) for c in "xywh"))
    images = spark.range(31).select("id", F.concat("id", F.lit(".tif")).alias("file_name"), F.lit(9).alias("width"), F.lit(9).alias("height"))
    categories, split = spark.createDataFrame([(2, "b")], "id int, name string"), images.select(F.col("id").alias("image_id"), F.when(F.col("id") % 3 == 0, "val").otherwise("train").alias("split"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        paths = dataset.write_split(images, notes, categories, split, f"file://{tmp_path}/split", ["train", "val", "test"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    single = dataset.write_split(images, notes, categories, split, f"file://{tmp_path}/single", ["train", "val", "test"], files=True)
    for name, n in {"train": 20, "val": 11, "test": 0}.items():
        got = readers.coco(spark, paths[name], parts=True)
        files = sorted((tmp_path / "split" / name).glob("part=*/part-*.txt"))
        doc = json.loads("".join(f.read_text() for f in files))
        assert doc == json.loads((tmp_path / "single" / f"{name}.json").read_text())
        assert {k: sorted(map(tuple, df.collect())) for k, df in got.items()} == {k: sorted(map(tuple, df.collect())) for k, df in readers.coco(spark, single[name]).items()}
        assert len(doc["images"]) == n and len(doc["annotations"]) == 100 * (n - (name == "val")) * (n > 0) and doc["categories"] == [{"id": 2, "name": "b"}]
        assert name == "test" or len(got["annotations"].inputFiles()) > 1


def test_ratio_runs_need_both_files(spark, tmp_path):
    for name, files in {"r20": 2, "r0p5": 2, "r30": 1, "none": 2}.items():
        (tmp_path / name / "eval").mkdir(parents=True)
        (tmp_path / name / "eval" / "metrics.json").write_text('{"AP": 0.5, "note": "x", "AR": 1}')
        if files == 2:
            (tmp_path / name / "eval" / "metrics_per_class.json").write_text('{"car": 0.25}')
    got = {tuple(r) for r in readers.ratio_runs(spark, f"file://{tmp_path}", inner="eval").collect()}
    assert got == {(n, p, *m) for n, p in (("r20", 20.0), ("r0p5", 50.0)) for m in (("global", "AP", 0.5), ("global", "AR", 1.0), ("per_class", "car", 0.25))}
    assert {r.name for r in readers.ratio_runs(spark, f"file://{tmp_path}", ["r20", "r30"], "eval").collect()} == {"r20"}
    with pytest.raises(ValueError):
        readers.ratio_runs(spark, f"file://{tmp_path}", ["r30"], "eval")


def test_geojson_strict_and_tolerant(spark, tmp_path):
    feature = lambda b, t=1: {"properties": {"image_id": "a.tif", "type_id": t, "bounds_imcoords": b}}
    path = put(tmp_path, "g.json", {"features": [feature("1,2,4,6")]})
    assert readers.geojson(spark, path).select("x", "y", "w", "h").first() == (1.0, 2.0, 3.0, 4.0)
    path = put(tmp_path, "t.json", {"features": [feature("1,2,4,6"), feature("1,2"), feature("1,2,x,4"), feature("1,2,3,4", 0), feature("[1, 2, 3, 4]")]})
    assert readers.geojson(spark, path, tolerant=True).count() == 2


def test_detection_layouts(spark, tmp_path):
    d = {"image_id": 1, "category_id": 2, "bbox": [1, 2, 3, 4], "score": 0.5, "dino_label": "x"}
    for k, doc in enumerate(([d], {"annotations": [d]}, {"detections": [d]})):
        got = readers.detections(spark, put(tmp_path, f"{k}.json", doc), "dino_label").first()
        assert (got.raw_label, got.h, got.score) == ("x", 4.0, 0.5)


def test_class_map_first_name_counts(spark, tmp_path):
    got = readers.class_map(spark, put(tmp_path, "m.json", {"11": {"id": 1, "name": "a"}, "12": {"id": 1, "name": "b"}}))
    assert sorted(tuple(r) for r in got.collect()) == [(11, 1, "a"), (12, 1, "a")]


def test_prompt_dialects(spark):
    assert readers.prompts("Prompt one: car . bus\n- plane\nother line", "txt") == [("default", "car", 0), ("default", "bus", 1), ("default", "plane", 2)]
    assert readers.prompts('["a", "b"]', "json") == [("default", "a", 0), ("default", "b", 1)]
    assert readers.prompts("prompt_sets:\n  s1:\n    Car: [car, auto]\n", "yaml") == [("s1/Car", "car", 0), ("s1/Car", "auto", 1)]
    assert readers.prompt_table(spark, "prompt_sets:\n  s1:\n    Car: [car]\n", "yaml").first() == ("s1", "Car", "car", 0)


def test_metric_files_and_sets(spark, tmp_path):
    paths = {"a": put(tmp_path, "a.json", {"ap": 0.5}), "b": put(tmp_path, "b.json", "{broken"), "c": str(tmp_path / "none.json")}
    assert {r.name: r.ap for r in readers.metric_files(spark, paths, ["ap"]).collect()} == {"a": 0.5, "b": None, "c": None}
    df = spark.createDataFrame([(1, "s1"), (2, "s2")], "v int, prompt_set string")
    where = str(tmp_path / "sets")
    writers.write_sets(df, where)
    writers.write_sets(df.where("v = 2").selectExpr("v + 10 as v", "prompt_set"), where)
    assert sorted(r.v for r in spark.read.parquet(where).collect()) == [1, 12]
    assert writers.missing_sets(df, df.where("v = 1")).count() == 1
    assert writers.markdown(df.orderBy("v")).splitlines()[2] == "| 1 | s1 |"


def test_training_log_of_a_run_that_goes_on(spark, tmp_path):
    epoch = lambda e, m: f"Epoch {e}/9 | train_loss=1.5 | val_loss=2.5 | mAP50={m} | lr=1e-4\n"
    text = "[INFO] Argumentos: a\n" + epoch(1, 0.1) + epoch(2, 0.2) + epoch(3, 0.3) + "[INFO] Argumentos: b\nEpoch 2 | iter 5/10 | val_loss=0.5\n" + epoch(2, 0.4)
    path = put(tmp_path, "log.txt", text)
    assert sorted((r.epoch, r.run, r.map, r.lr) for r in readers.training_epochs(spark, path).collect()) == [(1, 1, 0.1, 1e-4), (2, 2, 0.4, 1e-4)]
    assert [tuple(r) for r in readers.training_iterations(spark, path).collect()] == [(2, "val", 2, 5, 10, 0.5)]
