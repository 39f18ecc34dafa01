"""Queries of counts, audits and distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxquery.functions import geometry, params
from boxquery.operators import dataset, policy, stats, tiling
from boxquery.plans import views
from boxquery.plans.registry import query, rounded
from boxquery.sources import writers


@query("SELECT image_id, category_id, count(*) AS n FROM gt GROUP BY ALL")
def a01_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.class_counts(views.truths(spark, sf_dir), ["image_id", "category_id"])


@query("SELECT count(*) AS objects, round(avg(w), 6) AS mean_w, round(avg(h), 6) AS mean_h, count(DISTINCT image_id) AS annotated_images, (SELECT max(c) FROM (SELECT count(*) AS c FROM gt GROUP BY image_id)) AS max_per_image, (SELECT count(*) FROM img) AS images FROM gt")
def a04_dataset_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.dataset_stats(views.images(spark, sf_dir), views.truths(spark, sf_dir)), "mean_w", "mean_h")


@query("SELECT category_id, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM gt), 6) AS pct FROM gt GROUP BY 1")
def a04_class_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.class_shares(views.truths(spark, sf_dir)), "pct")


_SPLIT = "CASE WHEN image_id % 10 < 7 THEN 'train' WHEN image_id % 10 = 7 THEN 'val' ELSE 'test' END"
_AUDIT = f""", tg AS (SELECT * FROM (VALUES ('train', 0.7::DOUBLE), ('val', 0.1::DOUBLE), ('test', 0.2::DOUBLE)) v(split, target)),
ct AS (SELECT category_id, {_SPLIT} AS split, count(*) AS n FROM gt GROUP BY ALL),
au AS (SELECT c.category_id, tg.split, coalesce(n, 0) AS n, target, coalesce(n, 0) * 100.0 / sum(coalesce(n, 0)) OVER (PARTITION BY c.category_id) AS pct FROM (SELECT DISTINCT category_id FROM gt) c CROSS JOIN tg LEFT JOIN ct ON ct.category_id = c.category_id AND ct.split = tg.split)"""
_TARGETS = {"train": 0.7, "val": 0.1, "test": 0.2}


def _audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = views.truths(spark, sf_dir).withColumn("split", F.expr(_SPLIT))
    return stats.split_audit(g, "split", _TARGETS)


@query(_AUDIT + " SELECT category_id, split, n, target, round(pct, 6) AS pct, round(abs(pct - target * 100), 6) AS deviation FROM au")
def a05_split_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_audit(spark, sf_dir), "pct", "deviation")


@query(_AUDIT + " SELECT category_id, round(sum(abs(pct - target * 100)), 6) AS total_deviation, round(avg(abs(pct - target * 100)), 6) AS mean_deviation FROM au GROUP BY 1")
def w13_a22_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.deviation_order(_audit(spark, sf_dir)), "total_deviation", "mean_deviation")


@query("SELECT category_id, count(*) AS n, count(*) FILTER (WHERE image_id % 5 = 0) AS kept, round(count(*) FILTER (WHERE image_id % 5 = 0) * 100.0 / count(*), 6) AS retention, round(count(*) FILTER (WHERE image_id % 5 = 0) * 100.0 / count(*) - 20, 6) AS deviation FROM gt GROUP BY 1")
def a06_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = views.truths(spark, sf_dir)
    return rounded(stats.retention(g, g.where("image_id % 5 = 0"), 0.2), "retention", "deviation")


@query(""", z AS (SELECT category_id, CASE WHEN w * h < 1024 THEN 'small' WHEN w * h < 9216 THEN 'medium' ELSE 'large' END AS size FROM gt),
c AS (SELECT category_id, size, count(*) AS n FROM z GROUP BY GROUPING SETS ((category_id, size), (size)))
SELECT category_id, size, n, round(n * 100.0 / sum(n) OVER (PARTITION BY category_id), 6) AS pct_class, round(n * 100.0 / (SELECT count(*) FROM gt), 6) AS pct_all FROM c""")
def a07_p04_size_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.size_distribution(views.truths(spark, sf_dir)), "pct_class", "pct_all")


@query("SELECT round(avg(x), 6) AS x_mean, round(avg(y), 6) AS y_mean, round(stddev_pop(x), 6) AS x_std, round(stddev_pop(y), 6) AS y_std FROM det")
def a08_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.moments(views.detections(spark, sf_dir), ["x", "y"]), "x_mean", "y_mean", "x_std", "y_std")


@query("SELECT category_id, prompt_set, count(*) AS n, round(avg(score), 9) AS mean, round(quantile_cont(score, 0.25), 9) AS p25, round(quantile_cont(score, 0.5), 9) AS p50, round(quantile_cont(score, 0.75), 9) AS p75, round(quantile_cont(score, 0.95), 9) AS p95 FROM det GROUP BY ALL")
def a09_score_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.score_stats(views.detections(spark, sf_dir), ["category_id", "prompt_set"]), "mean", "p25", "p50", "p75", "p95", places=9)


@query(", b AS (SELECT src, least(floor(x / 5)::INT + 1, 20) AS bin, count(*) AS n FROM det WHERE x BETWEEN 0 AND 100 GROUP BY ALL) SELECT src, bin, n, round(n / (sum(n) OVER (PARTITION BY src) * 5.0), 6) AS density FROM b")
def a10_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.histogram(views.detections(spark, sf_dir), "x", 0.0, 100.0, 20, ["src"]), "density")


@query(", c AS (SELECT k AS category_id, count(gt_id) AS n FROM (SELECT unnest(range(1, 8))::INT AS k) LEFT JOIN gt ON gt.category_id = k GROUP BY 1), r AS (SELECT category_id, CASE WHEN n > 0 THEN sqrt((SELECT count(*) FROM gt) / n) ELSE 1 END AS raw FROM c) SELECT category_id, round(raw / avg(raw) OVER (), 6) AS weight FROM r")
def a17_class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = spark.range(1, 8).select(F.col("id").cast("int").alias("category_id"))
    return rounded(stats.class_weights(views.truths(spark, sf_dir), classes, "sqrt"), "weight")


@query("SELECT max(n) AS most, round(avg(n), 6) AS mean FROM (SELECT count(*) AS n FROM det GROUP BY image_id)")
def a18_most_per_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.most_per_group(views.detections(spark, sf_dir), "image_id"), "mean")


@query("SELECT event_type AS label, count(*) AS n FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3", views=False)
def a16_top_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.top_labels(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_type", 3)


@query("SELECT event_type AS label, (count(*) + count(*) FILTER (WHERE event_id % 2 = 0))::BIGINT AS n FROM events GROUP BY 1", views=False)
def a15_u01_merged_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumnRenamed("event_type", "label")
    count = lambda df: df.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return stats.merged_counts([count(e), count(e.where("event_id % 2 = 0"))])


@query("SELECT coalesce(a.category_id, b.category_id) AS category_id, coalesce(a.n, 0) AS n_one, coalesce(b.n, 0) AS n_two FROM (SELECT category_id, count(*) AS n FROM det WHERE src = 1 GROUP BY 1) a FULL JOIN (SELECT category_id, count(*) AS n FROM gt WHERE category_id < 4 GROUP BY 1) b ON a.category_id = b.category_id")
def j21_u05_class_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = stats.class_counts(views.detections(spark, sf_dir).where("src = 1")).withColumnRenamed("n", "n_one")
    b = stats.class_counts(views.truths(spark, sf_dir).where("category_id < 4")).withColumnRenamed("n", "n_two")
    return a.join(b, "category_id", "full").fillna(0, ["n_one", "n_two"])


@query("SELECT l_returnflag AS type_name, n_name, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE l_returnflag NOT IN ('A') AND l_quantity > 10 GROUP BY ALL", views=False)
def j01_f03_dimension_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    rows = t("lineitem").where(~F.col("l_returnflag").isin("A") & (F.col("l_quantity") > 10)).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.join(F.broadcast(t("nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.groupBy(F.col("l_returnflag").alias("type_name"), "n_name").agg(F.count(F.lit(1)).alias("n"))


@query(", ty AS (SELECT * FROM (VALUES (1, 10, 'a'), (2, 10, 'a'), (4, 20, 'b')) v(type_id, category_id, name)) SELECT det_id, ty.category_id, ty.name FROM det JOIN ty ON ty.type_id = det.category_id WHERE det.category_id <> 2 AND image_id NOT IN (3, 5) AND w > 0 AND h > 0")
def j01_f04_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = spark.createDataFrame([(1, 10, "a"), (2, 10, "a"), (4, 20, "b")], "type_id int, category_id int, name string")
    d = views.detections(spark, sf_dir).withColumnRenamed("category_id", "type_id")
    return tiling.clean(d, [2], [3, 5], mapping).select("det_id", "category_id", "name")


@query("SELECT gt_id FROM gt WHERE w * h >= 900")
def f06_min_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, _ = tiling.min_area(views.truths(spark, sf_dir), views.images(spark, sf_dir), 900, True)
    return kept.select("gt_id")


@query("SELECT id FROM img ORDER BY id LIMIT 25")
def w09_first_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.first_images(views.images(spark, sf_dir).select("id"), 25)


@query(", c AS (SELECT image_id, count(*) AS n FROM gt GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n, image_id) AS a, row_number() OVER (ORDER BY n DESC, image_id) AS b FROM c) SELECT image_id, n FROM r WHERE a <= 10 OR b <= 10")
def w07_both_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.both_ends(stats.class_counts(views.truths(spark, sf_dir), ["image_id"]), "n", "image_id", 10)


@query("SELECT n AS name, CASE WHEN n < 4 THEN (SELECT round(avg(score), 6) FROM det WHERE category_id = n) END AS value FROM (SELECT unnest(range(1, 8)) AS n)")
def e22_experiment_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.range(1, 8).withColumnRenamed("id", "name")
    m = views.detections(spark, sf_dir).where("category_id < 4").groupBy(F.col("category_id").cast("long").alias("name")).agg(F.avg("score").alias("value"))
    return rounded(stats.experiment_table(names, m, "value"), "value")


@query("SELECT 'img_' || image_id || '_' || floor(y / 32)::INT || '_' || floor(x / 32)::INT || '.tif' AS file_name, count(*) AS n FROM det GROUP BY 1")
def p25_tile_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.detections(spark, sf_dir).select("image_id", F.floor(F.col("y") / 32).alias("r"), F.floor(F.col("x") / 32).alias("c"))
    return d.groupBy(tiling.tile_name("image_id", "r", "c").alias("file_name")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT doc_id, CASE WHEN n_chars < 1024 THEN printf('%.2f', n_chars::DOUBLE) || ' B' ELSE printf('%.2f', n_chars::DOUBLE / 1024) || ' KB' END AS size FROM documents""", views=False)
def p31_byte_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", geometry.bytes_text(F.col("n_chars").cast("double")).alias("size"))


@query("SELECT category_id, coalesce(printf('%.4f', CASE WHEN category_id < 4 THEN round(avg(w), 2) END), 'N/A') AS mean_w FROM det GROUP BY 1")
def k02_formatted(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.detections(spark, sf_dir).groupBy("category_id").agg(F.when(F.col("category_id") < 4, F.round(F.avg("w"), 2)).alias("mean_w"))
    return writers.formatted(d, ["mean_w"])


@query("SELECT det_id FROM det WHERE prompt_set NOT IN (0, 2)")
def k05_missing_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.detections(spark, sf_dir)
    return writers.missing_sets(d, d.where("prompt_set in (0, 2)")).select("det_id")


@query("SELECT image_id, category_id, x, y, w, h, count(*) AS n, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM (SELECT *, ['zero', 'one', 'two'][src + 1] AS source FROM det) GROUP BY ALL")
def u01_a21_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every box of the union of sources, with its rows and its sources."""
    d = views.detections(spark, sf_dir)
    both = dataset.union_sources({name: d.where(F.col("src") == k) for k, name in enumerate(("zero", "one", "two"))})
    return both.groupBy("image_id", "category_id", "x", "y", "w", "h").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


@query("SELECT image_id, category_id, det_id FROM det WHERE EXISTS (SELECT 1 FROM img WHERE img.id = det.image_id AND id % 4 = 1)")
def f12_u04_valid_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = views.images(spark, sf_dir).where(views.VALID).select(F.col("id").alias("image_id"))
    return views.detections(spark, sf_dir).join(i, "image_id", "left_semi").select("image_id", "category_id", "det_id")


@query("SELECT image_id, count(*) AS n, sum(det_id)::BIGINT AS id_sum FROM det GROUP BY 1")
def w11_by_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.detections(spark, sf_dir).groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.sum("det_id").alias("id_sum"))




@query("SELECT gt_id, image_id, row_number() OVER (ORDER BY image_id, gt_id) - 1 AS place FROM gt")
def j03_image_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations brought to their images by file name, in the images' order."""
    name = F.concat(F.lit("img_"), F.col("image_id"), F.lit(".tif")).alias("file_name")
    notes = views.truths(spark, sf_dir).select("gt_id", name)
    files = views.images(spark, sf_dir).select(F.col("id").alias("image_id"), F.concat(F.lit("img_"), F.col("id"), F.lit(".tif")).alias("file_name"))
    return dataset.numbered(notes.join(files, "file_name"), "place", ["image_id", "gt_id"], 0, 8).select("gt_id", "image_id", "place")


@query("SELECT det_id FROM det WHERE score > 0.5")
def f02_strict_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.above(views.detections(spark, sf_dir), 0.5).select("det_id")


@query("SELECT det_id, replace(printf('s%.3f_t%.3f', score, (det_id * 29 % 1000) / 1000.0::DOUBLE), '.', 'p') AS run FROM det")
def p26_variant_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.detections(spark, sf_dir)
    return d.select("det_id", params.variant_names(F.col("score"), (F.col("det_id") * 29 % 1000) / 1000).alias("run"))


@query("SELECT det_id, unnest(CASE WHEN score > 1 OR category_id = 5 THEN [] WHEN score = 0.5 THEN [score] ELSE [score, 0.5] END) AS score, 0.5::DOUBLE AS text FROM det")
def p27_threshold_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of thresholds read from the text that a run's row has; a text with a bad part has none."""
    d = views.detections(spark, sf_dir)
    said = F.concat(F.lit(" "), F.col("score").cast("string"), F.lit(":0.5, 0.5:0.5,,"), F.col("score").cast("string"), F.when(F.col("category_id") == 5, F.lit(":x")).otherwise(F.lit(":0.5 ")))
    return d.select("det_id", F.explode(params.pairs_of(said)).alias("p")).select("det_id", "p.score", "p.text")


@query(", n AS (SELECT image_id, count(*) AS n FROM det GROUP BY 1) SELECT image_id, least(100, n) AS first_cap, least(500, n) AS second_cap, n AS third_cap FROM n")
def p32_detection_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = views.detections(spark, sf_dir).groupBy("image_id").agg(params.caps_of(F.count(F.lit(1))).alias("c"))
    return per.select("image_id", *(F.get("c", F.lit(k)).alias(f"{name}_cap") for k, name in enumerate(("first", "second", "third"))))


@query("SELECT p_size AS base, count(*) AS n, floor(p_size * s)::INT AS size, r AS ratio FROM part, (SELECT unnest([0.5, 1.0, 2.25])::DOUBLE AS s), (SELECT unnest([0.5, 1.0, 2.0])::DOUBLE AS r) GROUP BY base, s, r", views=False)
def p33_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The anchors of each size of part, three scales by three ratios, and how many parts have them."""
    base = spark.read.parquet(f"{sf_dir}/part.parquet").groupBy(F.col("p_size").alias("base")).agg(F.count(F.lit(1)).alias("n"))
    return base.select("base", "n", F.inline(params.anchors_of(F.col("base"), [0.5, 1.0, 2.25], [0.5, 1.0, 2.0])))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'float16' WHEN 'view' THEN 'bfloat16' WHEN 'error' THEN 'float32' END AS dtype FROM events", views=False)
def p35_number_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("event_type") == "click", " Half ").when(F.col("event_type") == "view", "BF16").when(F.col("event_type") == "error", "fp32").otherwise("int8")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", params.dtypes_of(said).alias("dtype"))


@query("SELECT det_id, (w - 30) * (h - 27) AS area FROM det WHERE w > 30 AND h > 27")
def f13_solid_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets whose sides were cut by a border of 30 and 27, those without an area left out."""
    d = views.detections(spark, sf_dir).withColumns({"w": F.col("w") - 30, "h": F.col("h") - 27})
    return tiling.solid(d).select("det_id", "area")
