"""Reports over datasets, scores and label counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boxquery.functions.geometry import area, size_bucket
from boxquery.operators.overlaps import iou_join, overlapped
from boxquery.operators.selection import nth_values


def class_counts(annotations: DataFrame, by: Sequence[str] = ("category_id",)) -> DataFrame:
    return annotations.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def dataset_stats(images: DataFrame, annotations: DataFrame) -> DataFrame:
    per = annotations.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))
    a = annotations.agg(F.count(F.lit(1)).alias("objects"), F.avg("w").alias("mean_w"), F.avg("h").alias("mean_h"), F.count_distinct("image_id").alias("annotated_images"))
    return a.crossJoin(per.agg(F.max("n").alias("max_per_image"))).crossJoin(images.agg(F.count(F.lit(1)).alias("images")))


def class_shares(annotations: DataFrame) -> DataFrame:
    per = class_counts(annotations)
    return per.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(W.partitionBy()))


def size_distribution(annotations: DataFrame) -> DataFrame:
    """category_id (null: all), size, n and its share of the class and of the dataset."""
    rows = annotations.withColumn("size", size_bucket(area()))
    per = rows.groupBy("category_id", "size").agg(F.count(F.lit(1)).alias("n"))
    whole = per.groupBy("size").agg(F.sum("n").alias("n")).select(F.lit(None).cast("int").alias("category_id"), "size", "n")
    total = F.sum(F.when(F.col("category_id").isNotNull(), F.col("n"))).over(W.partitionBy())
    both = per.unionByName(whole)
    return both.withColumns({"pct_class": F.col("n") * 100.0 / F.sum("n").over(W.partitionBy("category_id")), "pct_all": F.col("n") * 100.0 / total})


def split_audit(annotations: DataFrame, split: str, targets: dict[str, float]) -> DataFrame:
    """category_id, split, n, pct of the class, deviation from the target."""
    per = annotations.groupBy("category_id", F.col(split).alias("split")).agg(F.count(F.lit(1)).alias("n"))
    names = annotations.sparkSession.createDataFrame(list(targets.items()), "split string, target double")
    grid = per.select("category_id").distinct().crossJoin(F.broadcast(names))
    rows = grid.join(per, ["category_id", "split"], "left").fillna(0, ["n"])
    rows = rows.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(W.partitionBy("category_id")))
    return rows.withColumn("deviation", F.abs(F.col("pct") - F.col("target") * 100))


def deviation_order(audit: DataFrame) -> DataFrame:
    """Classes by their summed deviation."""
    return audit.groupBy("category_id").agg(F.sum("deviation").alias("total_deviation"), F.avg("deviation").alias("mean_deviation")).orderBy("total_deviation", "category_id")


def retention(whole: DataFrame, sample: DataFrame, ratio: float) -> DataFrame:
    """category_id, n, kept, retention in percent, deviation from the ratio."""
    a, b = class_counts(whole), class_counts(sample).withColumnRenamed("n", "kept")
    rows = a.join(b, "category_id", "left").fillna(0, ["kept"]).withColumn("retention", F.col("kept") * 100.0 / F.col("n"))
    return rows.withColumn("deviation", F.col("retention") - ratio * 100)


def score_stats(dets: DataFrame, by: Sequence[str]) -> DataFrame:
    """n, mean and exact percentiles (interpolated) of the score; by selection, so no task has all scores of a group."""
    points = [0.25, 0.5, 0.75, 0.95]
    per = dets.groupBy(*by).agg(F.count("score").alias("n"), F.avg("score").alias("mean"))
    place = (F.col("n") - 1) * F.col("_point")
    wanted = per.where("n > 0").withColumn("_point", F.explode(F.array(*map(F.lit, points)))).select(*by, "_point", F.explode(F.array(F.floor(place), F.ceil(place))).alias("rank")).distinct()
    found = nth_values(dets, by, "score", wanted.select(*by, "rank").distinct()).select(*by, "rank", "value")
    both = wanted.join(found, [*by, "rank"]).join(per.select(*by, "n"), list(by)).withColumn("_part", place - F.floor(place))
    value = F.min("value") + (F.max("value") - F.min("value")) * F.first("_part")
    each = both.groupBy(*by, "_point").agg(value.alias("_v")).groupBy(*by).agg(*(F.max(F.when(F.col("_point") == p, F.col("_v"))).alias(f"p{int(p * 100)}") for p in points))
    return per.join(each, list(by), "left")


def histogram(dets: DataFrame, value: str, low: float, high: float, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """by, bin (1..bins; the last closed), n and density over shared edges."""
    place = F.when(F.col(value) == high, F.lit(bins)).otherwise(F.expr(f"width_bucket({value}, {low}D, {high}D, {bins})").cast("int"))
    rows = dets.where((F.col(value) >= low) & (F.col(value) <= high)).groupBy(*by, place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("density", F.col("n") / (F.sum("n").over(W.partitionBy(*by)) * ((high - low) / bins)))


def bincount(rows: DataFrame, value: str, top: int) -> DataFrame:
    """value 0..top with its count, gaps filled."""
    whole = rows.sparkSession.range(top + 1).select(F.col("id").alias("value"))
    return whole.join(rows.groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n")), "value", "left").fillna(0, ["n"])


def class_weights(annotations: DataFrame, classes: DataFrame, mode: str = "inverse", cap: float = 10.0) -> DataFrame:
    """category_id and weight, of mean 1: inverse of the share, its root, or the inverse capped; a class without rows has a raw weight of 1."""
    if mode not in ("inverse", "sqrt", "capped"):
        raise ValueError(f"unknown mode: {mode!r}")
    rows = classes.select("category_id").join(class_counts(annotations), "category_id", "left").fillna(0, ["n"])
    inverse = F.try_divide(F.sum("n").over(W.partitionBy()).cast("double"), F.col("n"))
    raw = {"inverse": inverse, "sqrt": F.sqrt(inverse), "capped": F.least(inverse, F.lit(cap))}[mode]
    rows = rows.withColumn("_raw", F.coalesce(raw, F.lit(1.0)))
    return rows.select("category_id", (F.col("_raw") / F.avg("_raw").over(W.partitionBy())).alias("weight"))


def most_per_group(rows: DataFrame, by: str) -> DataFrame:
    return class_counts(rows, [by]).agg(F.max("n").alias("most"), F.avg("n").alias("mean"))


def top_labels(rows: DataFrame, label: str, k: int = 50) -> DataFrame:
    return rows.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(k)


def prompt_table(dets: DataFrame, gts: DataFrame, threshold: float, by: str = "prompt_set", image: str = "image_id") -> DataFrame:
    """by, tiles, recall and precision: of each prompt, the means over tiles of the share of truth boxes, and of detections, that overlap any of the others.

    A tile without truth boxes has no recall, one without detections no precision; nulls
    don't count in the means.
    """
    hit = overlapped(dets, gts, [image], threshold).select("det_id", F.lit(1).alias("_hit"))
    precision = dets.join(hit, "det_id", "left").groupBy(by, image).agg((F.count("_hit") / F.count(F.lit(1))).alias("_p"))
    found = iou_join(gts.select(image, "gt_id", "x", "y", "w", "h"), dets.select(image, by, "x", "y", "w", "h"), [image], threshold).groupBy(F.col(f"b_{by}").alias(by), F.col(f"a_{image}").alias(image)).agg(F.count_distinct("a_gt_id").alias("_found"))
    tiles = dets.select(by).distinct().crossJoin(gts.groupBy(image).agg(F.count(F.lit(1)).alias("_n")))
    recall = tiles.join(found, [by, image], "left").select(by, image, (F.coalesce("_found", F.lit(0)) / F.col("_n")).alias("_r"))
    return recall.join(precision, [by, image], "full").groupBy(by).agg(F.count(F.lit(1)).alias("tiles"), F.avg("_r").alias("recall"), F.avg("_p").alias("precision"))


def merged_counts(parts: Sequence[DataFrame]) -> DataFrame:
    """Label counts of several runs summed, most first."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("label").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "label")


def moments(rows: DataFrame, values: Sequence[str]) -> DataFrame:
    """Mean and deviation of channels."""
    return rows.agg(*(F.avg(v).alias(f"{v}_mean") for v in values), *(F.stddev_pop(v).alias(f"{v}_std") for v in values))


def both_ends(rows: DataFrame, value: str, id: str, k: int) -> DataFrame:
    """The k lowest and the k highest rows, each once."""
    low = rows.orderBy(value, id).limit(k)
    high = rows.orderBy(F.desc(value), id).limit(k)
    return low.unionByName(high.join(low.select(id), id, "left_anti"))


def experiment_table(names: DataFrame, metrics: DataFrame, order: str) -> DataFrame:
    """All experiments with their metrics (null where none), best first."""
    return names.join(metrics, "name", "left").orderBy(F.desc_nulls_last(order), "name")
