"""Ranked-retrieval evaluation in the COCO protocol, and what builds on matches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boxquery.operators.matching import greedy_match, two_phase_match
from boxquery.operators.overlaps import BOX, crowded, greedy_choice, iou_join
from boxquery.operators.sweeps import best_points_of_bits, bit_counts, ranged_bits, score_range, two_mode_bits
from boxquery.sources.scratch import parked

#: Area ranges of the protocol, closed at both ends.
AREA_RANGES = {"all": (0.0, 1e10), "small": (0.0, 1024.0), "medium": (1024.0, 9216.0), "large": (9216.0, 1e10)}
COCO_THRESHOLDS = [round(0.5 + 0.05 * k, 2) for k in range(10)]


def threshold_table(spark: SparkSession, thresholds: Sequence[float]) -> DataFrame:
    return spark.createDataFrame([(float(t),) for t in thresholds], "t double")


def cap_detections(dets: DataFrame, most: int, keys: Sequence[str] = ("image_id", "category_id")) -> DataFrame:
    """The ``most`` best detections of each group."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("score"), "det_id"))
    return dets.withColumn("_r", rank).where(F.col("_r") <= most).drop("_r")


def scored_matches(dets: DataFrame, gts: DataFrame, thresholds: DataFrame, keys: Sequence[str] = ("image_id", "category_id")) -> DataFrame:
    """Every detection at every threshold, with its match: det_id, keys, score, t, iou (null: false positive)."""
    found = greedy_match(dets, gts, keys, thresholds=thresholds).select("t", "det_id", "iou")
    return dets.select(*keys, "det_id", "score").crossJoin(F.broadcast(thresholds)).join(found, ["t", "det_id"], "left")


def precision_curve(rows: DataFrame, truths: DataFrame, by: Sequence[str]) -> DataFrame:
    """``rows`` that count, in groups ``by`` that have truth boxes, with _prec, _rec and _k, the last of the 101 recalls reached.

    rows: by, score, det_id, tp (boolean; null: ignored); truths: by, npos.
    """
    # running counts within ranges of the score and over the ranges, so that no task has all rows of a class
    rows = rows.where("tp is not null").withColumn("_range", score_range())
    per = rows.groupBy(*by, "_range").agg(F.sum(F.col("tp").cast("long")).alias("_tps"), F.count(F.lit(1)).alias("_rows"))
    ahead = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    per = per.withColumns({"_tps": F.coalesce(F.sum("_tps").over(ahead), F.lit(0)), "_rows": F.coalesce(F.sum("_rows").over(ahead), F.lit(0))})
    order = W.partitionBy(*by, "_range").orderBy(F.desc("score"), "det_id").rowsBetween(W.unboundedPreceding, 0)
    curve = rows.withColumns({"_tp": F.sum(F.col("tp").cast("long")).over(order), "_n": F.count(F.lit(1)).over(order)}).join(per, [*by, "_range"])
    curve = curve.join(truths.where("npos > 0"), list(by)).withColumns({"_rec": (F.col("_tp") + F.col("_tps")) / F.col("npos"), "_prec": (F.col("_tp") + F.col("_tps")) / (F.col("_n") + F.col("_rows"))})
    k = F.floor(F.col("_rec") * 100)
    reached = lambda r: r / F.lit(100.0) <= F.col("_rec")
    return curve.withColumn("_k", F.when(reached(k + 1), k + 1).when(reached(k), k).otherwise(k - 1))


def best_points(curve: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, _k and the best _prec and _rec there: 101 rows a group at most; may be taken again over a finer result."""
    return curve.groupBy(*by, "_k").agg(F.max("_prec").alias("_prec"), F.max("_rec").alias("_rec"))


def curve_area(best: DataFrame, truths: DataFrame, by: Sequence[str]) -> DataFrame:
    """ap and recall of each group of ``truths`` (by, npos) from its best points; the best precision at a recall or beyond bounds the envelope."""
    beyond = W.partitionBy(*by).orderBy(F.desc("_k")).rowsBetween(W.unboundedPreceding, 0)
    lower = F.coalesce(F.lag("_k").over(W.partitionBy(*by).orderBy("_k")), F.lit(-1))
    steps = best.withColumns({"_env": F.max("_prec").over(beyond), "_wide": F.col("_k") - lower})
    ap = steps.groupBy(*by).agg((F.sum(F.col("_env") * F.col("_wide")) / 101).alias("ap"), F.max("_rec").alias("recall"))
    return truths.where("npos > 0").select(*by).join(ap, list(by), "left").fillna(0.0, ["ap", "recall"])


def average_precision(rows: DataFrame, truths: DataFrame, by: Sequence[str]) -> DataFrame:
    """101-point interpolated AP and the recall reached, of each group ``by`` that has truth boxes.

    rows: by, score, det_id, tp (boolean; null: ignored); truths: by, npos.
    """
    return curve_area(best_points(precision_curve(rows, truths, by), by), truths, by)


def ap_of_pairs(dets: DataFrame, pairs: DataFrame, truths: DataFrame, by: Sequence[str], crowd: DataFrame | None = None) -> DataFrame:
    """by, category_id, ap and recall from pairs that are known already, of detections and truth boxes of one class.

    dets: by, category_id, det_id, score; pairs: by, image_id, category_id, det_id, gt_id, iou, _s, gt_category_id (pairs of two classes go); truths: by, category_id, npos.
    """
    same = pairs.where("category_id = gt_category_id").select(*by, "image_id", "category_id", "det_id", "gt_id", "iou", "_s")
    found = greedy_choice(same, [*by, "image_id", "category_id"], "det_id", "gt_id", [F.col("_s")], [-F.col("iou")], crowd).select(*by, "det_id", F.lit(True).alias("tp"))
    rows = dets.select(*by, "category_id", "det_id", "score").join(found, [*by, "det_id"], "left").fillna(False, ["tp"])
    return average_precision(rows, truths, [*by, "category_id"])


def ap_by_class(dets: DataFrame, gts: DataFrame, thresholds: DataFrame, most: int | None = None) -> DataFrame:
    """category_id, t, ap, recall; classes without truth boxes are absent."""
    if most is not None:
        dets = cap_detections(dets, most)
    rows = scored_matches(dets, gts, thresholds).withColumn("tp", F.col("iou").isNotNull())
    truths = gts.groupBy("category_id").agg(F.count(F.lit(1)).alias("npos")).crossJoin(F.broadcast(thresholds))
    return average_precision(rows, truths, ["category_id", "t"])


def ap_of_bits(rows: DataFrame, truths: DataFrame, by: Sequence[str], thresholds: Sequence[float], ranges: Sequence[str]) -> DataFrame:
    """by, t, area, ap and recall from detections that tell all thresholds and ranges by bits.

    rows, as a table: by, score, det_id, hit, skip as ``sweeps.ranged_bits`` returns them; truths: by, area, npos.
    """
    table = F.broadcast(bit_table(rows.sparkSession, thresholds, ranges))
    truths, whole = truths.join(table, "area"), [*by, "t", "area"]
    points = best_points_of_bits(rows, truths, by, len(thresholds) * len(ranges)).join(table, "_c")
    return curve_area(best_points(points, whole), truths, whole)


def bit_table(spark: SparkSession, thresholds: Sequence[float], ranges: Sequence[str]) -> DataFrame:
    """_c, t and area: what the bits stand for."""
    return spark.createDataFrame([(k * len(thresholds) + m, t, a) for k, a in enumerate(ranges) for m, t in enumerate(sorted(thresholds))], "_c int, t double, area string")


def truths_by_size(gts: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """category_id, area, npos."""
    table = F.broadcast(gts.sparkSession.createDataFrame([(k, a, b) for k, (a, b) in ranges.items()], "area string, lo double, hi double"))
    return gts.crossJoin(table).where("w * h >= lo and w * h <= hi").groupBy("category_id", "area").agg(F.count(F.lit(1)).alias("npos"))


def ap_by_class_and_size(dets: DataFrame, gts: DataFrame, thresholds: DataFrame, ranges: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """category_id, t, area, ap, recall."""
    ranges = ranges or AREA_RANGES
    ts = [r.t for r in thresholds.select("t").distinct().collect()]
    rows = parked(ranged_bits(dets, gts, ts, ranges), "ranked")
    return ap_of_bits(rows, truths_by_size(gts, ranges), ["category_id"], ts, list(ranges)).select("category_id", "t", "area", "ap", "recall")


def coco_metrics(dets: DataFrame, gts: DataFrame, caps: Sequence[int] = (1, 10, 100), thresholds: Sequence[float] = COCO_THRESHOLDS, ranges: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """One row of the protocol's twelve metrics, -1 where no class has truth boxes of the kind.

    ap, ap50, ap75, ap_small, ap_medium, ap_large; ar_<cap> for each of the caps on
    detections of an image and class; ar_small, ar_medium, ar_large. All but the smaller
    caps' recalls hold at the largest cap. There is one matching: detections come by falling
    score, so those of the first ranks match as if the others weren't there, and a smaller cap
    is a condition on the rank. Means are over the classes (and thresholds) that have truth boxes.
    """
    ranges = ranges or AREA_RANGES
    caps = sorted(set(caps))
    rank = F.row_number().over(W.partitionBy("image_id", "category_id").orderBy(F.desc("score"), "det_id"))
    ranked = dets.withColumn("place", rank).where(F.col("place") <= caps[-1])
    rows = parked(ranged_bits(ranked, gts, thresholds, ranges, ["place"], dets), "ranked")
    npos = truths_by_size(gts, ranges)
    by = ["category_id", "t", "area"]
    per = ap_of_bits(rows, npos, ["category_id"], thresholds, list(ranges))
    if caps[:-1]:
        least_cap = F.array_min(F.filter(F.array(*map(F.lit, caps[:-1])), lambda c: F.col("place") <= c))
        counts = bit_counts(rows.withColumn("_cap", least_cap).where("_cap is not null"), ["category_id", "_cap"], len(thresholds) * len(ranges))
        counts = counts.select("category_id", "_cap", F.posexplode("_hits").alias("_c", "_n")).join(F.broadcast(bit_table(dets.sparkSession, thresholds, list(ranges))), "_c")
        within = [F.sum(F.when(F.col("_cap") <= c, F.col("_n"))).alias(f"_within_{c}") for c in caps[:-1]]
        per = per.join(counts.where("area = 'all'").groupBy(*by).agg(*within), by, "left").join(npos, ["category_id", "area"])
    whole = F.col("area") == "all"
    at = lambda t: F.avg(F.when(whole & (F.abs(F.col("t") - t) < 1e-9), F.col("ap")))
    parts = [k for k in ranges if k != "all"]
    fields = {"ap": F.avg(F.when(whole, F.col("ap"))), "ap50": at(0.5), "ap75": at(0.75)} | {f"ap_{k}": F.avg(F.when(F.col("area") == k, F.col("ap"))) for k in parts}
    fields |= {f"ar_{c}": F.avg(F.when(whole, F.coalesce(F.col(f"_within_{c}"), F.lit(0)) / F.col("npos"))) for c in caps[:-1]}
    fields |= {f"ar_{caps[-1]}": F.avg(F.when(whole, F.col("recall")))} | {f"ar_{k}": F.avg(F.when(F.col("area") == k, F.col("recall"))) for k in parts}
    return per.agg(*(F.coalesce(v, F.lit(-1.0)).alias(k) for k, v in fields.items()))


def coco_summary(per_class: DataFrame) -> DataFrame:
    """ap, ap50, ap75 and ar over classes and thresholds (area all), ap_small, ap_medium, ap_large; -1 where undefined."""
    whole = F.col("area") == "all"
    at = lambda t: F.avg(F.when(whole & (F.abs(F.col("t") - t) < 1e-9), F.col("ap")))
    fields = {"ap": F.avg(F.when(whole, F.col("ap"))), "ap50": at(0.5), "ap75": at(0.75), "ar": F.avg(F.when(whole, F.col("recall")))}
    fields |= {f"ap_{k}": F.avg(F.when(F.col("area") == k, F.col("ap"))) for k in ("small", "medium", "large")}
    return per_class.agg(*(F.coalesce(v, F.lit(-1.0)).alias(k) for k, v in fields.items()))


def precision_recall_summary(dets: DataFrame, gts: DataFrame, classes: DataFrame, thresholds: Sequence[float] = COCO_THRESHOLDS) -> DataFrame:
    """category_id (null: the mean over all ``classes``), p50, p75, p50_95, r50, r75, r50_95; all -1 without any detection.

    Precision and recall at the thresholds 0.5 and 0.75 and their means over all
    thresholds, 0 where nothing divides. Thresholds are a column of one matching, rolled
    up by threshold and then by class.
    """
    table = threshold_table(dets.sparkSession, thresholds)
    count = lambda df, name, *by: df.groupBy("category_id", *by).agg(F.count(F.lit(1)).alias(name))
    tp = count(greedy_match(dets, gts, ["image_id", "category_id"], thresholds=table), "tp", "t")
    per = classes.select("category_id").distinct().crossJoin(F.broadcast(table)).join(tp, ["category_id", "t"], "left")
    per = per.join(count(dets, "n_det"), "category_id", "left").join(count(gts, "n_gt"), "category_id", "left")
    share = lambda n: F.coalesce(F.try_divide("tp", n), F.lit(0.0))
    at = lambda t, v: F.max(F.when(F.abs(F.col("t") - t) < 1e-9, v))
    fields = {}
    for name, value in (("p", share("n_det")), ("r", share("n_gt"))):
        fields |= {f"{name}50": at(0.5, value), f"{name}75": at(0.75, value), f"{name}50_95": F.avg(value)}
    by_class = per.groupBy("category_id").agg(*(v.alias(k) for k, v in fields.items()))
    whole = by_class.agg(F.lit(None).cast(by_class.schema["category_id"].dataType).alias("category_id"), *(F.coalesce(F.avg(k), F.lit(-1.0)).alias(k) for k in fields))
    any_det = F.broadcast(dets.agg((F.count(F.lit(1)) > 0).alias("_any")))  # one row
    rows = by_class.unionByName(whole).join(any_det)
    return rows.select("category_id", *(F.when(F.col("_any"), F.col(k)).otherwise(-1.0).alias(k) for k in fields))


def method_comparison(methods: dict[str, DataFrame], gts: DataFrame, relabel_at: float = 0.1, cap: int = 500) -> DataFrame:
    """method, n_dets, ap50 and recall over ten thresholds (ar), class-aware and class-agnostic, of the results of several methods.

    ``methods``: detections by name, with ids unique within each. The method is a
    column, so all of them share the matching and the ranking; boxes are joined once for both and a detection stays one row for all thresholds. Class-agnostic: a detection first takes the class of the
    truth box that it matches at ``relabel_at``. Methods without detections have no row.
    """
    keys, dets = ["image_id", "category_id"], None
    for name, df in methods.items():
        part = df.select(F.lit(name).alias("method"), F.col("det_id").cast("long"), *keys, "score", *(F.col(c).cast("double") for c in BOX))
        dets = part if dets is None else dets.unionByName(part)
    assert dets is not None, "no methods"
    dets = parked(dets, "methods")
    rows = parked(two_mode_bits(dets, gts, COCO_THRESHOLDS, "method", relabel_at, cap), "ranked-methods").withColumn("skip", F.lit(None).cast("binary"))
    runs = F.broadcast(rows.select("mode", "method").distinct())  # two rows a method
    truths = gts.groupBy("category_id").agg(F.count(F.lit(1)).alias("npos")).crossJoin(runs).withColumn("area", F.lit("all"))
    ap = ap_of_bits(rows, truths, ["mode", "method", "category_id"], COCO_THRESHOLDS, ["all"])
    ap = ap.groupBy("method").pivot("mode", ["aware", "agnostic"]).agg(F.avg(F.when(F.abs(F.col("t") - 0.5) < 1e-9, F.col("ap"))).alias("ap50"), F.avg("recall").alias("ar"))
    sizes = dets.groupBy("method").agg(F.count(F.lit(1)).alias("n_dets"))
    return sizes.join(ap, "method").select("method", "n_dets", F.col("aware_ap50").alias("ap50_aware"), F.col("aware_ar").alias("ar_aware"), F.col("agnostic_ap50").alias("ap50_agnostic"), F.col("agnostic_ar").alias("ar_agnostic"))


def precision_recall(dets: DataFrame, gts: DataFrame, threshold: float) -> DataFrame:
    """category_id (null: all), n_det, n_gt, tp, precision, recall; 0 where nothing divides."""
    tp = greedy_match(dets, gts, ["image_id", "category_id"], threshold).groupBy("category_id").agg(F.count(F.lit(1)).alias("tp"))
    per = dets.groupBy("category_id").agg(F.count(F.lit(1)).alias("n_det")).join(gts.groupBy("category_id").agg(F.count(F.lit(1)).alias("n_gt")), "category_id", "full").join(tp, "category_id", "left")
    total = per.rollup("category_id").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_det", "n_gt", "tp")))
    share = lambda n: F.coalesce(F.try_divide("tp", n), F.lit(0.0))
    return total.withColumns({"precision": share("n_det"), "recall": share("n_gt")})


def ap_per_image(dets: DataFrame, gts: DataFrame, threshold: float) -> DataFrame:
    """image_id, num_gt, ap50 (mean over the image's classes); images without truth boxes are absent."""
    one = threshold_table(dets.sparkSession, [threshold])
    rows = scored_matches(dets, gts, one).withColumn("tp", F.col("iou").isNotNull())
    truths = gts.groupBy("image_id", "category_id").agg(F.count(F.lit(1)).alias("npos")).crossJoin(F.broadcast(one))
    ap = average_precision(rows, truths, ["image_id", "category_id", "t"])
    return ap.groupBy("image_id").agg(F.avg("ap").alias("ap50")).join(gts.groupBy("image_id").agg(F.count(F.lit(1)).alias("num_gt")), "image_id")


def worst_images(per_image: DataFrame, k: int) -> DataFrame:
    return per_image.orderBy("ap50", F.desc("num_gt"), "image_id").limit(k)


def agreement(dets: DataFrame, threshold: float) -> DataFrame:
    """set_i, set_j, ap50: the detections of set j against those of set i as truth, over classes; one plan for all pairs.

    The boxes are joined once, whatever their sets; the sets only name the groups of the pairs.
    """
    keys = ["image_id", "category_id"]
    boxes = dets.select("prompt_set", *keys, "det_id", "score", *BOX)
    pairs = iou_join(boxes, boxes.drop("score"), keys, threshold)
    pairs = pairs.select(F.col("b_prompt_set").alias("set_i"), F.col("a_prompt_set").alias("set_j"), *(F.col(f"a_{k}").alias(k) for k in keys), F.col("a_det_id").alias("det_id"), F.col("b_det_id").alias("gt_id"), "iou", "a_score")
    found = greedy_choice(pairs, ["set_i", "set_j", *keys], "det_id", "gt_id", [F.coalesce(-F.col("a_score"), F.lit(float("inf")))], [-F.col("iou")], crowded(dets, keys))
    sets = F.broadcast(dets.select(F.col("prompt_set").alias("set_i")).distinct())  # the prompt sets of a run, named by its user
    guess = dets.select(F.col("prompt_set").alias("set_j"), "category_id", "det_id", "score").crossJoin(sets)
    rows = guess.join(found.select("set_i", "det_id", F.lit(True).alias("_hit")), ["set_i", "det_id"], "left").withColumn("tp", F.coalesce("_hit", F.lit(False)))
    by = ["set_i", "set_j", "category_id"]
    truths = dets.groupBy(F.col("prompt_set").alias("set_i"), "category_id").agg(F.count(F.lit(1)).alias("npos")).crossJoin(sets.withColumnRenamed("set_i", "set_j"))
    return average_precision(rows, truths, by).groupBy("set_i", "set_j").agg(F.avg("ap").alias("ap50"))


def confusion(dets: DataFrame, gts: DataFrame, threshold: float) -> DataFrame:
    """gt_class, det_class (null: none), n and share of the truth class; images without truth boxes don't count."""
    seen = dets.join(gts.select("image_id").distinct(), "image_id", "left_semi")
    found = two_phase_match(seen, gts, "image_id", threshold).select("det_id", "gt_id")
    g = gts.select("gt_id", F.col("category_id").alias("gt_class"))
    d = seen.select("det_id", F.col("category_id").alias("det_class"))
    rows = g.join(found, "gt_id", "left").join(d, "det_id", "full").select("gt_class", "det_class")
    counts = rows.groupBy("gt_class", "det_class").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.when(F.col("gt_class").isNotNull(), F.col("n") / F.sum("n").over(W.partitionBy("gt_class"))))


def outcomes(dets: DataFrame, gts: DataFrame, threshold: float) -> DataFrame:
    """category_id, kind (tp, fp, fn), id, score, iou of every detection and every missed truth box."""
    keys = ["image_id", "category_id"]
    found = greedy_match(dets, gts, keys, threshold).select("det_id", "gt_id", "iou")
    d = dets.join(found, "det_id", "left").select("category_id", F.when(F.col("iou").isNotNull(), "tp").otherwise("fp").alias("kind"), F.col("det_id").alias("id"), "score", "iou")
    missed = gts.join(found, "gt_id", "left_anti").select("category_id", F.lit("fn").alias("kind"), F.col("gt_id").alias("id"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("double").alias("iou"))
    return d.unionByName(missed)


def per_class_or_none(per_class: DataFrame, classes: DataFrame, value: str) -> DataFrame:
    """All classes with ``value``, -1 where it isn't defined."""
    return classes.join(per_class, "category_id", "left").select("category_id", F.coalesce(value, F.lit(-1.0)).alias(value))


def delta(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Two results of one key side by side: a, b and b - a."""
    left, right = a.select(key, F.col(value).alias("a")), b.select(key, F.col(value).alias("b"))
    return left.join(right, key, "full").withColumn("delta", F.col("b") - F.col("a"))


def nullable(value: Column) -> Column:
    """NULL for the -1 of an undefined metric."""
    return F.when(value >= 0, value)
