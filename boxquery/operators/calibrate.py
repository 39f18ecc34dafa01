"""Calibration and threshold sweeps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boxquery.operators.evaluate import best_points, curve_area, precision_curve
from boxquery.operators.matching import candidates, greedy_match
from boxquery.operators.overlaps import iou_join

#: Metrics of the sweep where more is better; of the others less is.
HIGHER = {"precision", "recall", "f1", "ap50"}
#: What the metrics of the sweep are where no detection is left.
NULL_METRICS = {"ap50": 0.0, "lrp": 1.0, "oce": 1.0, "d_ece": 1.0, "la_ece0": 1.0}


def lrp(outcomes: DataFrame, threshold: float, by: Sequence[str] = ()) -> DataFrame:
    """Localisation recall precision: sum of (1 - iou) / (1 - t) over hits, plus misses and false alarms, over all; 0 if none."""
    loss = F.sum(F.when(F.col("kind") == "tp", (1 - F.col("iou")) / (1 - threshold)).otherwise(1.0))
    return outcomes.groupBy(*by).agg(F.coalesce(F.try_divide(loss, F.count(F.lit(1))), F.lit(0.0)).alias("lrp"), F.count_if(F.col("kind") == "tp").alias("tp"), F.count_if(F.col("kind") == "fp").alias("fp"), F.count_if(F.col("kind") == "fn").alias("fn"))


def oce(dets: DataFrame, gts: DataFrame, threshold: float) -> DataFrame:
    """Object calibration error: of each truth box the mean score c of all detections of its class on it; mean of (c - 1)^2, 1 without any."""
    keys = ["image_id", "category_id"]
    pairs = iou_join(gts.select(*keys, "gt_id", "x", "y", "w", "h"), dets.select(*keys, "det_id", "score", "x", "y", "w", "h"), keys, threshold)
    mean = pairs.groupBy(F.col("a_gt_id").alias("gt_id")).agg(F.avg("b_score").alias("c"))
    rows = gts.select("gt_id").join(mean, "gt_id", "left")
    return rows.agg(F.avg(F.coalesce((F.col("c") - 1) * (F.col("c") - 1), F.lit(1.0))).alias("oce"), F.count(F.lit(1)).alias("n_gt"))


def binned_error(rows: DataFrame, score: str, target: str, bins: int = 15) -> DataFrame:
    """Expected calibration error over equal bins of [0, 1], the last closed; scores outside dilute only."""
    inside = F.when((F.col(score) >= 0) & (F.col(score) <= 1), F.least(F.floor(F.col(score) * bins).cast("int"), F.lit(bins - 1)))
    per = rows.select(inside.alias("bin"), F.col(score).alias("s"), F.col(target).cast("double").alias("t")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("s").alias("conf"), F.avg("t").alias("acc"))
    total = F.sum("n")
    return per.agg(F.coalesce(F.try_divide(F.sum(F.when(F.col("bin").isNotNull(), F.col("n") * F.abs(F.col("conf") - F.col("acc")))), total), F.lit(0.0)).alias("ece"), F.coalesce(total, F.lit(0)).alias("n"))


def passes(value: Column, thresholds: Sequence[float], up: bool = True) -> Column:
    """How many of the thresholds the value passes: is at least (up) or at most; null where it is null.

    What passes p thresholds passes the p easiest, so a sum over all that pass one of them is a sum over a range of p.
    """
    table = F.array(*(F.lit(float(t)) for t in thresholds))
    return F.when(value.isNotNull(), F.size(F.filter(table, (lambda t: t <= value) if up else (lambda t: t >= value))))


def from_the_top(place: str, *by: str):
    """The window of a row and all of higher place."""
    return W.partitionBy(*by).orderBy(F.desc(place)).rowsBetween(W.unboundedPreceding, 0)


def _grid(spark, thresholds: Sequence[float]) -> DataFrame:
    """p and t of sorted thresholds: what passes p thresholds or more passes t."""
    return spark.createDataFrame([(p, float(t)) for p, t in enumerate(thresholds, 1)], "p int, t double")


def swept(outcomes: DataFrame, thresholds: DataFrame, n_gt: DataFrame) -> DataFrame:
    """t, category_id and precision, recall, f1 of the detections of score t or more; all thresholds in one plan.

    Detections are counted once, by how many thresholds they pass, and the counts summed from the top.
    """
    values = sorted({r.t for r in thresholds.select("t").collect()})
    grid = F.broadcast(_grid(outcomes.sparkSession, values))
    per = outcomes.where("kind <> 'fn'").groupBy("category_id", passes(F.col("score"), values).alias("p")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "tp").alias("tp"))
    whole = n_gt.crossJoin(grid).join(per, ["category_id", "p"], "left").fillna(0, ["n", "tp"])
    over = from_the_top("p", "category_id")
    rows = whole.withColumns({"n": F.sum("n").over(over), "tp": F.sum("tp").over(over)}).drop("p")
    precision, recall = F.try_divide("tp", "n"), F.try_divide("tp", "n_gt")
    return rows.withColumns({"precision": precision, "recall": recall, "f1": F.try_divide(2 * F.col("tp"), F.col("n") + F.col("n_gt"))})


def metric_sweep(dets: DataFrame, gts: DataFrame, thresholds: Sequence[float], iou: float = 0.5, bins: int = 15) -> DataFrame:
    """t, n (detections of score t or more) and ap50, lrp, oce, d_ece, la_ece0 of them, for every threshold from one pass.

    A floor on the score leaves the first ones of every ranking, whose matches and ranks
    don't depend on the rest. So detections are matched and ranked once, hits, false alarms,
    localisation losses and calibration bins are summed by how many thresholds a score passes,
    and the sums are added from the top. Curves keep, for each class and place, the best point of each recall.
    Of a truth box, the mean score of all detections on it changes only at places where it has one: the
    changes of its error are summed. Where no detection is left the metrics are ``NULL_METRICS``, and so are the
    calibration errors where all that are left have scores out of [0, 1].
    A null score passes nothing. ``ap50`` is the mean over the classes with truth boxes, at ``iou``.
    """
    spark = dets.sparkSession
    values = sorted({float(t) for t in thresholds})
    keys = ["image_id", "category_id"]
    grid = _grid(spark, values)
    placed = dets.withColumn("p", passes(F.col("score"), values)).where("p > 0")
    found = greedy_match(placed, gts, keys, iou).select("det_id", "iou")
    rows = placed.select("category_id", "det_id", "score", "p").join(found, "det_id", "left").withColumn("tp", F.col("iou").isNotNull())
    # hits, losses and calibration bins
    bin_ = F.when((F.col("score") >= 0) & (F.col("score") <= 1), F.least(F.floor(F.col("score") * bins).cast("int"), F.lit(bins - 1)))
    sums = {"n": F.count(F.lit(1)), "tp": F.count_if("tp"), "loss": F.coalesce(F.sum((1 - F.col("iou")) / max(1 - iou, 1e-9)), F.lit(0.0)), "conf": F.sum("score"), "hit_iou": F.coalesce(F.sum("iou"), F.lit(0.0))}
    per = rows.groupBy("p", F.coalesce(bin_, F.lit(-1)).alias("bin")).agg(*(v.alias(k) for k, v in sums.items()))
    every = spark.range(-1, bins).select(F.col("id").cast("int").alias("bin"))
    per = grid.crossJoin(F.broadcast(every)).join(per, ["p", "bin"], "left").fillna(0, list(sums))
    per = per.withColumns({k: F.sum(k).over(from_the_top("p", "bin")) for k in sums})
    gap = lambda target: F.sum(F.when(F.col("bin") >= 0, F.abs(F.col("conf") - F.col(target)))) / F.sum("n")
    binned = F.sum(F.when(F.col("bin") >= 0, F.col("n")))
    total = per.groupBy("p", "t").agg(*(F.sum(k).alias(f"_{k}") for k in ("n", "tp", "loss")), F.when(binned > 0, gap("tp")).alias("d_ece"), F.when(binned > 0, gap("hit_iou")).alias("la_ece0"))
    # errors of the truth boxes
    on = candidates(placed, gts, keys, iou).select("gt_id", "det_id").join(placed.select("det_id", "score", "p"), "det_id")
    on = on.groupBy("gt_id", "p").agg(F.sum("score").alias("_sum"), F.count(F.lit(1)).alias("_c"))
    over = from_the_top("p", "gt_id")
    error = F.sum("_sum").over(over) / F.sum("_c").over(over) - 1
    on = on.withColumn("_e", error * error)
    on = on.withColumn("_change", F.col("_e") - F.coalesce(F.lag("_e").over(W.partitionBy("gt_id").orderBy(F.desc("p"))), F.lit(1.0)))
    changes = on.groupBy("p").agg(F.sum("_change").alias("_change"))
    # curves
    truths = gts.groupBy("category_id").agg(F.count(F.lit(1)).alias("npos"))
    points = best_points(precision_curve(rows, truths, ["category_id"]), ["category_id", "p"])
    prefix = points.withColumnRenamed("p", "_p").join(F.broadcast(grid.select("p")), F.col("_p") >= F.col("p"))  # 101 points a class and place
    area = curve_area(best_points(prefix, ["category_id", "p"]), truths.crossJoin(F.broadcast(grid.select("p"))), ["category_id", "p"])
    ap = area.groupBy("p").agg(F.avg("ap").alias("_ap"))
    n_gt = F.broadcast(gts.agg(F.count(F.lit(1)).alias("n_gt")))  # one row
    out = total.join(changes, "p", "left").join(ap, "p", "left").fillna(0.0, ["_change", "_ap"]).join(n_gt)
    out = out.withColumn("_change", F.sum("_change").over(from_the_top("p")))  # a row a threshold
    fp, fn = F.col("_n") - F.col("_tp"), F.col("n_gt") - F.col("_tp")
    metrics = {
        "ap50": F.col("_ap"),
        "lrp": F.coalesce(F.try_divide(F.col("_loss") + fp + fn, F.col("_tp") + fp + fn), F.lit(0.0)),
        "oce": F.when(F.col("n_gt") > 0, 1 + F.col("_change") / F.col("n_gt")).otherwise(0.0),
        **{k: F.coalesce(k, F.lit(NULL_METRICS[k])) for k in ("d_ece", "la_ece0")},
    }
    return out.select("t", F.col("_n").alias("n"), *(F.when(F.col("_n") > 0, v).otherwise(NULL_METRICS[k]).alias(k) for k, v in metrics.items()))


def macro(table: DataFrame, by: str, values: Sequence[str]) -> DataFrame:
    """Means over the classes that have any detection."""
    return table.where("n > 0").groupBy(by).agg(*(F.avg(v).alias(v) for v in values), F.count(F.lit(1)).alias("classes"))


def best_per_metric(table: DataFrame, at: str, metrics: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """by, metric, best threshold and value by the metric's direction; of equal ones the lowest threshold. Null never wins."""
    long = table.select(*by, at, F.explode(F.create_map(*(x for m in metrics for x in (F.lit(m), F.col(m).cast("double"))))).alias("metric", "value")).where("value is not null")
    up = F.col("metric").isin(*HIGHER)
    rank = F.row_number().over(W.partitionBy(*by, "metric").orderBy(F.when(up, -F.col("value")).otherwise(F.col("value")), at))
    return long.withColumn("_r", rank).where("_r = 1").select(*by, "metric", F.col(at).alias("best_t"), "value")


def confidence_sweep(dets: DataFrame, outcomes: DataFrame, metrics: dict[str, bool], thresholds: DataFrame) -> DataFrame:
    """metric, t, category_id, n, tp, precision of the detections whose metric passes t.

    ``metrics``: column of ``dets`` and whether more is better (value >= t) or less (value <= t).
    A value is counted once, by how many thresholds it passes: the lowest ones if more is better, else the highest.
    """
    values = sorted({r.t for r in thresholds.select("t").collect()})
    pairs = [F.struct(F.lit(m).alias("metric"), passes(F.col(m).cast("double"), values, up).alias("p")) for m, up in metrics.items()]
    long = dets.select("det_id", "category_id", F.explode(F.array(*pairs)).alias("_m")).select("det_id", "category_id", "_m.metric", "_m.p").where("p > 0")
    hit = outcomes.where("kind = 'tp'").select(F.col("id").alias("det_id"), F.lit(1).alias("hit"))
    per = long.join(hit, "det_id", "left").groupBy("metric", "category_id", "p").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("tp"))
    grid = [(m, p, t) for m, up in metrics.items() for p, t in enumerate(values if up else values[::-1], 1)]
    whole = per.select("metric", "category_id").distinct().join(F.broadcast(dets.sparkSession.createDataFrame(grid, "metric string, p int, t double")), "metric")
    over = from_the_top("p", "metric", "category_id")
    rows = whole.join(per, ["metric", "category_id", "p"], "left").fillna(0, ["n", "tp"]).withColumns({"n": F.sum("n").over(over), "tp": F.sum("tp").over(over)}).where("n > 0")
    return rows.select("metric", "t", "category_id", "n", "tp", (F.col("tp") / F.col("n")).alias("precision"))
