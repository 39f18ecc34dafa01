"""Selection of pseudo-labels and of zones to leave out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boxquery.operators.selection import smallest


@dataclass(frozen=True)
class Policy:
    """Conjunction of floors; a missing score is 0, a missing n_cluster 1, missing sets none."""

    classes: tuple[int, ...] | None = None
    score: float | None = None
    n_cluster: int | None = None
    sets: int | None = None


def apply_policy(fused: DataFrame, policy: Policy) -> DataFrame:
    test = F.lit(True)
    if policy.classes is not None:
        test &= F.col("category_id").isin(*policy.classes)
    if policy.score is not None:
        test &= F.coalesce("score", F.lit(0.0)) >= policy.score
    if policy.n_cluster is not None:
        test &= F.coalesce("n_cluster", F.lit(1)) >= policy.n_cluster
    if policy.sets is not None:
        test &= F.coalesce(F.size("contributing_sets"), F.lit(0)) >= policy.sets
    return fused.where(test)


def full_image_filter(dets: DataFrame, images: DataFrame, most_ratio: float = 0.9, least_score: float = 0.1) -> DataFrame:
    """Detections that don't fill their image and have the score; an unknown image counts as 1 x 1."""
    frame = images.select(F.col("id").alias("image_id"), (F.col("width").cast("double") * F.col("height")).alias("_area"))
    rows = dets.join(frame, "image_id", "left")
    return rows.where((F.col("w") * F.col("h") <= most_ratio * F.coalesce("_area", F.lit(1.0))) & (F.col("score") >= least_score)).drop("_area")


def rescued(dets: DataFrame, tau: float, least: int, by: str = "category_id", id: str = "det_id") -> DataFrame:
    """Detections of score tau or more, but at least ``least`` of each class, with tau_eff, the floor that came of it.

    Selection is by threshold on the rank; ties at the cut go by id.
    """
    per = dets.groupBy(by).agg(F.count_if(F.col("score") >= tau).alias("_high"), F.min("score").alias("_low"))
    rows = dets.join(F.broadcast(per), by)
    high = rows.where(F.col("score") >= tau)
    # of the others so many as are wanted at most, first of each part of a class and then of the class
    best = lambda *keys: F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("score"), id))
    low = rows.where(~F.coalesce(F.col("score") >= tau, F.lit(False)) & (F.col("_high") < least)).withColumn("_part", F.pmod(F.xxhash64(id), F.lit(64)))
    low = low.withColumn("_rank", best(by, "_part")).where(F.col("_rank") <= least)
    low = low.withColumn("_rank", best(by) + F.col("_high")).where(F.col("_rank") <= least).drop("_part", "_rank")
    lowest = low.groupBy(by).agg(F.min("score").alias("_kept"))
    floor = F.when(F.col("_high") >= least, F.lit(float(tau))).otherwise(F.coalesce("_kept", "_low"))
    return high.unionByName(low).join(F.broadcast(lowest), by, "left").withColumn("tau_eff", floor).select(*dets.columns, "tau_eff")


def above(dets: DataFrame, floor: float, score: str = "score") -> DataFrame:
    """Detections of a score beyond the floor, which itself isn't enough; a null score never is."""
    return dets.where(F.col(score) > floor)


def rejected_zones(dets: DataFrame, kept: DataFrame, floor: float, id: str = "det_id") -> DataFrame:
    """Detections that weren't kept but have the floor."""
    return dets.where(F.col("score") >= floor).join(kept.select(id), id, "left_anti")


def box_anti_join(dets: DataFrame, taken: DataFrame, floor: float | None = None) -> DataFrame:
    """Detections whose image, class and exact box aren't taken; all rows of a taken key go."""
    out = dets.join(taken.select("image_id", "category_id", "x", "y", "w", "h").distinct(), ["image_id", "category_id", "x", "y", "w", "h"], "left_anti")
    return out if floor is None else out.where(F.col("score") >= floor)


def quota(dets: DataFrame, wanted: DataFrame, by: str = "category_id", id: str = "det_id", seed: int | None = None) -> DataFrame:
    """The best n of each class, or n drawn by a hash of the id; ``wanted``: by, n. By a cut that is found from counts; no class is sorted."""
    value = -F.col("score") if seed is None else F.pmod(F.col(id) * 2_654_435_761 + seed, F.lit(2_147_483_647))
    return smallest(dets, [by], value, id, wanted)
