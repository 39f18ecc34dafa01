"""Cleaning of annotations and their cut into tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxquery.functions.geometry import clipped


def clean(annotations: DataFrame, wrong_types: list[int], missing_images: list[str], mapping: DataFrame) -> DataFrame:
    """Annotations of mapped types, without the listed types and images, of positive size; ``mapping``: type_id, category_id, name."""
    kept = annotations.where(~F.col("type_id").isin(wrong_types) & ~F.col("image_id").isin(missing_images))
    return kept.join(F.broadcast(mapping), "type_id").where("w > 0 and h > 0")


def solid(boxes: DataFrame) -> DataFrame:
    """Boxes, targets and exclusion zones alike, of a width and a height above 0, with their ``area``; a null side is none."""
    return boxes.where("w > 0 and h > 0").withColumn("area", F.col("w") * F.col("h"))


def validated(annotations: DataFrame, images: DataFrame) -> DataFrame:
    """Annotations clipped to their image's frame, with flags: no_image, bad_size, outside, changed, gone.

    The flags overlap; rows that are valid have neither no_image nor gone.
    """
    frame = images.select(F.col("id").alias("image_id"), "width", "height")
    rows = annotations.join(frame, "image_id", "left")
    cut = clipped()
    rows = rows.withColumns({f"c_{k}": v for k, v in cut.items()})
    bad = (F.col("w") <= 0) | (F.col("h") <= 0)
    out = (F.col("x") < 0) | (F.col("y") < 0) | (F.col("x") + F.col("w") > F.col("width")) | (F.col("y") + F.col("h") > F.col("height"))
    rows = rows.withColumns({"no_image": F.col("width").isNull(), "bad_size": bad, "outside": F.coalesce(out, F.lit(False))})
    gone = bad | F.coalesce((F.col("c_w") <= 0) | (F.col("c_h") <= 0), F.lit(False))
    return rows.withColumns({"gone": gone, "changed": F.col("outside") & ~gone})


def validity_report(rows: DataFrame) -> DataFrame:
    """Counts of the flags, of all annotations (category_id null, is_total) and of each class."""
    flags = ("no_image", "bad_size", "outside", "changed", "gone")
    total = rows.cube("category_id").agg(F.grouping("category_id").alias("_g"), F.count(F.lit(1)).alias("n"), *(F.count_if(f).alias(f) for f in flags))
    return total.select("category_id", (F.col("_g") == 1).alias("is_total"), "n", *flags)


def min_area(annotations: DataFrame, images: DataFrame, least: float, drop_empty: bool) -> tuple[DataFrame, DataFrame]:
    """Annotations of w * h >= least, and the images (drop_empty: only those that keep some)."""
    kept = annotations.where(F.col("w") * F.col("h") >= least)
    return kept, images.join(kept.select(F.col("image_id").alias("id")), "id", "left_semi") if drop_empty else images


def tiles(annotations: DataFrame, images: DataFrame, tile: int, visibility: float) -> DataFrame:
    """A row each annotation and tile that it overlaps: clipped box in the tile's frame, visible share, kept.

    The tiles of a box come from arithmetic on its edges, so no annotation meets a tile that
    it doesn't touch; touching an edge is no overlap. Partial tiles at the frame's edge count.
    """
    frame = images.select(F.col("id").alias("image_id"), "width", "height")
    rows = annotations.join(frame, "image_id").withColumns(clipped()).where("w > 0 and h > 0")
    span = lambda v, s: F.sequence(F.floor(F.col(v) / tile), F.ceil((F.col(v) + F.col(s)) / tile) - 1)
    rows = rows.withColumn("tile_col", F.explode(span("x", "w"))).withColumn("tile_row", F.explode(span("y", "h")))
    left, top = F.col("tile_col") * tile, F.col("tile_row") * tile
    right, bottom = F.least(left + tile, F.col("width")), F.least(top + tile, F.col("height"))
    x1, y1 = F.greatest(F.col("x"), left), F.greatest(F.col("y"), top)
    x2, y2 = F.least(F.col("x") + F.col("w"), right), F.least(F.col("y") + F.col("h"), bottom)
    rows = rows.withColumns({"tx": x1 - left, "ty": y1 - top, "tw": x2 - x1, "th": y2 - y1, "visible": (x2 - x1) * (y2 - y1) / (F.col("w") * F.col("h"))})
    return rows.withColumn("kept", F.col("visible") >= visibility).drop("x", "y", "w", "h", "width", "height")


def tile_report(cut: DataFrame) -> DataFrame:
    return cut.agg(F.count(F.lit(1)).alias("intersecting"), F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("dropped"))


def tile_name(stem: str, row: str, col: str) -> Column:
    """The file name of a tile; the same in every run, unlike ids."""
    return F.concat(F.lit("img_"), F.col(stem), F.lit("_"), F.col(row), F.lit("_"), F.col(col), F.lit(".tif"))
