"""Box arithmetic as SQL text and Column expressions.

A box is (x, y, w, h), absolute, w and h not negative. The text builders take
prefixes (``a.``) so that they serve in joins and in lambdas over structs alike.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Upper bounds of the areas of small and medium boxes, as the COCO protocol has them.
SMALL_AREA, MEDIUM_AREA = 1024.0, 9216.0


def overlap_sql(a: str, b: str) -> str:
    """Area of the intersection of boxes ``a`` and ``b``."""
    return (
        f"(greatest(0D, least({a}x + {a}w, {b}x + {b}w) - greatest({a}x, {b}x))"
        f" * greatest(0D, least({a}y + {a}h, {b}y + {b}h) - greatest({a}y, {b}y)))"
    )


def iou_sql(a: str, b: str) -> str:
    """Intersection over union; 0 where the union is empty."""
    inter = overlap_sql(a, b)
    union = f"({a}w * {a}h + {b}w * {b}h - {inter})"
    return f"if({union} > 0D, {inter} / {union}, 0D)"


def centroid_in_sql(a: str, b: str) -> str:
    """Whether the centre of ``a`` lies in the closed box ``b``."""
    return f"({a}x + {a}w / 2D between {b}x and {b}x + {b}w and {a}y + {a}h / 2D between {b}y and {b}y + {b}h)"


def iou(a: str, b: str) -> Column:
    return F.expr(iou_sql(a, b))


def to_xyxy() -> list[Column]:
    return [F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2")]


def to_xywh() -> list[Column]:
    """From x1, y1, x2, y2; sides are 0 at least."""
    zero = F.lit(0.0)
    return [F.col("x1").alias("x"), F.col("y1").alias("y"), F.greatest(zero, F.col("x2") - F.col("x1")).alias("w"), F.greatest(zero, F.col("y2") - F.col("y1")).alias("h")]


def clipped(width: str = "width", height: str = "height") -> dict[str, Column]:
    """x, y, w, h with all four edges clamped to [0, width] and [0, height]."""
    inside = lambda v, top: F.least(F.greatest(v, F.lit(0.0)), F.col(top).cast("double"))
    x1, y1 = inside(F.col("x"), width), inside(F.col("y"), height)
    x2, y2 = inside(F.col("x") + F.col("w"), width), inside(F.col("y") + F.col("h"), height)
    return {"x": x1, "y": y1, "w": F.greatest(x2 - x1, F.lit(0.0)), "h": F.greatest(y2 - y1, F.lit(0.0))}


def area(given: str | None = None) -> Column:
    """w * h, or the column ``given`` where it isn't null."""
    own = F.col("w") * F.col("h")
    return own if given is None else F.coalesce(F.col(given).cast("double"), own)


def size_bucket(size: Column) -> Column:
    """small below 1024, medium below 9216, else large."""
    return F.when(size < SMALL_AREA, "small").when(size < MEDIUM_AREA, "medium").otherwise("large")


def area_ratio(width: str = "width", height: str = "height") -> Column:
    """Share of the image; an unknown frame counts as 1 x 1."""
    frame = F.coalesce(F.col(width).cast("double"), F.lit(1.0)) * F.coalesce(F.col(height).cast("double"), F.lit(1.0))
    return F.try_divide(F.col("w") * F.col("h"), frame)


def from_centre(width: str = "width", height: str = "height") -> dict[str, Column]:
    """Pixel x, y, w, h of a normalised box cx, cy, bw, bh, rounded to two places."""
    w, h = F.col("bw") * F.col(width), F.col("bh") * F.col(height)
    return {"x": F.round(F.col("cx") * F.col(width) - w / 2, 2), "y": F.round(F.col("cy") * F.col(height) - h / 2, 2), "w": F.round(w, 2), "h": F.round(h, 2)}


def from_bins(bins: int = 999, width: str = "width", height: str = "height") -> dict[str, Column]:
    """Pixel x1, y1, x2, y2 of corners given as bins 0..999 (b1..b4)."""
    at = lambda c, top: F.col(c) / F.lit(float(bins)) * F.col(top)
    return {"x1": at("b1", width), "y1": at("b2", height), "x2": at("b3", width), "y2": at("b4", height)}


def normalised(width: str = "width", height: str = "height") -> dict[str, Column]:
    """x1, y1, x2, y2 as shares of the frame, clamped to [0, 1]."""
    share = lambda v, top: F.least(F.greatest(v / F.col(top), F.lit(0.0)), F.lit(1.0))
    return {"x1": share(F.col("x"), width), "y1": share(F.col("y"), height), "x2": share(F.col("x") + F.col("w"), width), "y2": share(F.col("y") + F.col("h"), height)}


def fixed(value: Column, places: int) -> Column:
    """A double as text with fixed places: the value nearest to what it is in binary, exact ties to even.

    ``format_string`` rounds the shortest decimal form, and ties up. Half units are
    counted, and near a tie the product with the scale is taken exactly, in two parts.
    """
    halves = F.lit(2.0 * 10.0**places)
    near = F.rint(value * halves)
    high = value.cast("float").cast("double")
    off = (high * halves - near) + (value - high) * halves
    down = F.floor(near / 2).cast("double")
    up = (off > 0) | ((off == 0) & (F.pmod(down, F.lit(2.0)) == 1))
    units = F.when(F.pmod(near, F.lit(2.0)) == 0, near / 2).otherwise(F.when(up, down + 1).otherwise(down))
    exact = (F.abs(units).cast("decimal(20,0)") * F.lit(Decimal(1).scaleb(-places))).cast(f"decimal(38,{places})").cast("string")
    text = F.concat(F.when((value < 0), F.lit("-")).otherwise(F.lit("")), exact)
    return F.when(F.abs(value) * halves < F.lit(2.0**52), text).otherwise(F.format_string(f"%.{places}f", value))


def bytes_text(size: Column) -> Column:
    """A number of bytes with its unit, two places; GB is the largest unit."""
    out = F.concat(fixed(size / F.lit(1024.0**3), 2), F.lit(" GB"))
    for power, unit in ((2, "MB"), (1, "KB"), (0, "B")):
        out = F.when(size < F.lit(1024.0 ** (power + 1)), F.concat(fixed(size / F.lit(1024.0**power), 2), F.lit(f" {unit}"))).otherwise(out)
    return out
