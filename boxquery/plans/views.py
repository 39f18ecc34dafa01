"""Box tables derived from the driver's ``events`` by integer arithmetic, the same in any SQL engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CLASS_SQL = "CASE event_type WHEN 'error' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 WHEN 'click' THEN 4 ELSE 5 END"

DET_SQL = f"""
SELECT event_id AS det_id, user_id AS image_id, {CLASS_SQL} AS category_id, event_id % 5 AS prompt_set,
  cast((event_id * 37) % 97 AS double) AS x, cast((event_id * 53) % 89 AS double) AS y,
  cast(20 + (event_id * 11) % 23 AS double) AS w, cast(20 + (event_id * 7) % 19 AS double) AS h,
  value / cast(500 AS double) AS score, cast(event_id % 3 AS int) AS src
FROM events
"""

GT_SQL = f"""
SELECT event_id AS gt_id, user_id AS image_id, {CLASS_SQL} AS category_id,
  cast((event_id * 37) % 97 + event_id % 5 AS double) AS x, cast((event_id * 53) % 89 + event_id % 4 AS double) AS y,
  cast(22 + (event_id * 11) % 23 AS double) AS w, cast(22 + (event_id * 7) % 19 AS double) AS h
FROM events
"""

IMAGE_SQL = "SELECT DISTINCT user_id AS id, 120 AS width, 110 AS height FROM events"


def _view(sql: str, name: str):
    def make(spark: SparkSession, sf_dir: str) -> DataFrame:
        events = spark.read.parquet(f"{sf_dir}/events.parquet")
        return spark.sql(sql.replace("FROM events", "FROM {events}"), events=events)

    make.__name__ = name
    return make


detections = _view(DET_SQL, "detections")
truths = _view(GT_SQL, "truths")
images = _view(IMAGE_SQL, "images")

#: Second inputs of some operators, drawn from the same boxes; each stands for a list that a user brings along.
ZONES = "gt_id % 6 = 0"  # exclusion zones of an image
REFERENCE = "gt_id % 10 = 0"  # the labels whose class counts set the quotas
SELECTED = "id % 3 = 0"  # the file of selected image ids
RENAMED = "id % 7 <> 0"  # the images that another run has under other ids
LABELED = "image_id % 10 = 0"  # the images of the labeled set
VALID = "id % 4 = 1"  # the image ids that an evaluation is restricted to
ANNOTATED = "image_id % 2 = 0"  # the images whose annotations are kept, where empty ones are mixed in

#: The same views for SQL text that checks a query.
WITH_VIEWS = f"det AS ({DET_SQL}), gt AS ({GT_SQL}), img AS ({IMAGE_SQL})"


def iou_sql(a: str, b: str) -> str:
    """Intersection over union in plain SQL (boxes here always have an area)."""
    inter = f"(greatest(0, least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x)) * greatest(0, least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y)))"
    return f"({inter} / ({a}.w * {a}.h + {b}.w * {b}.h - {inter}))"
