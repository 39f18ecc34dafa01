"""Readers: COCO documents, GeoJSON features, detections, prompts, logs, metric files.

JSON documents become flat tables with fixed schemas; Parquet is the form between steps.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boxquery.functions.params import ratio_percent
from boxquery.sources.writers import COCO_PARTS

IMAGE = "struct<id:bigint,file_name:string,width:int,height:int>"
ANNOTATION = "struct<id:bigint,image_id:bigint,category_id:int,bbox:array<double>,area:double,iscrowd:int>"
CATEGORY = "struct<id:int,name:string>"
COCO = f"images array<{IMAGE}>, annotations array<{ANNOTATION}>, categories array<{CATEGORY}>"
DETECTION = "struct<image_id:bigint,category_id:int,bbox:array<double>,score:double,label:string,prompt_set:string,class_name:string>"


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document a file; an ill-formed one is an error."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def with_box(df: DataFrame, column: str = "bbox") -> DataFrame:
    """x, y, w, h instead of a four-element array."""
    return df.select(*[c for c in df.columns if c != column], *(F.get(column, F.lit(k)).alias(n) for k, n in enumerate("xywh")))


def coco(spark: SparkSession, path: str, parts: bool = False) -> dict[str, DataFrame]:
    """images, annotations (x, y, w, h) and categories of a COCO document.

    A file is one row of one task. parts: a folder of ``writers.coco_parts``, whose entries are parsed line by line by all tasks; an ill-formed one is an error too.
    """
    if parts:
        lines = spark.read.schema("value string, part string").text(path)
        entry = F.regexp_replace("value", "^,", "")
        forms = {"images": IMAGE, "annotations": ANNOTATION, "categories": CATEGORY}
        part = lambda name: lines.where(F.col("part") == COCO_PARTS[name]).select(F.from_json(entry, forms[name], {"mode": "FAILFAST"}).alias("e")).select("e.*")
    else:
        doc = json_document(spark, path, COCO)
        part = lambda name: doc.select(F.inline(name))
    return {"images": part("images"), "annotations": with_box(part("annotations")), "categories": part("categories")}


def geojson(spark: SparkSession, path: str, tolerant: bool = False, lines: bool = False) -> DataFrame:
    """image_id, type_id, x, y, w, h of features whose bounds are "x1,y1,x2,y2"; a document a file, or a line.

    tolerant: features without type or with other than four numbers are left out (bounds
    may be a list too); else they are an error.
    """
    schema = "features array<struct<properties:struct<image_id:string,type_id:int,bounds_imcoords:string>>>"
    documents = spark.read.schema(schema).option("mode", "FAILFAST").json(path) if lines else json_document(spark, path, schema)
    p = documents.select(F.explode("features.properties").alias("p")).select("p.*")
    parts = F.split(F.regexp_replace("bounds_imcoords", r"[\[\]\s]", ""), ",")
    if tolerant:
        p = p.where(F.coalesce("type_id", F.lit(0)) != 0).withColumn("b", F.transform(parts, lambda v: v.try_cast("double"))).where((F.size("b") == 4) & ~F.exists("b", lambda v: v.isNull()))
    else:
        p = p.withColumn("b", F.transform(parts, lambda v: v.cast("int").cast("double")))
    at = lambda k: F.get("b", F.lit(k))
    return p.select("image_id", "type_id", at(0).alias("x"), at(1).alias("y"), (at(2) - at(0)).alias("w"), (at(3) - at(1)).alias("h"))


def class_map(spark: SparkSession, path: str) -> DataFrame:
    """type_id, category_id, name of a map {type: {id, name}}; the first name of a category counts."""
    m = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,struct<id:int,name:string>>").alias("m"))
    rows = m.select(F.posexplode("m")).select("pos", F.col("key").cast("int").alias("type_id"), F.col("value.id").alias("category_id"), F.col("value.name").alias("name"))
    return rows.withColumn("name", F.min_by("name", "pos").over(W.partitionBy("category_id"))).drop("pos")


def detections(spark: SparkSession, path: str, label_key: str = "label", lines: bool = False) -> DataFrame:
    """Detections of a file (or of each line) that is a list, or an object with annotations or detections."""
    item = DETECTION.replace("label:string", f"`{label_key}`:string")
    text = spark.read.text(path, wholetext=not lines)
    as_list = F.from_json("value", f"array<{item}>")
    as_doc = F.from_json("value", f"struct<annotations:array<{item}>,detections:array<{item}>>")
    listed = F.substring(F.ltrim("value"), 1, 1) == "["
    rows = text.select(F.when(listed, as_list).otherwise(F.coalesce(as_doc["annotations"], as_doc["detections"])).alias("d"))
    return with_box(rows.select(F.inline("d"))).withColumnRenamed(label_key, "raw_label")


def compact_detections(spark: SparkSession, path: str, label_key: str = "label") -> DataFrame:
    """Detections of large files whose objects hold no objects: each is parsed alone, and those that can't be are left out."""
    item = DETECTION.replace("label:string", f"`{label_key}`:string")
    objects = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit(r"\{[^{}]*\}"), F.lit(0))).alias("o"))
    schema = item.removesuffix(">") + ",_bad:string>"
    rows = objects.select(F.from_json("o", schema, {"columnNameOfCorruptRecord": "_bad"}).alias("d")).select("d.*")
    return with_box(rows.where("_bad is null and bbox is not null").drop("_bad")).withColumnRenamed(label_key, "raw_label")


def require_paths(spark: SparkSession, *paths: str) -> None:
    """FileNotFoundError where one of them isn't there, in whatever store."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            raise FileNotFoundError(path)


def checkpoint_sets(spark: SparkSession, glob: str, pattern: str = r"_ckpt_(set[^/.]*)\.json", lines: bool = False) -> DataFrame:
    """The rows of many list files, or JSON-lines files, with the set's name from the file's."""
    return spark.read.option("multiLine", not lines).json(glob).withColumn("prompt_set", F.regexp_extract(F.col("_metadata.file_name"), pattern, 1))


def binary_listing(spark: SparkSession, path: str, glob: str = "*.tif") -> DataFrame:
    """file_name, image_id (the digits of the name) and bytes of the images of a folder, without their contents."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("file_name"), F.regexp_replace(name, r"\D", "").try_cast("bigint").alias("image_id"), F.col("length").alias("bytes"))


def prompts(text: str, kind: str) -> list[tuple[str, str, int]]:
    """(group, phrase, position) of a prompt file's text; kind: yaml, json or txt."""
    if kind == "txt":
        rows = []
        for line in map(str.strip, text.splitlines()):
            payload = ""
            if ":" in line and line.lower().startswith("prompt"):
                payload = line.split(":", 1)[1]
            elif line.startswith("-"):
                payload = line[1:]
            rows += [("default", p.strip()) for p in payload.split(".") if p.strip()]
    else:
        if kind == "yaml":
            import yaml

            doc = yaml.safe_load(text)
        else:
            doc = json.loads(text)
        if isinstance(doc, list):
            rows = [("default", str(p)) for p in doc]
        elif "prompt_sets" in doc:
            rows = [(f"{s}/{c}", str(p)) for s, of in doc["prompt_sets"].items() for c, ps in of.items() for p in ps]
        else:
            rows = [("default", str(p)) for p in doc.get("phrases", [])]
            rows += [(g["name"], str(p)) for g in doc.get("prompt_groups", []) for p in g.get("phrases", g.get("items", []))]
    return [(g, p, k) for k, (g, p) in enumerate(rows)]


def prompt_table(spark: SparkSession, text: str, kind: str) -> DataFrame:
    """prompt_set, class_name, phrase, pos; of a phrase named twice the last class counts elsewhere (max_by pos)."""
    rows = [(*(g.split("/", 1) if "/" in g else (g, None)), p, k) for g, p, k in prompts(text, kind)]
    return spark.createDataFrame(rows, "prompt_set string, class_name string, phrase string, pos int")


# The lines of a training log.
LOG_START = "[INFO] Argumentos:"
LOG_ITERATION = r"Epoch (\d+) \| iter (\d+)/(\d+) \| (train|val)_loss=([0-9.]+)"
LOG_EPOCH = r"Epoch (\d+)/\d+ \| train_loss=([0-9.]+) \| val_loss=([0-9.]+) \| (?:AP50|mAP50|mAP)=([0-9.]+) \| lr=([0-9.eE+-]+)"


def _log_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines with their run: a run begins at each start line. A log is one file, read in order."""
    lines = spark.read.text(path).coalesce(1).withColumn("at", F.monotonically_increasing_id())
    return lines.withColumn("run", F.sum(F.col("value").contains(LOG_START).cast("int")).over(W.orderBy("at")))


def training_epochs(spark: SparkSession, path: str) -> DataFrame:
    """run, epoch, train_loss, val_loss, map, lr; where a run goes on from an earlier epoch, what was after it is gone."""
    names = ("epoch", "train_loss", "val_loss", "map", "lr")
    lines = _log_lines(spark, path).where(F.col("value").rlike(LOG_EPOCH))
    got = lines.select("run", *(F.regexp_extract("value", LOG_EPOCH, k + 1).try_cast("int" if k == 0 else "double").alias(n) for k, n in enumerate(names)))
    starts = got.groupBy("run").agg(F.min("epoch").alias("start"))
    later = starts.withColumn("cut", F.min("start").over(W.orderBy("run").rowsBetween(1, W.unboundedFollowing))).select("run", "cut")
    return got.join(later, "run").where(F.col("cut").isNull() | (F.col("epoch") < F.col("cut"))).drop("cut")


def training_iterations(spark: SparkSession, path: str) -> DataFrame:
    """run, kind (train, val), epoch, iteration, of, loss."""
    lines = _log_lines(spark, path).where(F.col("value").rlike(LOG_ITERATION))
    part = lambda k, t: F.regexp_extract("value", LOG_ITERATION, k).cast(t)
    return lines.select("run", part(4, "string").alias("kind"), part(1, "int").alias("epoch"), part(2, "int").alias("iteration"), part(3, "int").alias("of"), part(5, "double").alias("loss"))


def metric_files(spark: SparkSession, paths: dict[str, str], metrics: list[str]) -> DataFrame:
    """name and metrics of the files that can be read; null where a file is missing or ill-formed."""
    names = spark.createDataFrame([(n,) for n in paths], "name string")
    reader = spark.read.option("ignoreMissingFiles", True)
    out = None
    for name, path in paths.items():
        try:
            text = reader.text(path, wholetext=True)
        except Exception as e:  # noqa: BLE001  a missing path is a missing result
            if "PATH_NOT_FOUND" not in str(e):
                raise
            continue
        parsed = text.select(F.lit(name).alias("name"), F.from_json("value", ", ".join(f"`{m}` double" for m in metrics)).alias("m")).select("name", "m.*")
        out = parsed if out is None else out.unionByName(parsed)
    if out is None:
        return names.select("name", *(F.lit(None).cast("double").alias(m) for m in metrics))
    return names.join(out, "name", "left")


def ratio_runs(spark: SparkSession, root: str, names: list[str] | None = None, inner: str = "inference") -> DataFrame:
    """name, percent, scope (global, or per_class), metric and value of the runs under ``root``, in whatever store.

    A run is a folder, of ``names`` if given, whose ``inner`` folder has both metrics.json and
    metrics_per_class.json; others are left out, and without any there's an error. The percentage is in the folder's name. Entries that are no
    numbers don't count.
    """
    files = {"global": "metrics.json", "per_class": "metrics_per_class.json"}
    listing = "|".join(files.values())
    jvm = spark._jvm.org.apache.hadoop.fs.Path
    fs = jvm(root).getFileSystem(spark._jsc.hadoopConfiguration())
    seen: dict[str, set[str]] = {}
    for status in fs.globStatus(jvm(f"{root}/*/{inner}/{{{listing.replace('|', ',')}}}")) or ():
        path = status.getPath()
        seen.setdefault(path.getParent().getParent().getName() if "/" not in inner else path.toString().split("/")[-3 - inner.count("/")], set()).add(path.getName())
    chosen = sorted(n for n, have in seen.items() if have == set(files.values()) and (names is None or n in names) and ratio_percent(n) is not None)
    if not chosen:
        raise ValueError(f"no run under {root} has {inner}/metrics.json and {inner}/metrics_per_class.json")
    runs = F.broadcast(spark.createDataFrame([(n, ratio_percent(n)) for n in chosen], "name string, percent double"))  # the folders just listed
    text = spark.read.text([f"{root}/{n}/{inner}/{f}" for n in chosen for f in files.values()], wholetext=True)
    place = F.regexp_extract(F.col("_metadata.file_path"), rf"([^/]+)/{inner}/({listing})$", 1)
    scope = F.when(F.col("_metadata.file_name") == files["global"], "global").otherwise("per_class")
    rows = text.select(place.alias("name"), scope.alias("scope"), F.explode(F.from_json("value", "map<string,string>")).alias("metric", "_text"))
    return rows.withColumn("value", F.col("_text").try_cast("double")).where("value is not null").join(runs, "name").select("name", "percent", "scope", "metric", "value")
