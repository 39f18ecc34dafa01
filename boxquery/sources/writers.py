"""Sinks: COCO documents, tables for people, checkpointed sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxquery.functions.geometry import fixed


def annotation_struct() -> Column:
    """The COCO form of x, y, w, h rows."""
    return F.struct("id", "image_id", "category_id", F.array("x", "y", "w", "h").alias("bbox"), (F.col("w") * F.col("h")).alias("area"), F.lit(0).alias("iscrowd"))


#: The parts of a COCO document, in order: marks, and between them the entries. Names of folders, so that those in order of name are the document.
COCO_PARTS = {"images": "1-images", "annotations": "3-annotations", "categories": "5-categories"}


def _coco_rows(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """The lines of one COCO document with their part and place in it: part, _id, value."""
    spark = annotations.sparkSession
    forms = [("images", images, F.struct("id", "file_name", "width", "height")), ("annotations", annotations, annotation_struct()), ("categories", categories, F.struct("id", "name"))]
    rows = spark.createDataFrame([(str(2 * k), 0, ("{" if k == 0 else "],") + f'"{name}":[') for k, (name, _, _) in enumerate(forms)] + [(str(2 * len(forms)), 0, "]}")], "part string, _id long, value string")
    for name, df, form in forms:
        first = F.broadcast(df.agg(F.min("id").alias("_first")))  # one row
        text = F.concat(F.when(F.col("id") == F.col("_first"), "").otherwise(","), F.to_json(form))
        rows = rows.unionByName(df.join(first).select(F.lit(COCO_PARTS[name]).alias("part"), F.col("id").cast("long").alias("_id"), text.alias("value")))
    return rows


def coco_lines(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """The lines of one COCO document, in order, column ``value``: a line each image, annotation and category.

    For hand-over to tools that want one file; large sets stay in Parquet. No row holds more than
    one entry, so a document of any length is sorted by all tasks, and streamed where one task writes it. Ids are unique in the format.
    """
    return _coco_rows(images, annotations, categories).orderBy("part", "_id").select("value")


def coco_parts(images: DataFrame, annotations: DataFrame, categories: DataFrame, path: str) -> None:
    """The same document as a folder that all tasks write: its text files, laid end to end in order of their paths, are the document.

    The entries of a kind have a folder of their own, so ``readers.coco`` reads a document by its lines, with as many tasks as its length asks for.
    """
    _coco_rows(images, annotations, categories).orderBy("part", "_id").select("part", "value").write.mode("overwrite").partitionBy("part").text(path)


def formatted(df: DataFrame, numbers: Sequence[str], places: int = 4, missing: str = "N/A") -> DataFrame:
    """Numbers as texts of fixed places."""
    return df.withColumns({c: F.when(F.col(c).isNull(), F.lit(missing)).otherwise(fixed(F.col(c).cast("double"), places)) for c in numbers})


def csv(df: DataFrame, path: str, one_file: bool = True) -> None:
    """With a header; a report is one file, a large table as many as it has partitions."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).csv(path)


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A report's table; one of more than ``most`` rows is refused, since none would be read as a page."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    line = lambda cells: "| " + " | ".join("" if c is None else str(c) for c in cells) + " |"
    return "\n".join([line(df.columns), line("---" for _ in df.columns), *(line(r) for r in rows)])


def markdown_lines(df: DataFrame) -> DataFrame:
    """The rows of a table of any size as lines, without the head."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))


def one_file(lines: DataFrame, path: str) -> None:
    """A text column as one file of this very name, for tools that want one; written by a task and renamed."""
    spark = lines.sparkSession
    lines.coalesce(1).write.mode("overwrite").text(f"{path}.parts")
    jvm, made = spark._jvm.org.apache.hadoop.fs.Path, spark._jvm.org.apache.hadoop.fs.Path(f"{path}.parts")
    fs = made.getFileSystem(spark._jsc.hadoopConfiguration())
    part = fs.globStatus(jvm(f"{path}.parts/part-*"))[0].getPath()
    fs.mkdirs(jvm(path).getParent())
    fs.delete(jvm(path), False)
    if not fs.rename(part, jvm(path)):
        raise OSError(f"can't write {path}")
    fs.delete(made, True)


def vectors(df: DataFrame, path: str, column: str) -> None:
    """Vectors of probabilities in single precision, as Parquet lists."""
    df.withColumn(column, F.col(column).cast("array<float>")).write.mode("overwrite").parquet(path)


def write_sets(df: DataFrame, path: str, by: str = "prompt_set") -> None:
    """Write the sets of ``df`` and leave the others as they are: a run can go on where it stopped."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def missing_sets(df: DataFrame, done: DataFrame, by: str = "prompt_set") -> DataFrame:
    """The rows of sets that aren't written yet."""
    return df.join(done.select(by).distinct(), by, "left_anti")
