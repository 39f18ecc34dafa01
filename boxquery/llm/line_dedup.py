"""Line dedup, in DataFrame operations only.

Lines are exploded, normalised and hashed, once, and the hashes written; those held
by two documents or more lose their lines everywhere but in the smallest document;
what is left is put together again by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxquery.llm._common import table, written

MIN_KEY_CHARS = 10
#: White space that is stripped from both ends of a line.
_SPACE = " \t\n\x0b\x0c\r"
#: A null id stands for one document after all others.
_NO_ID = (1 << 63) - 1
#: Keys with more than this share of all lines are sent to every task; there are fewer of them than its inverse.
HOT_SHARE = 0.001


def line_keys(line: Column) -> tuple[Column, Column]:
    """128 bits of hash, equal for lines that are equal once stripped and with A-Z in lower case.

    ``lower`` folds other letters too, and is many times as fast as a translation; lines
    that it makes equal are told apart by their other characters, which count as they are, in order.
    One of them becomes an ASCII letter, the Kelvin sign; lines that have it are translated.
    """
    kelvin = F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    others = F.when(F.octet_length(line) == F.char_length(line), F.lit("")).otherwise(F.regexp_replace(line, r"[\x00-\x7F]+", ""))
    folded = F.when(F.octet_length(line) == F.char_length(line), F.lower(line)).when(F.contains(line, F.lit("\u212a")), kelvin).otherwise(F.lower(line))
    return F.xxhash64(folded), F.xxhash64(others, folded)


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _whole(docs: DataFrame) -> DataFrame:
    """_id, _hash and _text of the rows, and in _row their other columns, whose names then clash with none."""
    text = F.coalesce(F.col("text"), F.lit(""))
    others = F.struct(F.lit(None).cast("string").alias("text"), *(F.col(c) for c in docs.columns if c != "text"))
    return docs.select(others.alias("_row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("_id"), text.alias("_text"), F.xxhash64(text).alias("_hash"))


def keyed_lines(docs: DataFrame, min_chars: int = MIN_KEY_CHARS) -> DataFrame:
    """_id, _hash (of the text), _pos and the key (_k1, _k2) of all lines of ``min_chars`` or more; written."""
    lines = _whole(docs).select("_id", "_hash", F.posexplode(F.split("_text", "\n", -1)).alias("_pos", "_line"))
    lines = lines.withColumn("_line", F.btrim("_line", F.lit(_SPACE))).where(F.char_length("_line") >= min_chars)
    first, second = line_keys(F.col("_line"))
    return written(lines.select("_id", "_hash", "_pos", first.alias("_k1"), second.alias("_k2")), "line-keys")


def repeated_lines(docs: DataFrame, min_chars: int = MIN_KEY_CHARS, min_docs: int = 2) -> DataFrame:
    """_id, _hash (of the text) and the positions ``_drop`` of the lines that go; rows without any are absent.

    Keys that hold a large share of all lines, which are few, meet their lines by broadcast, all others by a shuffle.
    """
    keyed, key = keyed_lines(docs, min_chars), ["_k1", "_k2"]
    if min_docs == 2:
        shared = keyed.groupBy(*key).agg(F.min("_id").alias("_first"), F.max("_id").alias("_last"), F.count(F.lit(1)).alias("_c")).where("_first < _last").drop("_last")
    else:
        each = keyed.groupBy(*key, "_id").agg(F.count(F.lit(1)).alias("_c"))
        shared = each.groupBy(*key).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_docs"), F.sum("_c").alias("_c")).where(F.col("_docs") >= min_docs).drop("_docs")
    shared = written(shared, "shared-lines")
    most = keyed.count() * HOT_SHARE
    hot = F.broadcast(shared.where(F.col("_c") > most).drop("_c"))
    rest = keyed.join(hot, key, "left_anti").join(shared.where(F.col("_c") <= most).drop("_c"), key)
    return keyed.join(hot, key).unionByName(rest).where("_id > _first").groupBy("_id", "_hash").agg(F.collect_set("_pos").alias("_drop"))


def line_dedup(docs: DataFrame, min_chars: int = MIN_KEY_CHARS, min_docs: int = 2) -> DataFrame:
    """The documents, all columns, with ``text`` replaced, and n_lines and n_dropped.

    A null or empty text is one empty line and comes back as the empty text. Rows of
    one doc_id are one document: a line that only they share isn't repeated. Rows with
    a null id are one document that comes after all others. Columns named like
    the result's are replaced by them, all others come back as they are. Texts of any length are whole.
    """
    rows = _whole(docs).join(repeated_lines(docs, min_chars, min_docs), ["_id", "_hash"], "left")
    drop = F.coalesce(F.col("_drop"), F.array().cast("array<int>"))
    lines = F.split("_text", "\n", -1)
    kept = F.when(F.size(drop) == 0, F.col("_text")).otherwise(
        _let(lines, lambda all_lines: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), drop), lambda p: F.get(all_lines, p)), "\n"))
    )
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return rows.select(*(kept.alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in names), F.size(lines).cast("long").alias("n_lines"), F.size(drop).cast("long").alias("n_dropped"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


_KEY_SQL = r"translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE_SQL = rf"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM docs),
keyed AS (SELECT doc_id, pos, line, {_KEY_SQL} AS k FROM lines),
shared AS (SELECT k, min(doc_id) AS first_id FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING min(doc_id) < max(doc_id)),
marked AS (SELECT d.doc_id, d.pos, d.line, (s.k IS NOT NULL AND d.doc_id > s.first_id) AS dropped FROM keyed d LEFT JOIN shared s ON d.k = s.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
