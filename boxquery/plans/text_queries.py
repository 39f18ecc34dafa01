"""Queries of labels, phrases and model output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxquery.functions import text
from boxquery.operators import dataset, ensemble
from boxquery.plans import views
from boxquery.plans.registry import query, rounded

_NORM = "trim(regexp_replace(regexp_replace(regexp_replace(replace({c}, '&', ' and '), '[/-]', ' ', 'g'), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
_MARKED_SQL = "strip_accents(lower({c}))"


def _norm_sql(c: str) -> str:
    return _NORM.format(c=_MARKED_SQL.format(c=c))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(f"SELECT item_id, {_norm_sql('text')} AS label, len(list_distinct(list_filter(string_split({_norm_sql('text')}, ' '), lambda t: t <> '')))::INT AS n_tokens FROM benchmark", views=False)
def p12_p13_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "benchmark").select("item_id", text.normalize_label(F.col("text")).alias("label"), F.size(text.tokens(F.col("text"))).alias("n_tokens"))


@query(f"WITH tk AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS t FROM benchmark) SELECT a.item_id AS a, b.item_id AS b, round(greatest(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))), 0.95 * len(list_intersect(a.t, b.t)) / least(len(a.t), len(b.t))), 9) AS similarity, round(len(list_intersect(a.t, b.t)) / len(a.t), 9) AS contained FROM tk a JOIN tk b ON a.item_id < b.item_id AND len(list_intersect(a.t, b.t)) > 0", views=False)
def p14_p16_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, sf_dir, "benchmark").select("item_id", text.letter_tokens(F.col("text")).alias("t"))
    a, b = t.select(F.col("item_id").alias("a"), F.col("t").alias("ta"), F.explode("t").alias("tok")), t.select(F.col("item_id").alias("b"), F.col("t").alias("tb"), F.explode("t").alias("tok"))
    pairs = a.join(b, "tok").where("a < b").drop("tok").dropDuplicates(["a", "b"])
    return rounded(pairs.select("a", "b", text.similarity(F.col("ta"), F.col("tb")).alias("similarity"), text.containment(F.col("ta"), F.col("tb")).alias("contained")), "similarity", "contained", places=9)


@query("SELECT item_id, array_to_string(list_filter(list_transform(string_split(text, '.'), lambda p: trim(p)), lambda p: p <> ''), ' . ') || ' .' AS prompt FROM benchmark", views=False)
def p17_p18_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "benchmark").select("item_id", text.phrases_to_prompt(text.split_prompt(F.col("text"))).alias("prompt"))


_ALIASES_SQL = "lb AS (SELECT DISTINCT text AS label FROM documents), al AS (SELECT item_id AS pos, text AS alias, 'c' || item_id % 7 AS class_name FROM benchmark)"
_TOKENS_SQL = "list_distinct(list_filter(string_split({n}, ' '), lambda t: t <> ''))"


@query(f"""WITH {_ALIASES_SQL}, n AS (SELECT label, {_norm_sql('label')} AS norm, {_TOKENS_SQL.format(n=_norm_sql('label'))} AS t FROM lb),
k AS (SELECT pos, class_name, {_norm_sql('alias')} AS norm, {_TOKENS_SQL.format(n=_norm_sql('alias'))} AS t FROM al),
ex AS (SELECT n.label, arg_min(class_name, pos) AS c FROM n JOIN k ON n.norm = k.norm GROUP BY 1),
nt AS (SELECT label, len(t) AS n, unnest(t) AS tok FROM n), kt AS (SELECT pos, class_name, len(t) AS m, unnest(t) AS tok FROM k),
pr AS (SELECT label, n, pos, class_name, m, count(*)::DOUBLE AS s FROM nt JOIN kt USING (tok) GROUP BY ALL),
fz AS (SELECT label, arg_max(class_name, (v, -pos)) AS c FROM (SELECT *, greatest(s / (n + m - s), s / least(n, m) * 0.95::DOUBLE) AS v FROM pr) WHERE v >= 0.45 GROUP BY 1)
SELECT n.label, coalesce(ex.c, fz.c) AS class_name FROM n LEFT JOIN ex USING (label) LEFT JOIN fz USING (label)""", views=False)
def j18_g16_resolve_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All whole texts against all whole items, at the production threshold."""
    aliases = _table(spark, sf_dir, "benchmark").select(F.col("text").alias("alias"), F.concat(F.lit("c"), F.col("item_id") % 7).alias("class_name"), F.col("item_id").alias("pos"))
    return ensemble.resolve_labels(_table(spark, sf_dir, "documents").select(F.col("text").alias("label")), aliases)


@query(f"""WITH {_ALIASES_SQL}, n AS (SELECT label, list_distinct(regexp_extract_all(lower(label), '[a-z]+')) AS t FROM lb),
k AS (SELECT DISTINCT class_name, alias, list_distinct(regexp_extract_all(lower(alias), '[a-z]+')) AS p FROM al),
nt AS (SELECT label, unnest(t) AS tok FROM n), kt AS (SELECT class_name, alias, len(p) AS m, unnest(p) AS tok FROM k),
sc AS (SELECT label, class_name, max(s) AS s FROM (SELECT label, class_name, alias, count(*) / m AS s FROM nt JOIN kt USING (tok) GROUP BY label, class_name, alias, m) GROUP BY ALL),
tp AS (SELECT label, max(s) AS top FROM sc GROUP BY 1),
w AS (SELECT label, count(*) AS n, min(class_name) AS c FROM sc JOIN tp USING (label) WHERE s >= top - 1e-9 AND top >= 0.8 GROUP BY 1)
SELECT n.label, CASE WHEN w.n = 1 THEN w.c END AS class_name FROM n LEFT JOIN w USING (label)""", views=False)
def j19_unique_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All whole texts against all whole items, at the production threshold."""
    phrases = _table(spark, sf_dir, "benchmark").select(F.col("text").alias("phrase"), F.concat(F.lit("c"), F.col("item_id") % 7).alias("class_name"))
    return ensemble.unique_phrase_class(_table(spark, sf_dir, "documents").select(F.col("text").alias("label")), phrases)


@query("SELECT det_id, 'thing ' || category_id AS label, k AS pos, (x + k)::INT AS b1, y::INT AS b2, (x + w)::INT AS b3, (y + h)::INT AS b4 FROM det, (SELECT unnest([0, 1]) AS k)")
def p20_raw_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.detections(spark, sf_dir)
    bins = lambda k: F.format_string("<%d><%d><%d><%d>", (F.col("x") + k).cast("int"), F.col("y").cast("int"), (F.col("x") + F.col("w")).cast("int"), (F.col("y") + F.col("h")).cast("int"))
    out = F.concat(F.lit("<|object_ref_start|>thing "), F.col("category_id"), F.lit("<|object_ref_end|><|box_start|>"), bins(0), F.lit(",<1><2>,"), bins(1), F.lit("<|box_end|><|im_end|>junk<1><2><3><4>"))
    got = d.select("det_id", F.posexplode(text.raw_boxes(out)).alias("k", "b")).select("det_id", F.col("b.label").alias("label"), F.col("k").alias("pos"), *(F.get("b.bins", F.lit(i)).alias(f"b{i + 1}") for i in range(4)))
    return got


@query("SELECT det_id, x AS x1, y AS y1, x + w AS x2, y + h AS y2, CASE WHEN det_id % 3 = 1 THEN 'c' || category_id ELSE 'd' END AS label, CASE WHEN det_id % 3 = 1 THEN 0.5 ELSE 1.0 END::DOUBLE AS score FROM det")
def p21_p23_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A payload takes far longer to take apart than its row to read, so the rows of a file, or of its few row groups, are dealt to all tasks."""
    d = views.detections(spark, sf_dir).select("det_id", "category_id", "x", "y", "w", "h").repartition("det_id")
    a = F.to_json(F.struct(F.array(F.struct(F.col("x").alias("xmin"), F.col("y").alias("ymin"), (F.col("x") + F.col("w")).alias("xmax"), (F.col("y") + F.col("h")).alias("ymax"), F.concat(F.lit("c"), F.col("category_id")).alias("label"), F.lit(0.5).alias("confidence"))).alias("objects")))
    b = F.to_json(F.array(F.struct(F.array("x", "y", "w", "h").alias("bbox"), F.lit("xywh").alias("bbox_format"), F.lit(" ").alias("label"), F.array(F.lit("d")).alias("class"))))
    got = d.select("det_id", F.inline(text.payload_found(F.when(F.col("det_id") % 3 == 1, a).otherwise(b))))
    return got.select("det_id", *(F.get("box", F.lit(i)).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))), "label", "score")


@query("SELECT event_id, props->>'$.k' AS k, try_cast(props->>'$.k' AS DOUBLE) AS value, event_type IN ('click', 'view') AS flagged FROM events", views=False)
def p19_p24_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    return e.select("event_id", k.alias("k"), text.coerce_float(k).alias("value"), text.flag(F.when(F.col("event_type").isin("click", "view"), " Yes").otherwise("off")).alias("flagged"))


@query(", c AS (SELECT image_id, category_id, count(*) AS n FROM det GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY image_id) AS p, row_number() OVER (PARTITION BY image_id ORDER BY n DESC) AS r FROM c) SELECT image_id, round(-sum(p * ln(p)), 6) AS entropy, round(max(p) - coalesce(max(p) FILTER (WHERE r = 2), 0), 6) AS margin FROM p GROUP BY 1")
def p28_p30_entropy_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.detections(spark, sf_dir).groupBy("image_id", "category_id").agg(F.count(F.lit(1)).alias("n"))
    m = c.groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("category_id", "n"))).alias("m"), F.sum("n").alias("t"))
    shares = F.transform_values("m", lambda k, v: v / F.col("t"))
    return rounded(m.select("image_id", text.entropy(F.map_values(shares)).alias("entropy"), text.margin(shares).alias("margin")), "entropy", "margin")


@query("SELECT vec_id, k AS place, round(exp(embedding[k + 1]::DOUBLE) / list_sum(list_transform(embedding, lambda v: exp(v::DOUBLE))), 9) AS p FROM (SELECT *, unnest(range(0, len(embedding))) AS k FROM embeddings)", views=False)
def p29_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _table(spark, sf_dir, "embeddings").withColumn("e", F.col("embedding").cast("array<double>"))
    each = v.select("vec_id", F.posexplode(text.softmax(F.col("e"))).alias("place", "p"))
    return rounded(each.withColumn("place", F.col("place").cast("long")), "p", places=9)


@query(f"WITH r AS (SELECT text AS phrase, item_id AS pos, row_number() OVER (PARTITION BY {_norm_sql('text')} ORDER BY item_id) AS k, {_norm_sql('text')} AS n FROM benchmark) SELECT phrase, pos FROM r WHERE k = 1 AND n <> '' ORDER BY pos LIMIT 30", views=False)
def w12_dedupe_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "benchmark").select(F.col("text").alias("phrase"), F.col("item_id").alias("pos"))
    return dataset.dedupe_phrases(p, text.normalize_label(F.col("phrase")), 30)


@query("SELECT conv_id, turn, CASE WHEN role LIKE '%user%' THEN 'rex_omni' ELSE 'transformers' END AS backend FROM conversations", views=False)
def p34_backend(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", text.pick_backend(F.when(F.col("role").contains("user"), "Some/Rex-Omni").otherwise("Grounding-DINO"), F.lit("dino"), F.lit("auto")).alias("backend"))
