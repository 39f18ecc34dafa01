"""Fusing the detections of several prompt sets.

Raw detections become clusters (components of the overlap graph, or weighted boxes
fusion), clusters get a class by one of four votes, and the winning members give the box.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boxquery.functions.geometry import centroid_in_sql, clipped, iou_sql
from boxquery.functions.text import letter_tokens, normalize_label, tokens, words_of
from boxquery.sources.scratch import parked

#: Bytes that are sent to every task at most.
SMALL_BYTES = 16 << 20


def _hint(sets: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Broadcasts what is made of these token sets, a row a set or a token, if their tokens are few bytes; else leaves the join to Spark."""
    size = sets.agg(F.sum(F.octet_length(F.array_join("set_toks", "")) + F.col("m") * 64 + 64)).first()[0] or 0
    return F.broadcast if size <= SMALL_BYTES else lambda df: df


def _key(label: str) -> dict[str, Column]:
    """128 bits of hash that stand for a label, so that a whole text isn't carried along with each of its tokens."""
    return {"k1": F.xxhash64(label), "k2": F.xxhash64(F.lit(1), F.col(label))}


def _least_shared(size: str, share: float) -> Column:
    """The smallest whole number that is ``share`` of the size, a rounding error aside."""
    return F.greatest(F.lit(1), F.ceil(F.col(size) * share - 1e-9))


#: Of the tokens that must be shared, the part that is asked for among the rarest ones.
HITS = 0.25


def _hits(size: str, share: float) -> Column:
    return F.ceil(_least_shared(size, share) * HITS)


def _prefix(tokens_of: DataFrame, key: Sequence[str], counts: DataFrame, size: str, share: float) -> DataFrame:
    """Of each set so many of its rarest tokens that a set sharing ``share`` of it must hold ``_need`` of them.

    tokens_of: key, size, tok; counts: tok, n. A set of m that shares k tokens leaves
    m - k unshared, so of any m - k + h at least h are shared; the rarest meet the fewest others.
    """
    rank = F.row_number().over(W.partitionBy(*key).orderBy(F.coalesce("_n", F.lit(0)), "tok"))
    ranked = tokens_of.join(counts.withColumnRenamed("n", "_n"), "tok", "left").withColumns({"_r": rank, "_need": _hits(size, share)})
    return ranked.where(F.col("_r") <= F.col(size) - _least_shared(size, share) + F.col("_need")).drop("_n", "_r")


def _counted(tokens_of: DataFrame) -> DataFrame:
    return tokens_of.groupBy("tok").agg(F.count(F.lit(1)).alias("n"))


def _sharing(texts: DataFrame, sets: DataFrame, share: float, both_ways: bool, hint: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """k1, k2, a: the pairs that may share ``share`` of the set (with ``both_ways``: of the smaller of the two).

    texts: k1, k2, n, toks; sets: a, m, set_toks. Pairs are met by rare tokens of the smaller side
    alone; a token that is in most texts makes none unless a set has nothing rarer.
    """
    of_texts = texts.select("k1", "k2", "n", F.explode("toks").alias("tok"))
    of_sets = sets.select("a", "m", F.explode("set_toks").alias("tok"))
    known = hint(of_sets.select("tok").distinct())
    rare = hint(_prefix(of_sets, ["a"], _counted(of_texts.join(known, "tok", "left_semi")), "m", share))
    met = of_texts.join(rare, "tok")
    enough = lambda rows: rows.groupBy("k1", "k2", "a", "_need").agg(F.count(F.lit(1)).alias("_c")).where("_c >= _need").select("k1", "k2", "a")
    if not both_ways:
        return enough(met)
    longest = sets.agg(F.max("m")).first()[0] or 0
    short = _prefix(of_texts.where(F.col("n") < longest), ["k1", "k2"], _counted(of_sets), "n", share)
    turned = short.join(hint(of_sets), "tok").where("n < m")
    return enough(met.where("m <= n")).unionByName(enough(turned))


def resolve_labels(labels: DataFrame, aliases: DataFrame, least: float = 0.45) -> DataFrame:
    """label and class_name: the alias of the same normalised text, else the most alike one of ``least`` or more.

    aliases: alias, class_name, pos; of equally alike ones the smallest pos wins. Labels
    are resolved once each, whatever their rows. Alike are sets of tokens by the larger of Jaccard and 0.95 of the share
    of the smaller set; either asks for a share of the smaller set, so candidates meet by its rarest tokens.
    """
    wanted = labels.select("label").distinct().withColumn("norm", normalize_label(F.col("label"))).withColumns({"toks": words_of(F.col("norm")), **_key("label")})
    known = aliases.select("class_name", "pos", normalize_label(F.col("alias")).alias("norm"), tokens(F.col("alias")).alias("set_toks")).distinct()
    known = parked(known.withColumns({"a": F.xxhash64("class_name", "pos", "norm"), "m": F.size("set_toks")}), "aliases")
    hint = _hint(known)
    exact = wanted.join(hint(known.groupBy("norm").agg(F.min_by("class_name", "pos").alias("exact"))), "norm", "left")
    exact = parked(exact.select("label", "k1", "k2", "exact", F.size("toks").alias("n"), "toks"), "labels")
    left = exact.where(F.col("exact").isNull()).select("k1", "k2", "n", "toks")
    near = _sharing(left, known, min(least / 0.95, 2 * least / (1 + least)), True, hint)
    pairs = near.join(left, ["k1", "k2"]).join(hint(known.select("a", "class_name", "pos", "m", "set_toks")), "a")
    shared = F.size(F.array_intersect("toks", "set_toks")).cast("double")
    scored = pairs.select("k1", "k2", "class_name", "pos", (shared / (F.col("n") + F.col("m") - shared)).alias("jaccard"), (shared / F.least("n", "m")).alias("contained"))
    close = scored.withColumn("s", F.greatest(F.col("jaccard"), F.col("contained") * 0.95)).where(F.col("s") >= least)
    best = close.groupBy("k1", "k2").agg(F.max_by("class_name", F.struct("s", -F.col("pos"))).alias("fuzzy"))
    return exact.join(best, ["k1", "k2"], "left").select("label", F.coalesce("exact", "fuzzy").alias("class_name"))


def unique_phrase_class(labels: DataFrame, phrases: DataFrame, least: float = 0.8) -> DataFrame:
    """label and class_name, where one class alone has the phrase best contained in the label (``least`` or more), else null."""
    wanted = parked(labels.select("label").distinct().withColumns({"toks": letter_tokens(F.col("label")), **_key("label")}).withColumn("n", F.size("toks")), "labels")
    known = phrases.select("class_name", letter_tokens(F.col("phrase")).alias("set_toks")).distinct()
    known = known.withColumns({"a": F.xxhash64("class_name", "set_toks"), "m": F.size("set_toks")}).where("m > 0")
    left = wanted.select("k1", "k2", "n", "toks")
    hint = _hint(known)
    near = _sharing(left, known, least - 1e-9, False, hint)
    pairs = near.join(left, ["k1", "k2"]).join(hint(known.select("a", "class_name", "m", "set_toks")), "a")
    scored = pairs.groupBy("k1", "k2", "class_name").agg(F.max(F.size(F.array_intersect("toks", "set_toks")) / F.col("m")).alias("s"))
    top = scored.groupBy("k1", "k2").agg(F.max("s").alias("top"), F.collect_list(F.struct("s", "class_name")).alias("_all"))
    winners = top.withColumn("_best", F.filter("_all", lambda x: x["s"] >= F.col("top") - 1e-9)).where((F.col("top") >= least) & (F.size("_best") == 1))
    one = winners.select("k1", "k2", F.get("_best", F.lit(0))["class_name"].alias("class_name"))
    return wanted.join(one, ["k1", "k2"], "left").select("label", "class_name")


def class_scores(members: DataFrame, mode: str, cluster: Sequence[str] = ("cluster",)) -> DataFrame:
    """cluster, class_name and ``points`` of the classes that have any, by mode.

    precomputed and vote: members of the class; score: mean score; borda: sum over prompt
    sets of 1 / rank of the class by its best score in the set (ties by class name).
    """
    known = members.where(F.col("class_name").isNotNull() & (F.col("class_name") != ""))
    by = [*cluster, "class_name"]
    if mode in ("precomputed", "vote"):
        return known.groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("points"))
    if mode == "score":
        return known.groupBy(*by).agg(F.avg("score").alias("points"))
    if mode == "borda":
        best = known.groupBy(*cluster, "prompt_set", "class_name").agg(F.max("score").alias("best"))
        rank = F.row_number().over(W.partitionBy(*cluster, "prompt_set").orderBy(F.desc("best"), "class_name"))
        return best.withColumn("points", 1.0 / rank).groupBy(*by).agg(F.sum("points").alias("points"))
    raise ValueError(f"unknown mode: {mode!r}")


def class_distribution(points: DataFrame, classes: DataFrame, mode: str, cluster: Sequence[str] = ("cluster",)) -> DataFrame:
    """cluster, winner, entropy (nats) and class_dist (map) over all classes.

    Points are normalised; mode score is a softmax over all classes, absent ones at 0.
    Ties (to nine places) go to the first class by name. Only classes with points are rows: all the
    absent ones weigh the same, and are counted in by their number.
    """
    names = F.broadcast(classes.agg(F.array_sort(F.collect_set("class_name")).alias("_names")))  # one row, the list of classes
    rows = points.groupBy(*cluster).agg(F.map_from_entries(F.collect_list(F.struct("class_name", "points"))).alias("_m")).crossJoin(names)
    rows = rows.withColumn("_keys", F.array_intersect("_names", F.map_keys("_m"))).withColumns({"_values": F.transform("_keys", lambda c: F.element_at("_m", c)), "_rest": (F.size("_names") - F.size("_keys")).cast("double")})
    if mode == "score":
        top = F.greatest(F.array_max("_values"), F.when(F.col("_rest") > 0, F.lit(0.0)))
        rows = rows.withColumn("_top", top).withColumns({"_weights": F.transform("_values", lambda v: F.exp(v - F.col("_top"))), "_absent": F.exp(-F.col("_top"))})
    else:
        rows = rows.withColumns({"_weights": F.col("_values"), "_absent": F.lit(0.0)})
    rows = rows.withColumn("_sum", F.aggregate("_weights", F.lit(0.0), lambda a, w: a + w) + F.col("_rest") * F.when(F.col("_rest") > 0, F.col("_absent")).otherwise(0.0))
    share = lambda w: F.when(F.col("_sum") > 0, w / F.col("_sum")).otherwise(1.0 / F.size("_names"))
    rows = rows.withColumns({"_p": F.transform("_weights", share), "_q": share(F.col("_absent"))})
    term = lambda p: F.when(p > 0, -p * F.ln(p)).otherwise(0.0)
    entropy = F.aggregate("_p", F.lit(0.0), lambda a, p: a + term(p)) + F.col("_rest") * F.coalesce(term(F.col("_q")), F.lit(0.0))
    ranked = F.zip_with("_p", "_keys", lambda p, c: F.struct((-F.round(p, 9)).alias("q"), c.alias("c")))
    first = F.get(F.array_except("_names", "_keys"), F.lit(0))
    absent = F.when(F.col("_rest") > 0, F.array(F.struct((-F.round("_q", 9)).alias("q"), first.alias("c")))).otherwise(F.array().cast("array<struct<q:double,c:string>>"))
    winner = F.array_min(F.concat(ranked, absent))["c"]
    place = lambda c: F.array_position(F.col("_keys"), c)
    dist = F.map_from_arrays("_names", F.transform("_names", lambda c: F.when(place(c) > 0, F.get("_p", (place(c) - 1).cast("int"))).otherwise(F.col("_q"))))
    return rows.select(*cluster, winner.alias("winner"), entropy.alias("entropy"), dist.alias("class_dist"))


def fuse(members: DataFrame, winners: DataFrame, weighted: bool = True, cluster: Sequence[str] = ("cluster",)) -> DataFrame:
    """One row a cluster: box, deviations, score, n_cluster, contributing sets of the winning class's members.

    Coordinates are means weighted by score (without weight if the scores sum to 0, or
    ``weighted`` is off); deviations are of the population and unweighted. A cluster whose
    winner no member has falls back to all members.
    """
    rows = members.join(winners.select(*cluster, "winner", "entropy"), list(cluster))
    rows = rows.withColumn("_win", F.coalesce(F.col("class_name") == F.col("winner"), F.lit(False)))
    rows = rows.withColumn("_any", F.max(F.col("_win").cast("int")).over(W.partitionBy(*cluster)))
    use = F.col("_win") | (F.col("_any") == 0)
    pick = lambda c: F.when(use, c)
    aggs: list[Column] = []
    for c in "xywh":
        mean = F.avg(pick(F.col(c)))
        heavy = F.try_divide(F.sum(pick(F.col(c) * F.col("score"))), F.sum(pick(F.col("score"))))
        aggs += [(F.coalesce(heavy, mean) if weighted else mean).alias(c), F.stddev_pop(pick(F.col(c))).alias(f"{c}_std")]
    out = rows.groupBy(*cluster, "winner", "entropy").agg(
        *aggs,
        F.avg(pick(F.col("score"))).alias("score"),
        F.count(pick(F.lit(1))).alias("n_cluster"),
        F.count(F.lit(1)).alias("n_cluster_total"),
        F.array_sort(F.collect_set(pick(F.col("prompt_set")))).alias("contributing_sets"),
    )
    return out.withColumn("loc_uncertainty", (F.col("x_std") + F.col("y_std") + F.col("w_std") + F.col("h_std")) / 4)


def ensemble(members: DataFrame, classes: DataFrame, mode: str = "borda", weighted: bool = True, cluster: Sequence[str] = ("cluster",)) -> DataFrame:
    """Clusters of ``members`` classified and fused. Where all members of a cluster have a class, score and vote count members."""
    points = class_scores(members, mode, cluster)
    if mode in ("score", "vote"):
        whole = members.groupBy(*cluster).agg(F.min((F.coalesce(F.col("class_name"), F.lit("")) != "").cast("int")).alias("_all")).where("_all = 1").select(*cluster)
        named = class_distribution(class_scores(members.join(whole, list(cluster), "left_semi"), "precomputed", cluster), classes, "precomputed", cluster)
        other = class_distribution(points.join(whole, list(cluster), "left_anti"), classes, mode, cluster)
        dist = named.unionByName(other)
    else:
        dist = class_distribution(points, classes, mode, cluster)
    return fuse(members, dist, weighted, cluster)


def summary(fused: DataFrame) -> DataFrame:
    """Clusters, sizes by winning members, singletons."""
    return fused.agg(F.count(F.lit(1)).alias("clusters"), F.avg("n_cluster").alias("mean_size"), F.max("n_cluster").alias("max_size"), F.count_if(F.col("n_cluster") == 1).alias("singletons"))


#: How a fused box gets its score; n boxes of k models of the M that have boxes in the group.
CONFIDENCES = ("mean", "avg", "max", "box_and_model_avg", "absent_model_aware_avg")


def fused_score(conf: str) -> Column:
    """The score of a fused box from _mean, _max, n, k and M.

    mean: of the members; avg: the mean, scaled by min(n, M) / M; max: the largest;
    box_and_model_avg: the mean, scaled by the share of the models that are in it; absent_model_aware_avg:
    as if each model that isn't in it had a box of score 0.
    """
    mean, n, k, models = F.col("_mean"), F.col("n"), F.col("k"), F.col("M")
    by = {
        "mean": mean,
        "avg": mean * F.least(n, models) / models,
        "max": F.col("_max"),
        "box_and_model_avg": mean * k / models,
        "absent_model_aware_avg": mean * n / (n + models - k),
    }
    if conf not in by:
        raise ValueError(f"unknown confidence type: {conf!r}")
    return by[conf]


def in_frame(boxes: DataFrame, images: DataFrame, keep_empty: bool = False) -> DataFrame:
    """Boxes clamped to their image (id, width, height); those that have no area left go, unless kept. An unknown image's boxes go too."""
    sized = boxes.join(images.select(F.col("id").alias("image_id"), "width", "height"), "image_id")
    out = sized.withColumns(clipped()).drop("width", "height")
    return out if keep_empty else out.where("w > 0 and h > 0")


def wbf(boxes: DataFrame, keys: Sequence[str], id: str, threshold: float, conf: str = "mean", model: str | None = None, models_by: Sequence[str] | None = None) -> DataFrame:
    """Weighted boxes fusion (Solovyev et al., 2021): keys, cluster number, fused box, score, members.

    Boxes by falling score join the first-best fused box of ``threshold`` or more, which is then
    the score-weighted mean of its members, or open a new one. A null score counts as 1. ``conf`` is one of
    ``CONFIDENCES``; all but mean and max need ``model``, the column that tells models apart, and count those that
    have boxes in the group ``models_by`` (the keys, unless given: the image, where classes are fused apart).
    """
    tell = F.col(model).cast("string") if model else F.lit("")
    score = F.coalesce(F.col("score"), F.lit(1.0))
    grouped = boxes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-score).alias("s"), F.col(id).alias("id"), "x", "y", "w", "h", tell.alias("m")))).alias("_all"))
    kind = "array<struct<x:double,y:double,w:double,h:double,sw:double,top:double,n:bigint,k:int,ids:array<bigint>,ms:array<string>>>"
    new = "named_struct('x', d.x, 'y', d.y, 'w', d.w, 'h', d.h, 'sw', -d.s, 'top', -d.s, 'n', 1L, 'k', size(f), 'ids', array(d.id), 'ms', array(d.m))"
    best = f"array_max(transform(filter(f, q -> {iou_sql('q.', 'd.')} >= {float(threshold)}D), q -> named_struct('iou', {iou_sql('q.', 'd.')}, 'neg', -q.k)))"
    mean = lambda c: f"(q.{c} * q.sw + d.{c} * -d.s) / (q.sw - d.s)"
    joined = f"named_struct('x', {mean('x')}, 'y', {mean('y')}, 'w', {mean('w')}, 'h', {mean('h')}, 'sw', q.sw - d.s, 'top', q.top, 'n', q.n + 1, 'k', q.k, 'ids', array_append(q.ids, d.id), 'ms', array_union(q.ms, array(d.m)))"
    fold = f"aggregate(_all, cast(array() as {kind}), (f, d) -> transform(array({best}), b -> if(b is null, array_append(f, {new}), transform(f, q -> if(q.k = -b.neg, {joined}, q))))[0])"
    fused = grouped.select(*keys, F.expr(f"inline({fold})"))
    rows = fused.select(*keys, F.col("k").alias("cluster"), "x", "y", "w", "h", (F.col("sw") / F.col("n")).alias("_mean"), F.col("top").alias("_max"), "n", "ids", F.size("ms").alias("k"))
    if conf in ("mean", "max"):
        rows = rows.withColumn("M", F.lit(1))
    elif model is None:
        raise ValueError(f"{conf} needs the column of the model")
    else:
        group = list(keys if models_by is None else models_by)
        rows = rows.join(boxes.groupBy(*group).agg(F.count_distinct(tell).alias("M")), group)
    return rows.select(*keys, "cluster", "x", "y", "w", "h", fused_score(conf).alias("score"), "n", "ids")


def assign_fused(boxes: DataFrame, fused: DataFrame, keys: Sequence[str], id: str, centroid: bool = False) -> DataFrame:
    """id and cluster: the fused box that each box overlaps most (the first of equal ones); null where it overlaps none.

    With ``centroid`` a fused box that holds the box's centre is preferred by a thousandth,
    and so takes boxes of no overlap too. A box of no cluster is one of its own.
    """
    right = fused.select(*(F.col(k).alias(f"b_{k}") for k in keys), F.col("cluster").alias("b_cluster"), *(F.col(c).alias(f"b_{c}") for c in "xywh"))
    left = boxes.select(*(F.col(k).alias(f"a_{k}") for k in keys), F.col(id).alias("_id"), *(F.col(c).alias(f"a_{c}") for c in "xywh"))
    more = f" + if({centroid_in_sql('a_', 'b_')}, 0.001D, 0D)" if centroid else ""
    near = left.join(right, [F.col(f"a_{k}") == F.col(f"b_{k}") for k in keys]).withColumn("p", F.expr(f"{iou_sql('a_', 'b_')}{more}")).where("p > 0")
    best = near.groupBy("_id").agg(F.max_by("b_cluster", F.struct("p", -F.col("b_cluster"))).alias("cluster"))
    return boxes.select(id).join(best.withColumnRenamed("_id", id), id, "left")


def segment_argmax(vectors: DataFrame, id: str, vector: str, segments: int, width: int) -> DataFrame:
    """Of a vector in ``segments`` parts: the part of the largest value (the first of equal ones), its maximum, and the vector's."""
    parts = F.transform(F.sequence(F.lit(0), F.lit(segments - 1)), lambda k: F.struct(F.array_max(F.slice(F.col(vector), k * width + 1, F.lit(width))).alias("m"), (-k).alias("k")))
    return vectors.select(id, F.array_max(parts).alias("b"), F.array_max(vector).alias("top")).select(id, (-F.col("b.k")).alias("segment"), F.col("b.m").alias("best"), "top")
