"""Splits and samples whose class shares come near a ratio, searched in rounds over the table of images.

An image is a row with its counts by class. A round scores, for every image, what moving
it would do to the deviation of the class shares, which needs no more than the class totals;
the best few moves are brought to the driver, in a number that doesn't depend on the data, and are
accepted one after the other while they help. Draws are by a hash of the id, so a rerun finds the same.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxquery.functions.params import target_size
from boxquery.operators.selection import smallest
from boxquery.sources.scratch import parked

ROUNDS = 8
#: Moves that a round may make; each is a row of an image's classes on the driver.
BATCH = 512

Counts = dict[int, int]


def draw(id: str, seed: int) -> Column:
    """A pseudorandom number below 2^31 - 1 of the id, the same in any SQL engine."""
    return F.pmod(F.col(id) * 2_654_435_761 + seed * 40_503, F.lit(2_147_483_647))


def image_counts(annotations: DataFrame, images: DataFrame) -> DataFrame:
    """image_id and cs, an array of (c, n) by class, of every image; written. An image of no annotation has an empty array; annotations of no image don't count."""
    per = annotations.groupBy("image_id", F.col("category_id").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    grouped = per.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("c", "n"))).alias("cs"))
    rows = images.select(F.col("id").alias("image_id")).distinct().join(grouped, "image_id", "left")
    return parked(rows.select("image_id", F.coalesce("cs", F.array().cast(grouped.schema["cs"].dataType)).alias("cs")), "image-counts")


def _totals(counts: DataFrame, *by: str) -> dict:
    """Annotations by class (and ``by``): as many numbers as there are classes."""
    out: dict = {}
    for r in counts.select(*by, F.explode("cs").alias("x")).groupBy(*by, "x.c").agg(F.sum("x.n").alias("n")).collect():
        (out.setdefault(r[by[0]], {}) if by else out)[r["c"]] = r["n"]
    return out


def share_deviation(counts: Counts, totals: Counts, ratio: float) -> float:
    """Mean over classes of how far the class's share is from ``ratio``, in percent points."""
    return sum(abs(counts.get(c, 0) / n - ratio) for c, n in totals.items()) / len(totals) * 100 if totals else 0.0


def _table(values: dict[int, list[float]]) -> Column:
    """Numbers by class, as a literal map of as many entries as there are classes."""
    return F.create_map(*(x for c, v in values.items() for x in (F.lit(c), F.array(*map(F.lit, v)))))


def _change(row: Column, place: int, ratio: float, total: Column, sign: int) -> Column:
    """What ``sign`` times an image's annotations of a class change of the deviation of a part's share."""
    have, n = total[place], F.lit(sign) * row["n"]
    return F.abs((have + n) / total[0] - ratio) - F.abs(have / total[0] - ratio)


def _changes(places: Sequence[tuple[int, float, int]]) -> Column:
    """The sum over an image's classes of the changes of some parts (place, ratio, sign), from columns cs and _now (by class: total, then the parts')."""
    return F.aggregate("cs", F.lit(0.0), lambda a, x: a + sum((_change(x, p, r, F.element_at("_now", x["c"]), s) for p, r, s in places), F.lit(0.0)))


def optimized_split(counts: DataFrame, ratios: dict[str, float], seed: int = 0, rounds: int = ROUNDS, batch: int = BATCH) -> DataFrame:
    """image_id and split: drawn by the ratios, then improved by moves that strictly lower the sum of the splits' deviations.

    counts: from ``image_counts``. Of an image the move of the greatest gain is proposed (the first
    split of equal ones); a round takes the ``batch`` best, ties by id, and makes each that still helps.
    Images without annotations stay where they were drawn.
    """
    names, spark = list(ratios), counts.sparkSession
    whole = sum(ratios.values())
    at, limits = 0.0, []
    for n in names[:-1]:
        at += ratios[n] / whole
        limits.append((n, int(at * 2_147_483_647)))
    drawn: Column = F.lit(names[-1])
    for n, limit in reversed(limits):
        drawn = F.when(draw("image_id", seed) < limit, n).otherwise(drawn)
    base = parked(counts.withColumn("split", drawn), "split")
    totals = _totals(counts)
    have = _totals(base, "split")
    now = {s: {c: have.get(s, {}).get(c, 0) for c in totals} for s in names}
    moved: dict[int, str] = {}
    place = {s: k for k, s in enumerate(names, 1)}

    def current() -> DataFrame:
        if not moved:
            return base
        overlay = spark.createDataFrame(list(moved.items()), "image_id long, _to string")  # rounds * batch rows at most
        return base.join(F.broadcast(overlay), "image_id", "left").withColumn("split", F.coalesce("_to", "split")).drop("_to")

    def change(cs: list, s: str, to: str) -> float:
        return sum(abs((now[p][c] + sign * n) / totals[c] - ratios[p]) - abs(now[p][c] / totals[c] - ratios[p]) for c, n in cs for p, sign in ((s, -1), (to, 1)))

    for _ in range(rounds if totals and len(names) > 1 else 0):
        table = _table({c: [float(t), *(float(now[s][c]) for s in names)] for c, t in totals.items()})
        rows = current().where(F.size("cs") > 0).withColumn("_now", table)
        moves = [F.struct(F.when(F.col("split") == s, _changes([(place[s], ratios[s], -1), (place[t], ratios[t], 1)])).alias("d"), F.lit(place[t]).alias("t")) for s in names for t in names if s != t]
        best = F.array_min(F.filter(F.array(*moves), lambda m: m["d"].isNotNull()))
        found = rows.withColumn("_best", best).where("_best.d < -1e-12").orderBy("_best.d", "image_id").limit(batch)
        made = 0
        for r in found.select("image_id", "split", "cs", "_best").collect():
            to, cs = names[r["_best"]["t"] - 1], [(x["c"], x["n"]) for x in r["cs"]]
            if change(cs, r["split"], to) < -1e-12:
                made += 1
                moved[r["image_id"]] = to
                for c, n in cs:
                    now[r["split"]][c] -= n
                    now[to][c] += n
        if not made:
            break
    return current().select("image_id", "split")


def optimized_sample(counts: DataFrame, ratio: float, fixed: DataFrame | None = None, seed: int = 0, rounds: int = ROUNDS, batch: int = BATCH) -> DataFrame:
    """image_id of so many images (the rounded ratio, one at least) that their class shares come near ``ratio``; the fixed ones stay in.

    Drawn by a hash, then improved by swaps that don't hurt: of the images inside and outside those
    whose move alone lowers the deviation most are paired, best with best.
    """
    spark = counts.sparkSession
    whole = counts.count()
    size = target_size(whole, ratio)
    held = counts.select("image_id").limit(0) if fixed is None else parked(fixed.select("image_id").distinct(), "fixed")
    n_held = held.count()
    if unknown := [r["image_id"] for r in held.join(counts, "image_id", "left_anti").orderBy("image_id").limit(5).collect()]:
        raise ValueError(f"fixed images that aren't there: {unknown}")
    if n_held > size:
        raise ValueError("more fixed images than the sample has")
    free = counts.join(held, "image_id", "left_anti").withColumn("_all", F.lit(1))
    first = smallest(free, ["_all"], draw("image_id", seed), "image_id", spark.createDataFrame([(1, size - n_held)], "_all int, n long"))
    chosen = first.select("image_id", F.lit(True).alias("inside")).unionByName(held.select("image_id", F.lit(True).alias("inside")))
    base = counts.join(chosen, "image_id", "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
    base = parked(base.join(held.withColumn("_held", F.lit(True)), "image_id", "left").withColumn("_held", F.coalesce("_held", F.lit(False))), "sample")
    totals = _totals(counts)
    now = {c: _totals(base.where("inside")).get(c, 0) for c in totals}
    turned: dict[int, bool] = {}

    def current() -> DataFrame:
        if not turned:
            return base
        overlay = spark.createDataFrame(list(turned.items()), "image_id long, _to boolean")  # 2 * rounds * batch rows at most
        return base.join(F.broadcast(overlay), "image_id", "left").withColumn("inside", F.coalesce("_to", "inside")).drop("_to")

    for _ in range(rounds if totals and 0 < size - n_held < whole - n_held else 0):
        rows = current().where("not _held").withColumn("_now", _table({c: [float(t), float(now[c])] for c, t in totals.items()}))
        scored = {}
        for inside, sign in ((True, -1), (False, 1)):
            part = rows.where(F.col("inside") == inside).withColumn("_d", _changes([(1, ratio, sign)]))
            scored[inside] = part.orderBy("_d", "image_id").select("image_id", "cs").limit(batch).collect()
        made = 0
        for a, b in zip(scored[True], scored[False], strict=False):
            trial: Counts = {}
            for r, sign in ((a, -1), (b, 1)):
                for x in r["cs"]:
                    trial[x["c"]] = trial.get(x["c"], 0) + sign * x["n"]
            d = sum(abs((now[c] + n) / totals[c] - ratio) - abs(now[c] / totals[c] - ratio) for c, n in trial.items())
            if d <= 0:
                made += d < -1e-12
                turned[a["image_id"]], turned[b["image_id"]] = False, True
                for c, n in trial.items():
                    now[c] += n
        if not made:
            break
    return parked(current().where("inside").select("image_id"), "sample")


def nested_samples(counts: DataFrame, ratios: Sequence[float], seed: int = 0) -> DataFrame:
    """ratio and image_id of samples of growing ratios, each holding the one before."""
    out, held = None, None
    for r in ratios:
        held = optimized_sample(counts, r, held, seed)
        part = held.select(F.lit(float(r)).alias("ratio"), "image_id")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no ratios")
    return out


def best_of_seeds(counts: DataFrame, ratio: float, seeds: Sequence[int], least_share: float = 0.5) -> tuple[DataFrame, list[dict]]:
    """The best sample of several seeds and the report of all: fewest classes missing, fewest short of ``least_share``, then the deviations, then the seed."""
    totals, report = _totals(counts), []
    for s in seeds:
        sample = optimized_sample(counts, ratio, seed=s)
        have = _totals(counts.join(sample, "image_id", "left_semi"))
        shares = {c: have.get(c, 0) / n for c, n in totals.items()}
        report.append({"seed": s, "sample": sample, "missing": sum(v == 0 for v in shares.values()), "short": sum(v < least_share * ratio for v in shares.values()), "worst": max((abs(v - ratio) for v in shares.values()), default=0.0), "mean": share_deviation(have, totals, ratio), "size": sample.count()})
    report.sort(key=lambda r: (r["missing"], r["short"], r["mean"], r["worst"], -r["size"], r["seed"]))
    return report[0]["sample"], report


def covering_sample(counts: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """image_id of n images: for each class in order that none so far has the first drawn one with it, then the first drawn of the rest."""
    order = F.struct(draw("image_id", seed), "image_id")
    firsts = counts.select("image_id", "cs", F.explode("cs.c").alias("c")).groupBy("c").agg(F.min_by(F.struct("image_id", F.col("cs.c").alias("seen")), order).alias("f"))
    chosen, seen = [], set()
    for r in firsts.orderBy("c").collect():  # a row a class
        if r["c"] not in seen and len(chosen) < n:
            chosen.append(r["f"]["image_id"])
            seen |= set(r["f"]["seen"])
    kept = counts.sparkSession.createDataFrame([(i,) for i in chosen], counts.select("image_id").schema)
    rest = counts.join(F.broadcast(kept), "image_id", "left_anti").select("image_id").withColumn("_all", F.lit(1))
    more = smallest(rest, ["_all"], draw("image_id", seed), "image_id", counts.sparkSession.createDataFrame([(1, n - len(chosen))], "_all int, n long"))
    return kept.unionByName(more.select("image_id"))
