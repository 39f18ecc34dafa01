"""Parameters as the command lines give them, parsed on the driver; and the same as columns, where each row of a table of runs has its own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from boxquery.functions.geometry import fixed


def variant_name(score: float, text: float) -> str:
    return f"s{score:.3f}_t{text:.3f}".replace(".", "p")


def score_text_pairs(text: str) -> list[tuple[float, float]]:
    """"0.1:0.2,0.3:0.4": distinct pairs in order, both in [0, 1]."""
    pairs: list[tuple[float, float]] = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        score, sep, other = part.partition(":")
        if not sep:
            raise ValueError(f"not a pair: {part!r}")
        pair = (float(score), float(other))
        if not all(0 <= v <= 1 for v in pair):
            raise ValueError(f"out of [0, 1]: {part!r}")
        if pair not in pairs:
            pairs.append(pair)
    if not pairs:
        raise ValueError("no pairs")
    return pairs


def nested_ratios(text: str) -> list[float]:
    """Strictly increasing ratios in (0, 1]."""
    ratios = [float(p) for p in text.split(",") if p.strip()]
    if not ratios or any(not 0 < r <= 1 for r in ratios) or any(b <= a for a, b in zip(ratios, ratios[1:], strict=False)):
        raise ValueError(f"not increasing ratios: {text!r}")
    return ratios


def candidate_seeds(text: str) -> list[int]:
    return list(dict.fromkeys(int(p) for p in text.split(",") if p.strip()))


def max_dets(n: int) -> list[int]:
    """The three caps of an evaluation whose largest is ``n``."""
    n = max(1, n)
    return [min(100, n), min(500, n), n]


def target_size(n: int, ratio: float) -> int:
    """round(n * ratio), halves to even, within 1..n."""
    return max(1, min(n, round(n * ratio)))


def grid(start: float, stop: float, step: float) -> list[float]:
    """start, start + step, ... up to stop, rounded to ten places."""
    count = int((stop + step / 2 - start) / step)
    values = [round(start + k * step, 10) for k in range(count + 2)]
    return [v for v in values if v < stop + step / 2]


def ratio_percent(name: str) -> float | None:
    """The percentage in a run's name; a number up to 1 is a share."""
    import re

    found = re.search(r"(\d+(?:[._p]\d+)?)", name)
    if not found:
        return None
    value = float(found[1].replace("p", ".").replace("_", "."))
    return value * 100 if value <= 1 else value


def anchor_sizes(base: list[int], scales: list[float]) -> list[list[int]]:
    return [[int(b * s) for s in scales] for b in base]


def split_labelled_paths(items: list[str], sep: str) -> dict[str, str]:
    """"name=path" items; only the first separator parts."""
    return dict(item.split(sep, 1) for item in items)


# The spellings of the number types.
DTYPES = {
    "float16": "float16", "fp16": "float16", "half": "float16",
    "bfloat16": "bfloat16", "bf16": "bfloat16",
    "float32": "float32", "fp32": "float32",
}


def parse_dtype(name: str) -> str:
    key = name.strip().lower()
    if key not in DTYPES:
        raise ValueError(f"unknown number type: {name!r}")
    return DTYPES[key]


def variant_names(score: Column, text: Column) -> Column:
    """``variant_name`` of two columns; null if one is."""
    name = F.concat(F.lit("s"), fixed(score, 3), F.lit("_t"), fixed(text, 3))
    return F.when(score.isNotNull() & text.isNotNull(), F.translate(name, ".", "p"))


def pairs_of(text: Column) -> Column:
    """The distinct (score, text) pairs of "0.1:0.2,0.3:0.4", in order; null where a part is no pair of numbers in [0, 1], or there is none."""
    parts = F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != "")
    number = lambda p, k: F.get(F.split(p, ":", 2), F.lit(k)).try_cast("double")
    pairs = F.array_distinct(F.transform(parts, lambda p: F.struct(number(p, 0).alias("score"), number(p, 1).alias("text"))))
    good = lambda p: F.coalesce(p["score"].between(0, 1) & p["text"].between(0, 1), F.lit(False))
    return F.when((F.size(pairs) > 0) & F.forall(pairs, good), pairs)


def caps_of(n: Column) -> Column:
    """``max_dets`` of a column."""
    most = F.greatest(F.lit(1), n)
    return F.array(F.least(F.lit(100), most), F.least(F.lit(500), most), most)


def anchors_of(base: Column, scales: list[float], ratios: list[float]) -> Column:
    """The anchors of a base size: every scale, cut to a whole number, with every ratio of the sides."""
    sizes = F.array(*(F.floor(base * F.lit(float(s))).cast("int") for s in scales))
    return F.flatten(F.transform(sizes, lambda size: F.transform(F.array(*map(F.lit, ratios)), lambda r: F.struct(size.alias("size"), r.alias("ratio")))))


def dtypes_of(name: Column) -> Column:
    """``parse_dtype`` of a column; null where it is unknown."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in DTYPES.items() for x in pair)), F.lower(F.trim(name)))
