"""Labels and phrases: normalising, tokens, similarity, model output grammars."""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


@functools.cache
def _folds() -> tuple[str, str, dict[str, str], str]:
    """What compatibility decomposition (NFKD), without combining marks and in lower case, makes of characters beyond ASCII.

    The characters that become one letter or digit and what they become, then those that
    vanish, for a translation; the others that hold any, with what they become; and a
    pattern of these. What is in none of them becomes a space.
    """
    one, many, gone = {}, {}, []
    for code in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= code < 0xE000:
            continue
        char = chr(code)
        plain = "".join(x for x in unicodedata.normalize("NFKD", char) if not unicodedata.combining(x)).lower()
        kept = "".join(x if x.isascii() and x.isalnum() or x == "&" else " " for x in plain)
        if not plain:
            gone.append(char)
        elif kept.strip():
            (one if len(kept) == 1 else many)[char] = kept
    runs: list[list[int]] = []
    for code in map(ord, many):
        if runs and code == runs[-1][1] + 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    return "".join(one) + "".join(gone), "".join(one.values()), many, "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in runs) + "]"


def fold(text: Column) -> Column:
    """Letters and digits in lower case and without marks, in Catalyst: a translation, and a look-up of ligatures and the like where there are any."""
    plain, to, many, pattern = _folds()
    table = F.str_to_map(F.lit("\u0001".join(f"{k}\u0002{v}" for k, v in many.items())), F.lit("\u0001"), F.lit("\u0002"))
    parts = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.element_at(table, c), c)), "")
    wide = F.when(F.regexp_replace(text, r"[\x00-\x7F]+", "").rlike(pattern), parts).otherwise(text)
    return F.lower(F.when(F.octet_length(text) == F.char_length(text), text).otherwise(F.translate(wide, plain, to)))


# The words of a true and of a false flag.
TRUE_WORDS = ("1", "true", "t", "yes", "y", "on")
FALSE_WORDS = ("0", "false", "f", "no", "n", "off")


def normalize_label(label: Column) -> Column:
    """Lower case without marks; & is "and", / and - are spaces, other signs too; single spaces."""
    s = F.replace(fold(label), F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))


def words_of(norm: Column) -> Column:
    """Distinct tokens of what is normalised already."""
    return F.array_distinct(F.filter(F.split(norm, " "), lambda t: t != ""))


def tokens(label: Column) -> Column:
    """Distinct tokens of the normalised label."""
    return words_of(normalize_label(label))


def letter_tokens(label: Column) -> Column:
    """Distinct runs of a-z; digits are dropped."""
    return F.array_distinct(F.regexp_extract_all(F.lower(label), F.lit("[a-z]+"), F.lit(0)))


def similarity(a: Column, b: Column) -> Column:
    """The larger of Jaccard and 0.95 times containment (shared tokens over the smaller set)."""
    shared = F.size(F.array_intersect(a, b)).cast("double")
    jaccard = F.try_divide(shared, F.size(F.array_union(a, b)))
    contained = F.try_divide(shared, F.least(F.size(a), F.size(b)))
    return F.coalesce(F.greatest(jaccard, contained * 0.95), F.lit(0.0))


def containment(phrase: Column, label: Column) -> Column:
    """Share of the phrase's tokens that the label has."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(phrase, label)).cast("double"), F.size(phrase)), F.lit(0.0))


def phrases_to_prompt(phrases: Column) -> Column:
    """Phrases joined by " . ", closed by " ."."""
    return F.concat(F.array_join(phrases, " . "), F.lit(" ."))


def split_prompt(prompt: Column) -> Column:
    """The phrases between points, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(prompt, r"\."), lambda p: F.trim(p)), lambda p: p != "")


def prompt_categories(prompt: Column) -> Column:
    """The phrases of a prompt, the first of each normalised form."""
    pairs = F.transform(split_prompt(prompt), lambda p: F.struct(normalize_label(p).alias("k"), p.alias("p")))
    empty = F.array().cast("array<struct<k:string,p:string>>")
    kept = F.aggregate(pairs, empty, lambda a, x: F.when((x["k"] == "") | F.exists(a, lambda y: y["k"] == x["k"]), a).otherwise(F.array_append(a, x)))
    return F.transform(kept, lambda x: x["p"])


def flag(word: Column) -> Column:
    """A boolean of one of six true and six false words; another word is an error."""
    w = F.lower(F.trim(word))
    return F.when(w.isin(*TRUE_WORDS), True).when(w.isin(*FALSE_WORDS), False).when(w.isNull(), None).otherwise(F.raise_error(F.concat(F.lit("not a flag: "), w)).cast("boolean"))


def coerce_float(value: Column) -> Column:
    return F.expr("1D") * value.try_cast("double")


def raw_boxes(output: Column) -> Column:
    """Labels and boxes (four bins each) of a model's token text.

    Text after the end sign is cut, and a closing box sign is supplied where the text doesn't
    end in one. A group is a label between object signs and boxes between box signs, parted
    by commas; a box is exactly four <n> tokens.
    """
    text = F.get(F.split(output, r"<\|im_end\|>"), F.lit(0))
    text = F.when(text.endswith("<|box_end|>"), text).otherwise(F.concat(text, F.lit("<|box_end|>")))
    group = r"<\|object_ref_start\|>\s*[^<]+?\s*<\|object_ref_end\|>\s*<\|box_start\|>.*?<\|box_end\|>"
    groups = F.regexp_extract_all(text, F.lit(f"({group})"), F.lit(1))

    def boxes(g: Column) -> Column:
        label = F.trim(F.regexp_extract(g, r"<\|object_ref_start\|>([^<]+)<", 1))
        inner = F.regexp_extract(g, r"<\|box_start\|>(.*?)<\|box_end\|>", 1)
        numbers = F.transform(F.split(inner, ","), lambda b: F.transform(F.regexp_extract_all(b, F.lit(r"<(\d+)>"), F.lit(1)), lambda n: n.cast("int")))
        return F.transform(F.filter(numbers, lambda n: (F.size(n) == 4) & (label != "")), lambda n: F.struct(label.alias("label"), n.alias("bins")))

    return F.flatten(F.transform(groups, boxes))


# The field names of model payloads, in the order in which they are tried.
CORNER_KEYS = (("x1", "y1", "x2", "y2"), ("xmin", "ymin", "xmax", "ymax"), ("left", "top", "right", "bottom"))
SIZE_KEYS = (("x", "y", "w", "h"), ("x", "y", "width", "height"))
XYXY_KEYS = ("bbox_xyxy", "xyxy", "box_xyxy")
XYWH_KEYS = ("bbox_xywh", "xywh", "box_xywh")
BOX_KEYS = ("bbox", "box", "bounding_box", "coordinates")
FORMAT_KEYS = ("bbox_format", "box_format")
XYWH_FORMATS = ("xywh", "coco", "xywh_abs")
LABEL_KEYS = ("label", "category", "class", "class_name", "name", "text")
SCORE_KEYS = ("score", "confidence", "conf", "probability", "prob")
CONTAINER_KEYS = ("detections", "predictions", "objects", "instances", "items", "results", "outputs")


def _once(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of`` a value that is worked out once, however often ``of`` names it."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def _corners(numbers: Column, sized: bool = False) -> Column:
    """x1, y1, x2, y2 of a list of just four numbers; ``sized``: they are x, y, w, h."""

    def of(b: Column) -> Column:
        x, y, w, h = (F.get(b, F.lit(i)) for i in range(4))
        box = F.array(x, y, x + F.greatest(F.lit(0.0), w), y + F.greatest(F.lit(0.0), h)) if sized else b
        return F.when((F.size(b) == 4) & ~F.exists(b, lambda n: n.isNull()), box)

    return _once(numbers, of)


def _number(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "double")


def _listed(v: Column, path: str = "$") -> Column:
    return F.try_variant_get(v, path, "array<double>")


def _variant_box(v: Column, nested: bool = True) -> Column:
    """An entry's fields are parted once; only those that are asked for become numbers, which costs far more than to find them."""

    def of(fields: Column) -> Column:
        there = lambda k, box: F.when(fields[k].isNotNull(), box)
        kind = F.lower(F.trim(F.coalesce(*(F.try_variant_get(fields[k], "$", "string") for k in FORMAT_KEYS))))
        tries = [there(names[0], _corners(F.array(*(_number(fields[k], "$") for k in names)), sized)) for keys, sized in ((CORNER_KEYS, False), (SIZE_KEYS, True)) for names in keys]
        tries += [there(k, _corners(_listed(fields[k]), sized)) for keys, sized in ((XYXY_KEYS, False), (XYWH_KEYS, True)) for k in keys]
        for k in BOX_KEYS:
            if nested:
                tries.append(there(k, _variant_box(fields[k], nested=False)))
            tries.append(there(k, F.when(kind.isin(*XYWH_FORMATS), _corners(_listed(fields[k]), sized=True)).otherwise(_corners(_listed(fields[k])))))
        return F.when(fields.isNotNull(), F.coalesce(*tries))

    return _once(F.try_variant_get(v, "$", "map<string,variant>"), of)


def _variant_label(v: Column) -> Column:
    texts = [F.nullif(F.trim(F.coalesce(F.try_variant_get(v, f"$.{k}[0]", "string"), F.try_variant_get(v, f"$.{k}", "string"))), F.lit("")) for k in LABEL_KEYS]
    return F.coalesce(*texts)


def _variant_score(v: Column) -> Column:
    return F.coalesce(*(_number(v, f"$.{k}") for k in SCORE_KEYS), F.lit(1.0))


def _variant_entries(v: Column) -> Column:
    """The entries of a payload: itself if a list or if it has a label, else those of its first container that is a list."""
    none = F.array().cast("array<variant>")
    labelled = F.coalesce(*(F.try_variant_get(v, f"$.{k}", "variant") for k in LABEL_KEYS)).isNotNull()
    lists = [F.try_variant_get(v, f"$.{k}", "array<variant>") for k in CONTAINER_KEYS]
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.when(labelled, F.array(v)), *lists, none)


def payload_box(payload: Column) -> Column:
    """x1, y1, x2, y2 of a JSON entry, by the first names that are all numbers; null if none are."""
    return _once(F.try_parse_json(payload), lambda v: _variant_box(v))


def payload_label(payload: Column) -> Column:
    """The first label field that isn't blank; of a list the first element."""
    return _once(F.try_parse_json(payload), _variant_label)


def payload_score(payload: Column) -> Column:
    """The first score field that is a number, else 1."""
    return _once(F.try_parse_json(payload), _variant_score)


def payload_entries(payload: Column) -> Column:
    """The entries of a payload as JSON texts; none of what isn't a payload."""
    return F.transform(_once(F.try_parse_json(payload), _variant_entries), lambda e: F.to_json(e))


def payload_found(payload: Column) -> Column:
    """box, label and score of each entry of a payload, which is parsed once; what ``payload_entries`` and the three above give."""
    return F.transform(_once(F.try_parse_json(payload), _variant_entries), lambda e: F.struct(_variant_box(e).alias("box"), _variant_label(e).alias("label"), _variant_score(e).alias("score")))


def category_map_entries(payload: Column) -> Column:
    """label, score and box of a payload {label: entry or list of entries}; an entry is an object or four numbers."""
    pairs = F.map_entries(F.try_variant_get(F.try_parse_json(payload), "$", "map<string,variant>"))

    def of(pair: Column) -> Column:
        label, value = F.trim(pair["key"]), pair["value"]
        entries = F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array(value))
        def entry(e: Column) -> Column:
            typed = F.lower(F.trim(F.try_variant_get(e, "$.type", "string"))) == "box"
            box = F.coalesce(F.when(typed, _corners(_listed(e, "$.coords"))), _variant_box(e), _corners(_listed(e)))
            return F.struct(label.alias("label"), _variant_score(e).alias("score"), box.alias("box"))

        return F.filter(F.transform(entries, entry), lambda d: (d["label"] != "") & d["box"].isNotNull())

    return F.coalesce(F.flatten(F.transform(pairs, of)), F.expr("cast(array() as array<struct<label:string,score:double,box:array<double>>>)"))


def pick_backend(model: Column, detector: Column, asked: Column) -> Column:
    """The runner that was asked for; for "auto" the one that the names hint at."""
    hint = F.concat_ws(" ", normalize_label(detector), normalize_label(model))
    asked = F.lower(F.trim(asked))
    known = asked.isin("auto", "transformers", "rex_omni")
    auto = F.when(hint.contains("rex omni") | hint.contains("rexomni"), "rex_omni").otherwise("transformers")
    return F.when(~known, F.raise_error(F.concat(F.lit("unknown backend: "), asked)).cast("string")).when(asked != "auto", asked).otherwise(auto)


def entropy(dist: Column) -> Column:
    """Shannon entropy (nats) of an array of probabilities; zeros count nothing."""
    return -F.aggregate(F.filter(dist, lambda p: p > 0), F.lit(0.0), lambda a, p: a + p * F.ln(p))


def softmax(values: Column) -> Column:
    top = F.array_max(values)
    powers = F.transform(values, lambda v: F.exp(v - top))
    return F.transform(powers, lambda p: p / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b))


def margin(dist: Column) -> Column:
    """Best less second best value of a map; 1 if it is empty, the best if it is alone."""
    ranked = F.reverse(F.array_sort(F.map_values(dist)))
    return F.when(F.coalesce(F.size(dist), F.lit(0)) == 0, 1.0).otherwise(F.get(ranked, F.lit(0)) - F.coalesce(F.get(ranked, F.lit(1)), F.lit(0.0)))
