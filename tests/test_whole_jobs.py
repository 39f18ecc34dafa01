"""Queries that run the whole job, against plain versions on small inputs."""

import collections
import random
import re

import pytest

from boxquery.plans import registry, views

WORDS = [f"{a}{b}" for a in ("red", "old", "big", "far", "dry", "wet") for b in ("car", "hut", "ship", "dam", "crane", "truck")]


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    """A folder with documents of ids up to 10,000 and benchmark items, most above 40 characters; the rows."""
    rng = random.Random(3)
    items = [(k, " ".join(rng.sample(WORDS, rng.randrange(2, 14)))) for k in range(30)]
    items += [(30, items[4][1] + " tail"), (31, items[4][1].upper() + "!"), (32, "")]
    docs = [(k * 37, " ".join(rng.choices(WORDS, k=rng.randrange(1, 60)))) for k in range(250)]
    docs += [(9000 + k, f"{t}, and 2 words more" if k % 2 else t) for k, t in items] + [(9990, ""), (9991, "nothing alike")]
    path = tmp_path_factory.mktemp("texts")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), docs, items


def norm(t):
    return " ".join(re.sub(r"[^a-z0-9\s]", " ", t.lower()).split())


def test_all_labels_are_resolved_by_whole_texts(spark, texts):
    path, docs, items = texts
    want = {}
    for label in {t for _, t in docs}:
        exact = [k for k, t in items if norm(t) == norm(label)]
        n, best = set(norm(label).split()), (0.45, None, None)
        for k, t in items:
            m = set(norm(t).split())
            both = len(n & m)
            s = max(both / len(n | m), 0.95 * (both / min(len(n), len(m)))) if both else 0.0
            if s > best[0] or (s == best[0] and best[1] is None):
                best = (s, k, None)
        k = exact[0] if exact else best[1]
        want[label] = None if k is None else f"c{k % 7}"
    got = registry.QUERIES["j18_g16_resolve_labels"](spark, path).collect()
    assert len(got) == len(want) and {r.label: r.class_name for r in got} == want
    assert None in want.values() and len(set(want.values())) > 4


def test_all_phrases_by_whole_texts(spark, texts):
    path, docs, items = texts
    letters = lambda t: set(re.findall("[a-z]+", t.lower()))
    want = {}
    for label in {t for _, t in docs}:
        by_class = {}
        for k, t in items:
            if p := letters(t):
                by_class[f"c{k % 7}"] = max(by_class.get(f"c{k % 7}", 0.0), len(p & letters(label)) / len(p))
        top = max(by_class.values())
        winners = [c for c, s in by_class.items() if s >= top - 1e-9]
        want[label] = winners[0] if top >= 0.8 and len(winners) == 1 else None
    got = registry.QUERIES["j19_unique_phrase"](spark, path).collect()
    assert len(got) == len(want) and {r.label: r.class_name for r in got} == want
    assert None in want.values() and len(set(want.values())) > 4


def test_all_sources_keep_every_box(spark):
    sf = "/root/testdata/sf0.001"
    got = registry.QUERIES["u01_a21_sources"](spark, sf).collect()
    boxes = collections.defaultdict(list)
    for r in views.detections(spark, sf).collect():
        boxes[r.image_id, r.category_id, r.x, r.y, r.w, r.h].append(("zero", "one", "two")[r.src])
    assert {(r.image_id, r.category_id, r.x, r.y, r.w, r.h): (r.n, r.sources) for r in got} == {b: (len(s), ",".join(sorted(set(s)))) for b, s in boxes.items()}
    assert any(r.n == 1 and r.image_id % 2 for r in got)


def test_phrases_are_deduped_by_their_whole_text(spark, tmp_path):
    start = "one two three four"  # more than 12 characters
    items = [(0, f"{start} five"), (1, f"{start} six"), (2, f" {start.upper()}  six!"), (3, "&"), (4, "--"), (5, "and")] + [(k, f"{start} {k}") for k in range(6, 40)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = registry.QUERIES["w12_dedupe_phrases"](spark, str(tmp_path)).collect()
    assert sorted(r.pos for r in got) == [0, 1, 3, *range(6, 33)]
