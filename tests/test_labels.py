"""Label resolution by rare tokens against all pairs."""

import random
import re

import pytest

from boxquery.operators import ensemble

SCHEMA = "label string"


def toks(text):
    return set(re.findall("[a-z0-9]+", text.lower()))


def texts(rng, n, most):
    words = [f"w{k}" for k in range(30)]
    return [" ".join(words[int(30 * rng.random() ** 3)] for _ in range(rng.randrange(0, most))) for _ in range(n)]


@pytest.mark.parametrize("least", [0.2, 0.45, 0.8, 0.95])
@pytest.mark.parametrize("size", [16 << 20, 0])
def test_resolved_labels(spark, monkeypatch, least, size):
    monkeypatch.setattr(ensemble, "SMALL_BYTES", size)
    rng = random.Random(2)
    labels = texts(rng, 60, 14) + [None, "", "W1 w2!"]
    aliases = [(t, f"c{k % 5}", k) for k, t in enumerate(texts(rng, 40, 9))] + [("w1-w2", "c9", 90), ("w1/w2", "c8", 91)]
    norm = lambda t: " ".join(re.findall("[a-z0-9]+", t.lower()))
    want = {}
    for t in labels:
        if t is None:
            want[t] = None
            continue
        same = [(p, c) for a, c, p in aliases if norm(a) == norm(t)]
        scored = []
        for a, c, p in aliases:
            x, y = toks(t), toks(a)
            k = len(x & y)
            s = max(k / len(x | y), 0.95 * (k / min(len(x), len(y)))) if k else 0
            if s >= least:
                scored.append((s, -p, c))
        want[t] = min(same)[1] if same else max(scored)[2] if scored else None
    got = ensemble.resolve_labels(spark.createDataFrame([(t,) for t in labels + labels[:3]], SCHEMA), spark.createDataFrame(aliases, "alias string, class_name string, pos long"), least).collect()
    assert len(got) == len(want) and {r.label: r.class_name for r in got} == want


@pytest.mark.parametrize("least", [0.5, 0.8, 1.0])
def test_unique_phrases(spark, least):
    rng = random.Random(3)
    letters = lambda t: t.translate(str.maketrans("0123456789", "abcdefghij"))
    labels = [letters(t) for t in texts(rng, 80, 20)] + [""]
    phrases = [(letters(t), f"c{k % 6}") for k, t in enumerate(texts(rng, 30, 6))] + [("wb", "c0"), ("wb", "c1")]
    want = {}
    for t in labels:
        best = {}
        for p, c in phrases:
            p = set(re.findall("[a-z]+", p))
            if p:
                best[c] = max(best.get(c, 0), len(p & toks(t)) / len(p))
        top = max(best.values())
        win = [c for c, s in best.items() if s >= top - 1e-9]
        want[t] = win[0] if top >= least and len(win) == 1 else None
    got = ensemble.unique_phrase_class(spark.createDataFrame([(t,) for t in labels], SCHEMA), spark.createDataFrame(phrases, "phrase string, class_name string"), least).collect()
    assert {r.label: r.class_name for r in got} == want
