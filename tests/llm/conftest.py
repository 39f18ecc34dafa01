import random

import pytest

WORDS = [f"w{k}" for k in range(400)]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOW = str.maketrans(UPPER, LOWER)


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus():
    """(doc_id, text, source) rows with copies, near copies, shared passages and lines, and every odd case."""
    rng = random.Random(7)
    passage = sentence(rng, 120)
    line = "  A very common Line of many documents\t"
    rows = []
    for k in range(60):
        text = sentence(rng, rng.randrange(5, 220))
        if k % 4 == 0:
            text += "\n" + line + "\n" + sentence(rng, 30)
        if k % 5 == 0:
            text = sentence(rng, 40) + " " + passage + " " + text
        rows.append((k, text, f"s{k % 3}" if k % 3 else "hot"))
    base = sentence(rng, 200).split(" ")
    for k in range(60, 80):  # near copies: one word changed
        words = list(base)
        words[rng.randrange(200)] = "changed"
        rows.append((k, " ".join(words), "hot"))
    rows += [(k, rows[3][1], "hot") for k in range(80, 90)]  # exact copies
    rows += [
        (90, None, "hot"),
        (91, "", None),
        (92, " \n\t ", "s1"),
        (93, "one two", "s1"),
        (94, "One TWO", "s2"),
        (95, sentence(rng, 20_000), "hot"),  # a very long text
        (96, "ab " * 3000, "s2"),  # periodic
        (97, "é漢字 " * 300 + "\n\n" + "ÄÖ", "s1"),
        (98, rows[7][1], "s1"),
        (98, rows[7][1], "s1"),  # a repeated row
        (99, sentence(rng, 50), "s1"),
        (99, sentence(rng, 60), "s2"),  # one id, two texts
        (None, rows[8][1], "s1"),  # no id
        (None, sentence(rng, 100), None),
    ]
    return rows


SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, id int, th string, pos string, anchor string, key string, gone string, _id string"


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The corpus, with other columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, s, "en", len(t or ""), 1, "x", "x", "x", "x", "x", "x") for i, t, s in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
