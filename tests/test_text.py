"""Texts and numbers as texts, against Python's own."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from boxquery.functions import geometry, text
from boxquery.operators import matching
from boxquery.sources import readers, scratch, writers


def normal(label):
    s = "".join(c for c in unicodedata.normalize("NFKD", label) if not unicodedata.combining(c)).lower()
    s = re.sub(r"[^a-z0-9\s]", " ", s.replace("&", " and ").replace("/", " ").replace("-", " "))
    return re.sub(r"\s+", " ", s).strip()


def test_labels_are_decomposed(spark):
    rng = random.Random(4)
    labels = ["ısı", "Đường phố", "Ｆｕｌｌ－ｗｉｄｔｈ", "ﬁre ﬂy", "½ m² ㎏", "İstanbul & Köln/Straße-x", "e\u0301a\u0308", "ΑΒΓ abc 漢字", "Ⅻ ⑴ ™", "", "K\u212a", "a\u00a0b", "𝐁𝐨𝐥𝐝"]
    labels += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA1, 0x250), rng.randrange(0x1E00, 0x1F00), rng.randrange(0x2100, 0x2200)])) for _ in range(12)) for _ in range(300)]
    got = spark.createDataFrame(list(enumerate(labels)), "k int, t string").select("k", text.normalize_label(F.col("t")).alias("n")).collect()
    assert {labels[r.k]: r.n for r in got} == {t: normal(t) for t in labels}


@pytest.mark.parametrize("places", [0, 2, 4])
def test_numbers_are_rounded_as_printf_does(spark, places):
    rng = random.Random(places)
    values = [0.0, 1.125, 1.135, 2.675, 0.125, 0.375, 2.5, 3.5, -0.001, -1.125, 1e6 + 0.125, 1e15, 0.00005, 0.00015, 1.00005]
    values += [rng.uniform(-1000, 1000) for _ in range(500)] + [round(rng.uniform(0, 99), places) + 0.5 * 10.0**-places for _ in range(500)]
    got = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double").select("k", geometry.fixed(F.col("v"), places).alias("t")).collect()
    assert {values[r.k]: r.t for r in got} == {v: f"{v:.{places}f}" for v in values}


def test_sizes(spark):
    sizes = [0, 1023, 1024, 1152, 1024**2 - 1, 1024**3, 5 * 1024**4]
    got = spark.createDataFrame([(float(s),) for s in sizes], "s double").select("s", geometry.bytes_text(F.col("s")).alias("t")).collect()
    assert [r.t for r in sorted(got)] == ["0.00 B", "1023.00 B", "1.00 KB", "1.12 KB", "1024.00 KB", "1.00 GB", "5120.00 GB"]


def test_a_long_report_is_refused(spark):
    assert writers.markdown(spark.range(2)).splitlines() == ["| id |", "| --- |", "| 0 |", "| 1 |"]
    with pytest.raises(ValueError):
        writers.markdown(spark.range(5), most=4)


def test_paths_and_shared_folder(spark, tmp_path):
    readers.require_paths(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        readers.require_paths(spark, str(tmp_path), f"{tmp_path}/none")
    assert scratch.shared_dir(spark) == scratch.shared_dir(spark)


def test_components_of_chains(spark):
    boxes = [(k, k // 40, 6.0 * (k % 40) + (1000 if k % 40 >= 25 else 0), 0.0, 10.0, 10.0) for k in range(80)]
    df = spark.createDataFrame(boxes, "det_id long, image_id long, x double, y double, w double, h double")
    want = {k: (k // 40) * 40 + (25 if k % 40 >= 25 else 0) for k in range(80)}
    assert {r.det_id: r.cluster for r in matching.components(df, ["image_id"], "det_id", 0.2).collect()} == want
    swept = {(r.t, r.det_id): r.cluster for r in matching.component_sweep(df, ["image_id"], "det_id", [0.2, 0.9]).collect()}
    assert swept == {(0.2, k): c for k, c in want.items()} | {(0.9, k): k for k in range(80)}
