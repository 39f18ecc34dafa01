"""The registered text queries against their SQL, and the pipeline against its stages' plain versions."""

import os

import duckdb
import pytest

import corpus_pipeline
from boxquery.llm import decontam, quality_model
from boxquery.llm._common import table
from boxquery.llm.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    want = con.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    names = sorted(df.columns)
    clean = lambda v: round(v, 6) if isinstance(v, float) else v
    got = sorted((tuple(clean(r[c]) for c in names) for r in df.collect()), key=repr)
    at = [want.columns.index(c) for c in names]
    assert got == sorted((tuple(clean(r[k]) for k in at) for r in want.fetchall()), key=repr)


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 14)}


def test_pipeline(spark):
    from .test_operators import brute_components, brute_hits

    stages = dict(corpus_pipeline.STAGES)
    docs = table(spark, SF, "documents")
    names = docs.columns
    frames = [docs]
    for name in list(stages)[:-1]:
        frames.append(stages[name](spark, frames[-1], SF).cache())
        assert frames[-1].columns == names
    rows = [sorted((r.doc_id, r.text) for r in f.collect()) for f in frames]
    # the classifier: the score's threshold
    scored = quality_model.score(docs, quality_model.fit(docs, table(spark, SF, "labels")))
    assert [i for i, _ in rows[1]] == sorted(r.doc_id for r in scored.where(f"score >= {quality_model.THRESHOLD}").collect())
    # lines: the same documents
    assert [i for i, _ in rows[2]] == [i for i, _ in rows[1]]
    # near-duplicates: the smallest of each component
    comps = brute_components([(i, t, None) for i, t in rows[2]])
    assert [i for i, _ in rows[3]] == sorted(i for i, _, c in comps if i == c)
    # benchmark: no hit
    items = [(str(r.item_id), r.text) for r in table(spark, SF, "benchmark").collect()]
    hits = brute_hits([t for _, t in rows[3]], items, decontam.WINDOW)
    assert [i for i, _ in rows[4]] == [i for (i, _), h in zip(rows[3], hits, strict=True) if not h[1]]
    # the mix: a row each document, and run() gives the same
    last = stages[list(stages)[-1]](spark, frames[-1], SF)
    assert sorted(r.doc_id for r in last.collect()) == [i for i, _ in rows[4]]
    assert sorted(map(repr, corpus_pipeline.run(spark, SF).collect())) == sorted(map(repr, last.collect()))
