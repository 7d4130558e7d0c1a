"""Registered text queries next to their SQL, and the pipeline stage by stage."""

from __future__ import annotations

import os
import sys

import duckdb
import pytest

from hashmark.llm.registry import ORACLES, QUERIES

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    relation = con.sql(ORACLES[name])
    columns = relation.columns
    want = sorted(relation.fetchall(), key=str)
    frame = QUERIES[name](spark, sf_dir)
    assert sorted(frame.columns) == sorted(columns)
    assert sorted((tuple(r) for r in frame.select(columns).collect()), key=str) == want


@pytest.mark.parametrize("name", ["op2_quality_rules", "op8_toxicity", "op9_lm_scoring"])
def test_one_row_for_each_document(spark, sf_dir, name):
    ids = sorted(r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect())
    assert sorted(r.doc_id for r in QUERIES[name](spark, sf_dir).select("doc_id").collect()) == ids


def test_every_operator_has_a_query():
    assert sorted(int(n.split("_")[0][2:]) for n in QUERIES) == list(range(1, 14))


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as pipeline

    docs = pipeline.documents(spark, sf_dir)
    frames = [docs]
    for name, stage in pipeline.STAGES:
        frames.append(pipeline.written(stage(spark, frames[-1], sf_dir), name.replace(" ", "-")))
    assert all(f.columns == docs.columns for f in frames[:-1])
    ids = [{r.doc_id for r in f.select("doc_id").distinct().collect()} for f in frames]
    assert all(after <= before for before, after in zip(ids, ids[1:]))
    kept = {r.doc_id for r in QUERIES["op2_quality_rules"](spark, sf_dir).filter("kept").collect()}
    assert ids[1] == kept and ids[4] == ids[5]
    lines = [r.text.split("\n") for r in frames[2].collect()]
    full = [frozenset(line.split()) for text in lines for line in text if line.split()]
    assert len(full) == len(set(full))
    for r in frames[4].collect():
        assert r.text and r.n_chars == len(r.text)
    room = frames[5].groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert max(r[1] for r in room) <= 2048


def test_rows_get_their_own_decision_whatever_their_id(spark, sf_dir):
    import random

    import corpus_pipeline as pipeline

    rng = random.Random(5)
    prose = [" ".join(f"w{rng.randrange(5000)}" for _ in range(120)) for _ in range(5)]
    texts = [(None, prose[0]), (None, "short"), (1, prose[1]), (1, "rejected"), (2, prose[2]), (2, prose[2]), (2, prose[2] + " tail")]
    texts += [(3, prose[3]), (3, prose[4]), (4, prose[3] + " tail"), (5, prose[4] + " tail")]
    rows = [(i, t, "en", "s", len(t)) for i, t in texts]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)

    def found(frame):
        assert frame.columns == docs.columns
        return sorted(((r.doc_id, r.text) for r in frame.collect()), key=str)

    clean = [(i, t) for i, t in texts if t not in ("short", "rejected")]
    assert found(pipeline.keep_quality(spark, docs, sf_dir)) == sorted(clean, key=str)
    kept = found(pipeline.keep_one_of_each_group(spark, docs, sf_dir))
    assert [i for i, _ in kept].count(2) == 1
    assert [x for x in kept if x[0] != 2] == sorted([x for x in texts if x[0] in (None, 1) or x in ((3, prose[3]), (3, prose[4]))], key=str)
