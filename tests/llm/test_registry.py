"""The queries with SQL against DuckDB, the pipeline's stages, and the guard of the entry module."""

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from siltstone.llm import common, registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        p = Path(sf) / f"{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p / '*.parquet' if os.path.isdir(p) else p}'")
    df = registry.queries()[name](spark, sf)
    rel = con.sql(registry.oracle_sql()[name])
    names = sorted(df.columns)
    assert names == sorted(rel.columns)
    places = [rel.columns.index(c) for c in names]
    assert sorted(tuple(r[c] for c in names) for r in df.collect()) == sorted(tuple(r[k] for k in places) for r in rel.fetchall())


def test_all_ten_and_the_pipeline_are_registered():
    names = __spark_entry__.queries()
    assert [n for k in range(1, 11) for n in names if n.startswith(f"op{k}_")] and "pipeline" in names
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_stages_keep_columns_and_take_effect(spark, sf):
    docs = common.table(spark, sf, "documents")
    columns, counts = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf), "stage")
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] == counts[3] == counts[4]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == counts[-1]
