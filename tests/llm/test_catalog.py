"""Registered queries with SQL against DuckDB, and the pipeline against plain versions."""

import duckdb
import pytest

import corpus_pipeline
from panelwise.llm import catalog
from tests.conftest import SF_SMALL
from tests.test_entry import TABLES, _norm

from . import brute
from .test_operators import check_packing


def test_all_operators_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in sorted({*TABLES, "documents"}):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    df = catalog.QUERIES[name](spark, SF_SMALL)
    cur = con.execute(catalog.ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    cols = sorted(names)
    want = sorted((tuple(_norm(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=repr) == want


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").withColumnRenamed("lang", "row").withColumnRenamed("source", "version")
    kept = {r.doc_id for r in catalog.op6(spark, SF_SMALL).where("kept").collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "minhash_near_dedup", "suffix_array_dedup", "best_fit_packing"]
    one = corpus_pipeline.written(stages["quality_rules"](spark, docs, SF_SMALL), "one")
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == kept
    rows = [(r.doc_id, r.text) for r in one.collect()]
    two = corpus_pipeline.written(stages["minhash_near_dedup"](spark, one, SF_SMALL), "two")
    first = {d for d, _, _, k in brute.near_duplicates(rows, width=5) if k}
    assert two.columns == docs.columns and sorted(r.doc_id for r in two.collect()) == sorted(first)
    rows = [(r.doc_id, r.text) for r in two.collect()]
    three = corpus_pipeline.written(stages["suffix_array_dedup"](spark, two, SF_SMALL), "three")
    want = {d: x[3].decode("utf-8", "ignore") for (d, _), x in zip(rows, brute.repeated_bytes([t for _, t in rows]))}
    got = {r.doc_id: (r.text, r.n_chars) for r in three.collect()}
    assert three.columns == docs.columns and got == {d: (t, len(t)) for d, t in want.items()}
    four = stages["best_fit_packing"](spark, three, SF_SMALL).collect()
    used, least = check_packing(four, list(want.values()), 4096)
    assert used <= least * 1.05 + 1
