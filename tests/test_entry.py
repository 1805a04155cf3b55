"""The driver's contract."""

import duckdb
import pytest

import __spark_entry__ as entry
from scriptorium.plans import oracle, queries


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(oracle.SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", ["q7_check", "sg7_segment", "sp5_sp7_hard_samples", "fx4_moved", "fv1_online_features", "ev2_auc", "ca2_document_scores", "md8_assemble"])
def test_against_sql(spark, sf, name):
    c = duckdb.connect()
    for t in ("documents", "paragraphs", "variants", "documents_metadata", "embeddings"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    a, b = queries.QUERIES[name](spark, sf).toPandas(), c.sql(oracle.SQL[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    canon = lambda d: sorted(map(str, d[sorted(d.columns)].astype(object).where(d[sorted(d.columns)].notna(), None).apply(lambda r: tuple(round(float(v), 5) + 0.0 if isinstance(v, float) else str(v) if v is None or isinstance(v, (str, bool)) else int(v) if hasattr(v, "__int__") and not isinstance(v, str) else v for v in r), axis=1)))
    assert canon(a) == canon(b)
