"""Some registered queries against their SQL, and the entry points."""

import os

import pytest

import __spark_entry__
from covlattice.plans import source_queries, source_sql
from covlattice.plans.queries import QUERIES as CORE
from covlattice.plans.sql import ORACLES as CORE_SQL

QUERIES, ORACLES = CORE | source_queries.QUERIES, CORE_SQL | source_sql.ORACLES
DATA = "/root/testdata/sf0.001"
SOME = ["coverage_similarity", "relative_strata", "pair_selection", "grouped_split", "bucket_batches", "regression_metrics", "geometry_metrics", "routed_aggregate", "label_distribution", "type_codes", "gcn_propagate", "cell_features", "early_stop", "plateau_rates", "scalar_maths", *source_queries.QUERIES]

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


def plain(rows):
    show = lambda v: "null" if v is None or v != v else repr(round(float(v), 6)) if isinstance(v, float) else str(v)
    return sorted(tuple(map(show, r)) for r in rows)


@pytest.mark.parametrize("name", SOME)
def test_query_gives_what_its_sql_gives(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    made = QUERIES[name](spark, DATA)
    columns = ", ".join(f'"{c}"' for c in made.columns)
    assert plain(made.collect()) == plain(con.execute(f"SELECT {columns} FROM ({ORACLES[name]})").fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 20 and rows == sorted(rows, key=lambda r: (-r.similarity, r.sample_a, r.sample_b))
