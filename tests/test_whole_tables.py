"""Queries whose findings said that they read a part of a table: each item of the whole table counts."""

import duckdb
import pytest

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def items(spark, sf_dir):
    """Items with a term that some document has."""
    from lumenquarry.plans.catalogue import _lexicon

    terms = _lexicon(spark, sf_dir, "true")[1]
    found = {r["query"] for r in terms.select("query").distinct().collect()}
    assert any(x % 100 for x in found) and len(found) > 2
    return found


def by_sql(name, sf_dir):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return {r[0] for r in c.execute(f"SELECT DISTINCT query FROM ({entry.oracle_sql()[name]})").fetchall()}


@pytest.mark.parametrize("name", ["idf_pruned_terms", "strategy_comparison"])
def test_every_item_is_a_query(name, spark, sf_dir, items):
    got = {r["query"] for r in entry.queries()[name](spark, sf_dir).select("query").distinct().collect()}
    assert got == items == by_sql(name, sf_dir)
