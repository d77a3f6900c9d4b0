"""Queries with SQL give what DuckDB gives."""

import duckdb
import pytest
from lumenquarry.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(name, spark, sf_dir):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = c.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    rows = QUERIES[name](spark, sf_dir).select(*names).collect()
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, found.fetchall()))
