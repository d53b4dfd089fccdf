"""Queries with SQL equal it on the small tables; guards on the subpackage's code."""

import pathlib
import re

import duckdb
import pytest

import __spark_entry__ as E
from skillweave.llm import queries
from tests.llm.conftest import SMALL

CODE = pathlib.Path(queries.__file__).parent


def ordered(columns, rows):
    """Rows with their columns sorted by name, in one order."""
    at = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(columns), sorted((tuple(r[i] for i in at) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SMALL)
    want = con.execute(queries.oracle_sql()[name])
    assert ordered(got.columns, [tuple(r) for r in got.collect()]) == ordered([d[0] for d in want.description], want.fetchall())


def test_all_eleven_queries_are_registered():
    names = E.queries()
    assert "pipeline" in names
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11))


def test_code_keeps_to_shared_storage_and_whole_tables():
    for path in CODE.glob("*.py"):
        text = path.read_text(encoding="utf-8")
        assert not re.search(r"localCheckpoint|mkdtemp|tempfile|crossJoin|monotonically_increasing_id|\.sample\(", text), path
