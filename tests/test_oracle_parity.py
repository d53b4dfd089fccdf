"""Every registered query equals its DuckDB oracle on the sf0.001 tables."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from skillweave.plans import registry

SF = "/root/testdata/sf0.001"
NAMES = sorted(registry.QUERIES)


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 6)
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(_norm(r[c]) for c in cols) for r in pdf.to_dict("records")), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ["documents", "embeddings", "benchmark", "pages"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    sql = E.oracle_sql()[name]
    got = _rows(E.queries()[name](spark, SF).toPandas())
    want = _rows(duck.execute(sql).df())
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_checks_of_made_adverts_match_their_sql(spark, duck):
    """The SQL of posting_checks over rows that the pages do not have: each check, on its own and with others."""
    from skillweave.plans.oracle import FRAGMENTS
    from skillweave.sources import adverts
    good = ("a", "u", "2024-01-01", "p", "e", "2024-01-01", "t", "x", "3")
    fields = adverts._RAW.fieldNames()
    made = lambda n, **kw: tuple(kw.get(c, f"{g}{n}" if c in ("id", "source_uri") else g) for c, g in zip(fields, good))
    groups = ["7", "3.0", None, "3.5", "drei", "2147483647", "-2147483648", "2147483648", "-2147483649", "1000000000000",
              "99999999999999999999", "1e300"]
    rows = [made(n, isco_group=g) for n, g in enumerate(groups)]
    rows += [made(100 + n, **{c: None}) for n, c in enumerate(fields)] + [made(110, id=None), (None,) * 9]
    rows += [made(120 + n, id="same", crawl_date="01.01.2024", posting_date="2024-02-30") for n in range(3)]
    duck.execute(f"CREATE OR REPLACE TABLE made ({', '.join(f'{c} VARCHAR' for c in fields)})")
    duck.executemany(f"INSERT INTO made VALUES ({', '.join('?' * len(fields))})", rows)
    sql = E.oracle_sql()["posting_checks"].replace(FRAGMENTS["raw_pages"][0], "SELECT * FROM made")
    want = sorted(map(repr, duck.execute(sql).fetchall()))
    got = [tuple(r) for r in adverts.validate_postings(spark.createDataFrame(rows, adverts._RAW)).collect()]
    assert sorted(map(repr, got)) == want
    said = {uri: (reasons, valid, n) for _, uri, reasons, valid, n in got}
    assert [said[f"u{n}"][0] for n in range(len(groups))] == [""] * 3 + ["bad_type:isco_group"] * 2 + [""] * 2 + ["bad_type:isco_group"] * 5
    # the reference takes any text for a date and every advert with its fields, also with an id that came before
    assert said["u120"] == ("bad_date:crawl_date|bad_date:posting_date|duplicate_id", True, 3)
    assert said["u110"] == ("missing:id", False, 1)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "refers_to_competence" in df.columns
