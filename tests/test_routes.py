"""Routes from end to end, their files, the stream of extracts, and queries against SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from loomgrid import queries
from loomgrid.plans import routes, sinks
from loomgrid.streaming.extracts import replace_years

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [r for r in routes.ROUTES if r != "casualty_matrix"])
def test_routes_balance_check_and_write(spark, tmp_path, name):
    out = routes.run(spark, name, SF, str(tmp_path))
    assert out.files and all(ok for _, ok, _ in out.checks)
    for table, df in out.tables.items():
        path = next(f for f in out.files if f.endswith(f"_{table}.parquet"))
        assert spark.read.parquet(path).count() == df.count()


def test_matrix_route_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "write_table", lambda df, folder, kind, name, csv=True: [f"{folder}/{kind}_{name}"])
    out = routes.run(spark, "casualty_matrix", SF, str(tmp_path))
    assert sum(t.startswith(("crosstab", "by_year")) for t in out.tables) == 3 + 3 * 7
    assert out.ledger.steps == ["two-party threshold", "emit affected parties"]


def test_a_failed_check_fails_the_route(spark, tmp_path, monkeypatch):
    monkeypatch.setitem(routes.ROUTES, "loading", lambda s, d, f, out: out.checks.append(("x", False, "bad")))
    with pytest.raises(routes.RouteFailed):
        routes.run(spark, "loading", SF, str(tmp_path))
    with pytest.raises(ValueError):
        sinks.path("f", "other", "t")


def test_a_stream_of_extracts_replaces_years(spark, tmp_path):
    target, source = str(tmp_path / "layer"), str(tmp_path / "in")
    sinks.write_years(spark.createDataFrame([("a", 2019), ("b", 2020)], "v string, YEAR int"), target)
    spark.createDataFrame([("c", 2020), ("d", 2021)], "v string, YEAR int").coalesce(1).write.parquet(source)
    for _ in range(2):
        replace_years(spark, source, "v string, YEAR int", target, str(tmp_path / "check")).awaitTermination()
    assert sorted((r.v, r.YEAR) for r in spark.read.parquet(target).collect()) == [("a", 2019), ("c", 2020), ("d", 2021)]


@pytest.fixture(scope="module")
def con():
    own = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents"):
        own.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return own


def plain(value):
    return float(f"{value:.8g}") if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_sql(spark, con, name):
    found = queries.QUERIES[name](spark, SF)
    result = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(found.columns)
    assert sorted(repr([plain(r[c]) for c in columns]) for r in found.collect()) == sorted(repr([plain(v) for v in row]) for row in result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 25 * 7 * 6 * 7
    assert set(entry.oracle_sql()) <= set(entry.queries())
