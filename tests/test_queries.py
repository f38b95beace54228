"""Every query with SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__
from tessera import catalog  # noqa: F401
from tessera.plans import bindings

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return str(value) if math.isinf(value) or math.isnan(value) else repr(round(value, 9))
    return repr(value)


@pytest.mark.parametrize("name", sorted(bindings.ORACLES))
def test_query(name, spark, sf, duck):
    df = bindings.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = duck.sql(bindings.ORACLES[name])
    assert sorted(result.columns) == columns
    places = [result.columns.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in places) for r in result.fetchall())


@pytest.mark.parametrize("name", sorted(set(bindings.QUERIES) - set(bindings.ORACLES)))
def test_query_without_sql_runs(name, spark, sf):
    assert bindings.QUERIES[name](spark, sf).count() >= 0


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["l", "r", "axes", "total", "rank"] and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_coordination_pairs_of_all_lines(spark, sf, duck):
    """Against all pairs of the orders of all lines by brute force, not against the query's own relation."""
    has = {}
    for team, supplier in duck.sql("select l_orderkey, l_suppkey from lineitem").fetchall():
        has.setdefault(team, set()).add(f"c{supplier}")
    teams = sorted(t for t in has if len(has[t]) > 1)
    want = {(a, b): ",".join(sorted(both)) for i, a in enumerate(teams) for b in teams[i + 1 :] if (both := has[a] & has[b])}
    got = bindings.QUERIES["coordination_pairs"](spark, sf).toPandas()
    assert len(got) == len(want) and dict(zip(zip(got["a"], got["b"]), got["shared"])) == want


def test_connected_components_of_all_orders(spark, sf, duck):
    rows = duck.sql("select o_custkey, c_nationkey, o_orderdate from orders join customer on c_custkey = o_custkey").fetchall()
    met, root = {}, {}
    for person, *key in rows:
        met.setdefault(tuple(key), set()).add(person)

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for people in met.values():
        if len(people) > 1:
            for x in people:
                a, b = sorted((find(x), find(min(people))))
                root[b] = a
    got = {r.node: r.component for r in bindings.QUERIES["connected_components"](spark, sf).collect()}
    assert got == {x: find(x) for x in root} and len(set(got.values())) > 1


def test_stars_grow_with_orders(spark, sf, duck):
    """Components come from an edge an order at most: all pairs of a nation and day would grow as the square of the orders."""
    from tessera.plans import retrieval

    stars, orders = bindings.bind(spark, sf, retrieval.STARS), duck.sql("select count(*) from orders").fetchall()[0][0]
    assert 0 < stars.count() <= orders
    ends = {r.n for r in stars.selectExpr("explode(array(a, b)) n").distinct().collect()}
    pairs = duck.sql(bindings.plain(retrieval.SPARSE)).fetchall()
    assert ends == {n for a, b, _ in pairs for n in (a, b)}


def test_features_are_made_once_in_tasks_that_lines_ask_for(spark, sf, duck, monkeypatch):
    lines = duck.sql("select count(*) from lineitem").fetchall()[0][0]
    monkeypatch.setattr(bindings, "LINES", 300)
    rows = bindings.features(spark, sf)
    assert rows.rdd.getNumPartitions() == -(-lines // 300) > spark.sparkContext.defaultParallelism
    got = sorted(map(tuple, rows.collect()))
    assert got == sorted(duck.sql(bindings.plain(bindings.FEATURES)).fetchall())


def test_features_of_lines_without_a_part(spark, tmp_path):
    """Against the tables' SQL: a line whose part or order is unknown, a customer without orders, repeated lines."""
    tables = {
        "lineitem": "select * from values (1L, 7L, 3L), (1L, 7L, 3L), (1L, 8L, cast(null as bigint)), (2L, cast(null as bigint), 4L), (9L, 7L, 5L) t(l_orderkey, l_partkey, l_suppkey)",
        "orders": "select * from values (1L, 50L), (2L, 51L), (3L, 52L) t(o_orderkey, o_custkey)",
        "part": "select * from values (7L, 'T', 'B', 5), (6L, 'U', 'C', cast(null as int)) t(p_partkey, p_type, p_brand, p_size)",
        "customer": "select * from values (50L, 'S'), (53L, cast(null as string)) t(c_custkey, c_mktsegment)",
    }
    for name, text in tables.items():
        spark.sql(text).write.parquet(f"{tmp_path}/{name}.parquet")
    rows = lambda df: sorted(map(repr, df.select("entity_id", "feature_id", "axis").collect()))
    assert rows(bindings.features(spark, str(tmp_path))) == rows(bindings.bind(spark, str(tmp_path), bindings.FEATURES))
