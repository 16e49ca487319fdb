"""Registration of a query with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinwork.plans.views import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of digits, so that the order of a sum doesn't show; never minus zero."""
    return df.select(*((F.round(F.col(f"`{c}`"), digits) + 0.0).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes))


def query(name: str, views: str, sql: str | None = None):
    """Register f(view frames...) under name; sql: the oracle over the same views."""
    names = views.split()

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(*(view(spark, sf_dir, v) for v in names)))
        if sql:
            ORACLES[name] = with_views(sql.strip(), *names)
        return f

    return add


#: The driver's tables, as far as the views read them, to learn the types of an oracle's columns.
SCHEMA = """
create table events (event_id bigint, ts timestamp, user_id bigint, event_type varchar, value double, props varchar);
create table part (p_partkey bigint, p_name varchar, p_brand varchar, p_type varchar, p_size integer, p_retailprice double);
create table lineitem (l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber integer, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag varchar, l_linestatus varchar, l_shipdate timestamp);
create table orders (o_orderkey bigint, o_custkey bigint, o_orderstatus varchar, o_totalprice double, o_orderdate timestamp, o_orderpriority varchar);
create table customer (c_custkey bigint, c_name varchar, c_nationkey integer, c_acctbal double, c_mktsegment varchar);
create table embeddings (vec_id bigint, embedding float[], label integer);
"""


def oracles() -> dict[str, str]:
    """The oracles with their doubles rounded as rounded() does, and sums of whole numbers as bigint."""
    try:
        import duckdb
    except ImportError:
        return dict(ORACLES)
    con, out = duckdb.connect(), {}
    con.execute(SCHEMA)
    for name, sql in ORACLES.items():
        columns = []
        for row in con.execute(f"describe {sql}").fetchall():
            c, kind = f'"{row[0]}"', row[1]
            real = kind in ("DOUBLE", "FLOAT") or kind.startswith("DECIMAL")
            columns.append(f"round({c}::double, 6) + 0e0 as {c}" if real else f"{c}::bigint as {c}" if kind == "HUGEINT" else c)
        out[name] = f"select {', '.join(columns)} from ({sql})"
    return out
