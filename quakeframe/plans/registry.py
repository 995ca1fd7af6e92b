"""Registry of queries: a function of (spark, sf_dir), and SQL over the same stand-in tables where SQL can say it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeframe.functions.numeric import Num, col

Query = Callable[[SparkSession, str], DataFrame]

#: Stand-ins for the engine's tables, as SQL that Spark and DuckDB both run over the test tables. A base table is named in braces.
STANDINS = {
    "station": "select s_suppkey as sta, concat('N', cast(s_nationkey % 7 as varchar(9))) as net, cast(-10 + (s_suppkey * 37 % 700) / 10.0 as double) as lat, cast(60 + (s_suppkey * 53 % 900) / 10.0 as double) as lon, cast(s_acctbal as double) as elev from {supplier}",
    "evt": "select o_orderkey as event_id, cast(-10 + (o_orderkey * 31 % 700) / 10.0 as double) as lat, cast(60 + (o_orderkey * 17 % 900) / 10.0 as double) as lon, cast(o_orderkey * 13 % 700 as double) as depth, cast(5.0 + (o_orderkey * 7 % 26) / 10.0 as double) as mag, o_orderdate as t, cast(extract(year from o_orderdate) as int) as year from {orders}",
    "vox": "select cast(m as int) as m, cast(p_partkey % 20 as int) as ilat, cast(cast(floor(p_partkey / 20) as int) % 20 as int) as ilon, cast(cast(floor(p_partkey / 400) as int) * 100 as double) as depth, cast(case when (p_partkey + m) % 17 = 0 then null else 3.5 + 0.0004 * cast(floor(p_partkey / 400) as int) * 100 + ((p_partkey * (7 * m + 3)) % 100) / 1000.0 end as double) as v from {part} cross join (select 0 as m union all select 1 union all select 2) k",
    "meas": "select cast(l_orderkey % 30 as int) as event, l_returnflag as model, l_suppkey as sta, l_linestatus as band, l_linenumber as phase, cast(l_discount as double) as nz, cast(l_tax as double) as w, l_orderkey as k, cast(l_quantity as double) as q from {lineitem}",
    "validity": "select o_orderkey as id, o_custkey as grp, cast(o_orderdate as date) as s, case when o_orderkey % 5 = 0 then null else cast(o_orderdate as date) + interval 30 day end as e from {orders}",
    "li": "select * from {lineitem}",
    "ord": "select * from {orders}",
    "ev": "select * from {events}",
    "emb": "select * from {embeddings}",
    "cust": "select * from {customer}",
}

#: A division in that SQL: DuckDB divides doubles where Spark divides decimals, and thresholds tell the two apart.
DIVISOR = re.compile(r"/ (\d+\.\d+)\b")

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stand-in table, its numbers divided as doubles."""
    base = set(re.findall(r"{(\w+)}", STANDINS[name]))
    return spark.sql(DIVISOR.sub(r"/ \1D", STANDINS[name]), **{b: spark.read.parquet(f"{sf_dir}/{b}.parquet") for b in base})


def query(sql: str | None = None) -> Callable[[Callable], Callable]:
    """Register a function of a table getter; the SQL names stand-ins as tables."""
    def wrap(f: Callable[[Callable[[str], DataFrame]], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            get = lambda name: table(spark, sf_dir, name)
            get.spark, get.sf_dir = spark, sf_dir
            return f(get)

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql is not None:
            used = [n for n in STANDINS if re.search(rf"\b{n}\b", sql)]
            views = ", ".join(f"{n} as ({STANDINS[n].replace('{', '').replace('}', '')})" for n in used)
            head = re.match(r"\s*with( recursive)?\s", sql)
            ORACLE[f.__name__] = f"with{head[1] or ''} {views}, {sql[head.end():].strip()}" if head else f"with {views} {sql.strip()}"
        return run

    return wrap


def r(x: Num, digits: int = 6) -> Column:
    """A rounded double that is never negative zero."""
    return F.round(col(x).cast("double"), digits) + F.lit(0.0)


def n(x: Num) -> Column:
    return col(x).cast("long")
