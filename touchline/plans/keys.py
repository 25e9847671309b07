"""Queries that find keys and references in the star tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession

from ..operators import keys as ky
from ..sources.tables import table
from .registry import query

#: The star tables' columns but for floating point ones: whole numbers, texts, times.
STAR = {
    "region": ("r_regionkey", "r_name"),
    "nation": ("n_nationkey", "n_name", "n_regionkey"),
    "customer": ("c_custkey", "c_name", "c_nationkey", "c_mktsegment"),
    "supplier": ("s_suppkey", "s_name", "s_nationkey"),
    "part": ("p_partkey", "p_name", "p_brand", "p_type", "p_size"),
    "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"),
    "lineitem": ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate"),
    "events": ("event_id", "ts", "user_id", "event_type", "props"),
}


def star(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {name: table(spark, sf_dir, name) for name in STAR}


def _count(name: str, columns: tuple[str, ...]) -> str:
    some = ", ".join(columns)
    value = some if len(columns) == 1 else f"({some})"
    return f"SELECT '{name}' AS name, '{','.join(columns)}' AS columns, '{columns[0]}' AS one, '{columns[-1]}' AS two, count(DISTINCT {value}) = count(*) AND count(*) > 0 AND count(*) FILTER ({' IS NULL OR '.join(columns)} IS NULL) = 0 AS tells FROM {name}"


_SINGLE = " UNION ALL ".join(_count(t, (c,)) for t, cs in STAR.items() for c in cs)
_PAIRS = " UNION ALL ".join(_count(t, p) for t, cs in STAR.items() for p in combinations(cs, 2))


@query(
    f"""WITH s AS ({_SINGLE}), p AS ({_PAIRS})
SELECT name, columns FROM s WHERE tells UNION ALL SELECT name, columns FROM p WHERE tells AND NOT EXISTS (SELECT 1 FROM s WHERE s.tells AND s.name = p.name AND s.one IN (p.one, p.two))"""
)
def keys_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smallest keys, of one or two columns, of all star tables."""
    found = [(name, ",".join(k)) for name, t in star(spark, sf_dir).items() for k in ky.unique_keys(t)]
    return spark.createDataFrame(found, "name string, columns string")


_TYPED = {c: "time" if c in ("o_orderdate", "l_shipdate", "ts") else "text" if c in ("r_name", "n_name", "c_name", "c_mktsegment", "s_name", "p_name", "p_brand", "p_type", "o_orderstatus", "o_orderpriority", "l_returnflag", "l_linestatus", "event_type", "props") else "whole" for cs in STAR.values() for c in cs}
_VALUES = " UNION ALL ".join(f"SELECT DISTINCT '{t}.{c}' AS c, '{_TYPED[c]}' AS kind, CAST({c} AS VARCHAR) AS v FROM {t} WHERE {c} IS NOT NULL" for t, cs in STAR.items() for c in cs)


@query(
    f"""WITH s AS ({_SINGLE}), v AS ({_VALUES}), n AS (SELECT c, count(*) AS n FROM v GROUP BY c),
x AS (SELECT a.c AS child, b.c AS parent, count(*) AS n FROM v a JOIN v b ON a.kind = b.kind AND a.v = b.v AND a.c <> b.c GROUP BY ALL)
SELECT child, parent, x.n FROM x JOIN n ON n.c = child AND n.n = x.n WHERE parent IN (SELECT name || '.' || columns FROM s WHERE tells)"""
)
def keys_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns all of whose values a key of some table holds."""
    return ky.references(spark, star(spark, sf_dir))
