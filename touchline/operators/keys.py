"""Keys and references found in the data itself, where no catalogue declares them.

*Unique keys*: sets of columns go up a lattice.  A set is looked at only if no part of it is a key already
and the distinct counts of its columns could multiply to as many values as there are rows; all sets of a
size that are left are then sketched in one pass, and only those whose sketch is near the number of rows
are counted exactly.

*References*: a column can be included in another only if its least and greatest value lie between the other's;
columns in no such pair are not looked at.  One grouped pass a kind over the others' values finds, of each
value, the columns that hold it, as bits of whole numbers; how many values two columns share comes from
counting pairs of columns in those sets, never from joining columns with each other.  A column whose every
value another one holds is included in it, and refers to it if that is a key of its table.

Defined results: columns with nulls are no part of a key; nulls do not count as values; whole numbers of
any width compare with each other, texts with texts, other types with their like; floating point columns
are left out; a table without rows has no keys, and a column without values refers to nothing.
"""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence
from itertools import combinations
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DataType, DateType, DecimalType, DoubleType, FloatType, IntegralType, StringType, TimestampNTZType, TimestampType

#: Sets that are sketched in one pass, the sketch's relative deviation, and how many of those a count may be off.
AT_ONCE, DEVIATION, MARGIN = 100, 0.02, 5
#: Columns that one whole number has bits for, and types whose values are compared as they are.
BITS = 63
NATIVE = (StringType, DateType, TimestampType, TimestampNTZType, DecimalType, BooleanType, BinaryType)


def usable(table: DataFrame) -> list[str]:
    return [f.name for f in table.schema if not isinstance(f.dataType, (DoubleType, FloatType)) and f.dataType.simpleString()[:3] not in ("map", "arr", "str") or isinstance(f.dataType, StringType)]


def _sketched(table: DataFrame, sets: Sequence[tuple[str, ...]]) -> dict[tuple[str, ...], int]:
    out: dict[tuple[str, ...], int] = {}
    for at in range(0, len(sets), AT_ONCE):
        some = sets[at : at + AT_ONCE]
        row = table.agg(*[F.approx_count_distinct(F.xxhash64(*s), DEVIATION).alias(f"c{i}") for i, s in enumerate(some)]).head()
        out |= dict(zip(some, row, strict=True))
    return out


def unique_keys(table: DataFrame, most: int = 2) -> list[tuple[str, ...]]:
    """The smallest sets of at most ``most`` columns whose values tell all rows apart."""
    columns = usable(table)
    if not columns:
        return []
    n, *nulls = table.agg(F.count("*"), *[F.count_if(F.col(c).isNull()) for c in columns]).head()
    columns = [c for c, k in zip(columns, nulls, strict=True) if not k]
    if not n:
        return []
    high = 1 + MARGIN * DEVIATION
    single = _sketched(table, [(c,) for c in columns])
    keys: list[tuple[str, ...]] = []
    for size in range(1, most + 1):
        sets = [s for s in combinations(columns, size) if not any(set(k) <= set(s) for k in keys) and prod(single[(c,)] * high for c in s) >= n]
        near = [s for s, d in (single if size == 1 else _sketched(table, sets)).items() if s in sets and d * high >= n]
        keys += [s for s in near if not table.groupBy(*s).agg(F.count("*").alias("n")).where("n > 1").head(1)]
    return keys


def _kind(t: DataType) -> str:
    return "whole" if isinstance(t, IntegralType) else t.simpleString()


def _value(name: str, t: DataType) -> Column:
    """The column in the one type that all columns of its kind are compared in."""
    if isinstance(t, IntegralType):
        return F.col(name).cast("long")
    return F.col(name) if isinstance(t, NATIVE) else F.col(name).cast("string")


def _bounds(table: DataFrame) -> dict[str, tuple]:
    """Of each usable column that has values: its kind, and the least and the greatest value, or none where they are not compared."""
    columns = usable(table)
    if not columns:
        return {}
    kinds = {c: _kind(table.schema[c].dataType) for c in columns}
    number = {"whole": lambda c: c.cast("long"), "string": lambda c: c, "date": F.unix_date, "timestamp": F.unix_micros}
    asked = [f(number[kinds[c]](F.col(c))) if kinds[c] in number else F.lit(None) for c in columns for f in (F.min, F.max)]
    row = table.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(columns)], *[x.alias(f"b{i}") for i, x in enumerate(asked)]).head()
    ends = row[len(columns) :]
    return {c: (kinds[c], *ends[2 * i : 2 * i + 2]) for i, c in enumerate(columns) if row[i]}


def _may_hold(parent: tuple, child: tuple) -> bool:
    return parent[0] == child[0] and (parent[1] is None or parent[1] <= child[1] and child[2] <= parent[2])


def _sets(tables: Mapping[str, DataFrame], columns: Sequence[str]) -> DataFrame:
    """(columns, n): how many values exactly these of ``columns``, which are of one kind, hold."""
    masks = [f"m{i}" for i in range(-(-len(columns) // BITS))]
    each = None
    for name, table in tables.items():
        cells = []
        for at, c in enumerate(columns):
            if c.startswith(f"{name}.") and c[len(name) + 1 :] in table.columns:
                own = c[len(name) + 1 :]
                bits = [F.lit(1 << at % BITS if i == at // BITS else 0).cast("long").alias(m) for i, m in enumerate(masks)]
                cells.append(F.struct(_value(own, table.schema[own].dataType).alias("value"), *bits))
        if cells:
            part = table.select(F.explode(F.array(*cells)).alias("x")).select("x.*").where("value is not null")
            each = part if each is None else each.unionByName(part)
    held = each.groupBy("value").agg(*[F.bit_or(m).alias(m) for m in masks])  # numbers only: a hash aggregate, partial before the shuffle
    names = [F.when(F.col(masks[at // BITS]).bitwiseAND(F.lit(1 << at % BITS).cast("long")) != 0, F.lit(c)) for at, c in enumerate(columns)]
    return held.groupBy(*masks).agg(F.count("*").alias("n")).select(F.array_compact(F.array(*names)).alias("columns"), "n")


def inclusions(tables: Mapping[str, DataFrame], parents: Collection[str] | None = None) -> DataFrame:
    """(child, parent, n): columns, as table.column, all of whose n distinct values another one, of ``parents`` if given, holds."""
    bounds = {f"{name}.{c}": b for name, table in tables.items() for c, b in _bounds(table).items()}
    pairs = [(child, parent) for parent in bounds if parents is None or parent in parents for child in bounds if child != parent and _may_hold(bounds[parent], bounds[child])]
    sets = None
    for kind in sorted({bounds[c][0] for c, _ in pairs}):
        part = _sets(tables, [c for c in bounds if bounds[c][0] == kind and any(c in p for p in pairs)])
        sets = part if sets is None else sets.unionByName(part)
    spark = next(iter(tables.values())).sparkSession
    if sets is None:
        return spark.createDataFrame([], "child string, parent string, n long")
    both = sets.select("n", F.explode("columns").alias("child"), "columns").select("n", "child", F.explode("columns").alias("parent"))
    shared = both.groupBy("child", "parent").agg(F.sum("n").alias("n"))
    asked = F.broadcast(spark.createDataFrame(pairs, "child string, parent string"))
    # of all pairs those that were asked for; a column with itself gives its own number of values
    own = F.max(F.when(F.col("child") == F.col("parent"), F.col("n"))).over(Window.partitionBy("child"))
    return shared.withColumn("own", own).where("child <> parent and n = own").join(asked, ["child", "parent"], "left_semi").select("child", "parent", "n")


def references(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """(child, parent, n): inclusions in a column that is a key of its table by itself."""
    return inclusions(tables, {f"{name}.{k[0]}" for name, table in tables.items() for k in unique_keys(table, 1)})


def catalogue_tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    """(name, kind, columns) of what the session's catalogue lists in a database."""
    rows = []
    for t in spark.catalog.listTables(database or spark.catalog.currentDatabase()):
        named = t.name if t.isTemporary or not t.namespace else ".".join([*t.namespace, t.name])
        rows.append((t.name, t.tableType, len(spark.catalog.listColumns(named))))
    return spark.createDataFrame(rows, "name string, kind string, columns int")
