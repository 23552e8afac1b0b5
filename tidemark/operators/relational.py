"""The view engine's operators as DataFrame functions. A weight column, where a frame has one, passes through the row-wise ones."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.values import arithmetic, compare

#: Signed rows carry their multiplicity here: positive adds, negative revokes.
WEIGHT = "_w"


@dataclass(frozen=True)
class Compare:
    """column op value, or column op other for two columns of one row; against None, = and != ask for null."""

    column: str
    op: str
    value: Any = None
    other: str | None = None

    def expression(self) -> Column:
        left = F.col(self.column)
        if self.other is not None:
            return compare(left, self.op, F.col(self.other))
        if self.value is None and self.op in ("=", "!="):
            return left.isNull() if self.op == "=" else left.isNotNull()
        return compare(left, self.op, F.lit(self.value))


@dataclass(frozen=True)
class In:
    column: str
    values: tuple

    def expression(self) -> Column:
        return F.col(self.column).isin(list(self.values))


Condition = Compare | In | Column


def all_of(conditions: Sequence[Condition]) -> Column:
    return reduce(lambda a, b: a & b, (c if isinstance(c, Column) else c.expression() for c in conditions), F.lit(True))


def filter_rows(df: DataFrame, *conditions: Condition) -> DataFrame:
    """Rows for which all conditions hold."""
    return df.filter(all_of(conditions))


def project(df: DataFrame, columns: Sequence[str] = (), expressions: Mapping[str, Column | tuple] | None = None, literals: Mapping[str, Any] | None = None) -> DataFrame:
    """Columns, then expressions (Columns or (left, operator, right)), then literals."""
    made = [(e if isinstance(e, Column) else arithmetic(*e)).alias(n) for n, e in (expressions or {}).items()]
    fixed = [F.lit(v).alias(n) for n, v in (literals or {}).items()]
    return df.select(*columns, *made, *fixed, *([WEIGHT] if WEIGHT in df.columns and WEIGHT not in columns else []))


def join(left: DataFrame, right: DataFrame, on: Sequence[str | tuple[str, str]], how: str = "inner") -> DataFrame:
    """Equi-join on pairs of columns; the right side's keys are left out. Null keys match nothing."""
    pairs = [(o, o) if isinstance(o, str) else o for o in on]
    marked = right.select(*(F.col(r).alias(f"__key{i}") for i, (_, r) in enumerate(pairs)), *(c for c in right.columns if c not in {r for _, r in pairs}))
    condition = reduce(lambda a, b: a & b, (left[a] == marked[f"__key{i}"] for i, (a, _) in enumerate(pairs)))
    return left.join(marked, condition, how).drop(*(f"__key{i}" for i in range(len(pairs))))


@dataclass(frozen=True)
class Aggregate:
    """count, sum, min, max or group_concat, under a name.

    over: a column, or None for count(*); distinct: each value once; where and otherwise: rows that fail the condition count as the literal, or not at all;
    for group_concat, pieces are column names and Columns in a row, and the distinct strings are joined in order.
    """

    kind: str
    name: str
    over: str | Column | None = None
    distinct: bool = False
    where: Condition | None = None
    otherwise: Any = None
    null_as_zero: bool = False
    pieces: tuple = ()
    separator: str = ","

    def value(self) -> Column:
        x = F.lit(1) if self.over is None else F.col(self.over) if isinstance(self.over, str) else self.over
        if self.where is not None:
            x = F.when(all_of([self.where]), x)
            if self.otherwise is not None:
                x = x.otherwise(F.lit(self.otherwise))
        return x

    def expression(self) -> Column:
        x = self.value()
        if self.kind == "count":
            out = F.count_distinct(x) if self.distinct else F.count(x)
        elif self.kind == "sum":
            out = F.sum_distinct(x) if self.distinct else F.sum(x)
            out = F.coalesce(out, F.lit(0)) if self.null_as_zero else out
        elif self.kind in ("min", "max"):
            out = getattr(F, self.kind)(x)
        elif self.kind == "group_concat":
            parts = [p if isinstance(p, Column) else F.col(p).cast("string") for p in (self.pieces or (self.over,))]
            out = F.array_join(F.array_sort(F.collect_set(F.concat(*parts))), self.separator)
        else:
            raise ValueError(f"no aggregate {self.kind}")
        return out.alias(self.name)

    @property
    def linear(self) -> bool:
        """Whether a change of rows changes the value by a sum over the changed rows."""
        return self.kind in ("count", "sum") and not self.distinct


def aggregate(df: DataFrame, by: Sequence[str], *aggregates: Aggregate) -> DataFrame:
    """One row a group; without groups, one row for all."""
    return df.groupBy(*by).agg(*(a.expression() for a in aggregates))


def _order(order: Sequence[tuple[str, bool]]) -> list[Column]:
    return [F.col(c).asc_nulls_first() if ascending else F.col(c).desc_nulls_last() for c, ascending in order]


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[tuple[str, bool]], k: int) -> DataFrame:
    """The first k rows of each group by (column, ascending) pairs; without groups, of all."""
    if not by:
        return df.orderBy(*_order(order)).limit(k)
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*by).orderBy(*_order(order))))
    return ranked.where(F.col("__rank") <= k).drop("__rank")


def latest(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each key that is last by the order columns: a partial aggregate, without sorting groups."""
    rows = df.groupBy(*(F.col(c).alias(f"__k{i}") for i, c in enumerate(key))).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("__row"))
    return rows.select("__row.*")


def union(*parents: DataFrame | tuple[DataFrame, Sequence[str]]) -> DataFrame:
    """Bag union of the parents, each with columns of its own choice, matched by name."""
    return reduce(DataFrame.unionByName, (p if isinstance(p, DataFrame) else p[0].select(*p[1]) for p in parents))


def distinct(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Each combination of the columns once."""
    return df.select(*by).distinct()


def identity(df: DataFrame) -> DataFrame:
    return df


def rewrite(df: DataFrame, signal: DataFrame, column: str, value: Any, key: str, signal_key: str | None = None) -> DataFrame:
    """column becomes value in rows whose key is in the signal."""
    keys = signal.select(F.col(signal_key or key).alias("__signal")).where("__signal IS NOT NULL").distinct()
    changed = F.when(F.col("__signal").isNotNull(), F.lit(value)).otherwise(F.col(column))
    return df.join(keys, df[key] == F.col("__signal"), "left").withColumn(column, changed).select(*df.columns)


def trigger(batch: DataFrame, seen: DataFrame, key: str, event: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """Keys of the batch that were not seen before, each once; event is called with them."""
    new = batch.select(key).where(F.col(key).isNotNull()).distinct().join(seen.select(key), key, "left_anti")
    if event is not None:
        event(new)
    return new


def shard(df: DataFrame, shards: int, column: str) -> DataFrame:
    """Rows dealt out by a hash of the column."""
    return df.repartition(shards, column)
