"""Base tables: rows under an optional primary key, changed by batches of ordered operations."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.relational import WEIGHT
from tidemark.sources.store import APPEND, KEYED, Scratch, State, Store

INSERT, DELETE, UPDATE, UPSERT = "insert", "delete", "update", "upsert"


@dataclass(frozen=True)
class Operation:
    """row: the values (of an insert, or an upsert where the key is new); key: of a delete, update or upsert; changes: column to a value, or to ("+" or "-", value)."""

    kind: str
    row: Mapping[str, Any] = field(default_factory=dict)
    key: tuple = ()
    changes: Mapping[str, Any] = field(default_factory=dict)


def insert(**row: Any) -> Operation:
    return Operation(INSERT, row)


def delete(*key: Any) -> Operation:
    return Operation(DELETE, key=key)


def update(key: tuple | Any, **changes: Any) -> Operation:
    return Operation(UPDATE, key=key if isinstance(key, tuple) else (key,), changes=changes)


def insert_or_update(row: Mapping[str, Any], **changes: Any) -> Operation:
    return Operation(UPSERT, row, changes=changes)


class BaseTable:
    """Rows, their key columns and columns' defaults. perform() gives the signed rows that a batch amounts to."""

    def __init__(self, spark: SparkSession, name: str, schema: T.StructType | str, key: Sequence[str] = (), defaults: Mapping[str, Any] | None = None, rows: DataFrame | None = None, folder: str | None = None, own: bool = False, state: State | None = None):
        schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.spark, self.name, self.key, self.defaults, self.folder = spark, name, tuple(key), dict(defaults or {}), folder
        if unknown := [c for c in self.key if c not in schema.names]:
            raise ValueError(f"{name} has no columns {unknown}")
        start = spark.createDataFrame([], schema) if rows is None else rows.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema))
        self.store = Store(start, KEYED if self.key else APPEND, self.key, None, folder, own, state=state)

    @property
    def schema(self) -> T.StructType:
        return self.store.state.schema

    @property
    def rows(self) -> DataFrame:
        return self.store.rows

    def _frame(self, operations: Iterable[Operation]) -> tuple[DataFrame, set[str]]:
        """Operations as rows: _seq, _op, the values, and how columns change; and the columns that are added to."""
        out, added = [], set()
        names = self.schema.names
        for i, o in enumerate(operations):
            if o.kind not in (INSERT, DELETE, UPDATE, UPSERT):
                raise ValueError(f"no operation {o.kind}")
            if not self.key and o.kind != INSERT:
                raise ValueError(f"{self.name} has no key: it only takes inserts")
            if unknown := [c for c in [*o.row, *o.changes] if c not in names]:
                raise ValueError(f"{self.name} has no columns {unknown}")
            if o.kind in (DELETE, UPDATE) and len(o.key) != len(self.key):
                raise ValueError(f"the key of {self.name} has {len(self.key)} columns")
            row = {f: o.row.get(f, self.defaults.get(f)) for f in names} if o.kind in (INSERT, UPSERT) else dict.fromkeys(names)
            row |= dict(zip(self.key, o.key, strict=False))
            if any(c in self.key for c in o.changes):
                raise ValueError("a key can't be changed in place")
            change = {c: v if isinstance(v, tuple) else ("=", v) for c, v in o.changes.items()}
            for c, (how, _) in change.items():
                if how not in ("=", "+", "-") or (how != "=" and not isinstance(self.schema[c].dataType, T.NumericType)):
                    raise ValueError(f"{c} can't change by {how}")
                added |= {c} if how != "=" else set()
            out.append((i, o.kind, *row.values(), *(change.get(f, (None, None))[1] for f in names), [change.get(f, ("",))[0] for f in names]))
        schema = T.StructType([T.StructField("_seq", T.LongType()), T.StructField("_op", T.StringType()), *self.schema, *(T.StructField(f"_new_{f.name}", f.dataType) for f in self.schema), T.StructField("_how", T.ArrayType(T.StringType()))])
        return self.spark.createDataFrame(out, schema), added

    def perform(self, operations: Iterable[Operation]) -> DataFrame:
        """Applies the operations in order; returns the signed rows."""
        return self.perform_frame(*self._frame(operations))

    def perform_rows(self, changes: DataFrame) -> DataFrame:
        """Applies changes given as rows with the table's columns, _op and _seq; updates and upserts set all columns but the key."""
        names = self.schema.names
        how = F.array(*(F.lit("" if c in self.key else "=") for c in names))
        value = lambda f: F.col(f"`{f.name}`").cast(f.dataType)
        ops = changes.select(F.col("_seq").cast("long").alias("_seq"), F.lower("_op").alias("_op"), *(value(f).alias(f.name) for f in self.schema), *(value(f).alias(f"_new_{f.name}") for f in self.schema), how.alias("_how"))
        if not self.key:
            return self.perform_frame(ops)
        scratch = Scratch(self.spark, self.folder)
        try:
            return self.perform_frame(scratch.stored(ops))
        finally:
            scratch.clear()

    def perform_frame(self, ops: DataFrame, added: Iterable[str] = ()) -> DataFrame:
        """Applies operations as _frame() makes them, whose rows must be the same each time they are read; added: the columns that are added to or subtracted from."""
        names = [F.col(f"`{c}`") for c in self.schema.names]
        if not self.key:
            change = self.store.write(ops.where(F.col("_op") == INSERT).select(*names, F.lit(1).alias(WEIGHT)))
        else:
            scratch = Scratch(self.spark, self.folder)
            try:
                change = self.store.write(folded(ops, scratch.stored(self.store.under(ops)), self.schema, self.key, set(added)))
            finally:
                scratch.clear()
        self.store.settle()
        return change

    def add_column(self, name: str, kind: T.DataType | str, default: Any = None) -> None:
        """Rows there get the default; so do later rows that don't say."""
        if name in self.schema.names:
            raise ValueError(f"{self.name} has a column {name}")
        self.store.add_column(name, T.StructType.fromDDL(f"`x` {kind}")["x"].dataType if isinstance(kind, str) else kind, default)
        self.defaults = self.defaults | {name: default}

    def drop_column(self, name: str) -> None:
        if name in self.key or name not in self.schema.names:
            raise ValueError(f"{name} is a key or no column of {self.name}")
        self.store.drop_column(name)
        self.defaults.pop(name, None)

    def convert(self, name: str, kind: T.DataType) -> None:
        """Widens a column's type where no value is lost by it; else refuses."""
        old = self.schema[name].dataType
        if name in self.key or not widens(old, kind):
            raise ValueError(f"{self.name}.{name} is {old.simpleString()}: it can't become {kind.simpleString()}")
        self.store.convert(name, kind)


_WHOLE = (T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType())


def widens(old: T.DataType, new: T.DataType) -> bool:
    """Whether each value of the old type is one of the new."""
    if old in _WHOLE and new in _WHOLE:
        return _WHOLE.index(old) <= _WHOLE.index(new)
    if isinstance(new, T.DoubleType):
        return old in (*_WHOLE[:3], T.FloatType())
    if isinstance(new, T.DecimalType):
        digits = {0: 3, 1: 5, 2: 10, 3: 19}
        return old in _WHOLE and new.precision - new.scale >= digits[_WHOLE.index(old)] or (isinstance(old, T.DecimalType) and new.scale >= old.scale and new.precision - new.scale >= old.precision - old.scale)
    return old == new


_START = -(1 << 63)


def folded(ops: DataFrame, old: DataFrame, schema: T.StructType, key: Sequence[str], added: set[str]) -> DataFrame:
    """The signed rows that operations amount to, played in the order of _seq on the old rows of their keys.

    The rows there count as inserts before all others. Of each key, what comes up to its last delete is void; the first insert or upsert after it makes
    the row; of each column, the last setting after that counts, and what is added after that setting. Each of these is an aggregate of a key's
    operations, joined back to them, so no key's operations are ever gathered or sorted.
    """
    names = schema.names
    row = F.struct(*(F.col(f"`{c}`") for c in names))
    k = F.struct(*(F.col(f"`{c}`") for c in key))  # compared as a whole, nulls are equal
    there = old.select(F.lit(_START).cast("long").alias("_seq"), F.lit(INSERT).alias("_op"), *(F.col(f"`{c}`") for c in names), *(F.lit(None).cast(f.dataType).alias(f"_new_{f.name}") for f in schema), F.array().cast("array<string>").alias("_how"))
    every = ops.unionByName(there).withColumn("__k", k)
    seq, at = F.col("_seq"), lambda c: names.index(c)
    first = every.groupBy("__k").agg(F.max(F.when(F.col("_op") == DELETE, seq)).alias("__gone"), F.first(F.when(seq == _START, row), ignorenulls=True).alias("__old"))
    made = every.where(F.col("_op").isin(INSERT, UPSERT)).join(first.select("__k", "__gone"), "__k").where(F.col("__gone").isNull() | (seq > F.col("__gone")))
    made = made.groupBy("__k").agg(F.min(seq).alias("__from"), F.min_by(row, seq).alias("__row"))
    later = every.where(F.col("_op").isin(UPDATE, UPSERT)).join(made.select("__k", "__from"), "__k").where(seq > F.col("__from"))
    values = [c for c in names if c not in key]
    how, new = (lambda c: F.get("_how", at(c))), (lambda c: F.col(f"`_new_{c}`"))
    # a setting in a struct of its own, so that one to null differs from none
    sets = [F.max_by(F.struct(new(c).alias("value"), seq.alias("seq")), F.when(how(c) == "=", seq)).alias(f"__set{at(c)}") for c in values]
    sets = later.groupBy("__k").agg(*sets) if values else later.select("__k").distinct()
    now = made.join(sets, "__k", "left")
    if added:
        after = later.join(sets.select("__k", *(F.col(f"__set{at(c)}.seq").alias(f"__s{at(c)}") for c in added)), "__k")
        sums = []
        for c in added:
            on = how(c).isin("+", "-") & (F.col(f"__s{at(c)}").isNull() | (seq > F.col(f"__s{at(c)}")))
            step = F.when(how(c) == "-", -new(c)).otherwise(new(c))
            sums += [F.sum(F.when(on, step)).alias(f"__add{at(c)}"), F.coalesce(F.bool_or(on & new(c).isNull()), F.lit(False)).alias(f"__void{at(c)}")]
        now = now.join(after.groupBy("__k").agg(*sums), "__k", "left")
    cells = []
    for f in schema:
        x = F.col("__row").getField(f.name)
        if f.name in values:
            i = at(f.name)
            x = F.when(F.col(f"__set{i}.seq").isNotNull(), F.col(f"__set{i}.value")).otherwise(x)
            if f.name in added:
                x = F.when(F.coalesce(f"__void{i}", F.lit(False)), None).otherwise(F.when(F.col(f"__add{i}").isNull(), x).otherwise((x + F.col(f"__add{i}")).cast(f.dataType)))
        cells.append(x.cast(f.dataType).alias(f.name))
    now = now.select("__k", F.struct(*cells).alias("__now"))
    both = first.join(now, "__k", "left").where(~F.col("__old").eqNullSafe(F.col("__now")))
    side = lambda c, w: F.struct(F.col(c).alias("row"), F.lit(w).cast("long").alias("w"))
    return both.select(F.explode(F.array(side("__old", -1), side("__now", 1))).alias("x")).where("x.row IS NOT NULL").select("x.row.*", F.col("x.w").alias(WEIGHT))
