"""The view engine: base tables, views over them kept current by their changes, keyed reads, live change of views and tables, recovery."""

from __future__ import annotations

import itertools
from collections import OrderedDict
from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.delta import MaintainedView, Node, difference
from tidemark.operators.relational import WEIGHT
from tidemark.plans.recipe import Definition, Recipe, Select, Statement, single_aggregate
from tidemark.sources.base import BaseTable, Operation
from tidemark.sources.store import BAG, KEYED, Files, Scratch, State, Store, consolidated, load, matching, place, save, signed, stored

_NUMBERS = itertools.count()
NONE, FULL, PARTIAL = "none", "full", "partial"
#: Keys of one column that a read may name in a filter.
FILTERED_KEYS = 200
#: Fillings of a partial view that are kept apart; with more they are written into one.
FILLINGS = 8


def bound(spark: SparkSession, sql: str, tables: Mapping[str, DataFrame], names: Iterable[str]) -> DataFrame:
    """sql over the given tables, planned by Spark; names: those that it may mention."""
    used = [n for n in tables if n.lower() in {x.lower() for x in names}]
    views = {n: f"__tidemark_{next(_NUMBERS)}" for n in used}
    for n, v in views.items():
        tables[n].createOrReplaceTempView(v)
    try:
        with_ = ", ".join(f"`{n}` AS (SELECT * FROM {v})" for n, v in views.items())
        return spark.sql(f"WITH {with_} {sql}" if with_ else sql)
    finally:
        for v in views.values():
            spark.catalog.dropTempView(v)


def unique(df: DataFrame) -> DataFrame:
    """df with a number at the end of names that stood before."""
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        seen[c.lower()] = n = seen.get(c.lower(), 0) + 1
        names.append(c if n == 1 else f"{c}_{n}")
    return df.toDF(*names)


def _of(tables: Mapping[str, DataFrame], name: str) -> DataFrame | None:
    return next((tables[t] for t in tables if t.lower() == name.lower()), None)


class Sums:
    """Aggregates of groups that new rows follow from, given the change of the input: COUNT, whole or decimal SUM, MIN and MAX.

    by: group columns and their expressions. calls: (column, kind, argument) of the others. Beside them are stored the number of the group's rows (__agg_n) and of those
    with a value for each sum. A group has to be looked at again only if a row that held its minimum or maximum went and no new row takes its place.
    """

    def __init__(self, by: Mapping[str, str], calls: Sequence[tuple[str, str, str]], copies: Mapping[str, str]):
        self.by, self.calls, self.copies = dict(by), list(calls), dict(copies)
        self.more = ["COUNT(*) AS __agg_n", *(f"COUNT({x}) AS __agg_{i}" for i, (_, kind, x) in enumerate(self.calls) if kind == "sum")]
        self.arguments = {f"__x{i}": x for i, (_, _, x) in enumerate(self.calls) if x != "*"}
        self.extremes = [(i, c, kind) for i, (c, kind, _) in enumerate(self.calls) if kind in ("min", "max")]

    def exact(self, moves: DataFrame) -> bool:
        """Whether a value times a weight keeps all its places."""
        values = [f"__x{i}" for i, (_, kind, _) in enumerate(self.calls) if kind == "sum"]
        products = moves.select(*((F.col(x) * F.col(WEIGHT)).alias(x) for x in values)).schema
        return all(not isinstance(f.dataType, T.DecimalType) or f.dataType.scale == moves.schema[f.name].dataType.scale for f in products)

    def gathered(self, moves: DataFrame) -> DataFrame:
        """One row for each group that the moves touch: what they add to counts and sums, and the extremes among what came and what went."""
        w, out = F.col(WEIGHT), [F.sum(WEIGHT).alias("__n")]
        for i, (_, kind, x) in enumerate(self.calls):
            v = F.col(f"__x{i}") if x != "*" else F.lit(1)
            if kind in ("count", "sum"):
                out.append(F.sum(F.when(v.isNotNull(), w).otherwise(0)).alias(f"__c{i}"))
            if kind == "sum":
                out.append(F.sum(v * w).alias(f"__s{i}"))
            elif kind in ("min", "max"):
                most = F.max if kind == "max" else F.min
                out += [most(F.when(w > 0, v)).alias(f"__in{i}"), most(F.when(w < 0, v)).alias(f"__out{i}")]
        return consolidated(moves).groupBy(*(F.col(f"`{c}`") for c in self.by)).agg(*out)

    def merged(self, gathered: DataFrame, old: DataFrame) -> DataFrame:
        """Old and new row of each group, null where there's none, and whether the group must be looked at again."""
        kinds = old.schema
        before = old.select(*(F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(self.by)), F.struct(*(F.col(f"`{c}`") for c in old.columns)).alias("__old"))
        on = reduce(lambda a, b: a & b, (gathered[f"`{c}`"].eqNullSafe(before[f"__k{i}"]) for i, c in enumerate(self.by)))
        was = lambda c: F.col("__old").getField(c)
        values, again = {}, F.lit(False)
        for i, (c, kind, _) in enumerate(self.calls):
            if kind == "count":
                values[c] = F.coalesce(was(c), F.lit(0)) + F.col(f"__c{i}")
            elif kind == "sum":
                values[f"__agg_{i}"] = some = F.coalesce(was(f"__agg_{i}"), F.lit(0)) + F.col(f"__c{i}")
                values[c] = F.when(some > 0, F.coalesce(was(c) + F.col(f"__s{i}"), was(c), F.col(f"__s{i}")))
            else:
                came, went, top = F.col(f"__in{i}"), F.col(f"__out{i}"), F.greatest if kind == "max" else F.least
                values[c] = F.when(was(c).isNull(), came).when(came.isNull(), was(c)).otherwise(top(was(c), came))
                at = (lambda a, b: a >= b) if kind == "max" else (lambda a, b: a <= b)
                again |= F.coalesce(at(went, was(c)), F.lit(False)) & ~F.coalesce(at(came, was(c)), F.lit(False))
        values["__agg_n"] = F.coalesce(was("__agg_n"), F.lit(0)) + F.col("__n")
        values |= {c: F.col(f"`{c}`") for c in self.by} | {c: F.col(f"`{of}`") for c, of in self.copies.items()}
        new = F.when(values["__agg_n"] > 0, F.struct(*(values[f.name].cast(f.dataType).alias(f.name) for f in kinds)))
        return gathered.join(before, on, "left").select("__old", new.alias("__new"), (again & (values["__agg_n"] > 0)).alias("__again"))

    @staticmethod
    def signed(merged: DataFrame) -> DataFrame:
        """The signed rows of groups that changed."""
        rows = [F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("row"), F.lit(w).cast("long").alias(WEIGHT))) for c, w in (("__old", -1), ("__new", 1))]
        return merged.where(~F.col("__old").eqNullSafe(F.col("__new"))).select(F.inline(F.array_compact(F.array(*rows)))).select("row.*", WEIGHT)


class Filling:
    """Rows of the keys that a partial view was asked for at one time; those of live keys count."""

    def __init__(self, rows: DataFrame, path: str, keys: Iterable[tuple], size: int):
        self.rows, self.path, self.live, self.size = rows, path, set(keys), size
        self.first = len(self.live)


class View:
    """A named result. materialize: none (computed when read), full (stored, kept by changes) or partial (stored for keys that were read).

    names: what the plan calls its inputs, where that isn't the engine's own name for them. A partial view forgets the keys read longest ago
    when there are more than most_keys, or when what is stored comes to more than most_bytes.
    """

    def __init__(self, engine: Engine, name: str, plan: Select | Node, materialize: str, public: bool = True, most_keys: int = 10_000, most_bytes: int | None = None, names: Mapping[str, str] | None = None, states: Sequence[State] | None = None):
        self.engine, self.name, self.plan, self.materialize, self.public, self.most_keys, self.most_bytes, self.names = engine, name, plan, materialize, public, most_keys, most_bytes, dict(names or {})
        self.keys = [f"__key{i}" for i in range(len(plan.parameters))] if isinstance(plan, Select) else []
        self.maintained: MaintainedView | None = None
        self.sums: Sums | None = None
        self.store: Store | None = None
        self.filled: OrderedDict[tuple, Filling] = OrderedDict()
        known = [*(self.names or [n for n in engine.names() if n != name])]
        own = plan.sources() if isinstance(plan, Node) else {t for t in known if t.lower() in {w.lower() for w in plan.words()}}
        self.inputs = {t: self.names.get(t, t) for t in own}
        self.sources = set(self.inputs.values())
        tables = self._seen(engine.frames(self.sources))
        if isinstance(plan, Node):
            self.maintained = MaintainedView(plan, tables, engine.folder, states)
            self.plain = self.maintained.rows
        else:
            self.plain = self._compute(tables)
            if materialize == FULL:
                self.sums = self._sums()
                group = list(self.sums.by) if self.sums is not None else []
                if self.sums is not None:
                    self.plain = self._compute(tables)
                self.store = Store(self.plain, KEYED if group else BAG, group, self.keys or group, engine.folder, own=True, state=states[0] if states else None)

    def stores(self) -> list[Store]:
        return self.maintained.stores() if self.maintained is not None else [self.store] if self.store is not None else []

    def _seen(self, tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
        """The engine's tables by the names that the plan has for them."""
        return {t: tables[n] for t, n in self.inputs.items() if n in tables}

    def compute(self, tables: Mapping[str, DataFrame]) -> DataFrame:
        """All rows over tables by the engine's names, without what is stored beside them."""
        out = self._compute(self._seen(tables))
        return out.drop(*(c for c in out.columns if c.startswith("__agg")))

    def _compute(self, seen: Mapping[str, DataFrame]) -> DataFrame:
        return unique(bound(self.engine.spark, self.plan.sql(self.sums.more if self.sums is not None else (), ordered=True), seen, self.inputs))

    def same_as(self, other: View) -> bool:
        """Whether both have the same text, or Spark's optimiser makes the same plan of both."""
        if self.names == other.names and [t.text for t in self.plan.tokens] == [t.text for t in other.plan.tokens]:
            return True
        mine, theirs = (v.plain._jdf.queryExecution().optimizedPlan() for v in (self, other))
        return bool(mine.sameResult(theirs))

    @property
    def rows(self) -> DataFrame:
        """All rows, with the columns of the key and of the order."""
        if self.maintained is not None:
            return self.maintained.rows
        if self.store is None:
            return self.compute(self.engine.frames(self.sources))
        out = self.store.rows
        return out.drop(*(c for c in out.columns if c.startswith("__agg")))

    @property
    def columns(self) -> list[str]:
        return [c for c in self.plain.columns if not c.startswith(("__key", "__ord", "__agg"))]

    def _shown(self, rows: DataFrame) -> DataFrame:
        """The view's own columns, in the order that its SQL asks for."""
        if isinstance(self.plan, Select) and (order := self.plan.order):
            last = [c for c in rows.columns if c.startswith("__ord")]
            at = last or [x.split(".")[-1].strip("`") for x, _ in order]
            if all(c in rows.columns for c in at):
                rows = rows.orderBy(*(F.col(f"`{c}`").desc_nulls_last() if d.upper().startswith("DESC") else F.col(f"`{c}`").asc_nulls_first() for c, (_, d) in zip(at, order, strict=True)))
        return rows.select(*(F.col(f"`{c}`") for c in self.columns))

    # changes

    def take(self, before: Mapping[str, DataFrame], after: Mapping[str, DataFrame], changes: Mapping[str, DataFrame], read: bool = True) -> DataFrame | None:
        """Takes in changes of sources; returns the own signed rows, if these are stored or somebody reads the view."""
        before, after, changes = self._seen(before), self._seen(after), self._seen(changes)
        if self.maintained is not None:
            return self.maintained.apply(before, after, changes)
        if self.store is not None:
            out = self.store.write(self._change(before, after, changes))
            self.store.settle()
            return out
        if self.materialize == PARTIAL:
            self._forget(before, after, changes)
        return self.engine.scratch.stored(self._change(before, after, changes)) if read else None

    def _change(self, before, after, changes) -> DataFrame:
        """Signed rows: by the changes alone for joins of tables and their UNION ALL, by the touched groups where they are among the columns, else by comparison."""
        plan, names = self.plan, self.plain.columns
        if plan.compound:
            branches = plan.branches()
            if branches is not None and not any(b.aggregates or b.distinct for b in branches):
                parts = [self._moves(b, before, after, changes, None) for b in branches]
                if all(p is not None for p in parts):
                    return consolidated(reduce(DataFrame.unionAll, (p.toDF(*names, WEIGHT) for p in parts)))
        elif not (any(plan.limits) and not self.keys):
            if not plan.aggregates and not plan.distinct and not any(plan.limits):
                found = self._moves(plan, before, after, changes, names)
                if found is not None:
                    return consolidated(found)
            elif self.sums is not None and (out := self._summed(before, after, changes)) is not None:
                return out
            elif (by := self._touching()) is not None:
                own = [f"{e} AS `{n}`" for n, e in by.items() if n not in self.keys] or ["1 AS __one"]
                inner = Select(f"SELECT {', '.join(own)} FROM {plan.clause('FROM')}" + (f" WHERE {plan.clause('WHERE')}" if "WHERE" in plan.clauses else ""))
                found = self._moves(inner, before, after, changes, list(by))
                if found is not None:
                    keys = self.engine.scratch.stored(found.select(*(F.col(f"`{c}`") for c in by)).distinct())
                    only = self.store.touched(keys) if self.store is not None and self.store.by and set(self.store.by) <= set(by) else None
                    old = self.store.of(only) if self.store is not None else self._compute(before)
                    return consolidated(difference(matching(old, keys, list(by)), matching(self._compute(after), keys, list(by))))
        return consolidated(difference(self.store.rows if self.store is not None else self._compute(before), self._compute(after)))

    def _moves(self, plan: Select, before, after, changes, names: Sequence[str] | None) -> DataFrame | None:
        """How the rows of a join change; None where no rule is known.

        A join is linear in each input but those to the right of a LEFT JOIN: the change of such an input, joined with the others, is a part of the whole
        change (inputs before it are taken as they are now, those after it as they were). If it is one on the right that changes, the left rows
        under its changed keys are looked at again. Not consolidated: of a row that only some columns are taken of, an update may come to nothing and yet matter.
        """
        joins = plan.joins()
        if joins is None:
            return None
        parents = [(t, a) for t, a, _, _ in joins]
        if any(_of(after, t) is None for t, _ in parents):
            return None
        changed = [i for i, (t, _) in enumerate(parents) if _of(changes, t) is not None]
        right = [i for i in changed if joins[i][2] == "left"]
        if right and len(changed) > 1:
            return None
        pick = lambda df, *more: unique(df).select(*(F.col(f"`{c}`") for c in (names or [n for n in unique(df).columns if n not in ("__weight", WEIGHT)])), *more)
        if right:
            (_, alias), pairs = parents[right[0]], plan.pairs(joins[right[0]][3])
            sides = pairs and [(a, b) if b[0] == alias else (b, a) for a, b in pairs]
            if not sides or any(b[0] != alias or a[0] != sides[0][0][0] for a, b in sides):
                return None
            left = next((i for i, (_, a) in enumerate(parents) if a == sides[0][0][0]), None)
            if left is None or joins[left][2] == "left":
                return None
            keys = _of(changes, parents[right[0]][0]).select(*(F.col(f"`{b}`").alias(f"__j{i}") for i, (_, (_, b)) in enumerate(sides))).distinct()
            keys = self.engine.scratch.stored(keys.dropna())
            parts = []
            for tables in (before, after):
                own = {f"__in{k}": _of(tables, t) for k, (t, _) in enumerate(parents)}
                own[f"__in{left}"] = self._under(own[f"__in{left}"], keys, [a for (_, a), _ in sides])
                own[f"__in{right[0]}"] = self._under(own[f"__in{right[0]}"], keys, [b for _, (_, b) in sides])
                parts.append(pick(bound(self.engine.spark, _renamed(plan.sql(ordered=True), parents), own, own)))
            return difference(*parts)
        out = None
        for i in changed:
            own = {f"__in{k}": (_of(changes, t).withColumn(WEIGHT, F.col(WEIGHT).cast("long")) if k == i else _of(after if k < i else before, t)) for k, (t, _) in enumerate(parents)}
            sql = plan.sql([f"`{parents[i][1]}`.{WEIGHT} AS __weight"], ordered=True)
            part = pick(bound(self.engine.spark, _renamed(sql, parents), own, own), F.col("__weight").alias(WEIGHT))
            out = part if out is None else out.unionAll(part)
        if out is None:
            own = {f"__in{k}": _of(after, t) for k, (t, _) in enumerate(parents)}
            out = signed(pick(bound(self.engine.spark, _renamed(plan.sql(ordered=True), parents), own, own)).limit(0))
        return out

    @staticmethod
    def _under(rows: DataFrame, keys: DataFrame, by: Sequence[str]) -> DataFrame:
        return matching(rows, keys.toDF(*by), by)

    def _sums(self) -> Sums | None:
        """How new groups follow from old ones and the change; None where there's no such way."""
        plan = self.plan
        if plan.compound or plan.distinct or not plan.aggregates or "HAVING" in plan.clauses or any(plan.limits) or plan.joins() is None:
            return None
        by, texts = self._group_columns(), plan.expressions()
        if not by or texts is None or len(texts) != len(self.columns):
            return None
        own, calls, copies = {e.lower(): c for c, e in by.items()}, [], {}
        for c, text in [*zip(self.columns, texts, strict=True), *((f"__ord{i}", x) for i, (x, _) in enumerate(plan.order))]:
            found = single_aggregate(text)
            if c in by:
                continue
            if found is not None:
                if found[0] == "sum" and not isinstance(self.plain.schema[c].dataType, (T.LongType, T.DecimalType)):
                    return None
                calls.append((c, *found))
            elif text.lower() in own:
                copies[c] = own[text.lower()]
            else:
                return None
        return Sums(by, calls, copies)

    def _summed(self, before, after, changes) -> DataFrame | None:
        """Signed rows of groups by what moves in the input; the input itself is read for groups alone that lose their minimum or maximum."""
        plan, sums, scratch = self.plan, self.sums, self.engine.scratch
        own = [f"{e} AS `{n}`" for n, e in sums.by.items() if n not in self.keys] + [f"{x} AS {c}" for c, x in sums.arguments.items()]
        inner = Select(f"SELECT {', '.join(own or ['1 AS __one'])} FROM {plan.clause('FROM')}" + (f" WHERE {plan.clause('WHERE')}" if "WHERE" in plan.clauses else ""))
        moves = self._moves(inner, before, after, changes, [*sums.by, *sums.arguments])
        if moves is None or not sums.exact(moves):
            return None
        gathered, names = scratch.stored(sums.gathered(moves)), list(sums.by)
        merged = sums.merged(gathered, self.store.under(gathered))
        if not sums.extremes:
            return sums.signed(merged)
        merged = scratch.stored(merged)
        lost = merged.where("__again")
        if lost.isEmpty():
            return sums.signed(merged)
        was = lost.select("__old.*")
        keys = scratch.stored(was.select(*(F.col(f"`{c}`") for c in names)))
        return sums.signed(merged.where("NOT __again")).unionAll(difference(was, matching(self._compute(after), keys, names)))

    def _touching(self) -> dict[str, str] | None:
        """Columns (and expressions for them) such that a changed input row only matters to rows with its values there."""
        plan, keys = self.plan, dict(zip(self.keys, self.plan.parameters, strict=True))
        if any(plan.limits):
            return keys or None
        if plan.distinct:
            if plan.aggregates:
                return None
            own = {}
            for c, item in zip(self.columns, plan.items, strict=False):
                if item[-1].text == "*":
                    return None
                own[c] = plan.text[item[0].start : (item[-3] if len(item) > 2 and item[-2].is_word("AS") else item[-1]).end]
            return {**own, **keys}
        return self._group_columns()

    def _group_columns(self) -> dict[str, str] | None:
        """Output column to expression for the grouping columns, if all are among the outputs."""
        named = {e.lower(): n for n, e in self.plan.aliases().items()}
        out = {}
        group = [g.strip() for g in self.plan.clause("GROUP").split(",") if g.strip()]
        if any(not g.replace(".", "").replace("`", "").replace("_", "").isalnum() for g in group):
            return None
        outputs = {c.lower(): c for c in self.columns}
        for g in group:
            name = named.get(g.lower()) or outputs.get(g.split(".")[-1].strip("`").lower())
            if name is None:
                return None
            out[name] = g
        for k, e in zip(self.keys, self.plan.parameters, strict=True):
            out[k] = e
        return out or None

    # partial views

    def _forget(self, before, after, changes) -> None:
        """Keys that a change touches are no longer filled: for joins of tables those of the change's own rows, else all."""
        if not self.filled:
            return
        found = None
        if not self.plan.compound:
            inner = Select(f"SELECT 1 AS __one FROM {self.plan.clause('FROM')} WHERE {self.plan.clause('WHERE')}")
            found = self._moves(inner, before, after, changes, self.keys)
        touched = None if found is None else found.select(*self.keys).distinct().limit(self.most_keys + 1).collect()
        if touched is None or len(touched) > self.most_keys:
            self.flush()
        else:
            self.evict(map(tuple, touched))

    def evict(self, keys: Iterable[tuple]) -> None:
        """Forgets what is stored under the keys."""
        for k in keys:
            if (f := self.filled.pop(k, None)) is not None:
                f.live.discard(k)
                if not f.live:
                    Files(self.engine.spark).delete([f.path])

    def flush(self) -> None:
        """Forgets all that is stored of a partial view."""
        self.evict(list(self.filled))

    def stored_bytes(self) -> int:
        """Bytes of the filled keys, each taken to have an even share of its filling."""
        return sum(f.size * len(f.live) // max(1, f.first) for f in set(self.filled.values()))

    def lookup(self, *key: Any) -> DataFrame:
        """Rows under one key, in the view's order; a null matches nulls."""
        return self.multi_lookup([key])

    def lookup_first(self, *key: Any) -> Row | None:
        """The first row under a key, or None."""
        return self.lookup(*key).first()

    def multi_lookup(self, keys: Sequence[tuple]) -> DataFrame:
        """Rows under any of the keys, in one plan."""
        if not self.keys:
            raise ValueError(f"{self.name} has no key: scan() it")
        keys = list(dict.fromkeys(tuple(k) if isinstance(k, (tuple, list)) else (k,) for k in keys))
        if any(len(k) != len(self.keys) for k in keys):
            raise ValueError(f"the key of {self.name} has {len(self.keys)} columns")
        if self.materialize == PARTIAL:
            return self._shown(self._from_parts(keys))
        rows = self.store.of(self.store.touched(self._frame(keys))) if self.store is not None and self.store.state.buckets > 1 else self.rows
        return self._shown(self._only(rows, keys))

    def _frame(self, keys: Sequence[tuple]) -> DataFrame:
        return self.engine.spark.createDataFrame(keys, T.StructType([T.StructField(k, self.plain.schema[k].dataType) for k in self.keys]))

    def _only(self, rows: DataFrame, keys: Sequence[tuple]) -> DataFrame:
        """A filter where there's one key column and not very many keys, so that it reaches the scan; else a semi-join with the keys."""
        if len(self.keys) == 1 and len(keys) <= FILTERED_KEYS:
            some = [k[0] for k in keys if k[0] is not None]
            found = F.col(self.keys[0]).isin(some) if some else F.lit(False)
            return rows.where(found | F.col(self.keys[0]).isNull() if len(some) < len(keys) else found)
        if len(keys) == 1:
            hit = F.lit(True)
            for c, v in zip(self.keys, keys[0], strict=True):
                hit &= F.col(c).eqNullSafe(F.lit(v))
            return rows.where(hit)
        return matching(rows, self._frame(keys), self.keys)

    def _from_parts(self, keys: Sequence[tuple]) -> DataFrame:
        self._fill([k for k in keys if k not in self.filled])
        for k in keys:
            self.filled.move_to_end(k)
        by: dict[Filling, list[tuple]] = {}
        for k in keys:
            by.setdefault(self.filled[k], []).append(k)
        out = reduce(DataFrame.unionAll, (self._only(f.rows, own) for f, own in by.items())) if by else self.plain.limit(0)
        while len(self.filled) > max(self.most_keys, len(keys)):
            self.evict([next(iter(self.filled))])
        while self.most_bytes is not None and len(self.filled) > len(keys) and self.stored_bytes() > self.most_bytes:
            self.evict([next(iter(self.filled))])
        return out

    def _fill(self, missing: Sequence[tuple]) -> None:
        """Stores the rows of keys, together with those of all keys there once these are spread over very many fillings."""
        if not missing:
            return
        old = set(self.filled.values())
        rows, keys = self._only(self.compute(self.engine.frames(self.sources)), missing), list(missing)
        if merge := len(old) >= FILLINGS:
            rows = reduce(DataFrame.unionAll, (rows, *(self._only(f.rows, list(f.live)) for f in old)))
            keys += list(self.filled)
        path = place(self.engine.spark, self.engine.folder)
        made = Filling(stored(rows, path=path), path, keys, Files(self.engine.spark).bytes(path))
        order = [*self.filled, *missing]
        for k in order if merge else missing:
            self.filled[k] = made
        if merge:
            Files(self.engine.spark).delete(f.path for f in old)

    def scan(self) -> DataFrame:
        """All rows, in the view's order."""
        return self._shown(self.rows)

    def seen(self) -> DataFrame:
        """What other views see: the columns, in no order."""
        return self.rows.select(*(F.col(f"`{c}`") for c in self.columns))

    def size(self) -> int:
        """The number of keys, or of rows where there's no key."""
        return self.rows.select(*self.keys).distinct().count() if self.keys else self.rows.count()


def _renamed(sql: str, parents: Sequence[tuple[str, str]]) -> str:
    """Each input by a name of its own, under its alias, so that inputs of one table can differ."""
    plan = Select(sql)
    start = next(t.end for t in plan.tokens if t.depth == 0 and t.is_word("FROM"))
    end = next((t.start for t in plan.tokens if t.depth == 0 and t.start > start and t.is_word("WHERE", "GROUP", "ORDER", "LIMIT")), len(sql))
    text, out, k, expect, skip = sql[start:end], "", 0, True, 0
    found = Select(text).tokens
    done = 0
    for i, t in enumerate(found):
        if i < skip:
            continue
        if t.depth == 0 and expect and t.kind in ("word", "quoted") and not t.is_word("INNER", "JOIN", "LEFT", "OUTER"):
            j = i + 1
            if j < len(found) and found[j].is_word("AS"):
                j += 1
            last = found[j] if j < len(found) and found[j].kind in ("word", "quoted") and not found[j].is_word("ON", "JOIN", "INNER", "LEFT", "OUTER") else t
            out += text[done : t.start] + f"__in{k} AS `{parents[k][1]}`"
            done, k, expect = last.end, k + 1, False
            skip = found.index(last) + 1
        elif t.depth == 0 and (t.text == "," or t.is_word("JOIN")):
            expect = True
    return sql[:start] + out + text[done:] + " " + sql[end:]


class Engine:
    """Tables and views by name.

    folder: where rows are stored, and with them what it takes to open the engine again (reopen); each write and each change of the recipe is
    one step there. Without it, rows go to the session's checkpoint folder and are of use to this session alone.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, materialize: str = FULL):
        self.spark, self.folder, self.materialize = spark, folder, materialize
        self.tables: dict[str, BaseTable] = {}
        self.views: dict[str, View] = {}
        self.aliases: dict[str, str] = {}
        self.recipe = Recipe()
        #: The last batch of each stream that was taken in.
        self.applied: dict[str, int] = {}
        #: Called with the name and the signed rows of each table and view that a write changed.
        self.listeners: list[Callable[[str, DataFrame], None]] = []
        self.number, self.scratch = 0, Scratch(spark, folder)
        if folder is not None and load(spark, folder) is not None:
            raise ValueError(f"{folder} holds an engine: reopen it")

    def names(self) -> list[str]:
        return [*self.tables, *self.views, *self.aliases]

    def frames(self, names: Iterable[str] | None = None) -> dict[str, DataFrame]:
        """What queries see of the tables and views, all or those named."""
        wanted = set(self.names() if names is None else names)
        out = {n: t.rows for n, t in self.tables.items() if n in wanted}
        for n in (*self.views, *self.aliases):
            if n in wanted:
                out[n] = self.view(n).seen()
        return out

    def create_table(self, name: str, schema: T.StructType | str, key: Sequence[str] = (), defaults: Mapping[str, Any] | None = None, rows: DataFrame | None = None) -> BaseTable:
        """rows: what is there at first. Where the engine has a folder they are copied to it, else left where they are."""
        if name in self.names():
            raise ValueError(f"there is a {name}")
        self.tables[name] = BaseTable(self.spark, name, schema, key, defaults, rows, self.folder, own=self.folder is not None)
        self._save()
        return self.tables[name]

    def create_view(self, name: str, plan: str | Node, materialize: str | None = None, public: bool = True, names: Mapping[str, str] | None = None, most_bytes: int | None = None) -> View:
        """A view by SQL (`column = ?` makes a key) or by a tree of nodes. SQL that another view has already makes a second name for that view."""
        if name in self.names():
            raise ValueError(f"there is a {name}")
        made = self._made(name, Select(plan) if isinstance(plan, str) else plan, materialize or self.materialize, public, names, most_bytes)
        self._save()
        return made

    def _made(self, name: str, plan: Select | Node, materialize: str, public: bool, names: Mapping[str, str] | None = None, most_bytes: int | None = None) -> View:
        made = View(self, name, plan, materialize, public, names=names, most_bytes=most_bytes)
        same = next((v for v in self.views.values() if isinstance(plan, Select) and isinstance(v.plan, Select) and v.materialize == made.materialize and len(v.keys) == len(made.keys) and v.columns == made.columns and v.sources == made.sources and v.plan.order == plan.order and v.same_as(made)), None)
        if same is not None:
            self.aliases[name] = same.name
            for s in made.stores():
                s.drop()
            return same
        self.views[name] = made
        return made

    def view(self, name: str) -> View:
        return self.views[self.aliases.get(name, name)]

    def inputs(self) -> dict[str, T.StructType]:
        return {n: t.schema for n, t in self.tables.items()}

    def outputs(self) -> list[str]:
        return [*(n for n, v in self.views.items() if v.public), *self.aliases]

    # writes

    def write(self, table: str, operations: Iterable[Operation]) -> None:
        self._changed(table, lambda t: t.perform(operations))

    def write_rows(self, table: str, changes: DataFrame, stream: str | None = None, batch: int | None = None) -> None:
        """Applies changes as rows with _op and _seq; of a stream, batches up to the last one taken in are left out."""
        if stream is not None and batch <= self.applied.get(stream, -1):
            return
        self._changed(table, lambda t: t.perform_rows(changes), {stream: batch} if stream is not None else {})

    def _changed(self, table: str, perform: Callable[[BaseTable], DataFrame], applied: Mapping[str, int] | None = None) -> None:
        """All or nothing: where a view can't take the change in, table and views stay as they were."""
        order = self._readers({table})
        used = {table, *(s for n in order for s in self.views[n].sources)}
        before, undo = self.frames(used), self._undo()
        try:
            changes = {table: perform(self.tables[table])}
            after = {**before, table: self.tables[table].rows}
            for name in order:
                v, others = self.views[name], [name, *(a for a, n in self.aliases.items() if n == name)]
                own = v.take(before, after, changes, read=bool(self.listeners) or any(used & {n} for n in others))
                for n in others:
                    if own is not None:
                        changes[n] = own.select(*(F.col(f"`{c}`") for c in v.columns), WEIGHT)
                    if n in used:
                        after[n] = v.seen()
            self.applied = {**self.applied, **(applied or {})}
            self._save()
        except BaseException:
            undo()
            self.scratch.clear()
            raise
        try:
            for listener in self.listeners:
                for n, change in changes.items():
                    listener(n, change)
        finally:
            self.scratch.clear()

    def _readers(self, changed: Iterable[str]) -> list[str]:
        """Views that read any of these, directly or not, each after those that it reads."""
        stale, out = set(changed), []
        stale |= {a for a, n in self.aliases.items() if n in stale}
        for n in self._sorted():
            if self.views[n].sources & stale:
                out.append(n)
                stale |= {n, *(a for a, m in self.aliases.items() if m == n)}
        return out

    def _sorted(self) -> list[str]:
        """All views, each after those that it reads."""
        out, left = [], dict(self.views)
        while left:
            ready = [n for n, v in left.items() if not any(self.aliases.get(s, s) in left and self.aliases.get(s, s) != n for s in v.sources)]
            if not ready:
                raise ValueError(f"views read each other: {sorted(left)}")
            out += ready
            for n in ready:
                del left[n]
        return out

    def _undo(self) -> Callable[[], None]:
        """A function that makes everything as it is now."""
        tables, views, aliases, recipe, applied = dict(self.tables), dict(self.views), dict(self.aliases), self.recipe, dict(self.applied)
        stores = [*(t.store for t in tables.values()), *(s for v in views.values() for s in v.stores())]
        states, defaults = [s.state for s in stores], {n: t.defaults for n, t in tables.items()}
        named = {n: v.name for n, v in views.items()}

        def back() -> None:
            self.tables, self.views, self.aliases, self.recipe, self.applied = tables, views, aliases, recipe, applied
            for s, state in zip(stores, states, strict=True):
                s.state, s.made = state, {}
            for n, d in defaults.items():
                tables[n].defaults = d
            for n, v in views.items():
                v.name = named[n]
                v.flush()

        return back

    def flush_partial(self) -> None:
        for v in self.views.values():
            v.flush()

    def evict(self, view: str, keys: Iterable[tuple]) -> None:
        """Forgets what a partial view has under the keys, and all that partial views which read it have."""
        self.view(view).evict(keys)
        for n in self._readers({self.aliases.get(view, view)}):
            self.views[n].flush()

    # recipes

    def install(self, text: str) -> tuple[list[str], list[str]]:
        """Makes text the recipe: what is new is added, what is gone is removed, what reads a changed view is made anew. Either all of it happens or nothing."""
        new = Recipe.parse(text)
        return self._activate(new, *self.recipe.difference(new))

    def extend(self, text: str) -> list[str]:
        """Adds the statements of text, all or none."""
        more = Recipe.parse(text)
        for n, s in more.statements.items():
            if n in self.recipe.statements and self.recipe.statements[n].normal != s.normal:
                raise ValueError(f"{n} names another statement already")
        new = Recipe({**self.recipe.statements, **more.statements})
        return self._activate(new, *self.recipe.difference(new))[0]

    def _activate(self, new: Recipe, added: list[Statement], removed: list[Statement]) -> tuple[list[str], list[str]]:
        names = {s.name for s in added}
        gone = [s for s in removed if s.name not in names]
        undo = self._undo()
        try:
            self._check(new, {s.name for s in gone})
            changed = {s.name for s in added if s.table is not None and s.name in self.tables and self._define(s.table)}
            for s in added:
                if s.table is not None and s.name not in self.tables:
                    self._define(s.table)
            old = {s.name for s in removed if s.name in names and s.table is None}
            stale = self._readers(changed | old)
            for n in old:
                self._take_out(n)
            for s in added:
                if s.table is None:
                    if s.name in self.names():
                        raise ValueError(f"there is a {s.name}")
                    self._made(s.name, s.select, s.materialize or self.materialize, s.public)
            for n in stale:
                if n in self.views and n not in names:
                    self._again(n)
            for n in (n for n in self._sorted() if self.views[n].sources & {s.name for s in gone}):
                if n not in {s.name for s in gone}:
                    raise ValueError(f"{n} reads what the recipe no longer has")
            for s in reversed(gone):
                (self._take_out if s.table is None else self.tables.pop)(s.name)
            self.views = {n: self.views[n] for n in self._sorted()}
            self.recipe = new
            self._save()
        except BaseException:
            undo()
            raise
        return [s.name for s in added], [s.name for s in gone]

    def _check(self, new: Recipe, gone: set[str]) -> None:
        """Plans every view of the recipe over empty tables."""
        empty = lambda d: self.spark.createDataFrame([], ", ".join(f"`{n}` {k}" for n, k in d.columns))
        known = {n: df.limit(0) for n, df in self.frames(n for n in self.names() if n not in gone and n not in new.statements).items()} | {s.name: empty(s.table) for s in new.statements.values() if s.table is not None}
        for s in new.statements.values():
            if s.table is None:
                plan = s.select
                made = unique(bound(self.spark, plan.sql(), known, plan.words()))
                known[s.name] = made.drop(*(f"__key{i}" for i in range(len(plan.parameters))))

    def _define(self, d: Definition) -> bool:
        """Makes the table, or makes the one there what the definition says; whether an existing one changed."""
        if d.name not in self.tables:
            if d.name in self.names():
                raise ValueError(f"there is a {d.name}")
            self.tables[d.name] = BaseTable(self.spark, d.name, ", ".join(f"`{n}` {k}" for n, k in d.columns), d.key, dict(d.defaults), None, self.folder, own=self.folder is not None)
            return False
        table, before = self.tables[d.name], self.tables[d.name].schema
        if tuple(d.key) != table.key:
            raise ValueError(f"the key of {d.name} is {table.key}: it can't become {tuple(d.key)}")
        kinds = T.StructType.fromDDL(", ".join(f"`{n}` {k}" for n, k in d.columns))
        for f in kinds:
            if f.name not in table.schema.names:
                table.add_column(f.name, f.dataType, dict(d.defaults).get(f.name))
            elif table.schema[f.name].dataType != f.dataType:
                table.convert(f.name, f.dataType)
        for n in [c for c in table.schema.names if c not in kinds.names]:
            table.drop_column(n)
        table.defaults = dict(d.defaults)
        return table.schema != before

    def add_column(self, table: str, name: str, kind: T.DataType | str, default: Any = None) -> None:
        self._altered(table, lambda t: t.add_column(name, kind, default))

    def drop_column(self, table: str, name: str) -> None:
        self._altered(table, lambda t: t.drop_column(name))

    def _altered(self, table: str, change: Callable[[BaseTable], None]) -> None:
        undo = self._undo()
        try:
            change(self.tables[table])
            for n in self._readers({table}):
                self._again(n)
            self._save()
        except BaseException:
            undo()
            raise

    def _again(self, name: str) -> None:
        """Plans and fills a view anew."""
        v = self.views[name]
        self.views[name] = View(self, name, v.plan, v.materialize, v.public, v.most_keys, v.most_bytes, v.names)

    def remove_view(self, name: str) -> None:
        """Refuses while another view reads it."""
        if readers := [n for n, v in self.views.items() if name in v.sources and n != name]:
            raise ValueError(f"{name} is read by {readers}")
        own = self.view(name)
        self._take_out(name)
        self.recipe = self.recipe.without(name)
        self._save()
        if own not in self.views.values():
            own.flush()
            for s in own.stores():
                s.drop()

    def _take_out(self, name: str) -> None:
        """Without the name; a view goes on under another name if it has one."""
        if name in self.aliases:
            del self.aliases[name]
            return
        heir = next((a for a, n in self.aliases.items() if n == name), None)
        v = self.views.pop(name)
        if heir is not None:
            del self.aliases[heir]
            v.name = heir
            self.views[heir] = v
            self.aliases = {a: heir if n == name else n for a, n in self.aliases.items()}

    def remove_table(self, name: str) -> None:
        if readers := [n for n, v in self.views.items() if name in v.sources]:
            raise ValueError(f"{name} is read by {readers}")
        gone = self.tables.pop(name)
        self.recipe = self.recipe.without(name)
        self._save()
        gone.store.drop()

    def describe(self) -> dict[str, list[str]]:
        """What each view reads."""
        return {n: sorted(v.sources) for n, v in self.views.items()}

    # recovery

    def _save(self) -> None:
        """Where the engine has a folder: its state there from now on. One new file, so that a failure before it leaves the state before."""
        if self.folder is None:
            return
        tables = {n: {"key": list(t.key), "defaults": t.defaults, "state": t.store.state.to_json()} for n, t in self.tables.items()}
        views = [{"name": n, "sql": v.plan.text if isinstance(v.plan, Select) else None, "materialize": v.materialize, "public": v.public, "most_keys": v.most_keys, "most_bytes": v.most_bytes, "names": v.names, "states": [s.state.to_json() for s in v.stores()]} for n, v in ((n, self.views[n]) for n in self._sorted())]
        recipe = [{"name": s.name, "public": s.public, "text": s.text, "table": s.table is not None, "materialize": s.materialize} for s in self.recipe.statements.values()]
        save(self.spark, self.folder, {"materialize": self.materialize, "tables": tables, "views": views, "aliases": self.aliases, "recipe": recipe, "applied": self.applied}, self.number + 1)
        self.number += 1

    @classmethod
    def reopen(cls, spark: SparkSession, folder: str, nodes: Mapping[str, Node] | None = None) -> Engine:
        """The engine as its last whole step left it in the folder. nodes: the plans of the views that are trees of nodes, by name."""
        found = load(spark, folder)
        if found is None:
            raise ValueError(f"no engine in {folder}")
        d, number = found
        out = cls.__new__(cls)
        out.spark, out.folder, out.materialize, out.number, out.scratch = spark, folder, d["materialize"], number, Scratch(spark, folder)
        out.tables, out.views, out.aliases, out.applied, out.listeners = {}, {}, dict(d["aliases"]), dict(d["applied"]), []
        for n, t in d["tables"].items():
            state = State.from_json(t["state"])
            out.tables[n] = BaseTable(spark, n, state.schema, t["key"], t["defaults"], None, folder, state=state)
        for v in d["views"]:
            if v["sql"] is None and v["name"] not in (nodes or {}):
                raise ValueError(f"{v['name']} is a tree of nodes: name its plan in nodes")
            plan = Select(v["sql"]) if v["sql"] is not None else nodes[v["name"]]
            out.views[v["name"]] = View(out, v["name"], plan, v["materialize"], v["public"], v["most_keys"], v["most_bytes"], v["names"], [State.from_json(s) for s in v["states"]])
        out.recipe = Recipe.restored(d["recipe"])
        return out

    def sweep(self) -> list[str]:
        """Deletes files in the engine's folder that nothing refers to: leavings of steps that failed. Nobody else may write there."""
        if self.folder is None:
            raise ValueError("only an engine with a folder of its own can be swept")
        used = {p.rpartition("/")[2] for s in [*(t.store for t in self.tables.values()), *(s for v in self.views.values() for s in v.stores())] for p in (*(f.path for f in (*s.state.folders, *s.state.pending)), *s.state.garbage)}
        used |= {f.path.rpartition("/")[2] for v in self.views.values() for f in v.filled.values()}
        gone = [n for n in Files(self.spark).names(self.folder) if n.startswith("v-") and n not in used]
        Files(self.spark).delete(f"{self.folder.rstrip('/')}/{n}" for n in gone)
        return gone
