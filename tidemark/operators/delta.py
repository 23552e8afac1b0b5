"""Incremental maintenance: views as trees of nodes, each with a batch form and a rule for its change.

Changes are signed rows: a row with a weight, positive where it is added and negative where it is revoked. A step knows all inputs before and after a batch,
so a rule joins the (small) change with what it touches. COUNT and SUM of whole numbers keep state and read nothing but the change; MIN, MAX, top-k,
latest, distinct and group-concat look again at the touched groups alone.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import relational as rel
from tidemark.operators.relational import WEIGHT, Aggregate, Condition
from tidemark.sources.store import BAG, KEYED, Scratch, State, Store, consolidated, matching, signed


def difference(before: DataFrame, after: DataFrame) -> DataFrame:
    return signed(before, -1).unionByName(signed(after))


def _keys(change: DataFrame, by: Sequence[str]) -> DataFrame:
    return change.select(*by).distinct()


def _flipped(change: DataFrame) -> DataFrame:
    return change.withColumn(WEIGHT, -F.col(WEIGHT))


@dataclass(eq=False)
class Node:
    """inputs: the nodes it reads. batch(): its rows from its inputs' rows. change(): its signed rows in a step."""

    def inputs(self) -> tuple[Node, ...]:
        return tuple(x for x in vars(self).values() if isinstance(x, Node))

    def batch(self, *rows: DataFrame) -> DataFrame:
        raise NotImplementedError

    def change(self, step: Step) -> DataFrame:
        raise NotImplementedError

    def sources(self) -> set[str]:
        return set().union(*(n.sources() for n in self.inputs()))


class Step:
    """All sources before and after a batch of changes, and the changes; what nodes make of them, each once."""

    def __init__(self, before: Mapping[str, DataFrame], after: Mapping[str, DataFrame], changes: Mapping[str, DataFrame], states: Mapping[Node, Store] | None = None, folder: str | None = None):
        self.tables, self.changes, self.states, self.folder = {"before": before, "after": after}, changes, states or {}, folder
        self.scratch: Scratch | None = None
        self.made: dict = {}

    def stored(self, df: DataFrame) -> DataFrame:
        """df, stored until the step ends."""
        self.scratch = self.scratch or Scratch(df.sparkSession, self.folder)
        return self.scratch.stored(df)

    def end(self) -> None:
        if self.scratch is not None:
            self.scratch.clear()

    def rows(self, node: Node, when: str) -> DataFrame:
        if (node, when) not in self.made:
            self.made[node, when] = self.tables[when][node.name] if isinstance(node, Source) else node.batch(*(self.rows(n, when) for n in node.inputs()))
        return self.made[node, when]

    def change(self, node: Node) -> DataFrame:
        if node not in self.made:
            self.made[node] = node.change(self)
        return self.made[node]


@dataclass(eq=False)
class Source(Node):
    """A base table or another view, by name."""

    name: str

    def sources(self) -> set[str]:
        return {self.name}

    def change(self, step: Step) -> DataFrame:
        found = step.changes.get(self.name)
        return signed(step.rows(self, "after").limit(0)) if found is None else found.withColumn(WEIGHT, F.col(WEIGHT).cast("long"))


@dataclass(eq=False)
class Filter(Node):
    source: Node
    conditions: Sequence[Condition]

    def batch(self, rows):
        return rel.filter_rows(rows, *self.conditions)

    def change(self, step):
        return self.batch(step.change(self.source))


@dataclass(eq=False)
class Project(Node):
    source: Node
    columns: Sequence[str] = ()
    expressions: Mapping[str, Column | tuple] = field(default_factory=dict)
    literals: Mapping[str, Any] = field(default_factory=dict)

    def batch(self, rows):
        return rel.project(rows, self.columns, self.expressions, self.literals)

    def change(self, step):
        return self.batch(step.change(self.source))


@dataclass(eq=False)
class Identity(Node):
    source: Node

    def batch(self, rows):
        return rows

    def change(self, step):
        return step.change(self.source)


@dataclass(eq=False)
class Union(Node):
    """Bag union; columns: what of each parent, all where there's none."""

    parents: Sequence[Node]
    columns: Sequence[Sequence[str]] = ()

    def inputs(self):
        return tuple(self.parents)

    def batch(self, *rows):
        return rel.union(*zip(rows, self.columns, strict=True)) if self.columns else rel.union(*rows)

    def change(self, step):
        parts = [step.change(p) for p in self.parents]
        return rel.union(*((p, [*c, WEIGHT]) for p, c in zip(parts, self.columns, strict=True))) if self.columns else rel.union(*parts)


@dataclass(eq=False)
class Join(Node):
    """Inner or left equi-join on pairs of columns; the right side's keys are left out."""

    left: Node
    right: Node
    on: Sequence[str | tuple[str, str]]
    how: str = "inner"

    def batch(self, left, right):
        return rel.join(left, right, self.on, self.how)

    def change(self, step):
        changed_left, changed_right = step.change(self.left), step.change(self.right)
        left, right = step.rows(self.left, "before"), step.rows(self.right, "after")
        out = rel.join(changed_left, right, self.on, self.how)
        names = out.columns
        out = out.unionByName(rel.join(left, changed_right, self.on).select(*names))
        if self.how == "left":
            pairs = [(o, o) if isinstance(o, str) else o for o in self.on]
            theirs = [b for _, b in pairs]
            keys = step.stored(_keys(changed_right, theirs).dropna())
            number = lambda when, n: matching(step.rows(self.right, when), keys, theirs).groupBy(*theirs).agg(F.count(F.lit(1)).alias(n))
            counted = keys.join(number("before", "b"), theirs, "left").join(number("after", "a"), theirs, "left").fillna(0, ["a", "b"])
            turned = counted.where((F.col("b") > 0) != (F.col("a") > 0)).withColumn(WEIGHT, F.when(F.col("a") > 0, -1).otherwise(1).cast("long")).select(*theirs, WEIGHT)
            lost = rel.join(left, turned, self.on)
            absent = [F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema if f.name not in theirs]
            out = out.unionByName(lost.select(*left.columns, *absent, WEIGHT).select(*names))
        return out


@dataclass(eq=False)
class Recomputed(Node):
    """What looks again at the touched groups: those of columns by."""

    source: Node
    by: Sequence[str]

    def change(self, step):
        keys = _keys(step.change(self.source), self.by)
        old, new = (self.batch(matching(step.rows(self.source, when), keys, self.by)) for when in ("before", "after"))
        return difference(old, new)


@dataclass(eq=False)
class Distinct(Recomputed):
    def batch(self, rows):
        return rel.distinct(rows, self.by)


@dataclass(eq=False)
class TopK(Recomputed):
    order: Sequence[tuple[str, bool]]
    k: int

    def batch(self, rows):
        return rel.top_k(rows, self.by, self.order, self.k)


@dataclass(eq=False)
class Latest(Recomputed):
    order: Sequence[str]

    def batch(self, rows):
        return rel.latest(rows, self.by, self.order)


@dataclass(eq=False)
class Grouped(Recomputed):
    """Aggregates of groups. Counts and sums of whole numbers and decimals keep state where the view is maintained; others look again."""

    aggregates: Sequence[Aggregate]

    def batch(self, rows):
        return rel.aggregate(rows, self.by, *self.aggregates)

    def keeps(self, rows: DataFrame) -> bool:
        kinds = rows.select(*(a.value().alias(f"x{i}") for i, a in enumerate(self.aggregates))).schema
        whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType)
        return all(a.linear and (a.kind == "count" or isinstance(k.dataType, whole)) for a, k in zip(self.aggregates, kinds, strict=True))

    def _sums(self, change: DataFrame) -> DataFrame:
        out, w = [F.sum(WEIGHT).alias("__n")], F.col(WEIGHT)
        for i, a in enumerate(self.aggregates):
            x = a.value()
            out.append(F.sum(F.when(x.isNotNull(), w).otherwise(0)).alias(f"__c{i}"))
            if a.kind == "sum":
                out.append(F.sum(x * w).alias(f"__s{i}"))
        sums = change.groupBy(*self.by).agg(*out)
        return sums.select(*self.by, *(F.coalesce(c, F.lit(0)).alias(c) for c in sums.columns if c not in self.by))

    def state(self, rows: DataFrame) -> DataFrame:
        return self._sums(signed(rows))

    def _shown(self, state: DataFrame) -> DataFrame:
        kinds = self.batch(state.sparkSession.createDataFrame([], self.of)).schema
        return state.select(*self.by, *(self._value(i, a).cast(kinds[a.name].dataType).alias(a.name) for i, a in enumerate(self.aggregates)), WEIGHT)

    @staticmethod
    def _value(i: int, a: Aggregate) -> Column:
        if a.kind == "count":
            return F.col(f"__c{i}")
        some = F.when(F.col(f"__c{i}") > 0, F.col(f"__s{i}"))
        return F.coalesce(some, F.lit(0)) if a.null_as_zero else some

    def change(self, step):
        if self not in step.states:
            return super().change(step)
        store, self.of = step.states[self], step.rows(self.source, "after").schema
        more = self._sums(step.change(self.source))
        if store.state.buckets > 1:
            more = step.stored(more)
        old = store.under(more)
        sums, kinds = [c for c in more.columns if c not in self.by], store.state.schema
        new = old.unionByName(more).groupBy(*self.by).agg(*(F.sum(c).cast(kinds[c].dataType).alias(c) for c in sums))
        both = store.write(difference(old, new.where(F.col("__n") > 0) if self.by else new))
        return self._shown(both)

@dataclass(eq=False)
class Rewrite(Node):
    """column becomes value in rows whose key is in the signal."""

    source: Node
    signal: Node
    column: str
    value: Any
    key: str
    signal_key: str

    def batch(self, rows, signal):
        return rel.rewrite(rows, signal, self.column, self.value, self.key, self.signal_key)

    def change(self, step):
        by, changed = [self.signal_key], step.change(self.signal)
        before, after = step.rows(self.signal, "before"), step.rows(self.signal, "after")
        rows = step.rows(self.source, "before")
        keys = _keys(changed, by).dropna()
        turned = difference(_keys(matching(before, keys, by), by), _keys(matching(after, keys, by), by))
        touched = matching(rows, consolidated(turned).withColumnRenamed(self.signal_key, self.key), [self.key])
        again = difference(self.batch(touched, matching(before, keys, by)), self.batch(touched, matching(after, keys, by)))
        return self.batch(step.change(self.source), after).unionByName(again)


class MaintainedView:
    """A node's rows, kept current by steps. changed is what the last step changed."""

    def __init__(self, node: Node, tables: Mapping[str, DataFrame], folder: str | None = None, states: Sequence[State] | None = None):
        """states: those of a view made before, as states() gives them, instead of computing all anew."""
        step = Step(tables, tables, {})
        self.node, self.folder, self.states, given = node, folder, {}, list(states or ())
        for n in self._nodes(node):
            if isinstance(n, Grouped) and n not in self.states and n.keeps(rows := step.rows(n.source, "after")):
                self.states[n] = Store(n.state(rows), KEYED, n.by, None, folder, own=True, state=given.pop(0) if given else None)
        self.store = Store(step.rows(node, "after"), BAG, (), None, folder, own=True, state=given.pop(0) if given else None)
        self.changed = signed(self.store.rows)

    def _nodes(self, node: Node) -> list[Node]:
        return [node, *(m for n in node.inputs() for m in self._nodes(n))]

    def stores(self) -> list[Store]:
        return [*self.states.values(), self.store]

    @property
    def rows(self) -> DataFrame:
        return self.store.rows

    def apply(self, before: Mapping[str, DataFrame], after: Mapping[str, DataFrame], changes: Mapping[str, DataFrame]) -> DataFrame:
        """Takes in changes of sources; returns the view's own signed rows."""
        step = Step(before, after, changes, self.states, self.folder)
        try:
            self.changed = self.store.write(consolidated(step.change(self.node)))
        finally:
            step.end()
        for s in self.stores():
            s.settle()
        return self.changed
