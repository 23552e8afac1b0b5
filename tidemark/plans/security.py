"""Universes: what a user may see. Row policies filter base tables and rewrite policies mask columns before any view is computed, so aggregates need no mending."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame

from tidemark.operators.delta import Node, Rewrite, Source, Step
from tidemark.operators.relational import WEIGHT, rewrite
from tidemark.plans.engine import FULL, Engine, bound
from tidemark.plans.recipe import Select
from tidemark.streaming.changes import NewKeys


@dataclass(frozen=True)
class RowPolicy:
    """predicate: the text of a condition; group: the name of the group it holds for. Rows that deny admits go, whatever else admits them."""

    table: str
    predicate: str
    deny: bool = False
    group: str | None = None


@dataclass(frozen=True)
class RewritePolicy:
    """column becomes value in rows whose key is among the rows of the query."""

    table: str
    column: str
    value: Any
    key: str
    query: str


@dataclass(frozen=True)
class Policies:
    rows: tuple[RowPolicy, ...] = ()
    rewrites: tuple[RewritePolicy, ...] = ()
    memberships: tuple[tuple[str, str], ...] = ()

    @classmethod
    def parse(cls, text: str | Mapping) -> Policies:
        """From JSON with `groups` (name, membership query with uid and gid, policies) and `policies`."""
        config = json.loads(text) if isinstance(text, str) else text
        rows, rewrites, members = [], [], []

        def take(p: Mapping, group: str | None) -> None:
            action = p.get("action", "allow")
            if action == "rewrite":
                rewrites.append(RewritePolicy(p["table"], p["column"], p["value"], p["key"], p["rewrite"].strip().rstrip(";")))
            elif action in ("allow", "deny"):
                rows.append(RowPolicy(p["table"], re.sub(r"(?is)^\s*where\b", "", p["predicate"]).strip().rstrip(";"), action == "deny", group))
            else:
                raise ValueError(f"no policy action {action}")

        for g in config.get("groups", []):
            members.append((g["name"], g["membership"].strip().rstrip(";")))
            for p in g["policies"]:
                take(p, g["name"])
        for p in config.get("policies", []):
            take(p, None)
        return cls(tuple(rows), tuple(rewrites), tuple(members))


def _literal(v: Any) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool) or not isinstance(v, (int, float)):
        return str(v).upper() if isinstance(v, bool) else "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"
    return repr(v)


class Universe:
    """An engine's tables and views as one user sees them. context: the user's attributes; `id` is looked up in memberships."""

    def __init__(self, engine: Engine, policies: Policies, context: Mapping[str, Any]):
        self.engine, self.policies, self.context = engine, policies, dict(context)

    def _predicate(self, p: RowPolicy) -> str:
        text = re.sub(r"\bUserContext\.(\w+)", lambda m: _literal(self.context[m[1]]), p.predicate)
        if p.group is None:
            return f"({text})"
        member = dict(self.policies.memberships)[p.group]
        text = re.sub(r"\bGroupContext\.id\b", "__member.gid", text)
        return f"EXISTS (SELECT 1 FROM ({member}) AS __member WHERE __member.uid = {_literal(self.context.get('id'))} AND ({text}))"

    def table(self, name: str) -> DataFrame:
        """The rows of a base table that a policy admits, each once; without row policies, all. Masked columns are masked in either case."""
        tables = {n: t.rows for n, t in self.engine.tables.items()}
        mine = [p for p in self.policies.rows if p.table.lower() == name.lower()]
        allow, deny = [self._predicate(p) for p in mine if not p.deny], [self._predicate(p) for p in mine if p.deny]
        where = [f"({' OR '.join(allow)})"] * bool(allow) + [f"NOT coalesce({d}, false)" for d in deny]
        rows = tables[name]
        if where:
            rows = bound(self.engine.spark, f"SELECT * FROM `{name}` WHERE {' AND '.join(where)}", tables, tables)
        for r in self.policies.rewrites:
            if r.table.lower() == name.lower():
                signal = bound(self.engine.spark, Select(r.query).sql(), tables, Select(r.query).words())
                rows = rewrite(rows, signal, r.column, r.value, r.key, signal.columns[0])
        return rows

    def tables(self) -> dict[str, DataFrame]:
        return {n: self.table(n) for n in self.engine.tables}

    def view(self, name: str) -> DataFrame:
        """All rows of a view of the engine, computed over what the user sees; key columns included."""
        return self._view(name, self.tables())

    def _view(self, name: str, seen: dict[str, DataFrame]) -> DataFrame:
        v = self.engine.view(name)
        for s in sorted(v.sources):
            if s not in seen:
                seen[s] = self._view(s, seen).select(*(f"`{c}`" for c in self.engine.view(s).columns))
        if isinstance(v.plan, Select):
            return v.compute(seen)
        own = v._seen(seen)
        return Step(own, own, {}).rows(v.plan, "after")

    def lookup(self, name: str, *key: Any) -> DataFrame:
        v = self.engine.view(name)
        return v._shown(v._only(self.view(name), [key]))

    # maintained

    def install(self, views: Iterable[str], prefix: str, materialize: str = FULL) -> dict[str, str]:
        """Makes the user's tables and views views of the engine, kept current by its writes; name to the engine's name, which starts with prefix.

        Tables with a key: each allowing policy is a view of its own (of a group's: the table joined with the memberships), then each row counts once,
        denied rows go, and rewrite policies mask columns. Tables without a key, whose equal rows must stay apart, are filtered in one view.
        """
        made: dict[str, str] = {}
        for t in self.engine.tables:
            made[t] = self._table(t, f"{prefix}{t}")
        for name in views:
            self._install(name, prefix, materialize, made)
        return made

    def _install(self, name: str, prefix: str, materialize: str, made: dict[str, str]) -> None:
        v = self.engine.view(name)
        for s in sorted(v.sources):
            if s not in made:
                self._install(s, prefix, materialize, made)
        self.engine.create_view(f"{prefix}{name}", v.plan if isinstance(v.plan, Node) else v.plan.text, materialize, public=False, names={t: made[n] for t, n in v.inputs.items()})
        made[name] = f"{prefix}{name}"

    def _table(self, name: str, own: str) -> str:
        """A chain of views that ends in the rows of a table that the user sees; its name."""
        e = self.engine
        mine = [p for p in self.policies.rows if p.table.lower() == name.lower()]
        rewrites = [r for r in self.policies.rewrites if r.table.lower() == name.lower()]
        if not mine and not rewrites:
            return name
        last, known = name, {n: n for n in e.tables}
        allow, deny = [p for p in mine if not p.deny], [p for p in mine if p.deny]
        add = lambda part, plan, names: e.create_view(f"{own}__{part}", plan, FULL, public=False, names=names) and f"{own}__{part}"
        if mine and (not e.tables[name].key or any(p.group for p in deny)):
            where = [f"({' OR '.join(map(self._predicate, allow))})"] * bool(allow) + [f"NOT coalesce({self._predicate(p)}, false)" for p in deny]
            last = add("rows", f"SELECT * FROM `{name}` WHERE {' AND '.join(where)}", known)
        elif mine:
            parts = []
            no = "".join(f" AND NOT coalesce({self._predicate(p)}, false)" for p in deny)
            plain = [self._predicate(p) for p in allow if p.group is None]
            if plain or not allow:
                parts.append(add("plain", f"SELECT * FROM `{name}` WHERE ({' OR '.join(plain) or 'true'}){no}", known))
            for p in (p for p in allow if p.group is not None):
                members = add(f"members{len(parts)}", dict(self.policies.memberships)[p.group], known)
                text = re.sub(r"\bGroupContext\.id\b", "GroupContext.gid", re.sub(r"\bUserContext\.(\w+)", lambda m: _literal(self.context[m[1]]), p.predicate))
                parts.append(add(f"group{len(parts)}", f"SELECT DISTINCT {', '.join(f'`{name}`.`{c}` AS `{c}`' for c in e.tables[name].schema.names)} FROM `{name}` JOIN members AS GroupContext ON true WHERE GroupContext.uid = {_literal(self.context.get('id'))} AND ({text}){no}", {name: name, "members": members}))
            last = parts[0]
            if len(parts) > 1:
                every = add("every", " UNION ALL ".join(f"SELECT * FROM p{i}" for i in range(len(parts))), {f"p{i}": p for i, p in enumerate(parts)})
                last = add("once", f"SELECT DISTINCT {', '.join(f'`{c}` AS `{c}`' for c in e.tables[name].schema.names)} FROM every", {"every": every})
        for i, r in enumerate(rewrites):
            signal = add(f"signal{i}", r.query, known)
            key = e.view(signal).columns[0]
            last = add(f"masked{i}", Rewrite(Source(last), Source(signal), r.column, r.value, r.key, key), {last: last, signal: signal})
        return last


def group_universes(engine: Engine, policies: Policies) -> dict[str, DataFrame]:
    """The ids of each group template's groups, each once: one group universe stands for each."""
    tables = {n: t.rows for n, t in engine.tables.items()}
    return {name: bound(engine.spark, q, tables, Select(q).words()).select("gid").where("gid IS NOT NULL").distinct() for name, q in policies.memberships}


def watch_groups(engine: Engine, policies: Policies, made: Callable[[str, DataFrame], None], prefix: str = "group_of_") -> None:
    """Calls made with a template's name and the ids (gid) of groups that come into being: those there now, then those that writes bring, each once."""
    seen = {}
    for name, query in policies.memberships:
        view = engine.create_view(f"{prefix}{name}", query, FULL, public=False)
        keys = seen[view.name] = NewKeys("gid", lambda new, name=name: made(name, new), engine.folder)
        keys(view.seen())
    engine.listeners.append(lambda n, change: seen[n](change.where(f"{WEIGHT} > 0")) if n in seen else None)
