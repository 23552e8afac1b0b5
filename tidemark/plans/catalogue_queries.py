"""Named queries over the star-schema tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from tidemark.operators import delta as D
from tidemark.operators import relational as R
from tidemark.operators.relational import Aggregate, Compare, In
from tidemark.plans.engine import NONE, PARTIAL, Engine
from tidemark.plans.security import Policies, Universe
from tidemark.sources.base import BaseTable
from tidemark.sources.store import shared
from tidemark.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function under name, with its oracle where there is one."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


@query("vote_flagship", "SELECT c_custkey, c_name, coalesce(n, 0) AS n_orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) o ON c_custkey = o_custkey")
def vote_flagship(spark, sf_dir):
    votes = R.aggregate(table(spark, sf_dir, "orders"), ["o_custkey"], Aggregate("count", "n"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return R.join(customer, votes, [("c_custkey", "o_custkey")], "left").select("c_custkey", "c_name", F.coalesce("n", F.lit(0)).alias("n_orders"))


@query("filter_compare", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_totalprice > 1000 AND o_totalprice <= 200000 AND o_orderstatus != 'P' AND o_orderkey >= 10 AND o_custkey < 100000 AND o_orderpriority = '1-URGENT'")
def filter_compare(spark, sf_dir):
    conditions = [Compare("o_totalprice", ">", 1000), Compare("o_totalprice", "<=", 200000), Compare("o_orderstatus", "!=", "P"), Compare("o_orderkey", ">=", 10), Compare("o_custkey", "<", 100000), Compare("o_orderpriority", "=", "1-URGENT")]
    return R.project(R.filter_rows(table(spark, sf_dir, "orders"), *conditions), ["o_orderkey", "o_totalprice", "o_orderstatus"])


@query("filter_columns", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey > l_suppkey AND l_tax = l_discount")
def filter_columns(spark, sf_dir):
    kept = R.filter_rows(table(spark, sf_dir, "lineitem"), Compare("l_partkey", ">", other="l_suppkey"), Compare("l_tax", "=", other="l_discount"))
    return R.project(kept, ["l_orderkey", "l_linenumber"])


@query("filter_in_list", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'O')")
def filter_in_list(spark, sf_dir):
    return R.project(R.filter_rows(table(spark, sf_dir, "orders"), In("o_orderstatus", ("F", "O"))), ["o_orderkey", "o_orderstatus"])


@query("filter_or", "SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE (o_orderstatus = 'F' OR o_totalprice > 100000) AND (c_acctbal < 0 OR o_orderpriority = '5-LOW')")
def filter_or(spark, sf_dir):
    joined = R.join(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), [("o_custkey", "c_custkey")])
    one = Compare("o_orderstatus", "=", "F").expression() | Compare("o_totalprice", ">", 100000).expression()
    two = Compare("c_acctbal", "<", 0).expression() | Compare("o_orderpriority", "=", "5-LOW").expression()
    return R.project(R.filter_rows(joined, one, two), ["o_orderkey"])


@query("filter_null", "SELECT c_custkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) o ON c_custkey = o_custkey WHERE o_orderkey IS NULL")
def filter_null(spark, sf_dir):
    dear = R.filter_rows(table(spark, sf_dir, "orders"), Compare("o_totalprice", ">", 300000))
    joined = R.join(table(spark, sf_dir, "customer"), dear, [("c_custkey", "o_custkey")], "left")
    return R.project(R.filter_rows(joined, Compare("o_orderkey", "=", None)), ["c_custkey"])


@query("project_arith", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net, l_orderkey // 7 AS week, l_linenumber - 5 AS low, CAST(trunc((l_linenumber - 5) / 2) AS BIGINT) AS half, 'line' AS kind FROM lineitem")
def project_arith(spark, sf_dir):
    made = {"net": F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4), "week": ("l_orderkey", "div", F.lit(7)), "low": ("l_linenumber", "-", F.lit(5)), "half": ((F.col("l_linenumber") - 5), "div", F.lit(2))}
    return R.project(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], made, {"kind": "line"})


@query("join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(spark, sf_dir):
    return R.project(R.join(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), [("o_custkey", "c_custkey")]), ["o_orderkey", "c_name"])


@query("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 250000) o ON c_custkey = o_custkey")
def join_left(spark, sf_dir):
    dear = R.filter_rows(table(spark, sf_dir, "orders"), Compare("o_totalprice", ">", 250000))
    return R.project(R.join(table(spark, sf_dir, "customer"), dear, [("c_custkey", "o_custkey")], "left"), ["c_custkey", "o_orderkey"])


@query("join_multi", "SELECT n_name, count(*) AS n, sum(CAST(l_quantity AS BIGINT))::BIGINT AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def join_multi(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    joined = R.join(R.join(R.join(t("lineitem"), t("orders"), [("l_orderkey", "o_orderkey")]), t("customer"), [("o_custkey", "c_custkey")]), t("nation"), [("c_nationkey", "n_nationkey")])
    return R.aggregate(joined, ["n_name"], Aggregate("count", "n"), Aggregate("sum", "quantity", F.col("l_quantity").cast("long")))


@query("join_two_columns", "SELECT l_orderkey, s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON s_nationkey = c_nationkey AND l_partkey = c_custkey")
def join_two_columns(spark, sf_dir):
    joined = R.join(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier"), [("l_suppkey", "s_suppkey")])
    return R.project(R.join(joined, table(spark, sf_dir, "customer"), [("s_nationkey", "c_nationkey"), ("l_partkey", "c_custkey")]), ["l_orderkey", "s_name"])


@query("agg_count", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey")
def agg_count(spark, sf_dir):
    return R.aggregate(table(spark, sf_dir, "orders"), ["o_custkey"], Aggregate("count", "n"))


@query("agg_sum", "SELECT l_suppkey, sum(CAST(l_quantity AS BIGINT))::BIGINT AS quantity FROM lineitem GROUP BY l_suppkey")
def agg_sum(spark, sf_dir):
    return R.aggregate(table(spark, sf_dir, "lineitem"), ["l_suppkey"], Aggregate("sum", "quantity", F.col("l_quantity").cast("long")))


@query("agg_min_max", "SELECT l_partkey, min(l_quantity) AS least, max(l_extendedprice) AS most FROM lineitem GROUP BY l_partkey")
def agg_min_max(spark, sf_dir):
    return R.aggregate(table(spark, sf_dir, "lineitem"), ["l_partkey"], Aggregate("min", "least", "l_quantity"), Aggregate("max", "most", "l_extendedprice"))


@query("agg_group_concat", "SELECT r_name, string_agg(DISTINCT n_name || '!', '; ' ORDER BY n_name || '!') AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def agg_group_concat(spark, sf_dir):
    joined = R.join(table(spark, sf_dir, "nation"), table(spark, sf_dir, "region"), [("n_regionkey", "r_regionkey")])
    return R.aggregate(joined, ["r_name"], Aggregate("group_concat", "names", pieces=("n_name", F.lit("!")), separator="; "))


@query("agg_filter_count", "SELECT o_custkey, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS done FROM orders GROUP BY o_custkey")
def agg_filter_count(spark, sf_dir):
    return R.aggregate(table(spark, sf_dir, "orders"), ["o_custkey"], Aggregate("count", "done", where=Compare("o_orderstatus", "=", "F")))


@query("agg_filter_sum", "SELECT l_orderkey, sum(CASE WHEN l_returnflag = 'R' THEN l_linenumber END)::BIGINT AS back FROM lineitem GROUP BY l_orderkey")
def agg_filter_sum(spark, sf_dir):
    return R.aggregate(table(spark, sf_dir, "lineitem"), ["l_orderkey"], Aggregate("sum", "back", "l_linenumber", where=Compare("l_returnflag", "=", "R")))


@query("agg_filter_else", "SELECT l_orderkey, sum(CASE WHEN l_returnflag = 'R' THEN l_linenumber ELSE 100 END)::BIGINT AS back, count(CASE WHEN l_returnflag = 'R' THEN l_linenumber ELSE 1 END) AS n FROM lineitem GROUP BY l_orderkey")
def agg_filter_else(spark, sf_dir):
    back = Compare("l_returnflag", "=", "R")
    return R.aggregate(table(spark, sf_dir, "lineitem"), ["l_orderkey"], Aggregate("sum", "back", "l_linenumber", where=back, otherwise=100), Aggregate("count", "n", "l_linenumber", where=back, otherwise=1))


@query("agg_count_distinct", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, sum(DISTINCT o_custkey)::BIGINT AS keys FROM orders GROUP BY o_orderstatus")
def agg_count_distinct(spark, sf_dir):
    return R.aggregate(table(spark, sf_dir, "orders"), ["o_orderstatus"], Aggregate("count", "customers", "o_custkey", distinct=True), Aggregate("sum", "keys", "o_custkey", distinct=True))


@query("agg_no_group", "SELECT 2 * max(l_linenumber) AS most, count(*) AS n FROM lineitem")
def agg_no_group(spark, sf_dir):
    one = R.aggregate(table(spark, sf_dir, "lineitem"), [], Aggregate("max", "m", "l_linenumber"), Aggregate("count", "n"))
    return R.project(one, [], {"most": (F.lit(2), "*", "m"), "n": F.col("n")})


@query("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
def agg_having(spark, sf_dir):
    return R.filter_rows(R.aggregate(table(spark, sf_dir, "orders"), ["o_custkey"], Aggregate("count", "n")), Compare("n", ">", 12))


@query("latest", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest(spark, sf_dir):
    return R.latest(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"]).drop("ts")


@query("union_all", "SELECT c_nationkey AS nation, c_name AS name FROM customer UNION ALL SELECT s_nationkey, s_name FROM supplier")
def union_all(spark, sf_dir):
    named = lambda n, p: R.project(table(spark, sf_dir, n), [], {"nation": F.col(f"{p}_nationkey"), "name": F.col(f"{p}_name")})
    return R.union(named("customer", "c"), named("supplier", "s"))


@query("topk_group", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def topk_group(spark, sf_dir):
    return R.top_k(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [("o_totalprice", False), ("o_orderkey", True)], 3)


@query("topk_global", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def topk_global(spark, sf_dir):
    return R.top_k(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [], [("o_totalprice", False), ("o_orderkey", True)], 50)


@query("topk_union", "SELECT * FROM (SELECT c_name AS name, c_acctbal AS balance FROM customer UNION ALL SELECT s_name, s_acctbal FROM supplier) ORDER BY balance DESC, name LIMIT 20")
def topk_union(spark, sf_dir):
    named = lambda n, p: R.project(table(spark, sf_dir, n), [], {"name": F.col(f"{p}_name"), "balance": F.col(f"{p}_acctbal")})
    return R.top_k(R.union(named("customer", "c"), named("supplier", "s")), [], [("balance", False), ("name", True)], 20)


@query("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_rows(spark, sf_dir):
    return R.distinct(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"])


@query("identity_view", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal > 0")
def identity_view(spark, sf_dir):
    return R.identity(R.project(R.filter_rows(table(spark, sf_dir, "customer"), Compare("c_acctbal", ">", 0)), ["c_custkey", "c_mktsegment"]))


@query("rewrite_policy", "SELECT o_orderkey, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') THEN 'hidden' ELSE o_orderpriority END AS o_orderpriority FROM orders")
def rewrite_policy(spark, sf_dir):
    signal = R.filter_rows(table(spark, sf_dir, "lineitem"), Compare("l_returnflag", "=", "R"))
    return R.rewrite(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), signal, "o_orderpriority", "hidden", "o_orderkey", "l_orderkey")


@query("row_policy_union", "SELECT o_orderkey, o_custkey, CASE WHEN o_totalprice > 100000 THEN 'masked' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE (o_orderstatus = 'F' OR o_custkey = 7 OR o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7)) AND NOT o_orderpriority = '5-LOW'")
def row_policy_union(spark, sf_dir):
    engine = Engine(spark, materialize=NONE)
    for n, key in (("orders", "o_orderkey"), ("customer", "c_custkey")):
        rows = table(spark, sf_dir, n)
        engine.create_table(n, rows.schema, [key], rows=rows)
    policies = {
        "groups": [{"name": "nation", "membership": "SELECT c_nationkey AS uid, c_custkey AS gid FROM customer", "policies": [{"table": "orders", "predicate": "WHERE o_custkey = GroupContext.id"}]}],
        "policies": [
            {"table": "orders", "predicate": "WHERE o_orderstatus = 'F'"}, {"table": "orders", "predicate": "WHERE o_custkey = UserContext.id"}, {"table": "orders", "predicate": "WHERE o_orderpriority = '5-LOW'", "action": "deny"},
            {"table": "orders", "action": "rewrite", "column": "o_orderstatus", "value": "masked", "key": "o_orderkey", "rewrite": "SELECT o_orderkey FROM orders WHERE o_totalprice > 100000"},
        ],
    }
    return Universe(engine, Policies.parse(policies), {"id": 7}).table("orders").select("o_orderkey", "o_custkey", "o_orderstatus")


@query("trigger_new_keys", "SELECT DISTINCT user_id FROM events WHERE event_id >= 100 AND user_id NOT IN (SELECT user_id FROM events WHERE event_id < 100 AND user_id IS NOT NULL)")
def trigger_new_keys(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return R.trigger(events.where("event_id >= 100"), events.where("event_id < 100"), "user_id")


@query("shard_by_key", "SELECT o_custkey, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY o_custkey")
def shard_by_key(spark, sf_dir):
    return R.aggregate(R.shard(table(spark, sf_dir, "orders"), 8, "o_custkey"), ["o_custkey"], Aggregate("sum", "keys", "o_orderkey"))


def _engine(spark, sf_dir, *names: str, materialize: str = NONE) -> Engine:
    keys = {"customer": ["c_custkey"], "orders": ["o_orderkey"], "part": ["p_partkey"], "supplier": ["s_suppkey"], "nation": ["n_nationkey"], "region": ["r_regionkey"]}
    engine = Engine(spark, materialize=materialize)
    for n in names:
        rows = table(spark, sf_dir, n)
        engine.create_table(n, rows.schema, keys.get(n, []), rows=rows)
    return engine


@query("subquery_in", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")
def subquery_in(spark, sf_dir):
    return _engine(spark, sf_dir, "customer", "orders").create_view("v", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)").scan()


@query("subquery_join", "SELECT c_name, big.n FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey) AS big ON c_custkey = big.o_custkey")
def subquery_join(spark, sf_dir):
    return _engine(spark, sf_dir, "customer", "orders").create_view("v", "SELECT c_name, big.n FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey) AS big ON c_custkey = big.o_custkey").scan()


@query("recipe_views", "SELECT n_name, count(*) AS n, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS done FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def recipe_views(spark, sf_dir):
    engine = _engine(spark, sf_dir, "orders", "customer", "nation")
    engine.extend("VIEW placed: SELECT n_name, o_orderstatus FROM orders, customer, nation WHERE o_custkey = c_custkey AND c_nationkey = n_nationkey; QUERY per_nation: SELECT n_name, COUNT(*) AS n, SUM(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS done FROM placed GROUP BY n_name;")
    return engine.view("per_nation").scan()


@query("param_lookup", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 17")
def param_lookup(spark, sf_dir):
    return _engine(spark, sf_dir, "orders").create_view("v", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = ?").lookup(17)


@query("param_multi_lookup", "SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey IN (3, 17, 40) GROUP BY o_custkey")
def param_multi_lookup(spark, sf_dir):
    return _engine(spark, sf_dir, "orders").create_view("v", "SELECT o_custkey, COUNT(*) AS n FROM orders WHERE o_custkey = ? GROUP BY o_custkey").multi_lookup([(3,), (17,), (40,)])


@query("param_topk", "SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey IN (3, 17) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
def param_topk(spark, sf_dir):
    return _engine(spark, sf_dir, "orders").create_view("v", "SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey = ? ORDER BY o_totalprice DESC, o_orderkey LIMIT 2").multi_lookup([(3,), (17,)])


@query("param_offset", "SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey IN (3, 17) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) BETWEEN 2 AND 4")
def param_offset(spark, sf_dir):
    return _engine(spark, sf_dir, "orders").create_view("v", "SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey = ? ORDER BY o_totalprice DESC, o_orderkey LIMIT 3 OFFSET 1").multi_lookup([(3,), (17,)])


@query("text_literals", "SELECT c_custkey, 'x = NULL and group_concat(y)' AS note FROM customer WHERE c_name <> 'a = NULL' AND c_custkey IS NOT NULL")
def text_literals(spark, sf_dir):
    return _engine(spark, sf_dir, "customer").create_view("v", "SELECT c_custkey, 'x = NULL and group_concat(y)' AS note FROM customer WHERE c_name <> 'a = NULL' AND c_custkey != NULL").scan()


@query("group_concat_nested", "SELECT r_name, string_agg(DISTINCT n_name || '(' || CAST(n_nationkey AS VARCHAR), ', ' ORDER BY n_name || '(' || CAST(n_nationkey AS VARCHAR)) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def group_concat_nested(spark, sf_dir):
    return _engine(spark, sf_dir, "nation", "region").create_view("v", "SELECT r_name, GROUP_CONCAT(CONCAT(n_name, '(', n_nationkey), ', ') AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name").scan()


@query("view_over_alias", "SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY o_custkey")
def view_over_alias(spark, sf_dir):
    engine = _engine(spark, sf_dir, "orders")
    engine.extend("VIEW dear: SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 1000; VIEW same: SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 1000; QUERY n: SELECT o_custkey, COUNT(*) AS n FROM same GROUP BY o_custkey;")
    return engine.view("n").scan()


@query("param_partial", "SELECT c_name, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey IN (4, 9)")
def param_partial(spark, sf_dir):
    view = _engine(spark, sf_dir, "orders", "customer").create_view("v", "SELECT c_name, o_orderkey FROM orders, customer WHERE o_custkey = c_custkey AND c_nationkey = ?", PARTIAL)
    view.lookup(4)
    return view.multi_lookup([(4,), (9,)])


def _parts(rows, key: str):
    """Rows there at first, rows that come and rows that go in one batch: a tenth each comes and goes."""
    part = (F.col(key) * 7919) % 10
    return rows.where(part != 1), rows.where(part == 1), rows.where(part == 2)


def _after(rows, key: str):
    return rows.where((F.col(key) * 7919) % 10 != 2)


def _maintained(node, tables: dict, changed: dict[str, str]):
    """The node's view, kept by one batch of changes of the tables in changed (with the key that deals their rows)."""
    before, after, changes = dict(tables), dict(tables), {}
    for name, key in changed.items():
        before[name], come, gone = _parts(tables[name], key)
        after[name] = _after(tables[name], key)
        changes[name] = D.signed(come).unionByName(D.signed(gone, -1))
    view = D.MaintainedView(node, before)
    view.apply(before, after, changes)
    return view.rows


def _kept(name: str, key: str) -> str:
    return f"(SELECT * FROM {name} WHERE ({key} * 7919) % 10 <> 2) AS {name}"


_O, _C, _L, _E = _kept("orders", "o_orderkey"), _kept("customer", "c_custkey"), _kept("lineitem", "l_orderkey"), _kept("events", "event_id")


@query("ivm_vote", f"SELECT c_custkey, c_name, n FROM {_C} LEFT JOIN (SELECT o_custkey, count(*) AS n FROM {_O} WHERE o_totalprice > 200000 GROUP BY o_custkey) o ON c_custkey = o_custkey")
def ivm_vote(spark, sf_dir):
    votes = D.Grouped(D.Filter(D.Source("orders"), [Compare("o_totalprice", ">", 200000)]), ["o_custkey"], [Aggregate("count", "n")])
    node = D.Project(D.Join(D.Source("customer"), votes, [("c_custkey", "o_custkey")], "left"), ["c_custkey", "c_name", "n"])
    return _maintained(node, {n: table(spark, sf_dir, n) for n in ("customer", "orders")}, {"customer": "c_custkey", "orders": "o_orderkey"})


@query("ivm_join", f"SELECT l_orderkey, l_linenumber, c_name FROM {_L} JOIN {_O} ON l_orderkey = o_orderkey JOIN {_C} ON o_custkey = c_custkey")
def ivm_join(spark, sf_dir):
    node = D.Join(D.Join(D.Source("lineitem"), D.Source("orders"), [("l_orderkey", "o_orderkey")]), D.Source("customer"), [("o_custkey", "c_custkey")])
    tables = {"lineitem": table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), "orders": table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "customer": table(spark, sf_dir, "customer").select("c_custkey", "c_name")}
    return _maintained(D.Project(node, ["l_orderkey", "l_linenumber", "c_name"]), tables, {"lineitem": "l_orderkey", "orders": "o_orderkey", "customer": "c_custkey"})


@query("ivm_sum", f"SELECT l_suppkey, count(*) AS n, sum(l_linenumber)::BIGINT AS lines FROM {_L} GROUP BY l_suppkey")
def ivm_sum(spark, sf_dir):
    node = D.Grouped(D.Source("lineitem"), ["l_suppkey"], [Aggregate("count", "n"), Aggregate("sum", "lines", "l_linenumber")])
    return _maintained(node, {"lineitem": table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber")}, {"lineitem": "l_orderkey"})


@query("ivm_minmax", f"SELECT l_partkey, min(l_quantity) AS least, max(l_extendedprice) AS most FROM {_L} GROUP BY l_partkey")
def ivm_minmax(spark, sf_dir):
    node = D.Grouped(D.Source("lineitem"), ["l_partkey"], [Aggregate("min", "least", "l_quantity"), Aggregate("max", "most", "l_extendedprice")])
    return _maintained(node, {"lineitem": table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")}, {"lineitem": "l_orderkey"})


@query("ivm_group_concat", f"SELECT o_custkey, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS kinds FROM {_O} GROUP BY o_custkey")
def ivm_group_concat(spark, sf_dir):
    node = D.Grouped(D.Source("orders"), ["o_custkey"], [Aggregate("group_concat", "kinds", "o_orderpriority", separator="|")])
    return _maintained(node, {"orders": table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")}, {"orders": "o_orderkey"})


@query("ivm_topk", f"SELECT o_custkey, o_orderkey, o_totalprice FROM {_O} QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def ivm_topk(spark, sf_dir):
    node = D.TopK(D.Source("orders"), ["o_custkey"], [("o_totalprice", False), ("o_orderkey", True)], 3)
    return _maintained(node, {"orders": table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")}, {"orders": "o_orderkey"})


@query("ivm_distinct", f"SELECT DISTINCT l_partkey, l_returnflag FROM {_L}")
def ivm_distinct(spark, sf_dir):
    node = D.Distinct(D.Source("lineitem"), ["l_partkey", "l_returnflag"])
    return _maintained(node, {"lineitem": table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")}, {"lineitem": "l_orderkey"})


@query("ivm_latest", f"SELECT user_id, event_id, event_type FROM {_E} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def ivm_latest(spark, sf_dir):
    node = D.Project(D.Latest(D.Source("events"), ["user_id"], ["ts", "event_id"]), ["user_id", "event_id", "event_type"])
    return _maintained(node, {"events": table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")}, {"events": "event_id"})


@query("ivm_union", f"SELECT c_nationkey AS nation, c_name AS name FROM {_C} UNION ALL SELECT s_nationkey, s_name FROM supplier")
def ivm_union(spark, sf_dir):
    named = lambda n, p: D.Project(D.Source(n), [], {"nation": F.col(f"{p}_nationkey"), "name": F.col(f"{p}_name")})
    return _maintained(D.Union([named("customer", "c"), named("supplier", "s")]), {n: table(spark, sf_dir, n) for n in ("customer", "supplier")}, {"customer": "c_custkey"})


@query("ivm_rewrite", f"SELECT o_orderkey, CASE WHEN EXISTS (SELECT 1 FROM {_L} WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') THEN 'hidden' ELSE o_orderpriority END AS o_orderpriority FROM orders")
def ivm_rewrite(spark, sf_dir):
    node = D.Rewrite(D.Source("orders"), D.Filter(D.Source("lineitem"), [Compare("l_returnflag", "=", "R")]), "o_orderpriority", "hidden", "o_orderkey", "l_orderkey")
    tables = {"orders": table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "lineitem": table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag")}
    return _maintained(node, tables, {"lineitem": "l_orderkey"})


_WRITTEN = """WITH written AS (
    SELECT c_custkey, c_name, CASE WHEN c_custkey % 7 = 3 THEN c_nationkey + 100 ELSE c_nationkey END AS c_nationkey FROM customer WHERE c_custkey % 7 <> 5
    UNION ALL SELECT -1 - c_custkey, 'new', c_nationkey FROM customer WHERE c_custkey % 7 = 1)"""


def _writes(customer):
    """Updates, deletes and inserts as rows with their order."""
    at = F.col("c_custkey") % 7
    changed = customer.where(at == 3).withColumn("c_nationkey", F.col("c_nationkey") + 100).withColumn("_op", F.lit("upsert"))
    gone, new = customer.where(at == 5).withColumn("_op", F.lit("delete")), customer.where(at == 1).withColumn("c_custkey", -1 - F.col("c_custkey")).withColumn("c_name", F.lit("new")).withColumn("_op", F.lit("insert"))
    ignored = customer.where(at == 2).withColumn("c_name", F.lit("never")).withColumn("_op", F.lit("insert"))
    return changed.unionByName(gone).unionByName(new).unionByName(ignored).withColumn("_seq", F.monotonically_increasing_id())


@query("base_upsert", f"{_WRITTEN} SELECT * FROM written")
def base_upsert(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    base = BaseTable(spark, "customer", rows.schema, ["c_custkey"], rows=rows)
    base.perform_rows(_writes(rows))
    return base.rows


@query("base_update", """WITH t AS (SELECT o_orderkey, o_custkey, o_orderkey + 9007199254740993 AS wide, CAST(o_totalprice AS DECIMAL(18,2)) AS price, CASE WHEN o_orderkey % 5 = 1 THEN 'nan'::DOUBLE WHEN o_orderkey % 5 = 2 THEN NULL ELSE o_totalprice END AS d, o_orderdate FROM orders)
    SELECT o_orderkey, CASE WHEN k = 3 THEN 7 ELSE o_custkey END AS o_custkey, CASE WHEN k = 3 THEN wide + 5 WHEN k = 6 THEN 11 ELSE wide END AS wide, CASE WHEN k = 3 THEN price - 0.25 ELSE price END AS price,
        CASE WHEN k = 4 THEN NULL ELSE d END AS d, CASE WHEN k = 6 THEN NULL ELSE o_orderdate END AS o_orderdate FROM (SELECT *, o_orderkey % 8 AS k FROM t) WHERE k <> 5""")
def base_update(spark, sf_dir):
    """Set, Add, Sub, delete and a new start after a delete, several operations a key, on bigints beyond a double's reach, NaN, decimals and dates."""
    orders, nothing = table(spark, sf_dir, "orders"), F.lit(None)
    kind = F.col("o_orderkey") % 5
    rows = orders.select("o_orderkey", "o_custkey", (F.col("o_orderkey") + F.lit(9007199254740993)).alias("wide"), F.col("o_totalprice").cast("decimal(18,2)").alias("price"), F.when(kind == 1, F.lit(float("nan"))).when(kind != 2, F.col("o_totalprice")).alias("d"), "o_orderdate")
    base = BaseTable(spark, "orders", rows.schema, ["o_orderkey"], rows=rows)
    names, k = rows.columns, F.col("o_orderkey") % 8

    def ops(when, op, seq, **changes):
        """An operation for each of some keys; changes: column to how and value."""
        own = rows.where(when)
        values = [changes.get(c, ("", nothing))[1].cast(rows.schema[c].dataType).alias(f"_new_{c}") for c in names]
        return own.select(F.lit(seq).cast("long").alias("_seq"), F.lit(op).alias("_op"), *names, *values, F.array(*(F.lit(changes.get(c, ("",))[0]) for c in names)).alias("_how"))

    parts = [
        ops(k == 3, "update", 0, wide=("+", F.lit(100))), ops(k == 3, "update", 1, wide=("=", F.col("wide"))), ops(k == 3, "update", 2, wide=("+", F.lit(8)), price=("-", F.lit(0.25)), o_custkey=("=", F.lit(7))), ops(k == 3, "update", 3, wide=("-", F.lit(3))),
        ops(k == 4, "update", 0, d=("+", nothing)), ops(k == 5, "delete", 0), ops(k == 5, "update", 1, o_custkey=("=", F.lit(1))), ops(k == 2, "delete", 0), ops(k == 2, "insert", 1), ops(k == 2, "insert", 2, wide=("=", F.lit(0))),
        ops(k == 6, "upsert", 0, wide=("=", F.lit(11)), o_orderdate=("=", nothing)), ops(k == 7, "insert", 0, wide=("=", F.lit(0))),
    ]
    base.perform_frame(reduce(lambda a, b: a.unionByName(b), parts), {"wide", "price", "d"})
    return base.rows


@query("ivm_sql_join", f"{_WRITTEN} SELECT o_orderkey, c_name FROM orders JOIN written ON o_custkey = c_custkey WHERE c_nationkey > 10")
def ivm_sql_join(spark, sf_dir):
    return _sql_kept(spark, sf_dir, "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey > 10")


@query("ivm_sql_group", f"{_WRITTEN} SELECT c_nationkey, count(*) AS n, max(o_totalprice) AS most FROM orders JOIN written ON o_custkey = c_custkey GROUP BY c_nationkey")
def ivm_sql_group(spark, sf_dir):
    return _sql_kept(spark, sf_dir, "SELECT c_nationkey, COUNT(*) AS n, MAX(o_totalprice) AS most FROM orders, customer WHERE o_custkey = c_custkey GROUP BY c_nationkey")


def _sql_kept(spark, sf_dir, sql: str):
    """A stored SQL view, kept while customers are written."""
    engine = Engine(spark)
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    engine.create_table("customer", rows.schema, ["c_custkey"], rows=rows)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    engine.create_table("orders", orders.schema, ["o_orderkey"], rows=orders)
    view = engine.create_view("v", sql)
    engine.write_rows("customer", _writes(rows))
    return view.scan()


@query("ivm_sql_outer", f"{_WRITTEN} SELECT o_orderkey, c_name FROM orders LEFT JOIN written ON o_custkey = c_custkey")
def ivm_sql_outer(spark, sf_dir):
    return _sql_kept(spark, sf_dir, "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON orders.o_custkey = customer.c_custkey")


@query("ivm_sql_having", f"{_WRITTEN} SELECT c_nationkey, count(*) AS n FROM written GROUP BY c_nationkey HAVING count(*) > 5")
def ivm_sql_having(spark, sf_dir):
    return _sql_kept(spark, sf_dir, "SELECT c_nationkey, COUNT(*) AS n FROM customer GROUP BY c_nationkey HAVING COUNT(*) > 5")


@query("ivm_sql_union", f"{_WRITTEN} SELECT c_custkey AS k FROM written UNION ALL SELECT o_custkey FROM orders")
def ivm_sql_union(spark, sf_dir):
    return _sql_kept(spark, sf_dir, "SELECT c_custkey AS k FROM customer UNION ALL SELECT o_custkey FROM orders")


@query("ivm_sql_distinct", f"{_WRITTEN} SELECT DISTINCT c_nationkey FROM written WHERE c_nationkey > 3")
def ivm_sql_distinct(spark, sf_dir):
    return _sql_kept(spark, sf_dir, "SELECT DISTINCT c_nationkey FROM customer WHERE c_nationkey > 3")


@query("universe_kept", f"{_WRITTEN} SELECT c_custkey, CASE WHEN c_nationkey > 20 THEN 'masked' ELSE c_name END AS c_name, c_nationkey FROM written WHERE (c_nationkey < 30 OR c_custkey = 7) AND NOT c_nationkey = 4")
def universe_kept(spark, sf_dir):
    """A user's universe as views of the engine, kept while customers are written."""
    engine = Engine(spark)
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    engine.create_table("customer", rows.schema, ["c_custkey"], rows=rows)
    policies = {"policies": [{"table": "customer", "predicate": "WHERE c_nationkey < 30"}, {"table": "customer", "predicate": "WHERE c_custkey = UserContext.id"}, {"table": "customer", "predicate": "WHERE c_nationkey = 4", "action": "deny"}, {"table": "customer", "action": "rewrite", "column": "c_name", "value": "masked", "key": "c_custkey", "rewrite": "SELECT c_custkey FROM customer WHERE c_nationkey > 20"}]}
    engine.create_view("v", "SELECT c_custkey, c_name, c_nationkey FROM customer")
    made = Universe(engine, Policies.parse(policies), {"id": 7}).install(["v"], "u7_")
    engine.write_rows("customer", _writes(rows))
    return engine.view(made["v"]).scan()


@query("avg_sql", "SELECT o_custkey, avg(o_orderkey) AS mean FROM orders GROUP BY o_custkey")
def avg_sql(spark, sf_dir):
    return _engine(spark, sf_dir, "orders").create_view("v", "SELECT o_custkey, AVG(o_orderkey) AS mean FROM orders GROUP BY o_custkey").scan()


@query("using_and_set_operations", "(SELECT k FROM (SELECT c_custkey AS k FROM customer) JOIN (SELECT o_custkey AS k FROM orders) USING (k)) EXCEPT SELECT s_suppkey FROM supplier")
def using_and_set_operations(spark, sf_dir):
    sql = "(SELECT k FROM (SELECT c_custkey AS k FROM customer) JOIN (SELECT o_custkey AS k FROM orders) USING (k)) EXCEPT SELECT s_suppkey FROM supplier"
    return _engine(spark, sf_dir, "customer", "orders", "supplier").create_view("v", sql).scan()


@query("logic_sql", "SELECT c_custkey FROM customer WHERE (c_acctbal BETWEEN 0 AND 5000 OR c_name LIKE '%9') AND NOT c_mktsegment = 'BUILDING' AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def logic_sql(spark, sf_dir):
    return _engine(spark, sf_dir, "customer", "orders").create_view("v", "SELECT c_custkey FROM customer WHERE (c_acctbal BETWEEN 0 AND 5000 OR c_name LIKE '%9') AND NOT c_mktsegment = 'BUILDING' AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)").scan()


@query("reopened_engine", f"{_WRITTEN} SELECT c_nationkey, count(*) AS n FROM written GROUP BY c_nationkey")
def reopened_engine(spark, sf_dir):
    """What an engine shows that was opened again after a write, and written to once more without effect."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    folder = f"{shared(spark)}/engine-{uuid.uuid4().hex}"
    engine = Engine(spark, folder)
    engine.create_table("customer", rows.schema, ["c_custkey"], rows=rows)
    engine.create_view("v", "SELECT c_nationkey, COUNT(*) AS n FROM customer GROUP BY c_nationkey")
    engine.write_rows("customer", _writes(rows), "s", 0)
    again = Engine.reopen(spark, folder)
    again.write_rows("customer", _writes(rows), "s", 0)  # taken in before
    return again.view("v").scan()


@query("event_windows", "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    counted = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), "event_type", "n")
