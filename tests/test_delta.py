"""Kept views equal computed ones after every batch of random changes, for every operator."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.operators import delta as D
from tidemark.operators.relational import WEIGHT, Aggregate, Compare

L, R = "x int, y string, z int", "x int, name string"


def nodes():
    left, right = D.Source("l"), D.Source("r")
    counted = D.Grouped(left, ["x"], [Aggregate("count", "n"), Aggregate("sum", "total", "z"), Aggregate("count", "some", "z", where=Compare("z", ">", 3)), Aggregate("sum", "other", "z", where=Compare("z", ">", 3), otherwise=10)])
    return {
        "filter_project": D.Project(D.Filter(left, [Compare("z", ">=", 2)]), ["x"], {"twice": ("z", "*", F.lit(2))}, {"one": 1}),
        "join": D.Join(left, right, ["x"]),
        "left_join": D.Join(left, right, ["x"], "left"),
        "self_join": D.Join(left, D.Project(left, ["x"], {"w": F.col("z")}), ["x"]),
        "counts": counted,
        "left_join_of_counts": D.Join(right, counted, ["x"], "left"),
        "global": D.Grouped(left, [], [Aggregate("count", "n"), Aggregate("sum", "total", "z")]),
        "min_max": D.Grouped(left, ["y"], [Aggregate("min", "least", "z"), Aggregate("max", "most", "z")]),
        "concat": D.Grouped(left, ["x"], [Aggregate("group_concat", "all", "y", separator="#")]),
        "count_distinct": D.Grouped(left, ["x"], [Aggregate("count", "n", "y", distinct=True)]),
        "top_k": D.TopK(left, ["y"], [("z", False), ("x", True)], 2),
        "top_k_global": D.TopK(left, [], [("z", False), ("x", True), ("y", True)], 3),
        "distinct": D.Distinct(left, ["x", "y"]),
        "latest": D.Latest(left, ["x"], ["z", "y"]),
        "union": D.Union([D.Project(left, ["x"]), D.Project(right, ["x"])]),
        "rewrite": D.Rewrite(left, D.Filter(right, [Compare("name", "!=", "a")]), "y", "gone", "x", "x"),
    }


def changes(rng, rows, new):
    """Rows that go (some of those there) and rows that come."""
    gone = rng.sample(rows, min(len(rows), rng.randint(0, 4)))
    come = [new() for _ in range(rng.randint(0, 5))]
    left = list((Counter(rows) - Counter(gone)).elements()) + come
    return left, [(*r, -1) for r in gone] + [(*r, 1) for r in come]


NAMES = ["concat", "count_distinct", "counts", "distinct", "filter_project", "global", "join", "latest", "left_join", "left_join_of_counts", "min_max", "rewrite", "self_join", "top_k", "top_k_global", "union"]


def test_all_are_tried(spark):
    assert sorted(nodes()) == NAMES


@pytest.mark.parametrize("name", NAMES)
def test_kept_equals_computed(spark, name):
    node, rng = nodes()[name], random.Random(name)
    makers = {"l": lambda: (rng.choice([1, 2, 3, None]), rng.choice(["a", "b", None]), rng.choice([0, 1, 2, 5, 9, None])), "r": lambda: (rng.choice([1, 2, 3, 4, None]), rng.choice(["a", "b"]))}
    schemas = {"l": L, "r": R}
    rows = {n: [makers[n]() for _ in range(6)] for n in "lr"}
    frames = {n: spark.createDataFrame(rows[n], schemas[n]) for n in "lr"}
    view = D.MaintainedView(node, frames)
    for _ in range(2):
        signed = {}
        for n in "lr":
            rows[n], signed[n] = changes(rng, rows[n], makers[n])
        after = {n: spark.createDataFrame(rows[n], schemas[n]) for n in "lr"}
        given = {n: spark.createDataFrame(signed[n], f"{schemas[n]}, {WEIGHT} int") for n in "lr" if signed[n]}
        before = Counter(map(tuple, view.rows.collect()))
        change = view.apply(frames, after, given)
        frames = after
        want = Counter(map(tuple, D.Step(after, after, {}).rows(node, "after").collect()))
        assert Counter(map(tuple, view.rows.collect())) == want
        moved = Counter(before)
        for r in change.select(*view.rows.columns, WEIGHT).collect():
            moved[tuple(r[:-1])] += r[-1]
        assert {k: n for k, n in moved.items() if n} == dict(want)


def test_counts_read_the_change_alone(spark):
    """Where state is kept, the plan of a change doesn't scan the source."""
    rows = spark.createDataFrame([(1, "a", 2)], L)
    node = D.Grouped(D.Source("l"), ["x"], [Aggregate("count", "n")])
    view = D.MaintainedView(node, {"l": rows})
    step = D.Step({"l": rows}, {"l": rows.where("rand() > 2")}, {"l": D.signed(rows)}, view.states)
    assert "rand" not in step.change(node)._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in D.consolidated(step.change(node)).orderBy("n").collect()] == [(1, 1, -1), (1, 2, 1)]
