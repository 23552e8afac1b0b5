"""Base tables: batches of operations in order, keys, defaults, columns that come and go."""

import random

import pytest

from tidemark.sources.base import BaseTable, delete, insert, insert_or_update, update

SCHEMA = "x int, y string, z int"


def rows(table):
    return sorted(map(tuple, table.rows.collect()), key=str)


def test_operations_in_order(spark):
    t = BaseTable(spark, "t", SCHEMA, ["x"], {"y": "none"})
    change = t.perform([insert(x=1, y="a", z=1), insert(x=2, z=2), insert(x=1, y="again", z=9)])
    assert rows(t) == [(1, "a", 1), (2, "none", 2)]
    assert sorted(map(tuple, change.collect())) == [(1, "a", 1, 1), (2, "none", 2, 1)]
    change = t.perform([update(1, z=("+", 5)), update(1, z=("-", 1), y="b"), delete(2), insert(x=2, y="new", z=0), update(7, z=1), delete(8)])
    assert rows(t) == [(1, "b", 5), (2, "new", 0)]
    assert sorted(map(tuple, change.collect()), key=str) == sorted([(1, "a", 1, -1), (1, "b", 5, 1), (2, "none", 2, -1), (2, "new", 0, 1)], key=str)
    t.perform([insert_or_update({"x": 3, "y": "c", "z": 1}, z=("+", 1)), insert_or_update({"x": 3, "y": "d", "z": 1}, z=("+", 1)), insert_or_update({"x": 1, "y": "?", "z": 0}, y="kept")])
    assert rows(t) == [(1, "kept", 5), (2, "new", 0), (3, "c", 2)]
    assert t.perform([update(1, z=("+", 0))]).count() == 0


def test_against_a_dictionary(spark):
    rng, t, want = random.Random(5), BaseTable(spark, "t", "a int, b int, v int", ["a", "b"]), {}
    for _ in range(8):  # over the number of layers, so that rows are rewritten once
        batch = []
        for _ in range(12):
            key = (rng.randint(0, 2), rng.choice([0, 1, None]))
            kind, v = rng.choice(["insert", "delete", "update", "upsert"]), rng.randint(0, 9)
            if kind == "insert":
                batch.append(insert(a=key[0], b=key[1], v=v))
                want.setdefault(key, v)
            elif kind == "delete":
                batch.append(delete(*key))
                want.pop(key, None)
            elif kind == "update":
                batch.append(update(key, v=("+", v)))
                want |= {key: want[key] + v} if key in want else {}
            else:
                batch.append(insert_or_update({"a": key[0], "b": key[1], "v": v}, v=v))
                want[key] = v
        t.perform(batch)
        assert {(r.a, r.b): r.v for r in t.rows.collect()} == want


def test_without_a_key(spark):
    t = BaseTable(spark, "t", SCHEMA)
    t.perform([insert(x=1), insert(x=1)])
    assert rows(t) == [(1, None, None)] * 2
    for bad in (delete(1), update(1, z=2)):
        with pytest.raises(ValueError):
            t.perform([bad])


def test_what_is_refused(spark):
    t = BaseTable(spark, "t", SCHEMA, ["x"])
    for bad in (insert(q=1), delete(1, 2), update(1, x=2), update(1, q=2)):
        with pytest.raises(ValueError):
            t.perform([bad])
    with pytest.raises(ValueError):
        BaseTable(spark, "t", SCHEMA, ["q"])


def test_columns_come_and_go(spark):
    t = BaseTable(spark, "t", SCHEMA, ["x"])
    t.perform([insert(x=1, y="a", z=1)])
    t.add_column("w", "int", 7)
    t.perform([insert(x=2, y="b", z=2), insert(x=3, w=8)])
    assert rows(t) == [(1, "a", 1, 7), (2, "b", 2, 7), (3, None, None, 8)]
    t.drop_column("y")
    assert t.rows.columns == ["x", "z", "w"]
    with pytest.raises(ValueError):
        t.drop_column("x")


def test_values_stay_as_they_are(spark):
    """Whole numbers beyond a double's reach, NaN, decimals and times, also in rows of which another column changes."""
    import datetime as dt
    from decimal import Decimal

    t = BaseTable(spark, "t", "id int, v bigint, d double, m decimal(20,2), at timestamp_ntz, b boolean", ["id"])
    wide, nan, at = 9007199254740993, float("nan"), dt.datetime(2020, 2, 29, 1, 2, 3, 4)
    t.perform([insert(id=1, v=wide, d=nan, m=Decimal("123456789012345678.25"), at=at, b=True), insert(id=2, v=wide + 2), insert(id=3, v=wide, d=1.5)])
    change = t.perform([update(1, b=False), delete(3), update(2, v=("+", 2), m=("=", Decimal("0.10"))), update(2, m=("-", Decimal("0.05")))])
    got = {r.id: r for r in t.rows.collect()}
    assert got[1].v == wide and got[1].d != got[1].d and got[1].m == Decimal("123456789012345678.25") and got[1].at == at and got[1].b is False
    assert got[2].v == wide + 4 and got[2].d is None and got[2].m == Decimal("0.05") and 3 not in got and change.count() == 5
    assert t.perform([update(1, d=nan)]).count() == 0
    plan = t.rows._jdf.queryExecution().executedPlan().toString() + change._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "Python" not in plan


def test_settings_and_additions_in_any_order(spark):
    rng, t, want = random.Random(8), BaseTable(spark, "t", "id int, v int, w int", ["id"]), {}
    for _ in range(4):
        batch = []
        for _ in range(25):
            key, c, v = rng.randint(0, 3), rng.choice("vw"), rng.choice([1, 2, 5, None])
            kind = rng.choice(["insert", "delete", "set", "+", "-", "upsert"])
            if kind == "insert":
                batch.append(insert(id=key, v=v, w=0))
                want.setdefault(key, {"v": v, "w": 0})
            elif kind == "delete":
                batch.append(delete(key))
                want.pop(key, None)
            elif kind == "upsert":
                batch.append(insert_or_update({"id": key, "v": 9, "w": v}, **{c: ("+", v)}))
                if key in want:
                    want[key][c] = None if v is None or want[key][c] is None else want[key][c] + v
                else:
                    want[key] = {"v": 9, "w": v}
            else:
                batch.append(update(key, **{c: v if kind == "set" else (kind, v)}))
                if key in want:
                    old = want[key][c]
                    want[key][c] = v if kind == "set" else None if v is None or old is None else old + v if kind == "+" else old - v
        t.perform(batch)
        assert {r.id: {"v": r.v, "w": r.w} for r in t.rows.collect()} == want
