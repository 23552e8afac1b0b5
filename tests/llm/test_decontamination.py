import re

from tidemark.llm import common, decontamination


def shingles(text, n):
    w = re.findall(r"\w+", (text or "").lower())
    return ({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()), w


def contained(docs, items, n=5, threshold=0.8):
    """(doc, item) for all pairs, one by one."""
    out = set()
    for i, t in items:
        own, _ = shingles(t, n)
        if not own:
            continue
        k = len(next(iter(own)))
        for d, x in docs:
            w = re.findall(r"\w+", (x or "").lower())
            have = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
            if len(own & have) >= threshold * len(own) - 1e-9:
                out.add((d, i))
    return out


def test_against_all_pairs(spark, tiny):
    docs, items = common.table(spark, tiny, "documents"), common.table(spark, tiny, "benchmark")
    want = contained([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert want
    for chars in (decontamination.BROADCAST_CHARS, 0):
        rows = decontamination.contaminated(docs, items, broadcast_chars=chars).collect()
        assert {(r.doc_id, r.item_id) for r in rows} == want and len(rows) == len(want)
        kept = decontamination.without_contaminated(docs, items, broadcast_chars=chars)
        assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - {d for d, _ in want}


def test_share_at_the_threshold(spark):
    item = " ".join(f"w{i}" for i in range(24))  # 20 shingles
    docs = [(1, "x " + " ".join(f"w{i}" for i in range(20)) + " y"), (2, " ".join(f"w{i}" for i in range(19))), (3, "W0, " + item.upper()), (4, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame([(1, item), (2, "only three words"), (3, None), (4, "")], "item_id long, text string")
    for chars in (10**6, 0):
        assert {(r.doc_id, r.item_id) for r in decontamination.contaminated(d, i, broadcast_chars=chars).collect()} == {(1, 1), (3, 1)}
    d = spark.createDataFrame([(5, "here are only three words again")], "doc_id long, text string")
    assert [r.item_id for r in decontamination.contaminated(d, i).collect()] == [2]


def test_odd_tables(spark, odd, none):
    items = spark.createDataFrame([(1, "the same words stand here twice over"), (1, "the same words stand here twice over"), (None, "alpha beta gamma delta epsilon zeta"), (3, None)], "item_id long, text string")
    rows = decontamination.contaminated(odd, items).collect()
    assert sorted((r.doc_id, str(r.item_id)) for r in rows) == sorted([(4, "1")] * 2 + [(5, "1")] * 4 + [(6, "None")])
    kept = decontamination.without_contaminated(odd, items)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {1, 2, None, 3, 7, 8, 9}
    assert decontamination.contaminated(none, items).count() == 0
    assert decontamination.contaminated(odd, items.limit(0)).count() == 0


def test_the_index_is_compact():
    """Bytes a character of items' text, and no more sets of shingles than are kept."""
    import pickle
    import random

    rng = random.Random(3)
    vocabulary = [f"word{i}" for i in range(5000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=200))) for i in range(1500)]
    index = decontamination.Index(items, 5, 0.8)
    chars = sum(len(t) for _, t in items)
    assert len(pickle.dumps(index)) < 3 * chars
    for i, t in items[:600]:
        assert [m[0] for m in index.matches(f"before {t} after")] == [i]
    assert len(index.held) <= decontamination.HELD and len(pickle.dumps(decontamination.Index(items, 5, 0.8))) < 3 * chars


def test_sieves_lose_nothing(spark):
    """Rows that are taken out one by one, all or none, with columns of any name."""
    from pyspark.sql import functions as F

    rows = spark.range(5000).select("id", F.lit("x").alias("__m0"), F.lit(1).alias("one"), F.lit(2).alias("b"))
    for gone in ("id % 7 = 3", "id = 11", "true", "false"):
        left = common.without(rows, spark.range(5000).where(gone), "id")
        assert left.columns == rows.columns
        assert sorted(r.id for r in left.collect()) == sorted(r.id for r in rows.where(f"NOT ({gone})").collect())
