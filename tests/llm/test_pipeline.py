"""The pipeline's stages against brute force, each on what the one before kept."""

import re
from functools import reduce

import corpus_pipeline
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tidemark.llm import common, pii, quality
from tidemark.llm.queries import ORACLES, QUERIES
from test_decontamination import contained
from test_simhash import components, plain


def test_stages(spark, tiny):
    docs = common.table(spark, tiny, "documents")
    labels, items = common.table(spark, tiny, "labels"), common.table(spark, tiny, "benchmark")
    got = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, tiny), f"test-{name}")
        got[name] = docs
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "decontamination", "personal_data", "packing"]
    first = common.table(spark, tiny, "documents")
    for n in names[:-1]:
        assert got[n].columns == first.columns
    rows = {n: {r.doc_id: r for r in got[n].collect()} for n in names[:-1]}

    model = quality.train(first, labels)
    texts = {r.doc_id: r.text for r in first.collect()}
    assert set(rows["quality"]) == {d for d, t in texts.items() if model.score(np.array([quality.features(t or "")]))[0] >= 0.3}
    kept = rows["quality"]
    assert set(rows["near_duplicates"]) == set(components({d: plain(r.text) for d, r in kept.items()}).values())
    kept = rows["near_duplicates"]
    bad = {d for d, _ in contained([(d, r.text) for d, r in kept.items()], [(r.item_id, r.text) for r in items.collect()])}
    assert set(rows["decontamination"]) == set(kept) - bad
    kept, red = rows["decontamination"], rows["personal_data"]
    assert set(red) == set(kept)
    for d, r in kept.items():
        if not pii._any(r.text or ""):
            assert red[d] == r
        assert not pii.base_spans(re.sub(r"\[[A-Z_]+\]", " x ", red[d].text or "")) or red[d].text == r.text
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = got["packing"].collect()
    total = {}
    for p in pieces:
        total[p.doc_id] = total.get(p.doc_id, 0) + p.length
    assert total == {d: len(t.encode(r.text or "", add_special_tokens=False).ids) + 1 for d, r in red.items()}
    assert {(p.doc_id, p.piece, p.ids_crc32) for p in pieces} == {(p.doc_id, p.piece, p.ids_crc32) for p in corpus_pipeline.run(spark, tiny).collect()}


def test_odd_documents_pass(spark, odd, none, tmp_path):
    """Each stage on odd rows, whose columns clash with names that operators make, and on tables of labels and items that clash too."""
    from pyspark.sql import functions as F

    clash = lambda df: reduce(lambda d, c: d.withColumn(c, F.lit("clash")), ("f", "h", "y", "place", "__tm_row", "n", "fp"), df)
    labels = spark.createDataFrame([(4, 1, 0), (2, 0, 0), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta"), (None, None), (2, "")], "item_id long, text string")
    for name, rows in (("documents", odd), ("labels", clash(labels)), ("benchmark", clash(items))):
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    ids, docs = {}, common.table(spark, str(tmp_path), "documents")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, common.written(stage(spark, docs, str(tmp_path)), f"odd-{name}")
        ids[name] = sorted((r.doc_id for r in docs.select("doc_id").collect()), key=str)
        if name != "packing":
            assert docs.columns == odd.columns and docs.schema == before.schema
    model = quality.train(odd, labels)
    assert ids["quality"] == sorted((r.doc_id for r in odd.select("doc_id", "text").collect() if model.score(np.array([quality.features(r.text or "")]))[0] >= 0.3), key=str)
    kept = set(ids["quality"])
    assert {4, 5} <= kept
    assert ids["near_duplicates"] == sorted({4, 6, 7, 8, 9, None} & kept | ({min({1, 2, 3} & kept)} if {1, 2, 3} & kept else set()), key=str)
    assert ids["decontamination"] == [i for i in ids["near_duplicates"] if i != 6] == ids["personal_data"]
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert sorted((r.doc_id, r.length) if r.doc_id is not None else (-1, r.length) for r in docs.collect()) == sorted((-1 if i is None else i, len(t.encode(texts[i] or "", add_special_tokens=False).ids) + 1) for i in ids["decontamination"])
    docs = none
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0


def test_a_very_long_text_goes_through_every_operator(spark, tmp_path):
    """Some megabytes in one row, beside a short one."""
    from pyspark.sql import functions as F

    long = " ".join(f"word{i % 9973} token{i % 7}" for i in range(250_000))
    spark.createDataFrame([(1, long, "en", "a", len(long)), (2, "a short text of a few words", "en", "a", 27)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "word9000 token5 word9001 token6 word9002 token0")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, "http://a.com/en/" + "x" * 100_000, "")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    for name, query in QUERIES.items():
        rows = query(spark, str(tmp_path))
        key = "page_id" if "page_id" in rows.columns else "doc_id"
        found = {r[0] for r in rows.select(F.col(key)).collect()}
        assert found == ({1} if key == "page_id" else {1, 2}) or name in ("pipeline", "op5_benchmark_decontamination"), name


def test_every_operator_has_its_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op"))
    assert numbers == list(range(1, 11)) and "pipeline" in QUERIES and set(ORACLES) <= set(QUERIES)
