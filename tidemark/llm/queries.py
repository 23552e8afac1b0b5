"""The queries of this subpackage: each operator, with production parameters, over its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import common, decontamination, flac, language, oracles, packing, pii, quality, secrets, simhash, toxicity, urls

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_best_fit_packing")
def op1_best_fit_packing(spark, sf_dir):
    return packing.pack(common.table(spark, sf_dir, "documents"), word_tokenizer(), capacity=4096, end_id=1)


@query("op2_simhash_near_duplicates")
def op2_simhash_near_duplicates(spark, sf_dir):
    return simhash.near_duplicates(common.table(spark, sf_dir, "documents"))


@query("op5_benchmark_decontamination", oracles.contaminated())
def op5_benchmark_decontamination(spark, sf_dir):
    return decontamination.contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


@query("op6_ftrl_toxicity")
def op6_ftrl_toxicity(spark, sf_dir):
    return toxicity.toxicity(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


@query("op8_additive_quality")
def op8_additive_quality(spark, sf_dir):
    return quality.quality(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


@query("op9_kneser_ney_language")
def op9_kneser_ney_language(spark, sf_dir):
    return language.identify(common.table(spark, sf_dir, "documents"))


@query("op7_secret_ledger", oracles.secret_spans())
def op7_secret_ledger(spark, sf_dir):
    found = secrets.history(common.table(spark, sf_dir, "documents"), f"{common.shared_folder(spark)}/secrets-{uuid.uuid4().hex}")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


@query("op10_url_language_models")
def op10_url_language_models(spark, sf_dir):
    return urls.judge(common.table(spark, sf_dir, "pages"))


@query("op4_flac_media")
def op4_flac_media(spark, sf_dir):
    return flac.digests(common.table(spark, sf_dir, "documents"))


@query("op3_weakly_supervised_pii")
def op3_weakly_supervised_pii(spark, sf_dir):
    found = pii.detect(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", *(f"n_{k}" for k in pii.BASE), F.sha2("base", 256).alias("base_sha256"), "spans")
