"""The registered queries of the training-data operators, with their SQL where SQL can state them."""

from __future__ import annotations

from . import bpe, exact_dedup, html_text, language, minhash, packing, secrets, substrings, toxicity, vectors
from .common import table

QUERIES, ORACLES = {}, {}


def tokenizer(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _register(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add


@_register(
    "op8_exact_dedup",
    r"""
    WITH d AS (
      SELECT doc_id, length(coalesce(text, '')) AS n,
             sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
      FROM documents)
    SELECT doc_id,
           first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
           count(*) OVER (PARTITION BY text_sha256) AS group_size,
           doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS kept,
           text_sha256
    FROM d""",
)
def op8_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@_register("op9_secret_scan")
def op9_secret_scan(spark, sf_dir):
    return secrets.scan(table(spark, sf_dir, "documents")).drop("live")


@_register("op3_toxicity")
def op3_toxicity(spark, sf_dir):
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_register("op5_bpe_round_trip")
def op5_bpe_round_trip(spark, sf_dir):
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


@_register("op10_language_id")
def op10_language_id(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "documents"))


@_register("op4_best_fit_packing")
def op4_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


@_register("op1_html_text")
def op1_html_text(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


@_register("op6_near_vectors")
def op6_near_vectors(spark, sf_dir):
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


@_register("op2_near_documents")
def op2_near_documents(spark, sf_dir):
    return minhash.near_groups(table(spark, sf_dir, "documents"))


@_register("op7_repeated_passages")
def op7_repeated_passages(spark, sf_dir):
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


@_register("pipeline")
def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
