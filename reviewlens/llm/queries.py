"""The queries of this subpackage and the SQL that checks them, where SQL can."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from reviewlens.llm import (
    decontaminate, exact_search, language_mixture, license_scan, line_dedup, merkle_manifest, near_duplicates, ngram_join,
    packing, phrase_mining, recurrent_lm, sql_text, token_counts, warc_derivatives,
)
from reviewlens.llm.common import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.digest(found)


def op2_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = language_mixture.train(language_mixture.training_rows(documents))
    predicted = language_mixture.predict(documents, model)
    return predicted.select("doc_id", language_mixture.held_out().alias("held_out"), "lang_pred", "score", "shares")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op4_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_derivatives.derivatives(warc_derivatives.responses(table(spark, sf_dir, "pages")))


def op7_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recurrent_lm.train_and_score(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.scan(table(spark, sf_dir, "documents")))


def op9_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.groups(table(spark, sf_dir, "documents"), width=4)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
    )


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    n_chars = F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    return merkle_manifest.manifest(documents, fields, "lang", "doc_id", {"n_chars": n_chars}).drop("siblings")


def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_mining.collocations(table(spark, sf_dir, "documents"), least=100, covered=100, top=2000)


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_language_mixture": op2_language_mixture,
    "op3_line_dedup": op3_line_dedup,
    "op4_exact_search": op4_exact_search,
    "op5_token_counts": op5_token_counts,
    "op6_warc_derivatives": op6_warc_derivatives,
    "op7_recurrent_lm": op7_recurrent_lm,
    "op8_license_scan": op8_license_scan,
    "op9_setsketch": op9_setsketch,
    "op10_packing": op10_packing,
    "op11_ngram_join": op11_ngram_join,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_phrase_mining": op13_phrase_mining,
}
OP4_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda z: z[1] * z[2])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

ORACLE_SQL: dict[str, str] = {
    "op4_exact_search": OP4_SQL,
    "op9_setsketch": sql_text.OP9_SQL,
    "op11_ngram_join": sql_text.OP11_SQL,
    "op12_merkle_manifest": sql_text.OP12_SQL,
    "op13_phrase_mining": sql_text.OP13_SQL,
}
