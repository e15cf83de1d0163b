"""Vocabularies, bags of words and TF-IDF weights."""

from __future__ import annotations

from typing import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window, functions as F

from reviewlens import settings
from reviewlens.operators.matrix import csr_chunks


#: Tokens that a bag of words is counted over at once, beyond which only a single row goes.
PIECE_TOKENS = 1 << 16


def term_counts(tokens_df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Document frequency and total frequency of every term, in one shuffle.

    Each document contributes its distinct terms with df 1 and all its terms
    with tf 1; both are pre-aggregated before the shuffle.
    """
    toks = F.col(tokens)
    marks = F.concat(
        F.transform(F.array_distinct(toks), lambda t: F.struct(t.alias("term"), F.lit(1).alias("d"), F.lit(0).alias("t"))),
        F.transform(toks, lambda t: F.struct(t.alias("term"), F.lit(0).alias("d"), F.lit(1).alias("t"))),
    )
    return (
        tokens_df.select(F.explode(marks).alias("m"))
        .select("m.*")
        .groupBy("term")
        .agg(F.sum("d").alias("df"), F.sum("t").alias("tf"))
    )


def document_count(tokens_df: DataFrame) -> Column:
    """Number of documents as a scalar subquery column."""
    return tokens_df.agg(F.count(F.lit(1)).alias("n")).scalar()


def study_vocabulary(
    tokens_df: DataFrame,
    max_features: int = settings.STUDY_MAX_FEATURES,
    min_df: int = settings.STUDY_MIN_DF,
    max_df: float = settings.STUDY_MAX_DF,
    stop_words: Sequence[str] = settings.STUDY_STOP_WORDS,
) -> DataFrame:
    """Most frequent terms by total count within the df limits; ids in term order.

    Lemmas may be stop words although the words they come from are not ("plays"),
    so the stop list acts on the terms once more.
    """
    n = document_count(tokens_df)
    kept = term_counts(tokens_df).filter((F.col("df") >= min_df) & (F.col("df") <= max_df * n))
    if stop_words:
        kept = kept.filter(~F.col("term").isin(*stop_words))
    top = kept.orderBy(F.desc("tf"), "term").limit(max_features)
    # at most max_features rows from here on
    return top.withColumn("term_id", F.row_number().over(Window.orderBy("term")) - 1)


def trimmed_dictionary(
    tokens_df: DataFrame,
    no_below: int = settings.FIXED_NO_BELOW,
    no_above: float = settings.FIXED_NO_ABOVE,
    keep_n: int = settings.FIXED_KEEP_N,
) -> DataFrame:
    """Dictionary kept by document frequency, renumbered 0.. ."""
    n = document_count(tokens_df)
    kept = term_counts(tokens_df).filter((F.col("df") >= no_below) & (F.col("df") <= no_above * n))
    top = kept.orderBy(F.desc("df"), "term").limit(keep_n)
    return top.withColumn("term_id", F.row_number().over(Window.orderBy(F.desc("df"), "term")) - 1)


def bag_of_words(tokens_df: DataFrame, keys: list[str], tokens: str = "tokens") -> DataFrame:
    """(keys, term, tf): the counts of each row's terms, made where the row lies.

    Every row is a document of its own; a null list has no terms.
    """
    slim = tokens_df.select(F.col(tokens).cast("array<string>").alias("_toks"), *keys)

    def pieces(batches):
        # some rows at a time: what is made of them stays small whatever a batch holds
        for batch in batches:
            offsets, low = batch.column(0).offsets.to_numpy(), 0
            while low < batch.num_rows:
                high = int(np.searchsorted(offsets, offsets[low] + PIECE_TOKENS, side="right")) - 1
                high = min(max(high, low + 1), batch.num_rows)
                yield batch.slice(low, high - low)
                low = high

    def run(batches):
        for batch in pieces(batches):
            lists = batch.column(0)
            codes = pc.dictionary_encode(pc.list_flatten(lists), null_encoding="encode")
            if not len(codes):
                continue
            found = pc.list_parent_indices(lists).to_numpy().astype(np.int64) * len(codes.dictionary) + codes.indices.to_numpy()
            found, counts = np.unique(found, return_counts=True)
            rows, terms = np.divmod(found, len(codes.dictionary))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i + 1).take(pa.array(rows)) for i in range(len(keys))), codes.dictionary.take(pa.array(terms)), pa.array(counts)],
                [*keys, "term", "tf"],
            )

    return slim.mapInArrow(run, _key_schema(slim, keys) + ", term string, tf long")


def _key_schema(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def in_vocabulary(bow: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Keep known terms and add their id and df (vocabulary size is capped)."""
    return bow.join(F.broadcast(vocabulary.select("term", "term_id", "df")), "term")


def smooth_idf(n: Column, df: Column) -> Column:
    return F.log((1 + n) / (1 + df)) + 1


def log2_idf(n: Column, df: Column) -> Column:
    return F.log2(n / df)


def tfidf_long(
    tokens_df: DataFrame, vocabulary: DataFrame, keys: list[str], variant: str = "smooth"
) -> DataFrame:
    """(keys, term, term_id, w): L2-normalised TF-IDF, or plain counts, in long form.

    The rows of the sparse vectors, which are made where the documents lie.
    """
    space = FeatureSpace(vocabulary, 0 if variant == "count" else tokens_df.count(), variant)
    return vector_rows(space.transform(tokens_df), keys, space.terms)


def vector_rows(vectors: DataFrame, keys: list[str], terms: list[str], column: str = "features") -> DataFrame:
    """(keys, term, term_id, w) of the numbers of sparse vectors that are not zero."""
    slim = vectors.select(column, *keys)

    def run(batches):
        names = pa.array(terms, pa.string())
        for batch in batches:
            for piece, indices, values, starts in csr_chunks(batch, 0, 100):
                rows = np.repeat(np.arange(piece.start, piece.stop), np.diff(starts))
                held = np.flatnonzero(values)
                ids = pa.array(indices[held], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i + 1).take(pa.array(rows[held])) for i in range(len(keys))), names.take(ids), ids, pa.array(values[held])],
                    [*keys, "term", "term_id", "w"],
                )

    return slim.mapInArrow(run, _key_schema(slim, keys) + ", term string, term_id int, w double")


def vector_sums(vectors: DataFrame, keys: list[str], column: str = "features") -> DataFrame:
    """(keys, terms, total): how many numbers of a sparse vector are not zero, and their sum."""
    slim = vectors.select(column, *keys)

    def run(batches):
        for batch in batches:
            for piece, indices, values, starts in csr_chunks(batch, 0, 100):
                row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
                sums = [np.bincount(row, x, len(starts) - 1) for x in (values != 0, values)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i + 1).slice(piece.start, len(starts) - 1) for i in range(len(keys))), pa.array(sums[0].astype(np.int64)), pa.array(sums[1])],
                    [*keys, "terms", "total"],
                )

    return slim.mapInArrow(run, _key_schema(slim, keys) + ", terms long, total double")


class FeatureSpace:
    """A capped vocabulary held on the driver, turning token lists into vectors.

    Vectors are made row by row inside the JVM: no shuffle is needed to
    vectorise.  ``variant`` is ``count``, ``smooth`` or ``log2``.
    """

    def __init__(self, vocabulary: DataFrame, documents: int, variant: str = "count"):
        rows = vocabulary.select("term_id", "term", "df").orderBy("term_id").collect()
        self.terms = [r["term"] for r in rows]
        self.frequencies = [r["df"] for r in rows]
        self.documents = documents
        self.variant = variant

    def transform(self, tokens_df: DataFrame, tokens: str = "tokens", out: str = "features") -> DataFrame:
        counter = CountVectorizerModel.from_vocabulary(self.terms, inputCol=tokens, outputCol="_counts", minTF=1.0)
        counted = counter.transform(tokens_df)
        if self.variant == "count":
            return counted.withColumnRenamed("_counts", out)
        df = np.array(self.frequencies, dtype=float)
        if self.variant == "smooth":
            idf = np.log((1 + self.documents) / (1 + df)) + 1
        else:
            idf = np.log2(self.documents / df)
        scaled = ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="_counts", outputCol="_scaled").transform(counted)
        return Normalizer(p=2.0, inputCol="_scaled", outputCol=out).transform(scaled).drop("_counts", "_scaled")

    def terms_frame(self, spark) -> DataFrame:
        return spark.createDataFrame([(i, t) for i, t in enumerate(self.terms)], "term_id int, term string")


def feature_space(
    tokens_df: DataFrame, kind: str = "study", variant: str = "count", **limits
) -> FeatureSpace:
    """Learn the vocabulary of the sentence study or the fixed-count study."""
    vocabulary = study_vocabulary(tokens_df, **limits) if kind == "study" else trimmed_dictionary(tokens_df, **limits)
    return FeatureSpace(vocabulary, tokens_df.count(), variant)
