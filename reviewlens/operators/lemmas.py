"""Singular forms that the corpus itself attests."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F

from reviewlens.scale import BROADCAST_ROWS, join_lookup

#: Noun endings and what may replace them; the first attested form wins.
ATTESTED_ENDINGS = (
    ("ives", "ife"), ("lves", "lf"), ("arves", "arf"), ("eaves", "eaf"), ("oaves", "oaf"), ("ieves", "ief"), ("ooves", "oof"),
    ("s", ""), ("ies", "y"), ("ses", "s"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("men", "man"),
)
#: Letters of the shortest form, and how many times rarer than the word it may be.
SHORTEST_FORM, RARER = 3, 100


def attested_lemmas(words: DataFrame, word: str = "word", shortest: int = SHORTEST_FORM, rarer: int = RARER) -> DataFrame:
    """``word, lemma`` of every distinct word: a form by ``ATTESTED_ENDINGS`` that stands in
    the corpus too, at least once for ``rarer`` times of the word, or the word itself.

    Words in -ss have no form without the s.  Occurrences are counted first; the forms
    then meet the counts by an equi-join of distinct words, so no frequent word is a hot
    key.  Null words are left out.
    """
    counts = words.filter(F.col(word).isNotNull()).groupBy(F.col(word).alias("word")).agg(F.count(F.lit(1)).alias("n"))
    forms = []
    for rank, (ending, repl) in enumerate(ATTESTED_ENDINGS):
        hit = F.endswith("word", F.lit(ending)) & ~(F.lit(ending == "s") & F.endswith("word", F.lit("ss")))
        form = F.concat(F.substring(F.col("word"), F.lit(1), F.length("word") - len(ending)), F.lit(repl))
        forms.append(F.when(hit & (F.length(form) >= shortest), F.struct(F.lit(rank).alias("rank"), form.alias("form"))))
    plural = counts.filter(F.endswith("word", F.lit("s")) | F.endswith("word", F.lit("men")))
    asked = plural.select("word", "n", F.explode(F.array_compact(F.array(*forms))).alias("f")).select("word", "n", "f.*")
    known = counts.select(F.col("word").alias("form"), F.col("n").alias("form_n"))
    attested = asked.join(known, "form").filter(F.col("form_n") * rarer >= F.col("n"))
    chosen = attested.groupBy("word").agg(F.min_by("form", "rank").alias("form"))
    return counts.join(chosen, "word", "left").select("word", F.coalesce("form", "word").alias("lemma"))


def with_attested_lemmas(
    tokenised: DataFrame, keys: list[str], tokens: str = "tokens", max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Keys and token lists, in their order, with lemmas in place of the words.

    Keys name one row each; rows without tokens are left out.  Only words with another lemma are looked up: in place
    while a checked number of them can be broadcast; beyond it a frequent word is spread over salts.
    """
    changed = attested_lemmas(tokenised.select(F.explode(tokens).alias("word"))).filter("word <> lemma").persist()
    few = changed.limit(max_rows + 1).toArrow()
    if few.num_rows <= max_rows:
        return _replaced(tokenised.select(*keys, tokens), few, tokens)
    placed = tokenised.select(*keys, F.posexplode(tokens).alias("_at", "word"))
    joined = join_lookup(placed, changed, "word", [*keys, "_at"], max_rows=max_rows)
    in_order = F.array_sort(F.collect_list(F.struct("_at", F.coalesce("lemma", "word").alias("lemma"))))
    return joined.groupBy(*keys).agg(F.transform(in_order, lambda x: x["lemma"]).alias(tokens))


def _replaced(tokenised: DataFrame, changed: pa.Table, tokens: str) -> DataFrame:
    """The token lists with the lemmas of a small table, where the documents lie."""
    sent = tokenised.sparkSession.sparkContext.broadcast(changed)
    at = tokenised.columns.index(tokens)

    def run(batches):
        table = sent.value.combine_chunks()
        words, lemmas = (pa.concat_arrays(table.column(c).chunks or [pa.array([], pa.string())]) for c in ("word", "lemma"))
        for batch in batches:
            # a filter before would be pushed below the tokens and make them twice
            sizes = pa.compute.fill_null(pa.compute.list_value_length(batch.column(at)), 0)
            batch, sizes = batch.filter(pa.compute.greater(sizes, 0)), sizes.filter(pa.compute.greater(sizes, 0))
            found = batch.column(at).flatten()
            own = pa.compute.coalesce(lemmas.take(pa.compute.index_in(found, words)), found)
            ends = pa.concat_arrays([pa.array([0], pa.int32()), pa.compute.cumulative_sum(sizes).cast(pa.int32())])
            yield batch.set_column(at, tokens, pa.ListArray.from_arrays(ends, own))

    return tokenised.mapInArrow(run, tokenised.schema)
