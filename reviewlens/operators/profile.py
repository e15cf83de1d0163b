"""Data-set statistics and exploratory profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from reviewlens import settings
from reviewlens.functions.formatting import is_negative, is_positive
from reviewlens.operators.ranks import running_total
from reviewlens.scale import cut_lineage, join_lookup

QUARTILES = (("p25", 0.25), ("p50", 0.5), ("p75", 0.75))
#: Share of the rows on either side of a quartile's bracket, and the accuracy of the sketch.
BRACKET, SKETCH_ACCURACY = 0.001, 10_000


def dataset_stats(df: DataFrame, game: str = "app_id", score: str = "review_score", digits: int | None = 2) -> DataFrame:
    """Games, reviews, positive and negative reviews and the positive share.

    A statistic whose column is missing is 0; an empty data set has share 0.
    """
    games = F.countDistinct(game) if game in df.columns else F.lit(0)
    if score in df.columns:
        value = F.col(score).cast("double")
        positive, negative = F.count_if(is_positive(value)), F.count_if(is_negative(value))
    else:
        positive = negative = F.lit(0)
    counted = df.agg(
        games.cast("long").alias("game_count"),
        F.count(F.lit(1)).alias("review_count"),
        positive.cast("long").alias("positive_reviews"),
        negative.cast("long").alias("negative_reviews"),
    )
    share = F.when(F.col("review_count") > 0, 100.0 * F.col("positive_reviews") / F.col("review_count")).otherwise(0.0)
    return counted.withColumn("positive_percentage", share if digits is None else F.bround(share, digits))


def reviews_per_game(df: DataFrame, game: str = "appid", out: str = "n") -> DataFrame:
    return df.groupBy(game).agg(F.count(F.lit(1)).alias(out))


def top_games(df: DataFrame, game: str = "appid", n: int = 10) -> DataFrame:
    return reviews_per_game(df, game).orderBy(F.desc("n"), game).limit(n)


def count_back_on_row(df: DataFrame, game: str, key: str, out: str = "reviews_per_game") -> DataFrame:
    """Put the review count of its game on every row.

    Counts are aggregated first and joined back, so a game that holds most of
    the rows is never gathered in one task.
    """
    return join_lookup(df, reviews_per_game(df, game, out), game, salt_by=[key])


def distinct_game_counts(df: DataFrame, game: str) -> DataFrame:
    """Distinct (game, count) rows: the counts are already unique per game."""
    return reviews_per_game(df, game, "reviews_per_game").dropDuplicates()


def null_profile(df: DataFrame) -> DataFrame:
    """Nulls per column, in one pass."""
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return wide.unpivot([], [F.col(c) for c in df.columns], "column", "nulls")


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)).cast("long"))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def numeric_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Count, mean, std, min, exact quartiles and max of every numeric column.

    A mergeable sketch gives a bracket around each quartile.  A second pass counts what
    lies below each bracket and the copies of the few values inside it; exact ranks are
    then taken inside the brackets alone.  A bracket that misses its ranks is widened to
    the whole column, so that the quartiles are exact for any data.
    """
    columns = numeric_columns(df) if columns is None else columns
    long = (
        df.select([F.col(c).cast("double").alias(c) for c in columns])
        .unpivot([], [F.col(c) for c in columns], "column", "v")
        .filter(F.col("v").isNotNull() & ~F.isnan("v"))
    )
    edges = [max(0.0, q - BRACKET) for _, q in QUARTILES] + [q + BRACKET for _, q in QUARTILES]
    stats = cut_lineage(long.groupBy("column").agg(
        F.count("v").alias("count"),
        F.avg("v").alias("mean"),
        F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
        F.percentile_approx("v", edges, SKETCH_ACCURACY).alias("edges"),
    ))
    part = len(QUARTILES)
    brackets = stats.select("column", "count", F.posexplode(F.array(*[
        F.struct(
            F.lit(name).alias("name"), (F.lit(q) * (F.col("count") - 1)).alias("at"),
            F.col("edges")[i].alias("low"), F.col("edges")[part + i].alias("high"),
        ) for i, (name, q) in enumerate(QUARTILES)
    ]))).select("column", "count", F.col("col.*"))
    found = cut_lineage(_picked(long, brackets))
    missed = brackets.join(found.filter(F.col("value").isNull()).select("column", "name"), ["column", "name"], "left_semi")
    if not missed.isEmpty():
        whole = missed.withColumns({"low": F.lit(float("-inf")), "high": F.lit(float("inf"))})
        found = found.filter(F.col("value").isNotNull()).unionByName(_picked(long, whole))
    quartiles = found.groupBy("column").pivot("name", [name for name, _ in QUARTILES]).agg(F.first("value"))
    return stats.join(quartiles, "column").select("column", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def _picked(long: DataFrame, brackets: DataFrame) -> DataFrame:
    """``column, name, value``: the value at rank ``at``, null where the bracket doesn't hold it.

    Values below a bracket are counted at null, which sorts first.
    """
    # three rows for each column of the profile
    placed = long.join(F.broadcast(brackets), "column").filter(F.col("v") <= F.col("high"))
    inside = F.when(F.col("v") >= F.col("low"), F.col("v"))
    copies = placed.groupBy("column", "name", "at", inside.alias("v")).agg(F.count(F.lit(1)).alias("copies"))
    ranked = running_total(copies, ["column", "name", "v"], "copies")
    # ranks inside a bracket: the rows of the brackets sorted before it are taken off
    sizes = copies.groupBy("column", "name").agg(F.sum("copies").alias("n"))
    earlier = Window.orderBy("column", "name").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("column", "name", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    last = F.col("total") - F.col("start") - 1
    ranks = ranked.join(F.broadcast(starts), ["column", "name"]).withColumns({"last": last, "first": last - F.col("copies") + 1})
    low = F.max(F.when(_covers(F.floor("at")), F.col("v")))
    high = F.max(F.when(_covers(F.ceil("at")), F.col("v")))
    share = F.max(F.col("at") - F.floor("at"))
    return ranks.groupBy("column", "name").agg((low + (high - low) * share).alias("value"))


def _covers(rank: Column) -> Column:
    return (F.col("first") <= rank) & (rank <= F.col("last"))


def without_identifiers(df: DataFrame, columns=settings.PROFILE_DROPPED_COLUMNS) -> DataFrame:
    return df.drop(*columns)


def download_progress(df: DataFrame, game: str, kind: str, kinds: list[str]) -> DataFrame:
    """Reviews per game, one column per review type."""
    pivoted = df.groupBy(game).pivot(kind, kinds).agg(F.count(F.lit(1)))
    return pivoted.na.fill(0, subset=kinds)
