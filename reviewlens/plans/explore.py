"""Exploratory profile of a review table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from reviewlens.operators import profile


def explore(reviews: DataFrame, game: str = "appid", key: str = "recommendationid") -> dict[str, DataFrame]:
    """Shape, summary, nulls, per-game counts and the trimmed table."""
    trimmed = profile.without_identifiers(reviews)
    return {
        "shape": profile.shape(reviews),
        "preview": reviews.limit(5),
        "summary": profile.numeric_profile(reviews),
        "nulls": profile.null_profile(reviews),
        "trimmed": trimmed,
        "top_games": profile.top_games(reviews, game),
        "rows_with_count": profile.count_back_on_row(reviews, game, key),
        "game_counts": profile.distinct_game_counts(reviews, game),
    }
