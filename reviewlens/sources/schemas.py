"""Schemas of the files read and written."""

from __future__ import annotations

from pyspark.sql import types as T

_L, _S, _B, _D, _I = T.LongType(), T.StringType(), T.BooleanType(), T.DoubleType(), T.IntegerType()

# The columns of a review file.
REVIEW_COLUMNS = (
    ("recommendationid", _L), ("language", _S), ("review", _S),
    ("timestamp_created", _L), ("timestamp_updated", _L), ("voted_up", _B),
    ("votes_up", _L), ("votes_funny", _L), ("weighted_vote_score", _D),
    ("comment_count", _L), ("steam_purchase", _B), ("received_for_free", _B),
    ("written_during_early_access", _B), ("primarily_steam_deck", _B),
    ("author_steamid", _L), ("author_num_games_owned", _L), ("author_num_reviews", _L),
    ("author_playtime_forever", _L), ("author_playtime_last_two_weeks", _L),
    ("author_playtime_at_review", _L), ("author_last_played", _L),
    ("author_deck_playtime_at_review", _D), ("appid", _L), ("fetch_date", _S),
    ("total_reviews", _L), ("timestamp_dev_responded", _D), ("developer_response", _S),
)
REVIEW_TYPE_COLUMN = ("review_type", _S)

REVIEWS = T.StructType([T.StructField(n, t) for n, t in REVIEW_COLUMNS])
KNOWN_TYPES = dict([*REVIEW_COLUMNS, REVIEW_TYPE_COLUMN])

# Fields of the nested author, without the author_ prefix.
_AUTHOR = T.StructType([T.StructField(n[len("author_"):], t) for n, t in REVIEW_COLUMNS if n.startswith("author_")])
_ITEM = T.StructType(
    [
        T.StructField(n, t)
        for n, t in REVIEW_COLUMNS
        if not n.startswith("author_") and n not in ("appid", "fetch_date", "total_reviews")
    ]
    + [T.StructField("author", _AUTHOR)]
)

#: One landed reply of the review feed, with the request it answers.
FEED_PAGE = T.StructType([
    T.StructField("appid", _L), T.StructField("review_type", _S), T.StructField("page_no", _L),
    T.StructField("success", _I), T.StructField("cursor", _S), T.StructField("reviews", T.ArrayType(_ITEM)),
])

CATALOGUE = T.StructType([T.StructField("_index", _I), T.StructField("AppID", _L), T.StructField("Name", _S)])
TOPIC_WORDS = T.StructType([T.StructField("topic_id", _I), T.StructField("words", _S), T.StructField("scores", _S)])
CHECKPOINT_LOG = T.StructType([T.StructField(n, _S) for n in ("timestamp", "stage", "filename")])
RUN_SUMMARY = T.StructType([
    T.StructField("timestamp", _S), T.StructField("num_sentences", _L), T.StructField("num_topics", _L),
    T.StructField("sentiment_analysis", T.ArrayType(T.StructType([
        T.StructField("topic", _I), T.StructField("sentiment_mean", _D), T.StructField("sentence_count", _L),
        T.StructField("confidence_mean", _D), T.StructField("confidence_std", _D),
    ]))),
])
