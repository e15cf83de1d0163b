"""Stamps, timestamps, rounding, fingerprints, field fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Stamp formats.
RUN_STAMP = "yyyyMMdd_HHmmss"
FILE_TIME = "yyyy-MM-dd HH:mm:ss"


def run_stamp(ts: Column | None = None) -> Column:
    return F.date_format(F.current_timestamp() if ts is None else ts, RUN_STAMP)


def parse_stamp(text: Column) -> Column:
    return F.to_timestamp(text, RUN_STAMP)


def file_time(ts: Column) -> Column:
    return F.date_format(ts, FILE_TIME)


def unix_seconds(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def half_even(value: Column, digits: int) -> Column:
    return F.bround(value, digits)


def sentiment_value(label: Column) -> Column:
    """POSITIVE is 1, NEGATIVE is -1, everything else null."""
    return F.when(label == "POSITIVE", F.lit(1)).when(label == "NEGATIVE", F.lit(-1))


def is_positive(score: Column) -> Column:
    return score > 0


def is_negative(score: Column) -> Column:
    return score <= 0


def fingerprint(df: DataFrame, text: str, key: str) -> DataFrame:
    """Ten hex digits naming a data set: its first three texts by key and its size."""
    first = df.orderBy(key).limit(3).agg(
        F.transform(F.sort_array(F.collect_list(F.struct(key, text))), lambda s: s[text]).alias("texts")
    )
    rows = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    joined = F.concat_ws("|", F.array_join("texts", "|"), rows.cast("string"))
    return first.select(F.substring(F.md5(joined), 1, 10).alias("fingerprint"))


def to_text(array: Column) -> Column:
    """Array as JSON text, for CSV files."""
    return F.to_json(array)


def quote_cursor(cursor: Column) -> Column:
    """Percent-encoded text in which '/' and the unreserved characters stay."""
    quoted = F.url_encode(cursor)
    for found, wanted in (("+", "%20"), ("*", "%2A"), ("%2F", "/"), ("%7E", "~")):
        quoted = F.replace(quoted, F.lit(found), F.lit(wanted))
    return quoted
