"""Landed pages of the review feed: stop rules, flattening, metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from reviewlens.functions.formatting import run_stamp
from reviewlens.scale import cut_lineage, join_lookup
from reviewlens.sources import schemas

REQUEST = ["appid", "review_type"]
#: Folders of the review table: a game and type lies whole in one of them.
SHARD, SHARDS = "shard", 256


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.FEED_PAGE).json(path)


def _with_request(rows: DataFrame, lookup: DataFrame, keys, salt_by) -> DataFrame:
    """Rows joined to one row per request; nulls in the keys meet each other.

    The lookup holds no texts: where its checked size is small the pages stay in place.
    """
    request = F.struct(*keys)
    keyed = lookup.withColumn("_request", request).drop(*keys)
    return join_lookup(rows.withColumn("_request", request), keyed, "_request", list(salt_by), "inner").drop("_request")


def followed_pages(pages: DataFrame) -> DataFrame:
    """Pages a client following the cursor would have kept.

    A failed or empty page ends the feed before it; a missing or '*' cursor ends
    it after its page.
    """
    broken = (F.coalesce("success", F.lit(0)) == 0) | (F.coalesce(F.size("reviews"), F.lit(0)) <= 0)
    final = F.coalesce("cursor", F.lit("")).isin("", "*")
    ends = pages.groupBy(*REQUEST).agg(
        F.min(F.when(broken, F.col("page_no"))).alias("_broken"), F.min(F.when(final, F.col("page_no"))).alias("_final")
    )
    joined = _with_request(pages, ends, REQUEST, ["page_no"])
    before = F.col("_broken").isNull() | (F.col("page_no") < F.col("_broken"))
    until = F.col("_final").isNull() | (F.col("page_no") <= F.col("_final"))
    return joined.filter(before & until).drop("_broken", "_final")


def flatten_pages(pages: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per review; the author's fields get the author_ prefix, ``extra`` page columns stay."""
    rows = pages.select(*REQUEST, *extra, "page_no", F.posexplode("reviews").alias("pos", "r"))
    item = schemas.FEED_PAGE["reviews"].dataType.elementType
    plain = [F.col(f"r.{f.name}") for f in item.fields if f.name != "author"]
    author = [F.col(f"r.author.{f.name}").alias(f"author_{f.name}") for f in item["author"].dataType.fields]
    return rows.select(*REQUEST, *extra, "page_no", "pos", *plain, *author)


def cap_per_request(rows: DataFrame, cap: int | None = None, keys=REQUEST, order=("page_no", "pos")) -> DataFrame:
    """First ``cap`` rows of every request; all rows when no cap is asked for.

    The limit is applied in every task before the shuffle, so a request with a
    third of all rows still sends at most ``cap`` rows per task.
    """
    if not cap:
        return rows
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_at", F.row_number().over(w)).filter(F.col("_at") <= cap).drop("_at")


def with_fetch_columns(rows: DataFrame, keys=REQUEST, salt_by=("recommendationid",), stamp=None) -> DataFrame:
    """Add fetch_date and total_reviews, the size of this fetch."""
    totals = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_reviews"))
    stamped = rows.withColumn("fetch_date", run_stamp() if stamp is None else F.lit(stamp))
    return _with_request(stamped, totals, keys, salt_by)


def feed_reviews(pages: DataFrame, cap: int | None = None, stamp: str | None = None) -> DataFrame:
    """Pages to review rows, stop rules and metadata included."""
    kept = cap_per_request(flatten_pages(followed_pages(pages)), cap)
    return with_fetch_columns(kept, stamp=stamp).drop("page_no", "pos")


def newest_reviews(rows: DataFrame) -> DataFrame:
    """One row of each review id within a game and type, that of the newest fetch.

    Rows without an id stay, once for each content: a repeated run adds none.
    """
    fetched = F.struct(F.coalesce(F.col("fetch_date").cast("string"), F.lit("")), F.xxhash64(*rows.columns))
    known = rows.filter(F.col("recommendationid").isNotNull())
    best = known.groupBy(*REQUEST, "recommendationid").agg(F.max_by(F.struct(*rows.columns), fetched).alias("r"))
    unknown = rows.filter(F.col("recommendationid").isNull())
    content = [c for c in rows.columns if c not in ("fetch_date", "total_reviews")]
    return best.select("r.*").unionByName(unknown.dropDuplicates(content))


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The review table at ``path`` with its shards, or nothing where none was written yet."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return None
    found = spark.read.option("mergeSchema", "true").parquet(path)
    if SHARD not in found.columns:
        raise ValueError(f"{path} is not laid out by {SHARD}: ingest the pages into a new place")
    return found


def write_reviews(rows: DataFrame, path: str) -> None:
    """Merge by review id into the table of reviews.

    The table is laid out in ``SHARDS`` folders by a hash of the game and type, so the
    number of files does not grow with that of the games.  Only shards that receive rows
    are read and replaced, so that a repeated run leaves the table as it is.  Crowded
    shards are split over several files.
    """
    spark = rows.sparkSession
    shard = F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in REQUEST]), F.lit(SHARDS)).cast("int")
    rows = cut_lineage(rows.withColumn(SHARD, shard))
    stored = _stored(spark, path)
    merged = rows
    if stored is not None:
        touched = [r[SHARD] for r in rows.select(SHARD).distinct().collect()]  # at most SHARDS
        merged = rows.unionByName(stored.filter(F.col(SHARD).isin(touched)), allowMissingColumns=True)
    # written apart first: the shards that are replaced are those just read
    merged = cut_lineage(newest_reviews(merged))
    merged.hint("rebalance", SHARD).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(SHARD).parquet(path)
