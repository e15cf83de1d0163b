"""Topic assignment tables: dominant topics, sizes, ordering, mean vectors."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from reviewlens import settings
from reviewlens.functions.vectors import first_max_index
from reviewlens.operators.ranks import running_total
from reviewlens.scale import join_lookup, salted_join


def dominant_topic(df: DataFrame, distribution: str = "distribution", out: str = "topic") -> DataFrame:
    """Topic with the largest share; the first one on ties.  No shuffle."""
    return df.withColumn(out, first_max_index(F.col(distribution)))


def topic_info(assigned: DataFrame) -> DataFrame:
    """Topics with their sizes, largest first."""
    return assigned.groupBy("topic").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "topic")


def topic_sizes(assigned: DataFrame, k: int) -> DataFrame:
    """Sizes of topics 0..k-1, zero where a topic got no document."""
    counted = assigned.groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
    every = assigned.sparkSession.range(k).select(F.col("id").cast("int").alias("topic"))
    return every.join(F.broadcast(counted), "topic", "left").select("topic", F.coalesce("n", F.lit(0)).alias("n"))


def valid_topics(sizes: DataFrame) -> DataFrame:
    """How many topics lie between the smallest and largest allowed size, and
    whether enough do."""
    total = sizes.agg(F.sum("n").alias("total")).scalar()
    low = F.floor(total * settings.VALID_MIN_SHARE)
    high = F.floor(total * settings.VALID_MAX_SHARE)
    counted = sizes.agg(
        F.count_if(F.col("n").between(low, high)).alias("valid_topics"), F.count(F.lit(1)).alias("n_topics")
    )
    return counted.withColumn("passes", F.col("valid_topics") >= settings.VALID_GATE * F.col("n_topics"))


def order_by_size(assigned: DataFrame, cluster: str = "cluster", keys: list[str] | None = None, bounded: bool = False) -> DataFrame:
    """Renumber clusters 0.. by size (0 the largest); outliers keep -1."""
    sizes = assigned.filter(F.col(cluster).cast("string") != str(settings.OUTLIER_TOPIC)).groupBy(cluster).agg(F.count(F.lit(1)).alias("_n"))
    # the number of clusters grows with the data: no window over all of them
    ranked = running_total(sizes.withColumn("_first", -F.col("_n")), ["_first", cluster], out="_rank").select(
        cluster, (F.col("_rank") - 1).cast("int").alias("topic")
    )
    if bounded:
        joined = assigned.join(F.broadcast(ranked), cluster, "left")
    else:
        joined = salted_join(assigned, ranked, [cluster], salt_by=keys or assigned.columns, how="left")
    return joined.withColumn("topic", F.coalesce("topic", F.lit(settings.OUTLIER_TOPIC)))


def topic_vectors(assigned: DataFrame, vector: str = "embedding") -> DataFrame:
    """Mean vector per topic, averaged inside the JVM with partial sums."""
    typed = assigned.select("topic", array_to_vector(F.col(vector).cast("array<double>")).alias("_v"))
    return typed.groupBy("topic").agg(vector_to_array(Summarizer.mean(F.col("_v"))).alias("vector"))


def cross_similarity(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cosine of every topic of ``a`` with every topic of ``b``.

    Both are (topic, dim, w) frames bounded by topics x dimensions.  Computed as
    a sparse product: joined on the dimension, summed per pair of topics.
    """

    def unit(df: DataFrame) -> DataFrame:
        lengths = df.groupBy("topic").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_length"))
        scaled = F.when(F.col("_length") > 0, F.col("w") / F.col("_length")).otherwise(0.0)
        return join_lookup(df, lengths, "topic", ["dim"], "inner").withColumn("w", scaled).drop("_length")

    left = unit(a).select("dim", F.col("topic").alias("topic_a"), F.col("w").alias("wa"))
    right = unit(b).select("dim", F.col("topic").alias("topic_b"), F.col("w").alias("wb"))
    return left.join(right, "dim").groupBy("topic_a", "topic_b").agg(F.sum(F.col("wa") * F.col("wb")).alias("similarity"))


def vector_dims(vectors: DataFrame, vector: str = "vector") -> DataFrame:
    return vectors.select("topic", F.posexplode(vector).alias("dim", "w"))


def topic_similarity(vectors: DataFrame, digits: int | None = 2) -> DataFrame:
    """Topic-by-topic cosine matrix in long form."""
    dims = vector_dims(vectors)
    pairs = cross_similarity(dims, dims)
    return pairs if digits is None else pairs.withColumn("similarity", F.bround("similarity", digits))
