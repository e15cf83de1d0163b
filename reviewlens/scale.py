"""Helpers that keep plans safe on skewed and very large inputs."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A frame is only broadcast when its checked row count is at most this.
BROADCAST_ROWS = 100_000
#: Number of slices a possibly hot join key is divided into.
SALTS = 32


def build_session(app: str = "reviewlens", master: str | None = None, **conf) -> SparkSession:
    """Session with the settings the operators are tuned for."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate data: that of ``spark.checkpoint.dir``.

    A folder of our own is used only where the session names none (tests on one
    machine).
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="reviewlens-ckpt-"))
    return context._jsc.sc().getCheckpointDir().get()


#: Whether Spark removes the shuffle files of a query at its end.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def released(df: DataFrame) -> DataFrame:
    """The frame, for one collect or checkpoint whose shuffle files go as soon as it ends.

    Otherwise they stay until the driver happens to collect its garbage: those of a loop add up.
    """
    conf = df.sparkSession.conf
    before = conf.get(SHUFFLES_GO, "false")
    conf.set(SHUFFLES_GO, "true")
    try:
        return df.select("*")  # the setting is read when a frame is made
    finally:
        conf.set(SHUFFLES_GO, before)


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return released(df).checkpoint() if eager else df.checkpoint(eager)


def row_hash(*columns, seed: int | str = 0) -> Column:
    """Repeatable md5 of a key: equal on every engine, so samples can be checked."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns], F.lit(str(seed))))


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """True when the frame has at most ``max_rows`` rows (reads no more than that)."""
    return df.limit(max_rows + 1).count() <= max_rows


def join_lookup(
    facts: DataFrame,
    lookup: DataFrame,
    on: str | list[str],
    salt_by: list[str],
    how: str = "left",
    max_rows: int = BROADCAST_ROWS,
    bounded: bool = False,
) -> DataFrame:
    """Join a big frame to one row per key without trusting the key distribution.

    Small lookups (checked, or ``bounded`` by a parameter of the caller) are
    broadcast.  Larger ones are copied ``SALTS`` times and the facts spread over
    the copies, so a key that holds a third of all rows is split over many tasks.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if bounded:
        return facts.join(F.broadcast(lookup), keys, how)
    lookup = lookup.persist()
    if fits_broadcast(lookup, max_rows):
        return facts.join(F.broadcast(lookup), keys, how)
    return salted_join(facts, lookup, keys, salt_by, how)


def salted_join(
    facts: DataFrame, lookup: DataFrame, keys: list[str], salt_by: list[str], how: str = "left", salts: int = SALTS
) -> DataFrame:
    """Equi-join whose left side may be skewed on ``keys``."""
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in salt_by]), F.lit(salts)).cast("int")
    spread = facts.withColumn("_salt", salt)
    copies = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copies, [*keys, "_salt"], how).drop("_salt")


def spread(df: DataFrame) -> DataFrame:
    """Use every core for text work on a small input.

    A file with few row groups arrives in few splits; the costly expressions
    after the scan would then run on as many cores.  Inputs with at least one
    split per core are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Union by column name; columns missing in a frame become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
