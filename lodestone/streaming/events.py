"""Streams: windows over event time, keyed counters, incremental recomputation, debounce.

Each function takes a batch or a streaming DataFrame alike, so what a stream
computes can be checked against a batch run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tumbling(events: DataFrame, at: str, width: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    w = events.withWatermark(at, late).groupBy(F.window(at, width), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return w.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "value")


def sliding(events: DataFrame, at: str, width: str, step: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    w = events.withWatermark(at, late).groupBy(F.window(at, width, step), *keys).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("window.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, at: str, gap: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    w = events.withWatermark(at, late).groupBy(F.session_window(at, gap), *keys).agg(F.count(F.lit(1)).alias("n"), F.max(at).alias("last"))
    return w.select(F.col("session_window.start").alias("start"), *keys, "n", "last")


def debounced(edits: DataFrame, at: str, key: str, columns: list[str], quiet: str = "500 milliseconds") -> DataFrame:
    """The last edit of each document before it was quiet for so long; a newer edit takes the place of a waiting one."""
    last = [F.max_by(c, at).alias(c) for c in columns]
    return edits.withWatermark(at, quiet).groupBy(F.session_window(at, quiet), key).agg(F.max(at).alias(at), F.count(F.lit(1)).alias("edits"), *last).drop("session_window")


def counters(feedback: DataFrame, key: str = "pattern", action: str = "action") -> DataFrame:
    """Keyed counters of a feedback log; a reverted action is no new suggestion."""
    n = lambda v: F.count_if(F.col(action) == v)
    return feedback.groupBy(key).agg(F.count_if(F.col(action) != "reverted").alias("total"), n("applied").alias("applied"), n("rejected").alias("rejected"), n("reverted").alias("reverted"))


def merged(fresh: DataFrame, cache: DataFrame, unchanged: DataFrame, key: str) -> DataFrame:
    """Fresh results and cached results of unchanged keys."""
    return fresh.unionByName(cache.join(unchanged.select(key), key, "left_semi"))


def without(tables: dict[str, DataFrame], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """All tables without the rows of keys that are gone."""
    return {name: t.join(gone.select(key), key, "left_anti") for name, t in tables.items()}


def recompute(current: DataFrame, cache: DataFrame, analyse: Callable[[DataFrame], DataFrame], key: str, digest: str, dependents: DataFrame | None = None) -> DataFrame:
    """Analyses only what is new, changed or depends on that, and takes the rest from ``cache`` (key, digest, results).

    ``dependents``: (key, on) edges, of which one step is followed.
    """
    joined = current.join(cache.select(F.col(key).alias("_k"), F.col(digest).alias("_d")).distinct(), F.col(key) == F.col("_k"), "left")
    changed = joined.where(F.col("_k").isNull() | ~F.col(digest).eqNullSafe(F.col("_d"))).select(key)
    if dependents is not None:
        changed = changed.unionByName(dependents.join(changed.withColumnRenamed(key, "on"), "on", "left_semi").select(key)).distinct()
    todo = current.join(changed, key, "left_semi")
    kept = current.join(changed, key, "left_anti").select(key)
    return merged(analyse(todo), cache, kept, key)


def run_to_table(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over all that is there now and returns the table of its results."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    return stream.sparkSession.table(name)


def event_stream(spark: SparkSession, sf_dir: str, files: int = 8) -> DataFrame:
    """The events table as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{sf_dir}/events.parque[t]")  # a pattern: a lone file can't be a stream's folder
