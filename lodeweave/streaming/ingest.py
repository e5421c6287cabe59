"""Micro-batch ingestion, change emission and stateful folds on Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window


def ingest(pages: DataFrame, target: str, checkpoint: str, version: str):
    """Write extractions of streamed pages to ``target``, one folder per batch.

    A batch overwrites its own folder, so a batch that runs again after a loss leaves its
    rows once. Pages that failed or are empty are not extracted."""
    from lodeweave.operators.pages import rebuild

    def write(batch: DataFrame, number: int) -> None:
        good = batch.where("http_status = 200 and html is not null and html != ''")
        rebuild(good, version).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def windowed_counts(events: DataFrame, time: str, width: str, late: str, *keys: str) -> DataFrame:
    """Events per window and key, late ones up to ``late`` included; batch and stream alike."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def changes_only(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the row before of the same key; the first counts as one."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumns({"_p": F.lag(value).over(w), "_n": F.row_number().over(w)}).where((F.col("_n") == 1) | ~F.col(value).eqNullSafe(F.col("_p"))).drop("_p", "_n")


_STATE = "value string"


def changes_stream(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The same on a stream: the last value of each key is its state. Rows of a batch are taken
    in the order of ``order``."""

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        known = state.exists
        rows = pd.concat(list(batches)).sort_values("ord")
        out = []
        for o, v in zip(rows["ord"], rows["value"]):
            if not known or v != last:
                out.append((name[0], o, v))
            known, last = True, v
        state.update((last,))
        yield pd.DataFrame(out, columns=["key", "ord", "value"])

    plain = rows.select(F.col(key).cast("string").alias("key"), F.col(order).cast("long").alias("ord"), F.col(value).cast("string").alias("value"))
    return plain.groupBy("key").applyInPandasWithState(step, "key string, ord long, value string", _STATE, "append", GroupStateTimeout.NoTimeout)


def silent(heartbeats: DataFrame, key: str, time: str, now: Column, patience: str = "5 minutes") -> DataFrame:
    """Keys whose last sign of life is older than ``patience``, or that never gave one."""
    last = heartbeats.groupBy(key).agg(F.max(time).alias("last"))
    return last.where(F.col("last").isNull() | (F.col("last") < now - F.expr(f"INTERVAL {patience}")))


def backoff(events: DataFrame, key: str, order: str, failed: Column, least: float = 1.0, most: float = 15.0) -> DataFrame:
    """(key, delay): the delay after all events of each key in order: doubled by a failure between
    ``least`` and ``most``, halved by a success, 0 once it is a quarter or less.

    A key's events are few bytes each; their ordered array is folded in the JVM."""
    flags = events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), failed.alias("f")))).alias("e"))
    up = lambda d: F.least(F.lit(most), F.greatest(F.lit(least), d * 2))
    down = lambda d: F.when(d / 2 <= 0.25, F.lit(0.0)).otherwise(d / 2)
    return flags.select(key, F.aggregate("e", F.lit(0.0), lambda d, x: F.when(x["f"], up(d)).otherwise(down(d))).alias("delay"))
