"""The progress operators on streams: debounced positions, the chapter cursor, and a store kept by batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from inkwell.operators import progress


def timed(events: DataFrame, ts_col: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Events with a watermark; timestamps without a zone are taken as the session's."""
    return events.withColumn(ts_col, F.col(ts_col).cast("timestamp")).withWatermark(ts_col, late)


def debounced(events: DataFrame, **options) -> DataFrame:
    return progress.debounced(events, **options)


def cursor(events: DataFrame, *, key_col: str, last_chapter: int, ts_col: str = "ts", type_col: str = "type") -> DataFrame:
    """``key_col``, ``chapter``: after each batch, where its events have led the key; the chapter is the key's state."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at = state.get[0] if state.exists else 0
        events = pd.concat(list(frames)).sort_values(ts_col, kind="stable")
        for kind in events[type_col]:
            at = min(at + 1, last_chapter) if kind == "next" else max(at - 1, 0)
        state.update((at,))
        yield pd.DataFrame({key_col: [key[0]], "chapter": [at]})

    moves = events.where(F.col(type_col).isin("prev", "next")).select(key_col, ts_col, type_col)
    kind = moves.schema[key_col].dataType.simpleString()
    return moves.groupBy(key_col).applyInPandasWithState(step, f"`{key_col}` {kind}, chapter int", "chapter int", "update", GroupStateTimeout.NoTimeout)


def keep_store(updates: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Write a stream of progress rows into a store, the latest row of each book.

    Every batch writes a new version beside the old one and only then counts, so a batch that is run again after a failure
    starts from the version before it; versions before that one are removed.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = latest_version(spark, path, number)
        store = spark.read.schema(progress.STORE).parquet(f"{path}/v{before}") if before is not None else spark.createDataFrame([], progress.STORE)
        progress.upserted(store, batch.select(store.columns)).write.mode("overwrite").parquet(f"{path}/v{number}")
        for old in [] if before is None else _versions(spark, path):
            if old < before:
                place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/v{old}")
                place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)

    return updates.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def latest_version(spark, path: str, below: int | None = None) -> int | None:
    """The newest complete version of a store, older than ``below`` if given."""
    return max((n for n in _versions(spark, path) if below is None or n < below), default=None)


def _versions(spark, path: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    files = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [entry.getPath().getName() for entry in files.listStatus(top)] if files.exists(top) else []
    return [int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and files.exists(jvm.org.apache.hadoop.fs.Path(top, f"{n}/_SUCCESS"))]
