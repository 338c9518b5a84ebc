"""Position and event tables as streams: files arriving chunk by chunk, sessions, late data, stateful linking."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from trackloom.plans.matches import kind


def arriving(spark: SparkSession, folder: str, schema: StructType, *, per_trigger: int = 16) -> DataFrame:
    """Parquet files of a folder as they arrive, a bounded number to a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def windowed_counts(stream: DataFrame, *, time: str, keys: list[str], width: str, late: str) -> DataFrame:
    """(window start, keys, n) over event time; rows later than ``late`` behind the newest are dropped."""
    w = F.window(time, width)
    return stream.withWatermark(time, late).groupBy(w, *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def sessions(stream: DataFrame, *, time: str, keys: list[str], gap: str, late: str) -> DataFrame:
    """(keys, start, end, n): stretches of events no farther apart than ``gap``."""
    s = F.session_window(time, gap)
    return stream.withWatermark(time, late).groupBy(*keys, s).agg(F.count("*").alias("n")).select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def once_per_key(stream: DataFrame, *, time: str, keys: list[str], late: str) -> DataFrame:
    """Rows without re-deliveries inside the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def possession_changes(stream: DataFrame) -> DataFrame:
    """(chunk, frame, lost_team, won_team) of a stream of possession rows (chunk, frame, team), with the last holder kept as state.

    Rows of a chunk must arrive in order of frame between batches; within a batch they are sorted.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts), ignore_index=True).sort_values("frame")
        was = state.get[0] if state.exists else None
        out = []
        for frame, team in zip(rows["frame"], rows["team"], strict=True):
            if was is not None and team != was:
                out.append((key[0], int(frame), int(was), int(team)))
            was = team
        state.update((int(was),))
        yield pd.DataFrame(out, columns=["chunk", "frame", "lost_team", "won_team"])

    return stream.groupBy("chunk").applyInPandasWithState(step, f"{kind(stream, 'chunk')}, frame long, lost_team int, won_team int", "team int", "append", "NoTimeout")


def drain(stream: DataFrame, name: str, checkpoint: str, *, mode: str = "append") -> StreamingQuery:
    """Runs over everything there is into a memory table, and ends."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def drain_to(stream: DataFrame, folder: str, checkpoint: str, *, partition_by: list[str] | None = None) -> StreamingQuery:
    """Runs over everything there is into parquet files, exactly once, and ends."""
    w = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", folder).trigger(availableNow=True)
    q = (w.partitionBy(*partition_by) if partition_by else w).start()
    q.awaitTermination()
    return q
