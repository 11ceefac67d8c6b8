"""Batch-side steps of live recordings: latest-wins, latency and sessions.

Spark cannot follow a file that still grows, so the recorder lands closed files; every
operator below is the streaming form of a batch operator and gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from keelson.sources.scans import clip_of, radar_rows


def radar_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Radar points of landed chunk files, oldest first, with the session and chunk of their file."""
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_trigger).option("latestFirst", "false").load(folder)
    rows = radar_rows(lines.select(clip_of(F.col("_metadata.file_path")).alias("clip_id"), F.col("value").alias("line")))
    name = F.split("clip_id", "/")
    return rows.withColumns({"session": name[0], "chunk": name[1]})


IDLE_MS = 600_000


def _timer(idle_ms: int | None) -> str:
    return GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout


def latest_wins(batch: DataFrame, keys: tuple[str, ...] = ("clip_id",), order: str = "ts") -> DataFrame:
    """For ``foreachBatch``: the newest row per key and how many were skipped."""
    rest = [c for c in batch.columns if c not in keys]
    g = batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r"), (F.count("*") - 1).alias("skipped_rows"))
    return g.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest], "skipped_rows")


def with_latency(rows: DataFrame, now: str | None = None, budget_ms: float = 333.0) -> DataFrame:
    """Source latency (never negative) and the tick-budget flag."""
    t = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    lat = (F.unix_micros(t) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6
    return rows.withColumn("source_latency_s", F.greatest(F.lit(0.0), lat)).withColumn("over_budget", F.col("tick_ms") > budget_ms)


def live_sessions(rows: DataFrame, gap_s: float = 45.0, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """Activities of a scene, each closed by the first row of that scene after a silent gap, or
    when the scene has been silent for ``idle_ms``.  State is one open session per scene."""
    def advance(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names = ["start_s", "end_s", "rows"]
        spans = [tuple(state.get)] if state.exists else []
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], *spans[0])], columns=["scene", *names])
            return
        for pdf in batches:
            t = np.sort(pdf["t"].to_numpy())
            cut = np.flatnonzero(np.diff(t) >= gap_s) + 1
            spans += [(p[0], p[-1] + gap_s, len(p)) for p in np.split(t, cut)]
        merged: list[tuple] = []
        for a, b, n in sorted(spans):
            if merged and a < merged[-1][1]:
                merged[-1] = (merged[-1][0], max(merged[-1][1], b), merged[-1][2] + n)
            else:
                merged.append((a, b, n))
        state.update((float(merged[-1][0]), float(merged[-1][1]), int(merged[-1][2])))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame([(key[0], *m) for m in merged[:-1]], columns=["scene", *names])

    s = rows.select("scene", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    return s.groupBy("scene").applyInPandasWithState(
        advance, "scene string, start_s double, end_s double, rows bigint", "start_s double, end_s double, rows bigint", "append", _timer(idle_ms))
