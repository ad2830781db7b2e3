"""Streams: admission under a token budget of the last seconds, and files that are chunked as they arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.chunkers import fixed_windows


def admitted(requests: list[tuple[int, int]], held: list[tuple[int, int]], limit: int, span: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """(time, tokens, time of admission) of requests in order of time, all in microseconds, and what stays in the window.

    A request is admitted if with it the tokens of the last `span` are within the limit, or if none are; else it waits until
    the oldest has left the window.
    """
    out, now = [], 0
    for at, n in requests:
        now = max(now, at)
        while True:
            held = [h for h in held if h[0] > now - span]
            if not held or sum(h[1] for h in held) + n <= limit:
                break
            now = max(now + 100_000, held[0][0] + span)
        held = [*held, (now, n)]
        out.append((at, n, now))
    return out, held


def budget_stream(events: DataFrame, limit: int = 30_000, seconds: int = 60) -> DataFrame:
    """worker, ts, tokens, admitted_at of a stream of events (worker, ts, tokens), with a window's state per worker."""
    span = seconds * 1_000_000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        held = list(zip(*state.get, strict=True)) if state.exists else []
        told, held = admitted(list(zip(rows["ts"].astype("int64") // 1000 if rows["ts"].dtype == "datetime64[ns]" else rows["ts"].astype("datetime64[us]").astype("int64"), rows["tokens"].astype("int64"), strict=True)), held, limit, span)
        state.update(([int(h[0]) for h in held], [int(h[1]) for h in held]))
        yield pd.DataFrame({"worker": key[0], "ts": pd.to_datetime([t[0] for t in told], unit="us"), "tokens": [int(t[1]) for t in told], "admitted_at": pd.to_datetime([t[2] for t in told], unit="us")})

    return events.groupBy("worker").applyInPandasWithState(step, "worker long, ts timestamp, tokens long, admitted_at timestamp", "times array<long>, tokens array<long>", "append", GroupStateTimeout.NoTimeout)


def chunk_stream(spark: SparkSession, folder: str, size: int = 240) -> DataFrame:
    """Fixed windows of text files as they arrive in a folder."""
    files = spark.readStream.format("text").option("wholetext", "true").load(folder)
    return fixed_windows(files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")), size)
