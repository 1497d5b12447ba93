"""The level detector on unbounded streams, with its state kept by Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sonoframe.operators.detector import MISSING, Detector, advance, fresh

FIELDS = ["n", "mode", "ambient", "hold", "warm", "start"]
STATE = "n bigint, mode int, ambient double, hold int, warm int, start bigint"


def segments(chunks: DataFrame, d: Detector, stream: str = "stream_id", order: tuple[str, ...] = ("chunk_idx",), value: str = "rms") -> DataFrame:
    """(stream, start, stop) of each event as soon as it has ended. Chunks of a stream must arrive in order between
    micro-batches; within one they are sorted. State per stream is six numbers, however long it runs."""
    kind = chunks.schema[stream].dataType.simpleString()

    def run(key: tuple[Any], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = dict(zip(FIELDS, state.get, strict=True)) if state.exists else fresh(d)
        rows = pd.concat(list(batches)).sort_values(list(order))
        ended = advance(d, now, rows[value].tolist())
        state.update(tuple(now[f] for f in FIELDS))
        yield pd.DataFrame({stream: [key[0]] * len(ended), "start": [a for a, _ in ended], "stop": [b for _, b in ended]})

    levels = F.coalesce(F.col(value).cast("double"), F.lit(MISSING)).alias(value)
    return chunks.select(stream, *order, levels).groupBy(stream).applyInPandasWithState(run, f"{stream} {kind}, start bigint, stop bigint", STATE, "append", GroupStateTimeout.NoTimeout)


def session_counts(events: DataFrame, key: str, at: str, gap: str, late: str) -> DataFrame:
    """Events per session (a key's events with no gap between them), complete once the watermark has passed."""
    e = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return e.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def watch_folder(spark, folder: str, schema: str, per_batch: int = 1000) -> DataFrame:
    """New sidecars in a folder as a stream; the file source's log remembers which were read."""
    return spark.readStream.schema(schema).option("multiLine", True).option("maxFilesPerTrigger", per_batch).json(folder)
