"""Live capture: streams of PCM chunks in, trimmed sound events out, with the last chunks held as state."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sonoframe.operators.detector import RECORDING, Detector, advance, fresh
from sonoframe.sources import audio
from sonoframe.sources.library import chunk_levels

CHUNK = "stream_id string, chunk_idx bigint, pcm binary"
FIELDS = ["n", "mode", "ambient", "hold", "warm", "start"]
STATE = "n bigint, mode int, ambient double, hold int, warm int, start bigint, first bigint, pcm binary"


def captured(chunks: DataFrame, d: Detector, depth: int, channels: int, threshold: float, before: int = 10, after: int = 90) -> DataFrame:
    """(stream_id, start, stop, frames, pcm): each sound event of streams of CHUNK, trimmed and faded, once it has ended.

    A stream's chunks (of d.chunk frames) come in order between micro-batches and are sorted within one. The state holds
    the frames from an event's start on, or the last before frames where there is none: as much as the longest event,
    which d.longest bounds, however long the stream is.
    """
    kind = np.int16 if depth == 16 else np.int32

    def run(key: tuple[Any], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, first, held = fresh(d), 0, b""
        if state.exists:
            *fields, first, held = state.get
            now = dict(zip(FIELDS, fields, strict=True))
        rows = pd.concat(list(batches)).sort_values("chunk_idx")
        x = np.frombuffer(bytes(held) + b"".join(map(bytes, rows.pcm)), kind).reshape(-1, channels)
        own = x[now["n"] * d.chunk - first :]
        out = []
        for start, stop in advance(d, now, chunk_levels(own, d.chunk)):
            y = audio.trim(x[max(0, start - before - first) : stop - first], threshold, before, after)
            out.append((key[0], start, stop, len(y), y.tobytes()))
        need = max(0, (now["start"] if now["mode"] == RECORDING else now["n"] * d.chunk) - before)
        keep = max(first, need)
        state.update((*(now[f] for f in FIELDS), keep, x[keep - first :].tobytes()))
        yield pd.DataFrame(out, columns=["stream_id", "start", "stop", "frames", "pcm"])

    return chunks.groupBy("stream_id").applyInPandasWithState(run, "stream_id string, start bigint, stop bigint, frames bigint, pcm binary", STATE, "append", GroupStateTimeout.NoTimeout)
