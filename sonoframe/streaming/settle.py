"""Arrivals that have settled: one notice per key once nothing more has come for a while."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def settled(arrivals: DataFrame, key: str, value: str, quiet_ms: int, order: str | None = None) -> DataFrame:
    """(key, value): each key's last value, quiet_ms after its last arrival; every arrival starts the wait anew.

    Of a micro-batch's arrivals the last is that of the greatest order, or of the greatest value where none is given.

    For files that are still being written (value: their size) and for controllers that are still being turned.
    """
    kinds = {c: arrivals.schema[c].dataType.simpleString() for c in (key, value)}

    def run(name, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            out = pd.DataFrame({key: [name[0]], value: [state.get[0]]})
            state.remove()
            yield out
            return
        rows = pd.concat(list(batches))
        if len(rows):
            state.update((rows.sort_values([c for c in (order, value) if c])[value].iloc[-1],))
        state.setTimeoutDuration(quiet_ms)

    return arrivals.select(key, value, *([order] if order else [])).groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, {value} {kinds[value]}", f"{value} {kinds[value]}", "append", GroupStateTimeout.ProcessingTimeTimeout)
