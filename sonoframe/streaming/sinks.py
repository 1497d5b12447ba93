"""Where streams end: once-only runs into a table, and batches integrated as one step."""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonoframe.operators.shared import shared_folder


def run_once(stream: DataFrame, name: str) -> DataFrame:
    """Take all that is there now, and return what the stream has given as a table."""
    folder = f"{shared_folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/{name}")


def integrate(stream: DataFrame, steps: list[Callable[[DataFrame, int], None]], log: str, listeners: list[Callable[[DataFrame, int], None]] = ()):
    """Each batch goes through all steps (library, index, variants) before the next one is read, then to the listeners.

    A step that fails fails the batch, which is then run again; a listener that fails is logged, and the others still
    hear of the batch, in order.
    """

    def run(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for step in steps:
                step(batch, number)
            for listener in listeners:
                try:
                    listener(batch, number)
                except Exception:
                    logging.getLogger(__name__).exception("a listener failed on batch %d", number)
        finally:
            batch.unpersist()

    return stream.writeStream.option("checkpointLocation", log).foreachBatch(run)


def following(map_file, step: Callable[[DataFrame, int, object], None]) -> Callable[[DataFrame, int], None]:
    """A step for integrate() that is also given the note map (a sources.library.MapFile) as it is by then."""
    return lambda batch, number: step(batch, number, map_file.current())


def captured_notices(samples: DataFrame) -> DataFrame:
    """What is said of a new recording: address and six values."""
    return samples.select(F.lit("/sample/captured").alias("address"), "filepath", "duration", "pitch.dominant_pitch_hz", "pitch.dominant_pitch_class", "rhythm.tempo_bpm", "rhythm.onset_count")


def loaded_notices(samples: DataFrame) -> DataFrame:
    """What is said of a sample that a library has taken in: address and four values."""
    return samples.select(F.lit("/sample/loaded").alias("address"), "name", "duration", "pitch.dominant_pitch_hz", "pitch.dominant_pitch_class")


class Retrying:
    """A step for integrate() that tries arrivals again with the next batches, up to attempts times.

    load(batch) returns the keys of those that couldn't be loaded yet. They wait in a table of the shared folder, one
    folder for each batch, so that a batch that is run again finds what the one before left.
    """

    def __init__(self, load: Callable[[DataFrame], DataFrame], key: str, folder: str, attempts: int = 3):
        self.load, self.key, self.folder, self.attempts = load, key, folder.rstrip("/"), attempts

    def waiting(self, spark, number: int, schema) -> DataFrame:
        try:
            return spark.read.schema(schema).parquet(f"{self.folder}/after={number}")
        except AnalysisException:
            return spark.createDataFrame([], schema)

    def __call__(self, batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("attempt", F.lit(0))
        rows = rows.unionByName(self.waiting(batch.sparkSession, number - 1, rows.schema))
        failed = self.load(rows.drop("attempt")).select(self.key).distinct()
        left = rows.join(failed, self.key, "left_semi").withColumn("attempt", F.col("attempt") + 1).where(F.col("attempt") <= self.attempts)
        left.write.mode("overwrite").parquet(f"{self.folder}/after={number}")


class Backlog:
    """Whether a stream falls behind: told of each progress, it warns where least or more batches' worth of rows wait,
    and says once when that is over."""

    def __init__(self, warn: Callable[[str], None], least: float = 3.0):
        self.warn, self.least, self.behind = warn, least, False

    def heard(self, came: float, done: float) -> None:
        """came and done are rows a second in and through."""
        late = came > 0 and came >= self.least * max(done, 1e-9)
        if late:
            self.warn(f"rows come {came / max(done, 1e-9):.1f} times as fast as they are taken in")
        elif self.behind:
            self.warn("all rows are taken in")
        self.behind = late

    def listener(self):
        """As a listener of Spark's streaming queries."""
        from pyspark.sql.streaming import StreamingQueryListener

        heard = self.heard

        class Listener(StreamingQueryListener):
            def onQueryStarted(self, event) -> None: ...  # noqa: N802

            def onQueryIdle(self, event) -> None: ...  # noqa: N802

            def onQueryTerminated(self, event) -> None: ...  # noqa: N802

            def onQueryProgress(self, event) -> None:  # noqa: N802
                heard(event.progress.inputRowsPerSecond or 0.0, event.progress.processedRowsPerSecond or 0.0)

        return Listener()
