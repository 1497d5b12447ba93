"""Libraries of sounds: recordings cut into segments, bulk import, files out, and libraries put together."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from yaml import YAMLError

from sonoframe.functions.analysis import analyse_sounds
from sonoframe.operators.detector import Detector, advance, fresh
from sonoframe.operators.retention import merged
from sonoframe.operators.shared import stored
from sonoframe.plans.spec import read_map
from sonoframe.sources import audio, sidecars

SEGMENT = "path string, start bigint, stop bigint, sample_rate int, bit_depth int, channels int, frames bigint, pcm binary"


def chunk_levels(x: np.ndarray, chunk: int) -> list[float]:
    """Root mean square of each whole chunk of a sound (frames x channels), in the sound's own integer scale."""
    whole = x[: len(x) // chunk * chunk].astype(np.float64).reshape(-1, chunk * x.shape[1])
    return np.sqrt((whole**2).mean(1)).tolist()


def segment_sounds(sounds: DataFrame, d: Detector, threshold: float, before: int = 10, after: int = 90, levels: Callable[[np.ndarray, int], list[float]] = chunk_levels) -> DataFrame:
    """The sound events in whole recordings, trimmed and faded: a row for each. A recording is one task's row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                x = audio.frames_of(r.pcm, r.bit_depth, r.channels)
                for a, b in advance(d, fresh(d), levels(x, d.chunk)):
                    y = audio.trim(x[max(0, a - before) : b], threshold, before, after)
                    rows.append((r.path, a, b, r.sample_rate, r.bit_depth, r.channels, len(y), y.tobytes()))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SEGMENT.split(", ")])

    return sounds.mapInPandas(run, SEGMENT)


def import_sounds(sounds: DataFrame, rate: int = 44100, depth: int = 16, threshold: float = 0.004, fade_ms: float = 1.0) -> DataFrame:
    """Recordings as library sounds: silence (under threshold of full scale) cut off both ends, short fades there,
    resampled. The same columns as read_wavs."""
    import hashlib

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                x = audio.to_float(audio.frames_of(r.pcm, r.bit_depth, r.channels)).astype(np.float64)
                x = audio.resample(audio.trim(x, threshold), r.sample_rate, rate)
                n = min(int(rate * fade_ms / 1000), len(x) // 2)
                if n:
                    ramp = ((1 - np.cos(np.pi * np.arange(n) / n)) / 2)[:, None]
                    x[:n] *= ramp
                    x[-n:] *= ramp[::-1]
                pcm = audio.to_pcm(x, depth)
                rows.append((r.path, rate, depth, r.channels, len(pcm), pcm.tobytes(), hashlib.md5(audio.encode(pcm, rate, depth)).hexdigest()))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in audio.PCM.split(", ")])

    return sounds.mapInPandas(run, audio.PCM)


def encoded(sounds: DataFrame) -> DataFrame:
    """(path, content, md5): each sound as the bytes of a WAV file; md5 is of exactly these bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            content = [audio.encode(audio.frames_of(r.pcm, r.bit_depth, r.channels), r.sample_rate, r.bit_depth) for r in batch.itertuples()]
            yield pd.DataFrame({"path": batch.path, "content": content})

    return sounds.mapInPandas(run, "path string, content binary").withColumn("md5", F.md5("content"))


def write_files(files: DataFrame, folder: str) -> None:
    """Each file's content under its base name in a folder of a store that all executors reach (any that pyarrow opens).

    A file is written under another name and then moved, so that readers never see half of one, and again is no harm.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base)
        for batch in batches:
            for path, content, md5 in zip(batch.path, batch.content, batch.md5, strict=True):
                name = f"{base}/{os.path.basename(path)}"
                with store.open_output_stream(f"{name}.{md5}.part") as out:
                    out.write(content)
                store.move(f"{name}.{md5}.part", name)
            yield pd.DataFrame({"n": [len(batch)]})

    files.select("path", "content", "md5").mapInPandas(run, "n bigint").agg(F.sum("n")).collect()


def load_or_analyse(spark: SparkSession, path: str, versions: tuple[str, ...] = ("13",), write: bool = False) -> DataFrame:
    """Samples (without sample_id) of the sounds under path: from their sidecars, and analysed where a sound has none that
    fits its content and version. With write the new sidecars are stored beside the sounds, for the next time.

    Sidecars are held against files by their hashes; only the sounds that lack one are decoded and analysed.
    """
    known = sidecars.decoded(sidecars.raw(spark, path), versions)
    files = sidecars.audio_files(spark, path)
    known = known.join(files.select(F.col("path").alias("filepath"), F.col("md5").alias("audio_md5")), ["filepath", "audio_md5"], "left_semi")
    lacking = sidecars.missing(files, known).select("path")
    made = sidecars.of_analysis(analyse_sounds(audio.read_wavs(spark, path).join(lacking, "path", "left_semi")))
    if write:
        made = stored(made, "analysed")
        write_files(sidecars.as_files(made), path)
    return known.unionByName(sidecars.decoded(made, versions))


def library(spark: SparkSession, directories: list[str], files: list[str] = (), versions: tuple[str, ...] = ("13",)) -> DataFrame:
    """Samples of directories, then single sounds by their path; of a name given twice the first counts."""
    places = [*directories, *(f + sidecars.SUFFIX for f in files)]
    parts = [sidecars.decoded(sidecars.raw(spark, p), versions) for p in places]
    return sidecars.numbered(reduce(lambda a, b: merged(a, b, "name"), parts))


def reference_by_path(spark: SparkSession, path: str, versions: tuple[str, ...] = ("13",)) -> DataFrame:
    """One sound as a reference that is named by its whole path: its sidecar, or analysed if it has none that fits."""
    folder, _, name = path.rpartition("/")
    known = sidecars.decoded(sidecars.raw(spark, folder), versions)
    known = known.where(F.url_decode(F.element_at(F.split(F.replace("filepath", F.lit("+"), F.lit("%2B")), "/"), -1)) == name)
    sound = audio.read_wavs(spark, folder, name).join(known.select(F.col("filepath").alias("path")), "path", "left_anti")
    return known.unionByName(sidecars.decoded(sidecars.of_analysis(analyse_sounds(sound)), versions)).withColumn("ref", F.upper(F.lit(path)))


class MapFile:
    """A note map that is read anew between batches when its file has changed; a map that can't be read changes nothing."""

    def __init__(self, path: str):
        self.path, self.stamp, self.found = path, None, None
        self.error: Exception | None = None

    def current(self):
        stamp = os.stat(self.path).st_mtime_ns
        if stamp != self.stamp:
            self.stamp = stamp
            try:
                with open(self.path, encoding="utf-8") as f:
                    self.found, self.error = read_map(f.read(), os.path.dirname(os.path.abspath(self.path))), None
            except (ValueError, YAMLError) as e:
                self.error = e
        return self.found


def described(samples: DataFrame) -> DataFrame:
    """(sample_id, text): a line about each sample, for logs."""
    text = F.format_string("%s %.2fs  tempo %.1f (%d onsets)  pitch %.1f Hz (%.2f)  rms %.3f", F.col("name"), F.col("duration"), F.col("rhythm.tempo_bpm"), F.col("rhythm.onset_count"), F.col("pitch.dominant_pitch_hz"), F.col("pitch.pitch_confidence"), F.col("level.rms"))
    return samples.select("sample_id", text.alias("text"))


def of_bank(samples: DataFrame, program: int) -> DataFrame:
    """The active bank's samples; bank is a partition column, so that only its files are read."""
    return samples.where(F.col("bank") == program)


def program_after(banks: list[dict], before: int | None) -> int | None:
    """The program that stays active when banks are replaced: the same one if it is still there, else the first."""
    programs = [b["program"] for b in banks]
    return before if before in programs else min(programs, default=None)
