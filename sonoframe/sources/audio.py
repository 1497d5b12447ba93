"""Sound files and PCM: reading, unpacking, writing, and the bulk import."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

PCM = "path string, sample_rate int, bit_depth int, channels int, frames bigint, pcm binary, md5 string"


def unpack(data: bytes, depth: int, channels: int) -> np.ndarray:
    """Little-endian PCM of 16, 24 or 32 bits as frames x channels; 24 bits stand in the upper part of 32."""
    if depth == 16:
        flat = np.frombuffer(data, "<i2")
    elif depth == 32:
        flat = np.frombuffer(data, "<i4")
    elif depth == 24:
        low = np.frombuffer(data, np.uint8).reshape(-1, 3)
        flat = np.zeros((len(low), 4), np.uint8)
        flat[:, 1:] = low
        flat = flat.view("<i4").ravel()
    else:
        raise ValueError(f"PCM of {depth} bits isn't known")
    return flat.reshape(-1, channels)


def pack24(x: np.ndarray) -> bytes:
    """The upper 24 bits of 32-bit integers."""
    return np.ascontiguousarray(x.astype("<i4")).view(np.uint8).reshape(-1, 4)[:, 1:].tobytes()


def to_float(pcm: np.ndarray) -> np.ndarray:
    """Integers to -1..1, by full scale of their type."""
    return pcm.astype(np.float32) / float(2 ** (8 * pcm.dtype.itemsize - 1))


def to_mono(pcm: np.ndarray, channel: int | None = None) -> np.ndarray:
    x = to_float(pcm) if pcm.dtype.kind == "i" else pcm
    return x.mean(axis=1) if channel is None else x[:, channel]


def to_pcm(x: np.ndarray, depth: int) -> np.ndarray:
    """-1..1 to integers for storage: clipped, rounded to even; 24 bits in the upper part of 32."""
    scale = 2 ** (depth - 1)
    out = np.clip(np.rint(np.clip(x, -1, 1).astype(np.float64) * scale), -scale, scale - 1)
    return (out.astype(np.int64) << (8 if depth == 24 else 0)).astype(np.int16 if depth == 16 else np.int32)


def for_device(x: np.ndarray, depth: int) -> bytes:
    """-1..1 to a device's integers: times the largest one, cut towards 0."""
    full = np.trunc(np.clip(x, -1, 1).astype(np.float64) * (2 ** (depth - 1) - 1)).astype(np.int64)
    return pack24((full << 8).astype(np.int32)) if depth == 24 else full.astype("<i2" if depth == 16 else "<i4").tobytes()


def decode(data: bytes) -> tuple[np.ndarray, int, int]:
    """Frames, sample rate and bit depth of a WAV file."""
    with wave.open(io.BytesIO(data)) as w:
        depth = 8 * w.getsampwidth()
        return unpack(w.readframes(w.getnframes()), depth, w.getnchannels()), w.getframerate(), depth


def encode(pcm: np.ndarray, rate: int, depth: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(pcm.shape[1])
        w.setsampwidth(depth // 8)
        w.setframerate(rate)
        w.writeframes(pack24(pcm) if depth == 24 else pcm.astype("<i2" if depth == 16 else "<i4").tobytes())
    return out.getvalue()


def resample(x: np.ndarray, rate: int, wanted: int) -> np.ndarray:
    """Band-limited resampling by a windowed sinc, frames x channels."""
    if rate == wanted or not len(x):
        return x
    n = max(1, round(len(x) * wanted / rate))
    cut = min(1.0, wanted / rate)
    half = int(np.ceil(16 / cut))
    at = np.arange(n) * rate / wanted
    first = np.floor(at).astype(int) - half + 1
    taps = first[:, None] + np.arange(2 * half)
    away = at[:, None] - taps
    window = np.where(np.abs(away) < half, 0.5 + 0.5 * np.cos(np.pi * away / half), 0)
    gain = cut * np.sinc(cut * away) * window
    gain /= gain.sum(1, keepdims=True)
    return np.einsum("nk,nkc->nc", gain, x[np.clip(taps, 0, len(x) - 1)].astype(np.float64)).astype(x.dtype if x.dtype.kind == "f" else np.float64)


def decoded(spark: SparkSession, path: str, pattern: str = "*.wav") -> DataFrame:
    """(PCM, error) of every WAV file under path whose name fits pattern; error says why a file can't be read, and is null where it can."""
    import hashlib

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for where, data in zip(batch.path, batch.content, strict=True):
                try:
                    pcm, rate, depth = decode(data)
                    rows.append((where, rate, depth, pcm.shape[1], len(pcm), pcm.tobytes(), hashlib.md5(data).hexdigest(), None))
                except (wave.Error, EOFError, ValueError) as e:
                    rows.append((where, 0, 0, 0, 0, None, hashlib.md5(data).hexdigest(), f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[*(c.split()[0] for c in PCM.split(", ")), "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")
    return files.mapInPandas(run, PCM + ", error string")


def read_wavs(spark: SparkSession, path: str, pattern: str = "*.wav") -> DataFrame:
    """(PCM) of every WAV file under path that can be read; unreadable() has the others."""
    return decoded(spark, path, pattern).where("error is null").drop("error")


def unreadable(spark: SparkSession, path: str) -> DataFrame:
    """(path, error) of the WAV files under path that can't be read."""
    return decoded(spark, path).where("error is not null").select("path", "error")


def frames_of(pcm: bytes, depth: int, channels: int) -> np.ndarray:
    """64 bits are doubles, for frames that no integer of a sound's depth holds."""
    return np.frombuffer(pcm, {16: np.int16, 64: np.float64}.get(depth, np.int32)).reshape(-1, channels)


def trim(x: np.ndarray, threshold: float, before: int = 0, after: int = 0) -> np.ndarray:
    """From the first to the last frame at or over the threshold, padded, with half-cosine fades over the padding; the
    whole if there is none."""
    loud = np.flatnonzero(np.abs(x).max(axis=1) >= threshold)
    if not len(loud):
        return x
    start, stop = max(0, loud[0] - before), min(len(x), loud[-1] + 1 + after)
    out = x[start:stop].astype(np.float64)
    head, tail = loud[0] - start, stop - loud[-1] - 1
    ramp = lambda n: ((1 - np.cos(np.pi * np.arange(n) / n)) / 2)[:, None] if n else np.empty((0, 1))
    out[:head] *= ramp(head)
    if tail:
        out[-tail:] *= ramp(tail)[::-1]
    return out.astype(x.dtype) if x.dtype.kind == "f" else np.rint(out).astype(x.dtype)
