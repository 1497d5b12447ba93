"""Channels and space: mix matrices, device routing, ambisonic encoding, rotation and decoding.

Matrices are small constants that are worked out on the driver and become literals of a plan.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Channel orders of the layouts, and the ITU-R BS.775 rule: a channel that a smaller layout lacks goes at
#: -3 dB to the first of these that it has; LFE is dropped.
LAYOUTS = {1: ["M"], 2: ["L", "R"], 4: ["L", "R", "Ls", "Rs"], 6: ["L", "R", "C", "LFE", "Ls", "Rs"], 8: ["L", "R", "C", "LFE", "Ls", "Rs", "Lb", "Rb"]}
FOLDED = {"C": [["L", "R"]], "Ls": [["L"]], "Rs": [["R"]], "Lb": [["Ls"], ["L"]], "Rb": [["Rs"], ["R"]], "LFE": []}
HALF = 1 / math.sqrt(2)


def matrix(source: int, target: int) -> np.ndarray:
    """target x source gains. Up: channel to channel, the others silent; down by FOLDED, to mono by way of stereo. A
    layout that isn't known keeps its first channels."""
    if source <= target or source not in LAYOUTS or target not in LAYOUTS:
        return np.eye(target, source)
    if target == 1:
        return np.full((1, 2), HALF) @ matrix(source, 2)
    want = LAYOUTS[target]
    out = np.zeros((target, source))
    for j, channel in enumerate(LAYOUTS[source]):
        if channel in want:
            out[want.index(channel), j] = 1
            continue
        for others in FOLDED[channel]:
            if set(others) <= set(want):
                out[[want.index(c) for c in others], j] = HALF
                break
    return out


def pan_matrix(source: int, weights: list[float], outputs: int | None = None) -> np.ndarray:
    """Gains by the root of each weight's share, for a layout of as many channels as weights: mono goes out by them,
    more channels are first mixed to that layout. It is then mixed to outputs, where these are other than that."""
    total = sum(weights)
    gains = np.sqrt(np.array(weights, float) / total) if total > 0 else np.zeros(len(weights))
    out = gains[:, None] if source == 1 else gains[:, None] * matrix(source, len(weights))
    return out if outputs in (None, len(weights)) else matrix(len(weights), outputs) @ out


def route(m: np.ndarray, outputs: list[int], device: int) -> np.ndarray:
    """Rows of m to a device's channels, counted from 1."""
    if len(outputs) != len(m) or len(set(outputs)) != len(outputs) or min(outputs) < 1 or max(outputs) > device:
        raise ValueError(f"{outputs} isn't a choice of {len(m)} of {device} channels")
    out = np.zeros((device, m.shape[1]))
    out[np.array(outputs) - 1] = m
    return out


def applied(m: np.ndarray, frame: Column) -> Column:
    """m times a frame (an array of channels)."""
    rows = [F.aggregate(F.zip_with(F.array(*map(F.lit, map(float, r))), frame, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) for r in m]
    return F.array(*rows)


#: Capsules FLU, FRD, BLD, BRU to W, Y, Z, X, each a half.
A_TO_B = 0.5 * np.array([[1, 1, 1, 1], [1, -1, 1, -1], [1, -1, -1, 1], [1, 1, -1, -1]])
#: FuMa's W, X, Y, Z to AmbiX' W, Y, Z, X with W up by 3 dB.
FUMA_TO_AMBIX = np.array([[math.sqrt(2), 0, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1], [0, 1, 0, 0]])


def rotation(yaw: float, pitch: float, roll: float) -> np.ndarray:
    """Turn by yaw (z), then pitch (y), then roll (x), in radians, for channels W, Y, Z, X."""
    cz, sz, cy, sy, cx, sx = math.cos(yaw), math.sin(yaw), math.cos(pitch), math.sin(pitch), math.cos(roll), math.sin(roll)
    z = np.array([[cz, -sz, 0], [sz, cz, 0], [0, 0, 1]])
    y = np.array([[cy, 0, sy], [0, 1, 0], [-sy, 0, cy]])
    x = np.array([[1, 0, 0], [0, cx, -sx], [0, sx, cx]])
    xyz = z @ y @ x
    out = np.eye(4)
    order = [1, 2, 0]  # Y, Z, X of the matrix over x, y, z
    out[1:, 1:] = xyz[np.ix_(order, order)]
    return out


#: First-order gains by how the decoder shapes its beams.
SHAPES = {"basic": 1.0, "max_re": 1 / math.sqrt(3), "in_phase": 0.5}


def decoder(directions: list[tuple[float, float] | None], shape: str = "max_re") -> np.ndarray:
    """Speaker gains for W, Y, Z, X; directions are (azimuth, elevation) in degrees, None for the LFE, which has W only."""
    active = sum(d is not None for d in directions)
    out = np.zeros((len(directions), 4))
    for i, d in enumerate(directions):
        out[i, 0] = 1 / max(active, 1)
        if d is not None:
            a, e = map(math.radians, d)
            out[i, 1:] = SHAPES[shape] / active * np.array([math.sin(a) * math.cos(e), math.sin(e), math.cos(a) * math.cos(e)])
    return out


#: Azimuth and elevation of the speakers that an ambisonic sound is decoded to, by their number; None is the
#: LFE.
SPEAKERS = {
    2: [(45.0, 0.0), (-45.0, 0.0)],
    4: [(45.0, 0.0), (-45.0, 0.0), (135.0, 0.0), (-135.0, 0.0)],
    6: [(30.0, 0.0), (-30.0, 0.0), (0.0, 0.0), None, (110.0, 0.0), (-110.0, 0.0)],
    8: [(30.0, 0.0), (-30.0, 0.0), (0.0, 0.0), None, (110.0, 0.0), (-110.0, 0.0), (90.0, 0.0), (-90.0, 0.0)],
}


def mix_for(channel_format: str, source: int, device: int, weights: list[float] | None = None, outputs: list[int] | None = None, shape: str = "max_re", turn: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> np.ndarray:
    """The gains by which a sound goes to a device: decoded, after a turn (yaw, pitch, roll in degrees), if it is
    ambisonic and the outputs are a layout of speakers (for one output W alone), else panned or mixed by its channels."""
    n = len(outputs) if outputs is not None else device
    if channel_format == "b_format_ambix" and source == 4 and (n == 1 or n in SPEAKERS):
        speakers = np.eye(1, 4) if n == 1 else decoder(SPEAKERS[n], shape)
        out = speakers @ rotation(*(math.radians(a) for a in turn))
    else:
        out = matrix(source, n) if weights is None else pan_matrix(source, weights, n)
    return out if outputs is None else route(out, outputs, device)


def mixed(voices: DataFrame, frame: str, value: str, gain: str) -> DataFrame:
    """(frame, mixed, voices): all voices' values at their gains summed per frame, where they are before the shuffle."""
    return voices.groupBy(frame).agg(F.sum(F.col(value) * F.col(gain)).alias("mixed"), F.count("*").alias("voices"))


def released(position: Column, stopped: Column, length: int) -> Column:
    """A voice's gain at a position: 1 until it is stopped, then half a cosine down to 0 over length frames."""
    after = F.greatest(F.least((position - stopped) / length, F.lit(1.0)), F.lit(0.0))
    return F.when(stopped.isNull() | (position < stopped), 1.0).otherwise((1 + F.cos(F.lit(math.pi) * after)) / 2)
