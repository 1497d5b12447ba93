"""Features of a sound, worked out once per sound in numpy and returned as the structs of the samples table.

Spectra are short-time Fourier frames of the length and hop of window_length(). The harmonic split, the pitch track (a
YIN difference function with a threshold), the onset curve and the tempo (autocorrelation of it) are our own and
approximate what they are named after; they don't claim another library's numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from sonoframe.functions import dsp

VERSION = "13"
#: Ranges of the log-normalised features, the share of the peak that counts as active, bands in Hz.
TIME, FLATNESS, FLUX, CREST, LOWEST_HZ, ACTIVE, FLATTEST_ZCR, CONTRAST_DB = (0.001, 2.0), (1e-5, 0.9), (0.01, 5.0), (math.sqrt(2), 10.0), 20.0, 0.1, 0.5, 40.0
BANDS = [(20.0, 250.0), (250.0, 2000.0), (2000.0, 6000.0), (6000.0, 20000.0)]
SLOPE_DB = (-6.0, 2.0)
PITCH_HZ = (65.0, 2093.0)
MFCCS, MELS, ONSET_MS = 13, 40, 50.0


def log_share(v: float, low: float, high: float) -> float:
    if low >= high or v <= low:
        return 0.0
    return 1.0 if v >= high else math.log(v / low) / math.log(high / low)


def window_length(rate: int) -> tuple[int, int]:
    """The power of two nearest to 2048 samples at 44.1 kHz, and a quarter of it."""
    if rate <= 0:
        raise ValueError("the sample rate must be over 0")
    n = 2 ** round(math.log2(2048 / 44100 * rate))
    return n, n // 4


def frame_rms(x: np.ndarray, n: int, hop: int) -> np.ndarray:
    frames = np.lib.stride_tricks.sliding_window_view(x, n)[::hop]
    return np.sqrt((frames.astype(np.float64) ** 2).mean(1))


class Sound:
    """A mono signal with its spectra; what several features need is worked out once."""

    def __init__(self, x: np.ndarray, rate: int):
        n, hop = window_length(rate)
        self.x, self.rate = np.asarray(x, np.float64), rate
        self.n, self.hop = min(n, len(x)), min(hop, min(n, len(x)))
        self.complex = dsp.stft(self.x, self.n, max(self.hop, 1)) if self.n > 1 else np.zeros((1, 1), complex)
        self.size = np.abs(self.complex)
        self.power = self.size**2
        self.hz = np.fft.rfftfreq(self.n, 1 / rate) if self.n > 1 else np.zeros(1)
        self.seconds = self.hop / rate

    def flux(self) -> np.ndarray:
        """Rise of log level from frame to frame, averaged over frequencies: the onset curve."""
        level = 10 * np.log10(np.maximum(self.power, 1e-10))
        rise = np.maximum(0, np.diff(np.maximum(level, level.max() - 80), axis=0, prepend=level[:1]))
        return rise.mean(1)


def attack_release(s: Sound) -> tuple[float, float]:
    r = frame_rms(s.x, s.n, s.hop)
    top = r.max()
    if top < 1e-9:
        return 0.0, 0.0
    active, peak = np.flatnonzero(r >= ACTIVE * top), int(r.argmax())
    return log_share((peak - active[0]) * s.seconds, *TIME), log_share((active[-1] - peak) * s.seconds, *TIME)


def slope(s: Sound) -> float:
    mean = s.size.mean(0)
    own = (s.hz >= LOWEST_HZ) & (mean > 1e-10)
    if own.sum() < 2 or s.x.std() < 1e-9:
        return 0.5
    k = np.polyfit(np.log2(s.hz[own]), 20 * np.log10(mean[own]), 1)[0]
    return float(np.clip((k - SLOPE_DB[0]) / (SLOPE_DB[1] - SLOPE_DB[0]), 0, 1))


def contrast(s: Sound) -> float:
    """How far peaks stand over valleys (top and bottom fifth) in octave bands, in dB."""
    if s.n < 64:
        return 0.0
    edges, out = [0.0, 200.0, 400.0, 800.0, 1600.0, 3200.0, 6400.0, s.rate / 2], []
    for low, high in zip(edges, edges[1:]):
        band = np.sort(s.size[:, (s.hz >= low) & (s.hz < high)], axis=1)
        if band.shape[1]:
            k = max(1, round(0.2 * band.shape[1]))
            out.append(20 * np.log10((band[:, -k:].mean(1) + 1e-10) / (band[:, :k].mean(1) + 1e-10)).mean())
    return float(np.clip(np.mean(out) / CONTRAST_DB, 0, 1)) if out else 0.0


def pitch_track(s: Sound) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pitch in Hz, whether a frame is voiced, and how surely: the first dip of the cumulative mean difference."""
    low, high = int(s.rate / PITCH_HZ[1]), int(s.rate / PITCH_HZ[0])
    n = 2 * high
    if len(s.x) < high + 2:
        return np.empty(0), np.empty(0, bool), np.empty(0)
    x = np.pad(s.x, (0, max(0, n + high - len(s.x))))
    frames = np.lib.stride_tricks.sliding_window_view(x, n + high)[:: s.hop]
    spectrum = np.fft.rfft(frames, 2 * (n + high), axis=1)
    head = np.fft.rfft(frames[:, :n], 2 * (n + high), axis=1)
    shared = np.fft.irfft(spectrum * head.conj(), axis=1)[:, : high + 1]
    total = np.cumsum(np.pad(frames**2, ((0, 0), (1, 0))), axis=1)
    lag = np.arange(high + 1)
    gap = total[:, [n]] + (total[:, n + lag] - total[:, lag]) - 2 * shared
    mean = gap[:, 1:] * lag[1:] / np.maximum(np.cumsum(np.maximum(gap[:, 1:], 0), axis=1), 1e-12)
    mean = mean[:, low - 1 :]
    dip = (mean < 0.15) & (mean <= np.pad(mean[:, 1:], ((0, 0), (0, 1)), constant_values=np.inf))
    at = np.where(dip.any(1), dip.argmax(1), mean.argmin(1))
    sure = np.clip(1 - mean[np.arange(len(mean)), at], 0, 1)
    loud = total[:, n] > 1e-8 * n
    between = np.zeros(len(at))  # the dip is taken from a parabola through its neighbours
    inside = np.flatnonzero((at > 0) & (at < mean.shape[1] - 1))
    left, own, right = (mean[inside, at[inside] + k] for k in (-1, 0, 1))
    bend = left - 2 * own + right
    between[inside] = np.where(bend > 0, 0.5 * (left - right) / np.where(bend > 0, bend, 1), 0.0)
    return s.rate / (at + low + np.clip(between, -0.5, 0.5)), (sure > 0.85) & loud, np.where(loud, sure, 0.0)


def mel_bank(s: Sound) -> np.ndarray:
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    centres = 700 * (10 ** (np.linspace(mel(0), mel(s.rate / 2), MELS + 2) / 2595) - 1)
    up = (s.hz - centres[:-2, None]) / np.diff(centres)[:-1, None]
    down = (centres[2:, None] - s.hz) / np.diff(centres)[1:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (centres[2:] - centres[:-2]))[:, None]


def cepstrum(s: Sound) -> np.ndarray:
    level = 10 * np.log10(np.maximum(s.power @ mel_bank(s).T, 1e-10))
    level = np.maximum(level, level.max() - 80)
    k, m = np.arange(MFCCS)[:, None], np.arange(MELS)
    basis = np.sqrt(2 / MELS) * np.cos(np.pi * k * (m + 0.5) / MELS)
    basis[0] /= np.sqrt(2)
    return level @ basis.T


def deltas(c: np.ndarray) -> np.ndarray:
    """Local slope over an odd number of frames, 9 at most; none for under 3 frames."""
    width = min(9, len(c) - (len(c) + 1) % 2)
    if width < 3:
        return np.zeros(c.shape[1])
    half = width // 2
    k = np.arange(-half, half + 1)
    padded = np.pad(c, ((half, half), (0, 0)), mode="edge")
    return (np.lib.stride_tricks.sliding_window_view(padded, width, axis=0) @ k / (k**2).sum()).mean(0)


def timbre(s: Sound) -> dict:
    c = cepstrum(s)
    w = np.exp(-np.arange(len(c)) * s.seconds * 1000 / ONSET_MS)
    return {"mfcc": c.mean(0).tolist(), "mfcc_delta": deltas(c).tolist(), "mfcc_onset": (w @ c / w.sum()).tolist()}


def band_energy(s: Sound) -> dict:
    shares, decays, total = [], [], s.power.sum()
    for low, high in BANDS:
        own = s.power[:, (s.hz >= low) & (s.hz < min(high, s.rate / 2))].sum(1)
        rms = np.sqrt(own)
        shares.append(float(np.clip(own.sum() / total, 0, 1)) if total > 1e-20 else 0.0)
        if not len(rms) or rms.max() < 1e-9:
            decays.append(0.0)
            continue
        tail = rms[int(rms.argmax()) :]
        below = np.flatnonzero(tail < ACTIVE * rms.max())
        decays.append(log_share((below[0] if len(below) else len(tail)) * s.seconds, *TIME))
    return {"energy_fractions": shares, "decay_rates": decays}


def peaks(curve: np.ndarray, least: float) -> np.ndarray:
    if len(curve) < 3:
        return np.empty(0, int)
    return np.flatnonzero((curve[1:-1] > curve[:-2]) & (curve[1:-1] >= curve[2:]) & (curve[1:-1] >= least)) + 1


def attack_of(x: np.ndarray, rate: int, onset: float, before: float | None, hop: int) -> float:
    """Where the sound of an onset begins: the level's climb over a fifth of its way out of the valley before.

    It is looked for from the middle between the onsets, 50 ms before at most, to a hop after the onset, as the peak of
    the level may follow it; it is never after the onset.
    """
    at = int(onset * rate)
    first = max(0, at - int(0.05 * rate), (int(before * rate) + at) // 2 if before is not None else 0)
    last = min(len(x), at + hop)
    if last <= first + 1 or len(x) < 32:
        return onset
    part = np.abs(x[first : last + 31])
    smooth = np.zeros(last - first)  # frames without 32 after them have no level
    whole = np.convolve(part, np.ones(32) / 32, "valid") if len(part) >= 32 else smooth[:0]
    smooth[: len(whole)] = whole[: len(smooth)]
    valley = int(smooth[: max(1, int(0.6 * len(smooth)))].argmin())
    if smooth.max() <= smooth[valley]:
        return onset
    over = np.flatnonzero(smooth[valley:] >= smooth[valley] + 0.2 * (smooth.max() - smooth[valley]))
    return min(first + valley + (int(over[0]) if len(over) else len(smooth)), at) / rate


def rhythm(s: Sound, tempo_range: tuple[float, float] = (30.0, 300.0)) -> dict:
    out: dict = {"tempo_bpm": 0.0, "beat_times": [], "pulse_peak_times": [], "onset_times": [], "attack_times": [], "pulse_curve": [], "onset_count": 0}
    if len(s.x) < 2 * s.n or s.x.std() < 1e-9:
        return out
    curve, late = s.flux(), s.n // (2 * s.hop)
    onsets = peaks(curve, curve.mean() + curve.std())
    seconds = lambda at: np.minimum((np.asarray(at) + late) * s.seconds, len(s.x) / s.rate).tolist()
    # A frame's middle is its time, and its level rises as soon as a sound enters it, half a frame before.
    times = seconds(onsets)
    attacks = [attack_of(s.x, s.rate, t, times[i - 1] if i else None, s.hop) for i, t in enumerate(times)]
    out |= {"onset_times": times, "attack_times": attacks, "onset_count": len(times)}
    low, high = int(60 / tempo_range[1] / s.seconds), int(60 / tempo_range[0] / s.seconds)
    centred = curve - curve.mean()
    auto = np.convolve(np.correlate(centred, centred, "full")[len(curve) - 1 :], [0.25, 0.5, 0.25], "same")
    if len(auto) > low + 2 and len(times) > 1:
        lags = np.arange(max(low, 1), min(high, len(auto) - 1))
        prior = np.exp(-0.5 * np.log2(60 / (lags * s.seconds) / 120) ** 2)
        lag = int(lags[(auto[lags] * prior).argmax()])
        before, top, after = auto[lag - 1 : lag + 2]
        bend = before - 2 * top + after
        lag = lag + (0.5 * (before - after) / bend if bend < 0 else 0.0)  # between frames, on the parabola through three
        pulse = np.maximum(0, np.cos(2 * np.pi * (np.arange(len(curve)) - onsets[0]) / lag)) * (curve.max() > 0)
        out |= {"tempo_bpm": 60 / (lag * s.seconds), "beat_times": seconds(np.arange(onsets[0], len(curve) - late, lag)), "pulse_curve": pulse.astype(np.float32).tolist(), "pulse_peak_times": seconds(peaks(pulse, 0.5))}
    return out


def analyse(x: np.ndarray, rate: int) -> dict:
    """All feature structs of a mono sound; zeros for an empty one."""
    s = Sound(x if len(x) else np.zeros(2), rate)
    nyquist = rate / 2
    total = s.size.sum(1)
    loud = total > 1e-9
    centroid = (s.size @ s.hz / np.maximum(total, 1e-12))[loud]
    spread = np.sqrt((s.size * (s.hz - (s.size @ s.hz / np.maximum(total, 1e-12))[:, None]) ** 2).sum(1) / np.maximum(total, 1e-12))[loud]
    safe = np.maximum(s.power, 1e-10)
    flat = np.exp(np.log(safe).mean(1)) / safe.mean(1)
    upto = np.cumsum(s.power, axis=1)
    rolloff = s.hz[(upto >= 0.85 * upto[:, -1:]).argmax(1)]
    mean = lambda v: float(np.mean(v)) if len(v) else 0.0
    h, _ = dsp.split(s.x) if len(s.x) >= 64 else (s.x, None)
    energy = float((s.x**2).sum())
    ratio = min(1.0, float((h**2).sum()) / energy) if energy > 1e-12 else 0.0
    hz, voiced, sure = pitch_track(s)
    flux = s.flux()
    top = flux.max() if len(flux) else 0.0
    rise = (int(flux.argmax()) - int(np.flatnonzero(flux >= ACTIVE * top)[0])) * s.seconds if top > 0 else 0.0
    attack, release = attack_release(s)
    chroma = np.zeros(12)
    audible = s.hz >= 27.5
    if audible.any():
        np.add.at(chroma, np.round(12 * np.log2(s.hz[audible] / 440) + 69).astype(int) % 12, s.power[:, audible].mean(0))
    chroma = chroma / chroma.max() if chroma.max() > 0 else chroma
    found = hz[voiced]
    signs = np.signbit(s.x)
    return {
        "spectral": {
            "spectral_flatness": log_share(mean(flat), *FLATNESS) if loud.any() else 0.0, "attack": attack, "release": release, "spectral_centroid": log_share(mean(centroid), LOWEST_HZ, nyquist), "spectral_bandwidth": log_share(mean(spread), LOWEST_HZ, nyquist),
            "zcr": min(1.0, mean(signs[1:] != signs[:-1]) / FLATTEST_ZCR), "harmonic_ratio": ratio, "spectral_contrast": contrast(s), "voiced_fraction": float(voiced.mean()) if len(voiced) else 0.0, "log_attack_time": log_share(rise, *TIME),
            "spectral_flux": log_share(mean(flux), *FLUX), "spectral_rolloff": log_share(mean(rolloff), LOWEST_HZ, nyquist), "spectral_slope": slope(s),
        },
        "rhythm": rhythm(s),
        "pitch": {
            "dominant_pitch_hz": float(np.median(found)) if len(found) else 0.0, "pitch_confidence": mean(sure), "pitch_stability": float(np.std(12 * np.log2(found / np.median(found)))) if len(found) else 0.0, "chroma_profile": chroma.tolist(),
            "dominant_pitch_class": int(chroma.argmax()) if chroma.any() else -1, "voiced_frame_count": int(voiced.sum()),
        },
        "timbre": timbre(s), "level": dsp.level(s.x[:, None], s.n), "band_energy": band_energy(s),
    }


def envelopes(x: np.ndarray, rate: int, bins: int = 400) -> dict:
    """A sound's outline for previews: least and greatest value of each of bins runs as int8, and four bands' levels."""
    q = lambda v: np.clip(np.rint(np.asarray(v) * 127), -127, 127).astype(np.int8)
    parts = np.array_split(x, bins) if len(x) else []
    s = Sound(x if len(x) else np.zeros(2), rate)
    bands, totals = [], []
    for low, high in BANDS:
        own = np.sqrt(s.power[:, (s.hz >= low) & (s.hz < high)].sum(1))
        totals.append(float(own.sum()))
        own = own / own.max() if own.max() > 0 else own
        bands.append(q(np.interp(np.linspace(0, 1, bins), np.linspace(0, 1, len(own)), own)))
    return {"low": q([p.min() if len(p) else 0 for p in parts]), "high": q([p.max() if len(p) else 0 for p in parts]), "bands": bands, "totals": totals}


def heights(totals: list[float], pixels: int, least: int = 16) -> list[int]:
    """Pixels of each band by its share, least at the least, which add up exactly: differences of rounded sums. Equal
    ones, the first a pixel more, where the least don't fit or nothing sounds."""
    n, whole = len(totals), sum(totals)
    spare = pixels - least * n
    if spare < 0 or whole <= 0:
        return [pixels // n + (i < pixels % n) for i in range(n)]
    ends = [least * (i + 1) + round(spare * sum(t / whole for t in totals[: i + 1])) for i in range(n - 1)]
    return [b - a for a, b in zip([0, *ends], [*ends, pixels])]


def svg(x: np.ndarray, rate: int, onsets: list[float] = (), beats: list[float] = (), label: str = "", width: int = 1024, height: int = 256) -> str:
    """A preview as text: band levels, the outline, ticks at onsets, lines at beats, and a label."""
    e = envelopes(x, rate, 400)
    seconds, mid = max(len(x) / rate, 1e-9), height / 2
    points = [(i * width / 400, mid - v / 127 * mid) for i, v in enumerate(e["high"].tolist())] + [(i * width / 400, mid - v / 127 * mid) for i, v in reversed(list(enumerate(e["low"].tolist())))]
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width} {height}">']
    base = height
    for h, band in zip(heights(e["totals"], height), e["bands"], strict=True):
        line = " ".join(f"{i * width / 400:.1f},{base - v / 127 * h:.1f}" for i, v in enumerate(band.tolist()))
        out.append(f'<polyline fill="none" stroke="#888" points="{line}"/>')
        base -= h
    out.append('<polygon fill="#48c" points="' + " ".join(f"{a:.1f},{b:.1f}" for a, b in points) + '"/>')
    out += [f'<line stroke="{c}" x1="{t / seconds * width:.1f}" x2="{t / seconds * width:.1f}" y1="{y}" y2="{height}"/>' for c, ts, y in (("#c44", onsets, height - 16), ("#ccc", beats, 0)) for t in ts]
    text = label.replace("&", "&amp;").replace("<", "&lt;")
    return "".join([*out, f'<text x="8" y="20">{text}</text>' if label else "", "</svg>"])


def analyse_sounds(sounds: DataFrame) -> DataFrame:
    """(path, audio_md5, sample_rate, bit_depth, channels, duration and the feature structs) of sounds as read_wavs gives
    them. One task holds a batch of sounds; nothing is shuffled."""
    from sonoframe.sources.audio import frames_of, to_mono
    from sonoframe.sources.sidecars import BLOCKS

    blocks = ["spectral", "rhythm", "pitch", "timbre", "level", "band_energy"]
    schema = "path string, audio_md5 string, analysis_version string, sample_rate int, bit_depth int, channels int, duration double, " + ", ".join(f"{b} struct<{BLOCKS[b]}>" for b in blocks)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                x = to_mono(frames_of(r.pcm, r.bit_depth, r.channels))
                a = analyse(x, r.sample_rate)
                rows.append((r.path, r.md5, VERSION, r.sample_rate, r.bit_depth, r.channels, len(x) / r.sample_rate, *(a[b] for b in blocks)))
            yield pd.DataFrame(rows, columns=["path", "audio_md5", "analysis_version", "sample_rate", "bit_depth", "channels", "duration", *blocks])

    return sounds.mapInPandas(run, schema)
