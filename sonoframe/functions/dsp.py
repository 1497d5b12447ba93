"""Processors for sounds (frames x channels, float) in numpy, and the chain that applies them.

Each takes (x, rate, params) and returns the sound. Parameters that are None are worked out from the sound's analysis.
Pitch shifting and stretching are a phase vocoder of our own and sound unlike other stretchers; the harmonic and
percussive split takes medians of a spectrogram. Neither claims to equal another library's samples.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

EPS = 1e-10


def db(x: float) -> float:
    return float(10 ** (x / 20))


def clamp(x: float, low: float = 0.0, high: float = 1.0) -> float:
    return min(max(x, low), high)


# ---------------------------------------------------------------- filters


def sections(kind: str, hz: float | tuple[float, float], rate: int, order: int = 2, ripple: float = 0.0) -> list[np.ndarray]:
    """Second-order sections (b0 b1 b2 a1 a2) of a Butterworth, or with ripple a Chebyshev, filter by the bilinear map."""
    k = np.arange(1, order + 1)
    theta = np.pi * (2 * k - 1) / (2 * order)
    if ripple > 0:
        eps = np.sqrt(10 ** (ripple / 10) - 1)
        mu = np.arcsinh(1 / eps) / order
        poles = -np.sinh(mu) * np.sin(theta) + 1j * np.cosh(mu) * np.cos(theta)
        gain = np.prod(-poles).real / (np.sqrt(1 + eps**2) if order % 2 == 0 else 1)
    else:
        poles, gain = -np.sin(theta) + 1j * np.cos(theta), 1.0
    warp = lambda f: 2 * rate * np.tan(np.pi * clamp(f, 1.0, 0.499 * rate) / rate)
    if kind == "low":
        w = warp(hz)
        poles, zeros, gain = poles * w, np.empty(0), gain * w**order
    elif kind == "high":
        w = warp(hz)
        gain = gain / np.prod(-poles).real
        poles, zeros = w / poles, np.zeros(order)
    else:
        low, high = warp(hz[0]), warp(hz[1])
        width, centre = high - low, np.sqrt(low * high)
        half = poles * width / 2
        root = np.sqrt(half**2 - centre**2)
        poles, zeros, gain = np.concatenate([half + root, half - root]), np.zeros(order), gain * width**order
    fs = 2 * rate
    gain = gain * np.prod(fs - zeros).real / np.prod(fs - poles).real
    zd = np.concatenate([(fs + zeros) / (fs - zeros), -np.ones(len(poles) - len(zeros))])
    pd_ = (fs + poles) / (fs - poles)
    upper = pd_[pd_.imag > 1e-12]
    real = np.sort(pd_[np.abs(pd_.imag) <= 1e-12].real)
    pairs = [np.array([p, p.conj()]) for p in upper] + [real[i : i + 2] for i in range(0, len(real), 2)]
    zd = list(np.sort(zd.real))
    out = []
    for i, p in enumerate(pairs):
        z = [zd.pop(0), zd.pop()] if len(p) == 2 and len(zd) > 1 else [zd.pop()] if zd else []
        b = np.poly(z) * (gain if i == 0 else 1)
        a = np.poly(p).real
        out.append(np.concatenate([np.pad(b, (0, 3 - len(b))), np.pad(a[1:], (0, 3 - len(a)))]))
    return out


def biquad(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """One section over frames x channels; a loop over blocks with the recursion solved inside each by its impulse."""
    b0, b1, b2, a1, a2 = c
    y = np.empty_like(x, dtype=np.float64)
    x1 = x2 = y1 = y2 = np.zeros(x.shape[1])
    n = min(256, max(len(x), 1))
    impulse = np.zeros(n)
    s1 = s2 = 0.0
    for i in range(n):
        impulse[i] = (1.0 if i == 0 else 0.0) - a1 * s1 - a2 * s2
        s1, s2 = impulse[i], s1
    toeplitz = np.tril(impulse[np.clip(np.arange(n)[:, None] - np.arange(n), 0, None)])
    for at in range(0, len(x), n):
        own = x[at : at + n].astype(np.float64)
        m = len(own)
        one = np.vstack([x1[None], own[:-1]]) if m else own
        two = np.vstack([x2[None], x1[None], own[:-2]])[:m]
        drive = b0 * own + b1 * one + b2 * two
        drive[0] -= a1 * y1 + a2 * y2
        if m > 1:
            drive[1] -= a2 * y1
        out = toeplitz[:m, :m] @ drive
        y[at : at + m] = out
        x1, x2 = own[-1], (own[-2] if m > 1 else x1)
        y1, y2 = out[-1], (out[-2] if m > 1 else y1)
    return y


def sos(x: np.ndarray, cs: list[np.ndarray]) -> np.ndarray:
    for c in cs:
        x = biquad(x, c)
    return x


def high_shelf(hz: float, gain_db: float, rate: int) -> np.ndarray:
    """The shelf of the audio EQ cookbook with slope 1."""
    a, w = 10 ** (gain_db / 40), 2 * np.pi * hz / rate
    cos, alpha = np.cos(w), np.sin(w) / np.sqrt(2)
    root = 2 * np.sqrt(a) * alpha
    a0 = (a + 1) - (a - 1) * cos + root
    b = a * np.array([(a + 1) + (a - 1) * cos + root, -2 * ((a - 1) + (a + 1) * cos), (a + 1) + (a - 1) * cos - root])
    return np.concatenate([b, [2 * ((a - 1) - (a + 1) * cos), (a + 1) - (a - 1) * cos - root]]) / a0


def filter_low(x, rate, freq=16000.0, resonance=0.0, **_):
    return sos(x, sections("low", freq, rate, 2, clamp(resonance, 0, 24)))


def filter_high(x, rate, freq=80.0, resonance=0.0, **_):
    return sos(x, sections("high", freq, rate, 2, clamp(resonance, 0, 24)))


def filter_band(x, rate, freq=1000.0, q=0.7, resonance=0.0, **_):
    half = freq / (2 * clamp(q, 0.1, 20))
    edge = np.sqrt(freq**2 + half**2)
    return sos(x, sections("band", (edge - half, edge + half), rate, 2, clamp(resonance, 0, 24)))


# ---------------------------------------------------------------- levels and dynamics


def level(x: np.ndarray, frame: int = 2048) -> dict[str, float]:
    """Peak, RMS, crest factor (also in dB), and noise floor, the 5th percentile of frame RMS."""
    if not len(x):
        return dict.fromkeys(("peak", "rms", "crest_factor", "crest_factor_db", "noise_floor"), 0.0)
    peak, rms = float(np.abs(x).max()), float(np.sqrt(np.mean(x.astype(np.float64) ** 2)))
    whole = x[: len(x) // frame * frame] if len(x) >= frame else x
    parts = whole.reshape(-1, min(frame, len(x)), x.shape[1])
    floor = float(np.percentile(np.sqrt((parts.astype(np.float64) ** 2).mean((1, 2))), 5))
    crest = peak / rms if rms > EPS else 0.0
    return {"peak": peak, "rms": rms, "crest_factor": crest, "crest_factor_db": 20 * np.log10(crest) if crest > EPS else 0.0, "noise_floor": floor}


def one_pole(target: np.ndarray, rate: int, attack_ms: float, release_ms: float, now: float = 0.0) -> np.ndarray:
    """Follows target, at the attack's pace downwards (more reduction) and at the release's upwards."""
    coef = lambda ms: float(np.exp(-1 / max(rate * ms / 1000, 1e-9)))
    fast, slow = coef(attack_ms), coef(release_ms)
    out = np.empty_like(target)
    for i, t in enumerate(target.tolist()):
        c = fast if t < now else slow
        now = t + c * (now - t)
        out[i] = now
    return out


def ahead(envelope: np.ndarray, rate: int, ms: float) -> np.ndarray:
    n = int(rate * ms / 1000)
    return np.concatenate([envelope[n:], np.full(min(n, len(envelope)), envelope[-1] if len(envelope) else 0.0)]) if n else envelope


def squeeze(x, rate, threshold, ratio, attack, release, knee, makeup, lookahead):
    """Linked compression: loudest channel, quadratic knee, smoothed in dB."""
    over = 20 * np.log10(np.maximum(np.abs(x).max(1), EPS)) - threshold
    bend = (over + knee / 2) ** 2 / (2 * max(knee, EPS))
    past = np.where(over <= -knee / 2, 0.0, np.where(over < knee / 2, bend, over))
    gain = one_pole(ahead(-(1 - 1 / ratio) * past, rate, lookahead), rate, attack, release)
    return x * (10 ** ((gain + makeup) / 20))[:, None]


def compress(x, rate, threshold=None, ratio=4.0, attack=None, release=None, knee=6.0, makeup=0.0, lookahead=0.0, analysis=None, **_):
    """From 6 dB below the recorded peak; a percussive sound (spectral attack 0) gets the slowest attack."""
    a = analysis or {}
    peak = 20 * np.log10(a.get("peak", level(x)["peak"]) + EPS)
    return squeeze(x, rate, peak - 6 if threshold is None else threshold, max(ratio, 1.0), 1 + 29 * (1 - a.get("attack", 0.0)) if attack is None else attack, 30 + 270 * a.get("release", 0.0) if release is None else release, knee, makeup, lookahead)


def limit(x, rate, threshold=-1.0, release=50.0, lookahead=5.0, **_):
    return squeeze(x, rate, threshold, 100.0, 0.01, release, 0.0, 0.0, lookahead)


def gate(x, rate, threshold=None, attack=None, release=None, hold=None, lookahead=None, analysis=None, **_):
    """Open at the threshold and for the hold after it. A percussive sound (spectral attack 0) opens slowest, as the
    behaviour that this follows has it."""
    a = analysis or {}
    on, off = a.get("attack", 0.0), a.get("release", 0.0)
    floor = 20 * np.log10(a.get("noise_floor", level(x)["noise_floor"]) + EPS)
    threshold = floor + 6 if threshold is None else threshold
    attack, release = 5 - 4 * on if attack is None else attack, 20 + 80 * off if release is None else release
    hold, lookahead = 10 + 40 * off if hold is None else hold, 3 * (1 - on) if lookahead is None else lookahead
    loud = 20 * np.log10(np.abs(x).max(1) + EPS) >= threshold
    last = np.maximum.accumulate(np.where(loud, np.arange(len(x)), -(1 << 40)))
    wanted = (np.arange(len(x)) - last <= int(rate * hold / 1000)).astype(np.float64)
    gain = 1 + one_pole(wanted - 1, rate, release, attack, wanted[0] - 1 if len(wanted) else 0.0)
    late = min(int(rate * lookahead / 1000), len(x))
    return np.concatenate([np.zeros((late, x.shape[1])), x[: len(x) - late]]) * gain[:, None]


def saturate(x, rate, drive=6.0, **_):
    d = db(drive)
    return x if drive <= 0 else np.tanh(x * d) / np.tanh(d)


def reverse(x, rate, **_):
    return x[::-1]


def peak_of(x: np.ndarray) -> float:
    return float(np.abs(x).max()) if x.size else 0.0


def at_peak(x: np.ndarray, peak: float) -> np.ndarray:
    """x at the peak, if it has one."""
    own = peak_of(x)
    return x * (peak / own) if own > EPS else x


def crest_share(x: np.ndarray, analysis: dict | None) -> float:
    """Where the crest factor lies between 3 and 20 dB, as 0 to 1."""
    db_ = (analysis or {}).get("crest_factor_db")
    return clamp(((level(x)["crest_factor_db"] if db_ is None else db_) - 3) / 17)


def distort(x, rate, mode="hard_clip", drive=None, tone=None, mix=1.0, bits=8, factor=4, analysis=None, **_):
    """Driven, bent by the mode and brought back to its peak; then a low-pass at tone of half the rate, then the mix."""
    peak = peak_of(x)
    if peak < EPS:
        return x
    drive = 12 - 9 * crest_share(x, analysis) if drive is None else drive
    tone = 1 - 0.7 * (analysis or {}).get("spectral_rolloff", 0.0) if tone is None else tone
    wet = x * db(drive)
    if mode == "hard_clip":
        wet = np.clip(wet, -1, 1)
    elif mode == "fold":
        wet = np.abs(np.mod(wet + 1, 4) - 2) - 1
    elif mode == "bit_crush":
        steps = 2 ** int(clamp(bits, 1, 16))
        wet = np.rint(wet * steps) / steps
    elif mode == "downsample":
        n = int(clamp(factor, 2, 64))
        wet = np.repeat(wet[::n], n, axis=0)[: len(x)]
    else:
        raise ValueError(f"distort has no mode {mode!r}")
    wet = at_peak(wet, peak)
    if tone < 0.99:
        wet = sos(wet, sections("low", max(200.0, tone * rate / 2), rate))
    return mix * wet + (1 - mix) * x if mix < 1 else wet


def reshape(x, rate, attack=None, hold=0.0, decay=None, sustain=1.0, release=None, analysis=None, attacks=None, **_):
    """An envelope over the sound, in milliseconds, from its first attack, else its first frame over a tenth of the peak.

    Without attack the sound's own is kept up to its peak, without decay its own decay.
    """
    n, peak = len(x), peak_of(x)
    if release == 0 and attack is None and not hold and decay is None and sustain >= 1 or peak < EPS:
        return x
    frames = lambda ms: max(1, int(ms * rate / 1000))
    size = np.abs(x).max(1)
    start = int(attacks[0] * rate) if attacks else int(np.argmax(size > 0.1 * peak))
    start = int(clamp(start, 0, n - 1))
    gain, at = np.ones(n), max(start, int(size.argmax()))
    if attack is not None:
        at = min(start + frames(attack), n)
        gain[:start] = 0
        gain[start:at] = np.linspace(0, 1, at - start)
    at = min(at + int(hold * rate / 1000), n)
    if decay is not None:
        end = min(at + frames(decay), n)
        gain[at:end] = np.linspace(1, sustain, end - at)
        at = end
    release = 30 + 170 * (analysis or {}).get("release", 0.0) if release is None else release
    tail = max(at, n - frames(release))
    if decay is not None or sustain < 1:
        gain[at:tail] = sustain
    if tail < n:
        gain[tail:] = np.linspace(gain[tail], 0, n - tail)
    return x * gain[:, None]


# ---------------------------------------------------------------- spectra


def stft(x: np.ndarray, n: int = 2048, hop: int | None = None) -> np.ndarray:
    hop = hop or n // 4
    padded = np.pad(x, (n // 2, n // 2 + n))
    at = np.arange(0, len(x) + n // 2, hop)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    return np.fft.rfft(padded[at[:, None] + np.arange(n)] * window, axis=1)


def istft(spectrum: np.ndarray, length: int, n: int = 2048, hop: int | None = None) -> np.ndarray:
    hop = hop or n // 4
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    out = np.zeros(n + hop * (len(spectrum) - 1) + n)
    norm = np.zeros_like(out)
    for i, frame in enumerate(np.fft.irfft(spectrum, n, axis=1)):
        out[i * hop : i * hop + n] += frame * window
        norm[i * hop : i * hop + n] += window**2
    out = out / np.maximum(norm, 1e-8)
    return out[n // 2 : n // 2 + length]


def median(x: np.ndarray, width: int, axis: int) -> np.ndarray:
    pad = [(0, 0)] * x.ndim
    pad[axis] = (width // 2, width // 2)
    return np.median(np.lib.stride_tricks.sliding_window_view(np.pad(x, pad, mode="reflect" if x.shape[axis] > width // 2 else "edge"), width, axis), axis=-1)


def split(x: np.ndarray, width: int = 31) -> tuple[np.ndarray, np.ndarray]:
    """Harmonic and percussive parts of one channel: soft masks from medians along time and along frequency."""
    s = stft(x)
    power = np.abs(s)
    h, p = median(power, width, 0) ** 2, median(power, width, 1) ** 2
    mask = h / np.maximum(h + p, 1e-20)
    return istft(s * mask, len(x)), istft(s * (1 - mask), len(x))


def hpss(x, rate, keep="harmonic", **_):
    if keep not in ("harmonic", "percussive"):
        raise ValueError(f"hpss keeps harmonic or percussive, not {keep!r}")
    return np.stack([split(c)[keep == "percussive"] for c in x.T], axis=1)


def transient(x, rate, gain=None, analysis=None, **_):
    """The percussive part louder or softer, at the peak that there was."""
    gain = 4 - 8 * crest_share(x, analysis) if gain is None else gain
    peak = peak_of(x)
    if abs(gain) < 0.1 or peak < EPS:
        return x
    parts = [split(c) for c in x.T]
    return at_peak(np.stack([h + p * db(gain) for h, p in parts], axis=1), peak)


def stretch(x: np.ndarray, ratio: float, n: int = 2048) -> np.ndarray:
    """One channel at ratio times its length, by a phase vocoder."""
    hop = n // 4
    s = stft(x, n)
    at = np.arange(0, len(s) - 1, 1 / ratio)
    if len(s) < 2 or not len(at):
        return x
    advance = 2 * np.pi * hop * np.arange(s.shape[1]) / n
    left = np.floor(at).astype(int)
    part = (at - left)[:, None]
    size = (1 - part) * np.abs(s[left]) + part * np.abs(s[left + 1])
    turn = np.angle(s[left + 1]) - np.angle(s[left]) - advance
    turn = advance + turn - 2 * np.pi * np.round(turn / (2 * np.pi))
    phase = np.angle(s[0]) + np.vstack([np.zeros(s.shape[1]), np.cumsum(turn[:-1], axis=0)])
    return istft(size * np.exp(1j * phase), max(1, round(len(x) * ratio)), n)


def repitch(x, rate, note=60, hz=None, **_):
    """Shift so that a sound of hz sounds at the MIDI note: stretch, then resample to the old length."""
    from sonoframe.sources.audio import resample

    if not hz or hz <= 0:
        raise ValueError("repitch needs a sound with a pitch")
    semitones = note - (69 + 12 * np.log2(hz / 440))
    factor = 2 ** (semitones / 12)
    long = np.stack([stretch(c, factor) for c in x.T], axis=1)
    out = resample(long, round(rate * factor), rate)
    return np.pad(out, ((0, max(0, len(x) - len(out))), (0, 0)))[: len(x)]


#: Seconds kept before the first attack, and of the fades where a sound is cut.
BEFORE_ATTACK, FADE = 0.002, 0.001


def ramp(n: int) -> np.ndarray:
    """Half a cosine from 0 to 1, both ends included, for frames x channels."""
    return ((1 - np.cos(np.linspace(0, np.pi, n))) / 2)[:, None]


def faded(x: np.ndarray, head: int, tail: int) -> np.ndarray:
    x = np.array(x, np.float64)
    if head > 1:
        x[:head] *= ramp(head)
    if tail > 1:
        x[-tail:] *= ramp(tail)[::-1]
    return x


def grid_step(tempo: float, resolution: int) -> float:
    return 60 / tempo / (resolution / 4)


def from_first_attack(x: np.ndarray, rate: int, attacks: list[float]) -> tuple[np.ndarray, list[float]]:
    """The sound from just before its first attack, faded in, and the attacks in it."""
    lead = max(0.0, attacks[0] - BEFORE_ATTACK)
    x = x[int(lead * rate) :]
    fade = int(FADE * rate)
    return faded(x, fade if len(x) > fade else 0, 0), [t - lead for t in attacks]


def snapped(attacks: list[float], step: float, strength: float = 1.0) -> list[float]:
    """Each attack, from the left, at its nearest grid point (ties: the earlier) after the last one's, or a share of its
    way there."""
    out, at = [], -1
    for t in attacks:
        at = max(int(np.ceil(t / step - 0.5)), at + 1)
        out.append(t + strength * (at * step - t))
    return out


def attacks_of(attacks, onsets) -> list[float]:
    return list(attacks if attacks is not None and len(attacks) else onsets if onsets is not None else ())


def stretch_quantize(x, rate, tempo=120.0, grid=16, strength=1.0, attacks=None, onsets=None, bpm=0.0, marks=None, **_):
    """Stretch each stretch between attacks so that these fall on the grid, and what follows the last by the tempi; with
    under two attacks the whole by the tempi. A sound without a tempo stays as it is. marks gets the segments."""
    if bpm <= 0 or tempo <= 0:
        return x
    attacks = attacks_of(attacks, onsets)
    if len(attacks) < 2:
        return np.stack([stretch(c, bpm / tempo) for c in x.T], axis=1)
    x, own = from_first_attack(x, rate, attacks)
    goals = snapped(own, grid_step(tempo, grid), strength)
    to = [int(t * rate) for t in goals]
    total = max(int((goals[-1] + max(0.0, len(x) / rate - own[-1]) * bpm / tempo) * rate), to[-1] + 1)
    cuts, ends = [0], [0]
    for a, b in zip((int(t * rate) for t in own), to, strict=True):
        if cuts[-1] < a < len(x) and ends[-1] < b < total:
            cuts.append(a)
            ends.append(b)
    cuts, ends = [*cuts, len(x)], [*ends, total]
    parts = []
    for a, b, c, d in zip(cuts, cuts[1:], ends, ends[1:]):
        piece = np.stack([stretch(ch, (d - c) / (b - a)) for ch in x[a:b].T], axis=1) if b > a else x[a:b]
        parts.append(np.pad(piece, ((0, max(0, d - c - len(piece))), (0, 0)))[: d - c])
    if marks is not None:
        marks["bounds"] = list(zip(to, [*to[1:], total], strict=True))
    return np.concatenate(parts)


def pad_quantize(x, rate, tempo=120.0, grid=16, strength=1.0, attacks=None, onsets=None, marks=None, **_):
    """Move the segments that start at the attacks to the grid, faded, with silence between; none is cut short, so one
    that would begin before the last has ended goes to the next grid point after it. Sounds of under two attacks stay as
    they are. marks gets the segments."""
    attacks = attacks_of(attacks, onsets)
    if strength <= 0 or len(attacks) < 2:
        return x
    x, own = from_first_attack(x, rate, attacks)
    step = grid_step(tempo, grid)
    starts = [int(t * rate) for t in own]
    goals = [int(t * rate) for t in snapped(own, step, strength)]
    step, fade = int(step * rate), int(FADE * rate)
    bounds, end = [], 0
    for i, (goal, a, b) in enumerate(zip(goals, starts, [*starts[1:], len(x)], strict=True)):
        if i and goal < end:
            goal = -(-end // step) * step if step else end
        end = goal + b - a
        bounds.append((goal, end))
    out = np.zeros((end, x.shape[1]))
    for i, ((goal, stop), a) in enumerate(zip(bounds, starts, strict=True)):
        n = min(fade, (stop - goal) // 2)
        out[goal:stop] = faded(x[a : a + stop - goal], n if i else 0, n if i + 1 < len(bounds) else 0)
    if marks is not None:
        marks["bounds"] = [b for b in bounds if b[1] > b[0]]
    return out


def grid_energy(x: np.ndarray, rate: int, tempo: float, grid: int) -> list[float]:
    """The root mean square of each whole grid slot, the loudest 1; a sound shorter than one is one slot."""
    mono, n = x.mean(1) if x.size else np.zeros(1), max(1, int(grid_step(tempo, grid) * rate))
    slots = max(1, len(mono) // n)
    rms = np.array([np.sqrt(np.mean(mono[i * n : (i + 1) * n] ** 2)) for i in range(slots)])
    return (rms / rms.max() if rms.max() > 0 else rms).tolist()


def envelope(x: np.ndarray, rate: int, smooth_hz: float = 50.0) -> np.ndarray:
    """Magnitude of the analytic signal, smoothed both ways so that it isn't late."""
    n = len(x)
    spectrum = np.fft.fft(x)
    weight = np.zeros(n)
    weight[0] = 1
    weight[1 : (n + 1) // 2] = 2
    if n % 2 == 0 and n:
        weight[n // 2] = 1
    size = np.abs(np.fft.ifft(spectrum * weight))[:, None]
    c = sections("low", min(smooth_hz, rate / 4), rate)
    return np.maximum(sos(sos(size, c)[::-1], c)[::-1, 0], 0)


def both_ways(x: np.ndarray, c: list[np.ndarray]) -> np.ndarray:
    """Filtered forwards and back, which delays nothing."""
    return sos(sos(x[:, None], c)[::-1], c)[::-1, 0]


def filter_bank(bands: int, rate: int, semitones: float = 0.0) -> list[list[np.ndarray]]:
    """Band-passes of order 4 with log-spaced centres from 80 Hz to 12 kHz, edges halfway between neighbours."""
    top = rate / 2 - 100
    low, high = 80.0, min(12000.0, top)
    if semitones and high > low:
        low, high = max(20.0, low * 2 ** (semitones / 12)), min(top, high * 2 ** (semitones / 12))
    if high <= low:
        return []
    centres = np.geomspace(low, high, bands)
    half = np.sqrt(centres[1] / centres[0]) if bands > 1 else 1.25
    edges = [(max(20.0, c / half), min(rate / 2 - 1, c * half)) for c in centres]
    return [sections("band", e, rate, 4) for e in edges if e[1] > e[0]]


def vocoder(x, rate, carrier=None, bands=24, depth=1.0, formant_shift=0.0, **_):
    """The carrier's bands, repeated to the sound's length, at the levels of the sound's, brought back to its peak."""
    if carrier is None:
        raise ValueError("vocoder needs a carrier")
    peak, own, theirs = peak_of(x), filter_bank(int(bands), rate), filter_bank(int(bands), rate, formant_shift)
    if peak < EPS or not own or not theirs:
        return x
    carrier = np.resize(carrier, len(x))
    out = np.zeros(x.shape)
    for mine, other in zip(own, theirs):
        band = both_ways(carrier, other)
        for ch in range(x.shape[1]):
            out[:, ch] += band * envelope(both_ways(x[:, ch], mine), rate)
    return depth * at_peak(out, peak) + (1 - depth) * x


PROCESSORS: dict[str, Callable[..., np.ndarray]] = {f.__name__: f for f in (filter_low, filter_high, filter_band, reverse, saturate, compress, limit, hpss, gate, distort, reshape, transient, repitch, stretch_quantize, pad_quantize, vocoder)}


def register_processor(name: str, run: Callable[..., np.ndarray]) -> None:
    """Add a processor (x, rate, **parameters and what is known) that specs may then name."""
    from sonoframe.plans.spec import PROCESSORS as NAMES
    from sonoframe.plans.spec import USER_PROCESSORS

    if name in NAMES or name in USER_PROCESSORS:
        raise ValueError(f"there is a processor {name!r}")
    USER_PROCESSORS.add(name)
    PROCESSORS[name] = run


def chain(x: np.ndarray, rate: int, steps: list[tuple[str, dict[str, Any]]], processors: dict[str, Callable[..., np.ndarray]] | None = None, **known: Any) -> np.ndarray:
    """The steps in order, after the peak is brought to 0.9; known (analysis, attacks, onsets, hz, bpm, marks) goes to all."""
    x = at_peak(x, 0.9)
    for name, params in steps:
        x = (processors or PROCESSORS)[name](x, rate, **(known | params))
    return x


VARIANT = "sample_id bigint, spec_hash string, duration double, level struct<peak:double,rms:double,crest_factor:double,crest_factor_db:double,noise_floor:double>, channels int, bounds array<struct<start:bigint,stop:bigint>>, bpm double, resolution int, energy array<double>, pcm binary"
#: Bytes of a carrier; more are a mistake in a spec, as a carrier is a short sound.
CARRIER_BYTES = 10 << 20


def with_carriers(requests: DataFrame, carriers: DataFrame) -> DataFrame:
    """requests whose steps name a carrier by its path, with its sound (path, sample_rate, bit_depth, channels, pcm)."""
    from pyspark.sql import functions as F

    sound = F.struct("sample_rate", "bit_depth", "channels", "pcm").alias("carrier")
    known = carriers.where(F.length("pcm") <= CARRIER_BYTES).select(F.col("path").alias("_carrier"), sound)
    return requests.withColumn("_carrier", F.regexp_extract("steps", r'"carrier":\s*"([^"]*)"', 1)).join(known, "_carrier", "left").drop("_carrier")


def derive(requests: DataFrame, carriers: DataFrame | None = None) -> DataFrame:
    """Variants of requests (sample_id, spec_hash, sample_rate, bit_depth, channels, pcm, steps as JSON): a row each.

    With spectral, rhythm, pitch and level (structs as of samples) automatic parameters come from the record, else from
    the sound itself. bounds are the segments of the last quantise step, (start, stop) in frames; energy is that of each
    slot of its grid, with bpm and resolution. Both are null without one. One request is one sound, so a task holds a
    batch of sounds at a time; nothing is shuffled but what carriers need.
    """
    import json

    from sonoframe.sources.audio import frames_of, resample, to_float, to_mono

    requests = with_carriers(requests, carriers) if carriers is not None else requests
    own = dict(PROCESSORS)  # with those that users have added, which workers wouldn't know
    field = lambda r, block, name: (getattr(r, block, None) or {}).get(name)

    def known(r) -> dict[str, Any]:
        fields = {"attack": "spectral", "release": "spectral", "spectral_rolloff": "spectral", "peak": "level", "noise_floor": "level", "crest_factor_db": "level"}
        analysis = {f: v for f, b in fields.items() if (v := field(r, b, f)) is not None}
        out = {"analysis": analysis, "attacks": attacks_of(field(r, "rhythm", "attack_times"), None), "onsets": attacks_of(field(r, "rhythm", "onset_times"), None), "bpm": field(r, "rhythm", "tempo_bpm") or 0.0, "hz": field(r, "pitch", "dominant_pitch_hz"), "marks": {}}
        c = getattr(r, "carrier", None)
        if c:
            mono = to_mono(frames_of(c["pcm"], c["bit_depth"], c["channels"])).astype(np.float64)
            out["sound"] = resample(mono[:, None], c["sample_rate"], r.sample_rate)[:, 0]
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                x = to_float(frames_of(r.pcm, r.bit_depth, r.channels)).astype(np.float64)
                k = known(r)
                sound = k.pop("sound", None)
                steps = [(n, p or {}) for n, p in (next(iter(s.items())) for s in json.loads(r.steps))]
                steps = [(n, p | {"carrier": sound} if n == "vocoder" else p) for n, p in steps]
                y = chain(x, r.sample_rate, steps, own, **k)
                grids = [p for n, p in steps if n in ("stretch_quantize", "pad_quantize")]
                tempo, grid = (float(grids[-1].get("tempo", 120.0)), int(grids[-1].get("grid", 16))) if grids else (None, None)
                bounds = k["marks"].get("bounds")
                rows.append((r.sample_id, r.spec_hash, len(y) / r.sample_rate, level(y), y.shape[1], [{"start": a, "stop": b} for a, b in bounds] if bounds else None, tempo, grid, grid_energy(y, r.sample_rate, tempo, grid) if grids else None, y.astype("<f4").tobytes()))
            yield pd.DataFrame(rows, columns=["sample_id", "spec_hash", "duration", "level", "channels", "bounds", "bpm", "resolution", "energy", "pcm"]).astype({"bpm": "Float64", "resolution": "Int32"})

    return requests.mapInPandas(run, VARIANT)
