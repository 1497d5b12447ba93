"""Scalar functions on columns; all of them compile to built-in expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NOTES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]


def log_normalize(v: Column, low: float, high: float) -> Column:
    """0 up to low, 1 from high on, the share of the log distance between; 0 everywhere if low >= high."""
    if low >= high:
        return F.lit(0.0)
    return F.when(v <= low, 0.0).when(v >= high, 1.0).otherwise(F.log(v / low) / math.log(high / low))


def analysis_window(rate: Column) -> Column:
    """n_fft: the power of two nearest to 2048 samples at 44.1 kHz; the hop is a quarter of it."""
    return F.pow(F.lit(2.0), F.bround(F.log2(rate * 2048.0 / 44100.0))).cast("int")


def decibels(x: Column, floor: float = 1e-10) -> Column:
    return 20 * F.log10(F.greatest(x, F.lit(floor)))


def linear(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20)


def controller(value: Column, low: float, high: float, initial: float | None = None) -> Column:
    """A controller's 0..127 spread over low..high; without a value the initial one, or the middle."""
    return F.coalesce(low + value / 127.0 * (high - low), F.lit((low + high) / 2 if initial is None else initial))


def note_frequency(note: Column) -> Column:
    return 440.0 * F.pow(F.lit(2.0), (note - 69) / 12.0)


def pitch_label(hz: Column, confidence: Column, pitch_class: Column, least: float = 0.4) -> Column:
    """The class's name and the octave of the note at or below hz; null below the least confidence, without a pitch or
    outside the twelve classes."""
    midi = (69 + 12 * F.log2(hz / 440.0)).cast("int")
    name = F.get(F.array(*map(F.lit, NOTES)), pitch_class)
    return F.when((confidence >= least) & (hz > 0) & pitch_class.between(0, 11), F.concat(name, (F.floor(midi / 12) - 1).cast("string")))


def accent(confidence: Column, pitch_class: Column, centroid: Column, least: float = 0.4, neutral: tuple[int, int, int] = (180, 180, 200)) -> Column:
    """A sound's colour, as (red, green, blue) of 0 to 255: its pitch class around the wheel, else its centroid from blue
    (low) to orange, else neutral."""
    own = (confidence >= least) & pitch_class.between(0, 11)
    by_level = ~own & (centroid > 0)
    hue = F.when(own, pitch_class / 12.0).otherwise(0.6 - 0.5 * F.greatest(F.least(centroid, F.lit(1.0)), F.lit(0.0)))
    strength, value = F.when(own, 0.55).otherwise(0.45), F.when(own, 0.85).otherwise(0.80)

    def part(shift: int) -> Column:
        """One of the three: the value less what the hue's distance on the wheel takes off."""
        k = F.pmod(shift + hue * 6, F.lit(6.0))
        return F.bround(255 * (value - value * strength * F.greatest(F.least(k, 4 - k, F.lit(1.0)), F.lit(0.0)))).cast("int")

    return F.array(*(F.when(own | by_level, part(shift)).otherwise(other) for shift, other in zip((5, 3, 1), neutral, strict=True)))


def rhythmic(tempo: Column, beat_times: Column) -> Column:
    """Whether a sound can be put on a grid: it has a tempo and two beats or more."""
    return (tempo > 0) & (F.size(beat_times) >= 2)


def stratum_heights(totals: Column, pixels: int, least: int = 16) -> Column:
    """functions.analysis.heights on an array of totals: pixels of each band by its share, which add up exactly."""
    n, whole = F.size(totals), F.aggregate(totals, F.lit(0.0), lambda a, t: a + t)
    spare = pixels - least * n

    def end(i: Column) -> Column:
        share = F.aggregate(F.slice(totals, 1, i + 1), F.lit(0.0), lambda a, t: a + t / whole)
        return F.when(i == n - 1, F.lit(pixels)).otherwise(least * (i + 1) + F.bround(spare * share)).cast("int")

    equal = F.transform(totals, lambda _, i: (F.floor(F.lit(pixels) / n) + F.when(i < F.lit(pixels) % n, 1).otherwise(0)).cast("int"))
    by_share = F.transform(totals, lambda _, i: end(i) - F.when(i > 0, end(i - 1)).otherwise(0))
    return F.when((spare < 0) | (whole <= 0), equal).otherwise(by_share)


def file_name(ended: Column, suffix: str = ".wav") -> Column:
    """A recording's name: the time at which it ended, to the millisecond, so that two in a second differ."""
    return F.concat(F.date_format(ended, "yyyy-MM-dd_HH-mm-ss-SSS"), F.lit(suffix))


def pan_gains(weights: Column) -> Column:
    """Constant power: the root of each weight's share; silence if all are 0."""
    total = F.aggregate(weights, F.lit(0.0), lambda a, w: a + w)
    return F.transform(weights, lambda w: F.when(total > 0, F.sqrt(w / total)).otherwise(0.0))


def voice_gain(rms: Column, peak: Column, velocity: Column, gain_db: Column, target: float, row_sum: float = 1.0) -> Column:
    """Towards the target loudness, with velocity squared, and never past full scale on the loudest output row."""
    wanted = F.when(rms > 0, target / rms).otherwise(1.0) * F.pow(velocity / 127.0, F.lit(2.0)) * linear(gain_db)
    return F.when(peak > 0, F.least(wanted, 1 / (peak * row_sum))).otherwise(wanted)


def soft_limit(x: Column, threshold: float, ceiling: float) -> Column:
    """Unchanged up to the threshold, above it bent by tanh towards the ceiling."""
    room = ceiling - threshold
    bent = F.signum(x) * (threshold + room * F.tanh((F.abs(x) - threshold) / room))
    return F.greatest(F.least(F.when(F.abs(x) > threshold, bent).otherwise(x), F.lit(ceiling)), F.lit(-ceiling))


def fade_in(i: Column, n: Column) -> Column:
    """Half a cosine from 0 to 1 over n steps."""
    return (1 - F.cos(F.lit(math.pi) * i / n)) / 2


def saturate(x: Column, drive_db: float) -> Column:
    d = 10 ** (drive_db / 20)
    return x if drive_db <= 0 else F.tanh(x * d) / math.tanh(d)


def int8(x: Column) -> Column:
    return F.greatest(F.least(F.bround(x * 127), F.lit(127)), F.lit(-127)).cast("int")


def inside(path: Column, directory: str) -> Column:
    """Whether the path is the directory or in it, by whole components."""
    at = directory.rstrip("/")
    return F.coalesce((path == at) | F.startswith(path, F.lit(at + "/")), F.lit(False))


def variant_key(content: Column, version: str, rate: int, steps: Column) -> Column:
    """SHA-256 over what a derived sound depends on."""
    return F.sha2(F.concat_ws("\x1f", content, F.lit(version), F.lit(str(rate)), steps), 256)
