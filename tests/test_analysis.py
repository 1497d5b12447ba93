"""Features on synthetic signals, previews, and the path from files to samples."""

from __future__ import annotations

import numpy as np
import pytest

from sonoframe.functions import analysis
from sonoframe.sources import audio

RATE = 44100
T = np.arange(RATE) / RATE
RNG = np.random.default_rng(7)
SINE = 0.5 * np.sin(2 * np.pi * 440 * T)
NOISE = 0.3 * RNG.standard_normal(RATE)
CLICKS = np.zeros(2 * RATE)
for at in range(4, 16):
    CLICKS[at * 5512 : at * 5512 + 200] = RNG.standard_normal(200) * np.exp(-np.arange(200) / 40)


@pytest.fixture(scope="module")
def found():
    return {k: analysis.analyse(v, RATE) for k, v in {"sine": SINE, "noise": NOISE, "clicks": CLICKS, "silence": np.zeros(RATE)}.items()}


def test_all_in_range(found):
    for a in found.values():
        assert all(0 <= v <= 1 and np.isfinite(v) for v in a["spectral"].values()), a["spectral"]
        assert len(a["timbre"]["mfcc"]) == 13 and len(a["pitch"]["chroma_profile"]) == 12


def test_tone_and_noise(found):
    s, n = found["sine"]["spectral"], found["noise"]["spectral"]
    for more in ("spectral_flatness", "spectral_centroid", "spectral_bandwidth", "zcr", "spectral_rolloff"):
        assert n[more] > s[more], more
    assert s["voiced_fraction"] > 0.9 > 0.2 > n["voiced_fraction"] and s["harmonic_ratio"] > n["harmonic_ratio"]
    assert found["sine"]["pitch"]["dominant_pitch_hz"] == pytest.approx(440, rel=0.01) and found["sine"]["pitch"]["dominant_pitch_class"] == 9
    assert found["noise"]["spectral"]["spectral_slope"] > found["sine"]["spectral"]["spectral_slope"] or found["sine"]["spectral"]["spectral_slope"] < 1


def test_rhythm(found):
    r = found["clicks"]["rhythm"]
    assert r["onset_count"] == len(r["onset_times"]) == len(r["attack_times"]) and 10 <= r["onset_count"] <= 14
    assert any(r["tempo_bpm"] == pytest.approx(480 / k, rel=0.05) for k in (2, 3, 4, 6, 8))
    assert all(a <= o + 1e-9 and o - a <= 0.051 for a, o in zip(r["attack_times"], r["onset_times"]))


def test_silence_and_short(found):
    z = found["silence"]
    assert z["pitch"]["dominant_pitch_hz"] == 0 and z["rhythm"]["onset_count"] == 0 and z["level"]["rms"] == 0 and z["spectral"]["spectral_slope"] == 0.5
    for n in (0, 1, 2, 50, 700):
        assert analysis.analyse(SINE[:n], RATE)["level"]["peak"] <= 0.5


def test_bands():
    low = analysis.band_energy(analysis.Sound(0.5 * np.sin(2 * np.pi * 100 * T), RATE))
    assert low["energy_fractions"][0] > 0.95 and sum(low["energy_fractions"]) <= 1 + 1e-9


def test_window():
    assert analysis.window_length(44100) == (2048, 512) and analysis.window_length(96000) == (4096, 1024)
    with pytest.raises(ValueError):
        analysis.window_length(0)


def test_previews():
    e = analysis.envelopes(SINE, RATE)
    assert len(e["low"]) == len(e["high"]) == 400 and e["high"].max() in (63, 64) and len(e["bands"]) == 4
    for totals in ([0, 0, 0, 0], [5, 1, 1, 0.1]):
        h = analysis.heights(totals, 256)
        assert sum(h) == 256 and min(h) >= 16
    assert analysis.svg(SINE, RATE, [0.1], [0.5], "A4 <x>").count("<polyline") == 4


def test_from_files_to_samples(spark, tmp_path):
    for name, x in (("a", SINE), ("b", NOISE)):
        (tmp_path / f"{name}.wav").write_bytes(audio.encode(audio.to_pcm(x[:, None], 16), RATE, 16))
    rows = analysis.analyse_sounds(audio.read_wavs(spark, str(tmp_path))).orderBy("path").collect()
    assert [r.duration for r in rows] == [1.0, 1.0] and rows[0].pitch.dominant_pitch_hz == pytest.approx(440, rel=0.01)
