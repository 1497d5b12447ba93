"""Sound processing: invariants on synthetic signals, and PCM round trips."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonoframe.functions import analysis, dsp
from sonoframe.operators import routing
from sonoframe.sources import audio

RATE = 44100
T = np.arange(RATE // 2) / RATE


def sine(hz, gain=0.5):
    return (gain * np.sin(2 * np.pi * hz * T))[:, None]


def rms(x):
    return float(np.sqrt(np.mean(x**2)))


def test_biquad_is_the_direct_recursion():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((700, 2))
    c = dsp.sections("low", 3000, RATE)[0]
    y = np.zeros_like(x)
    for i in range(len(x)):
        at = lambda z, k: z[i - k] if i >= k else np.zeros(2)
        y[i] = c[0] * x[i] + c[1] * at(x, 1) + c[2] * at(x, 2) - c[3] * at(y, 1) - c[4] * at(y, 2)
    assert dsp.biquad(x, c) == pytest.approx(y, abs=1e-9)


def test_filters_pass_and_stop():
    assert rms(dsp.filter_low(sine(100), RATE, freq=1000)) == pytest.approx(rms(sine(100)), rel=0.02)
    assert rms(dsp.filter_low(sine(10000), RATE, freq=1000)) < 0.02 * rms(sine(100))
    assert rms(dsp.filter_high(sine(10000), RATE, freq=1000)) == pytest.approx(rms(sine(100)), rel=0.02)
    assert rms(dsp.filter_high(sine(50), RATE, freq=1000)) < 0.01
    assert rms(dsp.filter_band(sine(1000), RATE, freq=1000, q=2)) > 5 * rms(dsp.filter_band(sine(100), RATE, freq=1000, q=2))
    assert rms(dsp.filter_low(sine(1000), RATE, freq=1000)) == pytest.approx(rms(sine(1000)) / np.sqrt(2), rel=0.02)


def test_dynamics():
    loud = np.concatenate([sine(440, 0.05), sine(440, 0.9)])
    squeezed = dsp.compress(loud, RATE, threshold=-20, ratio=8, attack=1, release=50)
    assert rms(squeezed[RATE // 2 :]) / rms(squeezed[: RATE // 2]) < 0.6 * rms(loud[RATE // 2 :]) / rms(loud[: RATE // 2])
    assert np.abs(dsp.limit(sine(440, 1.0), RATE, threshold=-6)[2000:]).max() < 0.55
    noisy = np.concatenate([0.001 * np.ones((RATE // 4, 1)), sine(440)])
    assert np.abs(dsp.gate(noisy, RATE, threshold=-20, lookahead=0)[: RATE // 8]).max() < 1e-4
    assert dsp.saturate(sine(440), RATE, drive=0) is not None and np.abs(dsp.saturate(sine(440), RATE)).max() <= 1


def test_waveshapers():
    for mode in ("hard_clip", "fold", "bit_crush", "downsample"):
        assert np.abs(dsp.distort(sine(440), RATE, mode=mode)).max() == pytest.approx(0.5, rel=1e-6)
    with pytest.raises(ValueError):
        dsp.distort(sine(440), RATE, mode="melt")
    assert (dsp.reverse(dsp.reverse(sine(440), RATE), RATE) == sine(440)).all()
    assert dsp.reshape(np.ones((RATE, 1)), RATE, attack=10, release=10)[[0, RATE // 2, -1], 0] == pytest.approx([0, 1, 0], abs=0.01)


def test_spectra():
    x = sine(440)[:, 0]
    assert dsp.istft(dsp.stft(x), len(x)) == pytest.approx(x, abs=1e-6)
    clicks = np.zeros(len(x))
    clicks[::4000] = 1
    h, p = dsp.split(x + clicks)
    assert np.corrcoef(h, x)[0, 1] > 0.95 and np.corrcoef(p, clicks)[0, 1] > 0.6
    with pytest.raises(ValueError):
        dsp.hpss(sine(440), RATE, keep="both")


def peak_hz(x):
    return float(np.fft.rfftfreq(len(x), 1 / RATE)[np.abs(np.fft.rfft(x[:, 0] * np.hanning(len(x)))).argmax()])


def test_pitch_and_time():
    assert len(dsp.stretch(sine(440)[:, 0], 1.5)) == round(1.5 * len(T))
    out = dsp.repitch(sine(440), RATE, note=81, hz=440)
    assert len(out) == len(T) and peak_hz(out) == pytest.approx(880, rel=0.01)
    with pytest.raises(ValueError):
        dsp.repitch(sine(440), RATE, hz=0)
    x = np.zeros((RATE, 1))
    for at in (0.11, 0.37):
        x[int(at * RATE) : int(at * RATE) + 50] = 1
    moved = dsp.pad_quantize(x, RATE, tempo=120, grid=16, attacks=[0.11, 0.37])
    starts = np.flatnonzero(np.diff((moved[:, 0] > 0).astype(int)) == 1) / RATE
    assert np.diff(starts)[0] == pytest.approx(0.26, abs=0.13)
    assert len(dsp.stretch_quantize(x, RATE, tempo=120, attacks=[0.11, 0.37])) > 0
    assert dsp.snapped([0.002, 0.112, 0.132], 0.125) == pytest.approx([0, 0.125, 0.25])
    assert dsp.snapped([0.002, 0.112], 0.125, 0.5) == pytest.approx([0.001, 0.1185])
    assert dsp.pad_quantize(x, RATE, attacks=[0.11]) is x and dsp.stretch_quantize(x, RATE, attacks=[0.11, 0.37]) is x


def test_vocoder_follows_the_voice():
    voice = np.concatenate([sine(300), np.zeros((RATE // 2, 1))])
    rng = np.random.default_rng(0)
    out = dsp.vocoder(voice, RATE, carrier=rng.standard_normal(RATE), bands=8)
    assert rms(out[: RATE // 2]) > 10 * rms(out[-RATE // 4 :])


@pytest.mark.parametrize("depth", [16, 24, 32])
def test_pcm_round_trip(depth):
    x = np.random.default_rng(3).uniform(-1, 1, (500, 2))
    pcm = audio.to_pcm(x, depth)
    back, rate, d = audio.decode(audio.encode(pcm, 48000, depth))
    assert (rate, d) == (48000, depth) and (back == pcm).all()
    assert audio.to_float(pcm) == pytest.approx(x, abs=2 / 2**15)
    with pytest.raises(ValueError):
        audio.unpack(b"\0" * 8, 8, 1)


def test_trim_and_resample():
    x = np.array([[0], [10], [5000], [5000], [10], [0]], np.int16)
    assert audio.trim(x, 1000)[:, 0].tolist() == [5000, 5000]
    assert len(audio.trim(x, 1000, 1, 1)) == 4 and (audio.trim(x, 20000) == x).all()
    y = audio.resample(sine(440), RATE, 22050)
    assert len(y) == len(T) // 2 and rms(y) == pytest.approx(rms(sine(440)), rel=0.02)


def test_matrices():
    assert routing.matrix(1, 2).tolist() == [[1], [0]] and (routing.matrix(2, 2) == np.eye(2)).all()
    assert routing.matrix(6, 2)[:, 3].tolist() == [0, 0] and routing.matrix(8, 2)[0, 6] == pytest.approx(0.5**0.5)
    assert (routing.pan_matrix(1, [1, 1]) ** 2).sum() == pytest.approx(1) and not routing.pan_matrix(1, [0, 0]).any()
    assert routing.route(np.eye(2), [4, 2], 4).tolist() == [[0, 0], [0, 1], [0, 0], [1, 0]]
    with pytest.raises(ValueError):
        routing.route(np.eye(2), [1, 1], 2)
    r = routing.rotation(0.3, -0.2, 1.1)
    assert r @ r.T == pytest.approx(np.eye(4)) and routing.rotation(0, 0, 0) == pytest.approx(np.eye(4))
    front = routing.rotation(np.pi / 2, 0, 0) @ np.array([1, 0, 0, 1])
    assert front == pytest.approx([1, 1, 0, 0], abs=1e-9)
    d = routing.decoder([(30, 0), (-30, 0), None])
    assert d[0, 1] == pytest.approx(-d[1, 1]) and not d[2, 1:].any() and d[:, 0] == pytest.approx([0.5] * 3)
    assert routing.A_TO_B @ routing.A_TO_B.T == pytest.approx(np.eye(4))


def test_derive_variants(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"s{i}.wav").write_bytes(audio.encode(audio.to_pcm(sine(200 + i), 16), RATE, 16))
    (tmp_path / "bad.wav").write_bytes(b"no sound")
    found = audio.read_wavs(spark, str(tmp_path))
    assert found.count() == 3
    steps = json.dumps([{"reverse": None}, {"saturate": {"drive": 3}}])
    asked = found.select(F.xxhash64("path").alias("sample_id"), F.sha2(F.lit(steps), 256).alias("spec_hash"), "sample_rate", "bit_depth", "channels", "pcm", F.lit(steps).alias("steps"))
    out = dsp.derive(asked).collect()
    assert len(out) == 3 and all(r.duration == pytest.approx(0.5) and 0.9 < r.level.peak < 1.0 for r in out)


def test_distortion_keeps_its_sign_and_levels():
    x = np.array([[0.5], [-0.25], [0.9]])
    folded = np.abs(np.mod(x * 2 + 1, 4) - 2) - 1
    assert dsp.distort(x, RATE, "fold", drive=20 * np.log10(2), tone=1.0) == pytest.approx(folded * 0.9 / np.abs(folded).max())
    assert dsp.distort(np.array([[0.3], [0.26]]), RATE, "bit_crush", drive=0.0, tone=1.0, bits=2)[:, 0] == pytest.approx([0.3, 0.3])
    assert dsp.distort(np.zeros((4, 1)), RATE).tolist() == [[0]] * 4


def test_reshape_starts_at_the_attack():
    x = np.zeros((2000, 1))
    x[500:] = 0.5
    y = dsp.reshape(x, 1000, attack=5.0, release=1.0)
    assert y[500, 0] == 0 and 0 < y[502, 0] < 0.5 and y[504, 0] == pytest.approx(0.5)
    rising = np.linspace(0, 1, 1000)[:, None]
    y = dsp.reshape(rising, 1000, decay=50.0, sustain=0.2, release=1.0, attacks=[0.1])
    assert y[900, 0] == rising[900, 0]  # without an attack the sound's own is kept up to its peak


def test_transient_keeps_the_peak_and_gate_delays():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((4096, 1)) * np.exp(-np.arange(4096) / 300)[:, None] * 0.1
    assert np.abs(dsp.transient(x, RATE, gain=4.0)).max() == pytest.approx(np.abs(x).max())
    step = np.r_[np.zeros(10), np.ones(10)][:, None]
    late = dsp.gate(step, 1000, threshold=-20.0, attack=0.0, release=0.0, hold=0.0, lookahead=3.0)
    assert late[:13].max() == 0 and late[13:, 0].tolist() == [1] * 7


def test_thresholds_are_of_the_record():
    quiet = np.full((200, 1), 0.01)
    loud = quiet * 90
    record = {"peak": 0.01, "noise_floor": 0.0001, "attack": 0.0, "release": 0.0}
    assert np.abs(dsp.compress(loud, 1000, analysis=record)).max() < np.abs(dsp.compress(loud, 1000)).max()


def test_registered_processor_is_read_and_run(monkeypatch):
    from sonoframe.plans import spec

    monkeypatch.setattr(spec, "USER_PROCESSORS", set())
    monkeypatch.setattr(dsp, "PROCESSORS", dict(dsp.PROCESSORS))
    dsp.register_processor("halve", lambda x, rate, by=2.0, **_: x / by)
    steps = spec.Reader("mine").process([{"halve": {"by": 3.0}}])
    assert [s.name for s in steps] == ["halve"]
    assert dsp.chain(np.array([[0.3]]), RATE, [(s.name, dict(s.params)) for s in steps]) == pytest.approx(0.3)
    with pytest.raises(ValueError):
        dsp.register_processor("reverse", lambda x, rate, **_: x)


def test_stretch_has_segments_and_a_tail_by_the_tempi():
    x, marks = np.random.default_rng(1).standard_normal((RATE, 1)), {}
    y = dsp.stretch_quantize(x, RATE, tempo=60.0, grid=4, attacks=[0.1, 0.6], bpm=120.0, marks=marks)
    own = RATE / RATE - 0.098
    assert marks["bounds"][1][0] == RATE and len(y) == pytest.approx(RATE + (own - 0.502) * 2 * RATE, abs=2)
    assert marks["bounds"][-1][1] == len(y)
    assert len(dsp.grid_energy(y, RATE, 60.0, 4)) == len(y) // RATE


def test_attack_is_looked_for_past_the_onset():
    x = np.r_[np.zeros(4000), np.linspace(0, 1, 800), np.ones(4000)]
    late = analysis.attack_of(x, 44100, 4200 / 44100, None, 512)
    assert 4000 / 44100 <= late <= 4200 / 44100


def test_equal_heights_where_the_least_do_not_fit():
    assert analysis.heights([5, 1, 1, 1], 40) == [10, 10, 10, 10] and analysis.heights([0, 0, 0], 100) == [34, 33, 33]
