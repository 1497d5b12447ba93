"""The level detector: its state machine, the fold and the stream against each other, and sidecars."""

from __future__ import annotations

import base64
import json

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sonoframe.operators.detector import Detector, advance, fresh, segments
from sonoframe.sources import sidecars

SMALL = "/root/testdata/sf0.001"
QUIET, LOUD = 1.0, 10000.0


def run(d, levels):
    return advance(d, fresh(d), levels)


def fold(spark, d, levels):
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(levels)], "s int, i int, v double")
    return sorted((r.start, r.stop) for r in segments(df, "s", ["i"], "v", d).collect())


CASES = [
    [QUIET] * 5 + [LOUD] * 2 + [QUIET] * 8,
    [QUIET] * 5 + [LOUD] + [QUIET] * 2 + [LOUD] + [QUIET] * 9,
    [QUIET] * 3 + [LOUD] * 3,
    [LOUD] * 10,
    [0.0] * 10,
    [QUIET] * 3 + [LOUD] * 20 + [QUIET] * 3,
    [QUIET],
]


@pytest.mark.parametrize("levels", CASES)
@pytest.mark.parametrize("longest", [0, 600])
def test_fold_is_the_state_machine(spark, levels, longest):
    d = Detector(snr_db=6, alpha=0.5, hold=5, warm_up=0, longest=longest, chunk=100)
    assert fold(spark, d, levels) == run(d, levels)


def test_states():
    d = Detector.of(1000, 100, snr_db=6, alpha=0.5, hold_s=0.5, warm_up_s=0)
    assert d.hold == 5 and d.warm_up == 0
    assert run(d, [QUIET] * 5 + [LOUD] * 2 + [QUIET] * 8) == [(500, 1200)]
    assert run(d, [LOUD] + [QUIET] * 9) == []
    assert run(Detector(snr_db=6, alpha=0.5, hold=5, warm_up=4, chunk=100), [QUIET] * 3 + [LOUD] + [QUIET] * 9) == []


def test_stream_equals_batch(spark):
    batch = entry.queries()["segment_detect"](spark, SMALL)
    stream = entry.queries()["segment_detect_stream"](spark, SMALL)
    assert sorted(map(tuple, stream.collect())) == sorted(map(tuple, batch.collect())) != []


#: Streams that begin with digital silence, at once or after a while, or have nothing else.
SILENT = [[0.0] * 2, [0.3, 0.0, 0.2], [0.0] * 60, [5.0] + [0.0] * 200, [0.0] * 5, []]
SOUND = [40.0, 90.0, 3.0, 0.0, 0.0, 70.0, 2.0, 1.0, 0.0, 80.0, 80.5, 81.0, 1.0, 0.0, 0.0]


@pytest.mark.parametrize("name", ["captured_stream", "recorded_segments", "segment_detect", "segment_detect_stream"])
def test_silent_start_equals_sql(spark, tmp_path, name):
    streams = [v + (SOUND if k != 4 else []) for k, v in enumerate(SILENT)]
    rows = [(k, i, v) for k, x in enumerate(streams) for i, v in enumerate(x)]
    con = duckdb.connect()
    con.execute("create table e (user_id bigint, i bigint, value double)")
    con.executemany("insert into e values (?, ?, ?)", rows)
    con.execute("create table events as select i * 100 + user_id as event_id, timestamp '2024-01-01' + to_seconds(i) as ts, user_id, 'view' as event_type, value, '{}' as props from e")
    con.execute(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    got = entry.queries()[name](spark, str(tmp_path))
    want = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(want.fetchall()) != []


#: What a column of events may hold beside plain values, as SQL over i (0, 1, ...), user_id and value.
ODD = {
    "over 16 bits": ("value", "value * 1000"),
    "over 64 bits": ("value", "value * 1e300"),
    "negative": ("value", "case when i % 3 = 0 then -value else value end"),
    "no value": ("value", "case when i % 9 = 0 then null else value end"),
    "NaN": ("value", "case when i % 59 = 0 then 'nan'::double else value end"),
    "infinite": ("value", "case when i % 59 = 0 then 'inf'::double else value end"),
    "no user": ("user_id", "case when user_id % 2 = 0 then null else user_id end"),
    "no time": ("ts", "case when i % 9 = 0 then null else ts end"),
    "double user": ("user_id", "user_id * 1e7"),
}


@pytest.mark.parametrize("name, case", [*(("recorded_segments", c) for c in ODD), *((n, c) for n in ("segment_detect", "segment_detect_stream") for c in ("no value", "NaN"))])
def test_odd_events_equal_sql(spark, tmp_path, name, case):
    column, odd = ODD[case]
    con = duckdb.connect()
    con.execute("create table e as select i as event_id, i, timestamp '2024-01-01' + to_seconds(i) as ts, i % 5 as user_id, 'view' as event_type, cast(i * i * 37 % 211 * (i % 17) // 8 as double) as value, '{}' as props from range(0, 600) t(i)")
    con.execute(f"create table events as select * exclude i replace ({odd} as {column}) from e")
    con.execute(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    got = entry.queries()[name](spark, str(tmp_path))
    want = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(want.fetchall()) != []


def test_level_starts_anew_after_silence():
    """A noise floor that follows digital silence is no event, unless the level is only to start once."""
    d = {"snr_db": 12, "alpha": 0.1, "hold": 2, "warm_up": 1}
    levels = [0.0] * 4 + [30.0] * 6 + [900.0] * 2 + [30.0] * 4
    assert run(Detector(**d), levels) == [(10, 14)]
    assert run(Detector(**d, anew=False), levels) == []


def sidecar(**other):
    r = np.random.default_rng(1)
    out = {
        "analysis_version": "13", "audio_md5": "0" * 32, "sample_rate": 44100, "bit_depth": 16, "channels": 1, "duration": 0.5, "captured_at": None,
        "params": {"n_fft": 2048, "hop_length": 512, "sample_rate": 44100}, "spectral": {"attack": 0.2}, "rhythm": {"tempo_bpm": 0.0, "onset_times": [0.1]},
        "pitch": {"dominant_pitch_hz": 220.0, "chroma_profile": [0.1] * 12}, "timbre": {k: r.standard_normal(13).tolist() for k in ("mfcc", "mfcc_delta", "mfcc_onset")},
    }
    return out | other


def test_sidecars(spark, tmp_path):
    put = lambda name, x: (tmp_path / f"{name}.wav.analysis.json").write_text(x if isinstance(x, str) else json.dumps(x))
    put("Kick", sidecar())
    put("snare", sidecar(level={"peak": 0.5, "rms": 0.1}, channel_format="b_format_ambix"))
    put("old", sidecar(analysis_version="12"))
    put("bad", "{no json")
    short = sidecar()
    short["timbre"]["mfcc"] = [1.0]
    put("short", short)
    put("part", {k: v for k, v in sidecar().items() if k != "pitch"})
    got = {r.name: r for r in sidecars.instruments(spark, str(tmp_path)).collect()}
    assert sorted(got) == ["Kick", "snare"] and got["Kick"].sample_id == 1
    assert got["Kick"].pitch.dominant_pitch_class == -1 and got["Kick"].level.rms == 0 and got["Kick"].channel_format == "pcm"
    assert got["snare"].level.peak == 0.5 and got["Kick"].rhythm.beat_times == [] and got["Kick"].band_energy.decay_rates == [0.0] * 4
    refs = sidecars.references(spark, str(tmp_path), ("12", "13"))
    assert sorted(r.ref for r in refs.collect()) == ["KICK", "OLD", "SNARE"]
    (tmp_path / "Kick.wav").write_bytes(b"sound")
    files = sidecars.audio_files(spark, str(tmp_path))
    assert sidecars.missing(files, sidecars.instruments(spark, str(tmp_path))).count() == 1
    assert sidecars.instruments(spark, str(tmp_path), audio=files).count() == 0


def test_feature_vector(spark, tmp_path):
    from sonoframe.operators.similarity import WEIGHTS, cosine, feature_vector

    (tmp_path / "a.wav.analysis.json").write_text(json.dumps(sidecar()))
    s = sidecars.instruments(spark, str(tmp_path))
    v = s.select(feature_vector().alias("v")).first().v
    assert len(v) == 58 and np.linalg.norm(v[14:26]) == pytest.approx(WEIGHTS["timbre"]) and np.linalg.norm(v[26:38]) == pytest.approx(WEIGHTS["timbre_delta"])
    assert len(s.select(feature_vector({"spectral": 1.0}).alias("v")).first().v) == 14
    assert s.select(cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("c")).first().c == 0.0


def test_envelope(spark):
    x = np.arange(-200, 200).clip(-127, 127).astype(np.int8)
    df = spark.createDataFrame([(base64.b64encode(x.tobytes()).decode(),), ("AAAA",)], "e string")
    a, b = (r.v for r in df.select(sidecars.envelope(F.col("e")).alias("v")).collect())
    assert a == x.tolist() and b is None
