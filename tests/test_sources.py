"""Recordings, libraries and settled arrivals."""

from __future__ import annotations

import json
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_detector import sidecar

from sonoframe.operators.detector import Detector
from sonoframe.sources import audio, library, sidecars
from sonoframe.streaming import capture
from sonoframe.streaming.settle import settled
from sonoframe.streaming.sinks import Backlog, Retrying, following, integrate, run_once

RATE = 8000


@pytest.fixture(scope="module")
def recording(tmp_path_factory):
    folder = tmp_path_factory.mktemp("rec")
    x = np.full(RATE * 4, 1, np.int16)
    for at in (1.0, 2.5):
        x[int(at * RATE) : int(at * RATE) + 800] = 8000
    (folder / "a.wav").write_bytes(audio.encode(x[:, None], RATE, 16))
    return str(folder)


def test_segments_of_recordings(spark, recording):
    d = Detector.of(RATE, 100, snr_db=12, hold_s=0.1, warm_up_s=0.2)
    got = library.segment_sounds(audio.read_wavs(spark, recording), d, 1000, 10, 20).orderBy("start").collect()
    assert [(r.start, r.frames) for r in got] == [(8000, 830), (20000, 830)]


def test_import_and_files(spark, recording, tmp_path):
    made = library.import_sounds(audio.read_wavs(spark, recording), rate=RATE)
    row = made.first()
    assert row.frames == 12800 and row.sample_rate == RATE
    files = library.encoded(made)
    library.write_files(files, f"file://{tmp_path}/out")
    library.write_files(files, f"file://{tmp_path}/out")
    back = audio.read_wavs(spark, f"{tmp_path}/out").first()
    assert back.md5 == row.md5 == files.first().md5 and back.frames == row.frames and os.listdir(tmp_path / "out") == ["a.wav"]


def test_library_of_several_places(spark, tmp_path):
    for folder, name, tempo in (("a", "kick", 1.0), ("b", "kick", 2.0), ("b", "hat", 3.0), ("c", "lone", 4.0)):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / f"{name}.wav.analysis.json").write_text(json.dumps(sidecar(rhythm={"tempo_bpm": tempo})))
    got = library.library(spark, [str(tmp_path / "a"), str(tmp_path / "b")], [str(tmp_path / "c" / "lone.wav")])
    assert sorted((r.name, r.rhythm.tempo_bpm) for r in got.collect()) == [("hat", 3.0), ("kick", 1.0), ("lone", 4.0)]
    assert library.reference_by_path(spark, str(tmp_path / "c" / "lone.wav")).first().ref.endswith("/C/LONE.WAV")
    assert library.described(got).first().text.startswith("kick 0.50s")
    sidecars.save(got, str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 3


def test_map_file_is_read_again(tmp_path):
    path = tmp_path / "map.yaml"
    path.write_text("assignments: [{name: a, channel: 1, notes: 1}]")
    m = library.MapFile(str(path))
    assert m.current()[0][0].name == "a"
    path.write_text("assignments: [{name: b, channel: 77, notes: 1}]")
    os.utime(path, ns=(1, 1))
    assert m.current()[0][0].name == "a" and m.error
    path.write_text("assignments: [{name: c, channel: 1, notes: 1}]")
    os.utime(path, ns=(2, 2))
    assert m.current()[0][0].name == "c" and not m.error


def test_settled_arrivals(spark, tmp_path):
    source, out = tmp_path / "in", []
    source.mkdir()
    spark.createDataFrame([("a", 1), ("b", 5)], "path string, size bigint").coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema("path string, size bigint").parquet(str(source))
    log = str(tmp_path / "log")
    query = integrate(settled(stream, "path", "size", 500), [lambda b, n: out.extend(map(tuple, b.collect()))], log).trigger(processingTime="200 milliseconds").start()
    try:
        end = time.time() + 60
        while time.time() < end and len(out) < 2:
            time.sleep(0.3)
    finally:
        query.stop()
    assert sorted(out) == [("a", 1), ("b", 5)]


def test_watched_folder(spark, tmp_path):
    from sonoframe.streaming.detect import watch_folder
    from sonoframe.streaming.sinks import run_once

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.wav.analysis.json").write_text(json.dumps(sidecar()))
    stream = watch_folder(spark, str(tmp_path / "in"), sidecars.SIDECAR)
    assert run_once(stream.select("duration", F.lit(1).alias("one")), "seen").collect()[0].duration == 0.5


def test_reference_by_path_is_analysed_where_it_has_no_sidecar(spark, recording):
    ref = library.reference_by_path(spark, f"{recording}/a.wav").first()
    assert ref.ref.endswith("/A.WAV") and ref.duration == pytest.approx(4.0) and ref.level.peak == pytest.approx(8000 / 32768)


def test_settled_takes_the_last_by_order(spark, tmp_path):
    rows = spark.createDataFrame([("a", 3, 1), ("a", 1, 9), ("a", 2, 5)], "key string, value int, at int")
    rows.write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    seen = []
    query = settled(live, "key", "value", 200, "at").writeStream.outputMode("append").foreachBatch(lambda b, n: seen.extend(b.collect())).option("checkpointLocation", str(tmp_path / "log")).trigger(processingTime="200 milliseconds").start()
    try:
        for _ in range(100):
            if seen:
                break
            time.sleep(0.2)
    finally:
        query.stop()
    assert [tuple(r) for r in seen] == [("a", 1)]


def test_retries_wait_with_the_next_batches(spark, tmp_path):
    loaded, tries = [], []

    def load(rows):
        tries.append(sorted(r.path for r in rows.collect()))
        ok = rows.where("path <> 'late'" if len(tries) < 3 else "true").where("path <> 'never'")
        loaded.extend(r.path for r in ok.collect())
        return rows.join(ok, "path", "left_anti")

    step = Retrying(load, "path", str(tmp_path / "waiting"), attempts=3)
    batch = lambda *names: spark.createDataFrame([(n,) for n in names], "path string")
    for number, names in enumerate([["a", "late", "never"], ["b"], [], [], []]):
        step(batch(*names), number)
    assert loaded == ["a", "b", "late"] and tries == [["a", "late", "never"], ["b", "late", "never"], ["late", "never"], ["never"], []]


def test_backlog_warns_and_clears():
    said = []
    b = Backlog(said.append)
    for came, done in ((10, 10), (90, 10), (0, 10), (5, 10)):
        b.heard(came, done)
    assert len(said) == 2 and "9.0 times" in said[0] and said[1] == "all rows are taken in"


def test_capture_equals_whole_recordings(spark, recording, tmp_path):
    """A stream in several micro-batches gives the frames that the whole recording does, wherever batches are cut."""
    d = Detector.of(RATE, 100, snr_db=12, hold_s=0.1, warm_up_s=0.2)
    want = library.segment_sounds(audio.read_wavs(spark, recording), d, 1000, 10, 20).orderBy("start").collect()
    x = audio.frames_of(audio.read_wavs(spark, recording).first().pcm, 16, 1)
    chunks = [("mic", i, bytearray(x[i * 100 : (i + 1) * 100].tobytes())) for i in range(len(x) // 100)]
    for n, (a, b) in enumerate([(0, 83), (83, 86), (86, 202), (202, len(chunks))]):
        spark.createDataFrame(chunks[a:b], capture.CHUNK).coalesce(1).write.parquet(str(tmp_path / "in" / f"batch={n}"))
        time.sleep(0.05)
    live = spark.readStream.schema(capture.CHUNK).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "batch=*"))
    got = run_once(capture.captured(live, d, 16, 1, 1000, 10, 20), "captured").orderBy("start").collect()
    assert [(r.start, r.stop, r.frames, bytes(r.pcm)) for r in got] == [(r.start, r.stop, r.frames, bytes(r.pcm)) for r in want] and len(want) == 2


def test_map_is_followed(spark, tmp_path):
    path = tmp_path / "map.yaml"
    path.write_text("assignments:\n  - {name: a, channel: 1, notes: 60, select: {}}\n")
    names = []
    step = following(library.MapFile(str(path)), lambda batch, number, found: names.append([a.name for a in found[0]]))
    rows = spark.range(1)
    step(rows, 0)
    path.write_text("assignments:\n  - {name: b, channel: 1, notes: 60, select: {}}\n")
    os.utime(path, ns=(1, 1))
    step(rows, 1)
    path.write_text("assignments: [")
    os.utime(path, ns=(2, 2))
    step(rows, 2)
    assert names == [["a"], ["b"], ["b"]]
