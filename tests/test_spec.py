"""Specs: what is read, what is refused, and how rows are matched and ordered."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sonoframe.plans import compile as plan
from sonoframe.plans.spec import Controller, Order, Range, Reader, SpecError, expand_notes, note_hz, note_map, note_number, read_map

read = Reader("kit", "/maps")


def test_ranges_old_new_and_scalar():
    w = read.conditions({"duration": {"gte": 1, "lt": 2}, "min_onsets": 3, "max_onsets": 5, "tempo": 120, "pitch": {"gte": "A4"}})
    assert w.range("duration") == Range(gte=1.0, lt=2.0) and w.range("onsets") == Range(gte=3.0, lte=5.0)
    assert w.range("tempo") == Range(eq=120.0) and w.range("pitch_hz").gte == pytest.approx(440)


@pytest.mark.parametrize(
    "raw",
    [
        {"where": {"duration": {"near": 1}}}, {"where": {"min_tempo": 1, "tempo": 2}}, {"where": {"tempo": 2, "min_tempo": 1}}, {"where": {"colour": 1}},
        {"where": {"pitched": 1}}, {"where": {"name": "a", "path": "b.wav"}}, {"where": {"duration": "long"}}, {"where": []}, {"order": "best"}, {"order": {"dir": "asc"}},
        {"order": {"by": "age", "dir": "up"}}, {"order": {"by": "looks"}}, {"order": ["newest", "similarity"]}, {"order": {"by": "beat_match"}},
        {"order": {"by": "beat_match", "pattern": [1]}}, {"order": {"by": "beat_match", "pattern": [0, 2]}}, {"order": {"by": "beat_match", "pattern": ["x", 1]}},
        {"order": "newest", "order_by": "oldest"}, {"pick": 0}, {"pick": "x"}, "text", {"order": 3},
    ],
)
def test_refused(raw):
    with pytest.raises(SpecError):
        read.select(raw)


def test_lenient_reader_leaves_unknown_conditions_out():
    assert Reader("kit", strict=False).conditions({"colour": 1}).ranges == ()


def test_orders():
    assert read.one({"where": {"reference": "kick"}}).order == (Order("similarity", True),)
    assert read.one({}).order == ()
    assert read.order(["loudest", {"by": "beat_match", "dir": "DESC", "pattern": [True, 0.5]}]) == (Order("level", True), Order("beat_match", True, (("pattern", (1.0, 0.5)),)))


def test_paths_and_names():
    w = read.conditions({"name": "drums/kick.wav"})
    assert (w.name, w.name_path) == ("kick", "/maps/drums/kick.wav")
    assert read.conditions({"reference": "./a.wav"}).reference == "/maps/a.wav"
    assert read.conditions({"directory": "../x"}).directory == "/x"
    assert read.conditions({"name": "kick"}).name_path is None


def test_process():
    steps = read.process(["reverse", {"saturate": {"amount": 3}}, "hpss_harmonic", {"beat_quantize": {"bpm": 120, "strength": {"cc": 7, "min": 0, "max": 2}}}, {"repitch": None}])
    assert [s.name for s in steps] == ["reverse", "saturate", "hpss", "stretch_quantize", "repitch"]
    assert steps[1].get("drive") == 3 and steps[2].get("keep") == "harmonic" and steps[3].get("tempo") == 120
    assert steps[3].get("strength") == Controller(7, 0.0, 2.0) and steps[3].get("strength").at(None) == 1.0 and steps[3].get("strength").at(127) == 2.0
    for bad in ({"saturate": {"amount": 1, "drive": 2}}, {"a": 1, "b": 2}, "fly", {"reverse": 3}, 4):
        with pytest.raises(SpecError):
            read.process([bad])


def test_notes():
    assert note_number("C4") == 60 and note_number("F#2") == 42 and note_number("Bb-1") == 10
    assert note_hz("A4") == 440
    assert expand_notes(["C4", "36..38", 5]) == (60, 36, 37, 38, 5)
    for bad in ("H4", 128, "40..38"):
        with pytest.raises((SpecError, ValueError)):
            expand_notes(bad)


MAP = """
banks: [{name: a, directory: x}, {name: b, directory: y, program: 9}]
assignments:
  - {name: hats, channel: 10, notes: [42, 44, 46], select: {where: {reference: hat}}}
  - {name: bass, channel: 1, notes: C1..E1, select: {where: {pitched: true}}, process: [repitch], pan: [1, 1]}
  - {name: last, channel: 10, notes: 44, select: [{where: {name: a}, pick: 2}, {}]}
"""


def test_map():
    found, banks = read_map(MAP, references={"HAT"})
    assert [b["program"] for b in banks] == [0, 9] and len(found) == 3
    picks = note_map(found)
    assert [picks[10, n][1] for n in (42, 44, 46)] == [1, 2, 3] and picks[10, 44][0].name == "last"
    assert picks[1, 26][1] == 1
    assert [a.name for a in read_map(MAP, references=set())[0]] == ["bass", "last"]
    with pytest.raises(SpecError):
        read_map("banks: [{name: a, directory: x, program: 1}, {name: b, directory: y, program: 1}]")


@pytest.fixture(scope="module")
def few(spark):
    rows = [(1, "a", "/lib/a/x.wav", 1.0, 2), (2, "b", "/lib/ab/y.wav", float("nan"), 2), (3, "A", None, 1.0, 1), (4, "c", "/lib/a", 0.5, 9)]
    return spark.createDataFrame(rows, "sample_id bigint, name string, filepath string, duration double, n int").withColumn("rhythm", F.struct(F.col("n").alias("onset_count"), F.lit(0.0).alias("tempo_bpm")))


def ids(df):
    return [r.sample_id for r in df.orderBy("rank" if "rank" in df.columns else "sample_id").collect()]


def test_nan_fails_only_equality(few):
    assert ids(few.where(plan.conditions(read.conditions({"duration": {"lte": 1}})))) == [1, 2, 3, 4]
    assert ids(few.where(plan.conditions(read.conditions({"duration": {"gt": 0.7}})))) == [1, 2, 3]
    assert ids(few.where(plan.conditions(read.conditions({"duration": 1})))) == [1, 3]


def test_missing_tempo_is_zero(few):
    assert ids(few.where(plan.conditions(read.conditions({"tempo": {"lte": 90}})))) == [1, 2, 3, 4]


def test_names_and_directories(few):
    assert ids(few.where(plan.conditions(read.conditions({"name": "a"})))) == [1]
    assert ids(few.where(plan.conditions(read.conditions({"directory": "/lib/a"})))) == [1, 4]


def test_ties_go_to_the_lower_id_both_ways(few):
    assert ids(plan.ranked(read.one({"order": "onsets_desc"}), few)) == [4, 1, 2, 3]
    assert ids(plan.ranked(read.one({"order": "onsets_asc"}), few)) == [3, 1, 2, 4]
    assert ids(plan.ranked(read.one({}), few)) == [4, 3, 2, 1]


def test_similarity_up_is_the_reverse(spark, few):
    index = spark.createDataFrame([("Kick", 1, 0.5), ("kick", 2, 0.5), ("KICK", 3, 0.9), ("snare", 4, 1.0)], "ref string, sample_id bigint, score double")
    down = read.one({"where": {"reference": "kick"}})
    up = read.one({"where": {"reference": "kick"}, "order": {"by": "similarity"}})
    assert ids(plan.ranked(down, few, similarity=index)) == [3, 1, 2]
    assert ids(plan.ranked(up, few, similarity=index)) == [2, 1, 3]
    assert plan.ranked(down, few).count() == 0
    with pytest.raises(ValueError):
        plan.ranked(read.one({"order": "similarity"}), few, similarity=index)


def test_beats(spark, few):
    v = spark.createDataFrame([(1, [1.0, 0.0, 1.0, 0.0], 4), (2, [0.0, 1.0, 0.0, 1.0], 4), (3, [], 4)], "sample_id bigint, energy array<double>, resolution int")
    match = read.one({"order": {"by": "beat_match", "dir": "desc", "pattern": [1, 0, 1, 0]}})
    assert ids(plan.ranked(match, few, v)) == [1, 2]
    assert ids(plan.ranked(read.one({"order": "quantized_beats_desc"}), few, v)) == [1, 2, 3, 4]
    assert ids(plan.ranked(read.one({"where": {"quantized_beats": {"gte": 0}}, "order": "oldest"}), few, v)) == [1, 2, 3]


def test_filters_reach_the_scan(spark, few, tmp_path):
    few.drop("n").write.parquet(str(tmp_path / "s"))
    df = spark.read.parquet(str(tmp_path / "s")).where(plan.conditions(read.conditions({"name": "a", "onsets": {"gte": 2}}))).select("sample_id")
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(name,a)" in text and "tempo_bpm" not in text
