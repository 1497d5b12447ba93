"""Settings, retention, the similarity index and variants on small tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sonoframe.operators import frames, retention, similarity, variants
from sonoframe.plans.spec import Controller, Reader, Step
from sonoframe.sources import config


def test_config():
    c = config.load("max_memory_mb: 100\ninstrument:\nplayer: {max_polyphony: 4}")
    assert c["instrument"]["max_memory_mb"] == 60 and c["transform"]["max_memory_mb"] == 35 and c["transform"]["max_disk_mb"] == 105 and c["transform"]["carrier_memory_mb"] == 5
    assert c["player"]["max_polyphony"] == 4 and c["detection"]["hold_time"] == 0.5 and config.DEFAULTS["player"]["max_polyphony"] == 8
    assert config.load("recorder: {audio: {input: [1, 3]}}")["recorder"]["audio"]["channels"] == 2
    for bad in ("player: {max_polyphony: 0}", "recorder: {audio: {bit_depth: 8}}", "recorder: {audio: {bit_depth: 32, audio_format: flac}}", "recorder: {audio: {input: [1, 1]}}", "recorder: {audio: {ambisonic_format: a}}", "player: {limiter_ceiling_db: -3}", "analysis: {tempo_min: 400}", "detection: {ema_alpha: 0}", "transform: {quantize_resolution: 3}"):
        with pytest.raises(ValueError):
            config.load(bad)


def sizes(spark, *rows):
    return spark.createDataFrame(list(rows), "id bigint, bytes bigint")


def kept(df):
    return sorted(r.id for r in df.collect())


def test_fifo_keeps_the_newest(spark):
    rows = sizes(spark, (1, 50), (2, 30), (3, 20), (4, 40))
    assert kept(retention.newest_within(rows, "id", "bytes", 60)) == [3, 4]
    assert kept(retention.newest_within(rows, "id", "bytes", 59)) == [4]
    assert kept(retention.newest_within(rows, "id", "bytes", 10)) == [4]
    assert kept(retention.newest_within(rows, "id", "bytes", 1000)) == [1, 2, 3, 4]
    assert kept(retention.newest_within(rows.limit(0), "id", "bytes", 10)) == []


def test_families(spark):
    rows = spark.createDataFrame([(1, 1, 40), (1, 9, 40), (2, 2, 30), (3, 3, 30)], "sample_id bigint, inserted bigint, bytes bigint")
    assert sorted(r.sample_id for r in variants.in_memory(rows, 70).collect()) == [2, 3]
    assert variants.in_memory(rows, 10).count() == 0


def test_merge_latest_and_turns(spark):
    a = spark.createDataFrame([("x", 1)], "name string, v int")
    assert sorted((r.name, r.v) for r in retention.merged(a, spark.createDataFrame([("x", 2), ("y", 3)], "name string, v int"), "name").collect()) == [("x", 1), ("y", 3)]
    e = spark.createDataFrame([(1, 1, 5), (1, 2, 7), (2, 1, 9)], "k int, t int, v int")
    assert sorted((r.k, r.v) for r in retention.latest(e, ["k"], "v", "t").collect()) == [(1, 7), (2, 9)]
    assert sorted((r.k, r.t, r.turn_of) for r in retention.round_robin(e, ["k"], 2, "t").collect()) == [(1, 1, 0), (1, 2, 1), (2, 1, 0)]


def test_index_in_blocks_and_upkeep(spark, monkeypatch):
    v = spark.createDataFrame([(i, [float(i % 3), 1.0, float(i % 5)]) for i in range(20)], "sample_id bigint, v array<double>")
    refs = v.where("sample_id < 5").select(F.concat(F.lit("r"), "sample_id").alias("ref"), "v")
    whole = sorted(map(tuple, similarity.scored(refs, v).collect()))
    monkeypatch.setattr(similarity, "BROADCAST_ROWS", 2)
    assert sorted(map(tuple, similarity.scored(refs, v).collect())) == whole and len(whole) == 100
    index = similarity.scored(refs, v.where("sample_id < 10"))
    assert similarity.add_samples(index, refs, v).count() == 100
    assert similarity.add_references(index, refs.withColumn("ref", F.upper("ref")), v).count() == 50
    assert similarity.remove_samples(index, v.where("sample_id = 3")).count() == 45
    assert similarity.top(index, 2).count() == 10 and similarity.top(index).count() == 50 and similarity.at_rank(index, 99).count() == 0
    by_matrix = sorted(map(tuple, similarity.scored_by_matrix(refs, v).collect()))
    assert [x[:2] for x in by_matrix] == [x[:2] for x in whole] and [x[2] for x in by_matrix] == pytest.approx([x[2] for x in whole])
    assert similarity.scored_by_matrix(refs, v.limit(0)).count() == 0
    zero = spark.createDataFrame([("z", [0.0, 0.0, 0.0])], "ref string, v array<double>")
    assert {r.score for r in similarity.scored(zero, v).collect()} == {0.0}


def test_top_k_is_limited_below_the_shuffle(spark):
    index = spark.range(100).select((F.col("id") % 7).alias("ref"), F.col("id").alias("sample_id"), F.rand(1).alias("score"))
    assert "WindowGroupLimit" in similarity.top(index, 3)._jdf.queryExecution().executedPlan().toString()


def test_variants(spark):
    s = spark.createDataFrame([(1, "m1"), (2, "m2"), (2, "m2")], "sample_id bigint, audio_md5 string")
    steps = variants.canonical(Reader().process([{"saturate": {"drive": {"cc": 7, "max": 10}}}, "reverse"]), {(3, 7): 127})
    assert steps == '[{"saturate":{"drive":10.0}},{"reverse":{}}]'
    assert variants.canonical((Step("limit", (("release", Controller(1, 0, 4)),)),)) == '[{"limit":{"release":2.0}}]'
    wanted = variants.requested(s, steps, notes=[60, 61])
    there = wanted.where("sample_id = 1 and note = 60").select("sample_id", "spec_hash")
    assert variants.missing(wanted, there).count() == 3
    assert variants.missing(wanted, there, wanted.select("sample_id", "spec_hash")).count() == 0
    assert sorted((r.sample_id, r.note, r.found is not None) for r in variants.served(wanted.dropDuplicates(), there, "base").collect()) == [(1, 60, True), (1, 61, False), (2, 60, False), (2, 61, False)]
    v = spark.createDataFrame([(1, "a", ["stretch_quantize"]), (2, "b", ["pad_quantize"]), (3, "c", ["reverse"])], "sample_id bigint, spec_hash string, steps array<string>")
    stays, again = variants.after_tempo_change(v)
    assert [r.sample_id for r in stays.collect()] == [3] and [r.sample_id for r in again.collect()] == [1]


def test_frames(spark):
    f = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([0, 1, 3, 3, 3, 1, 2, 0])], "k int, i int, v double")
    assert sorted((r.peak_at, r.peak) for r in frames.local_maxima(f, "k", "i", "v").collect()) == [(3, 3.0), (6, 2.0)]
    assert [tuple(r) for r in frames.trim(f, "k", "i", "v", 3, 1, 1).collect()] == [(1, 1, 6)]
    assert [tuple(r) for r in frames.trim(f, "k", "i", "v", 9).collect()] == [(1, 0, 8)]
    assert [r.open for r in frames.hold_gate(f, "k", "i", "v", 3, 1).orderBy("i").collect()] == [False, False, True, True, True, True, False, False]
    assert [r.moving for r in frames.moving_mean(f, "k", "i", "v", 4).orderBy("i").collect()][-3:] == [0.0] * 3


def test_rank_over_many_tasks(spark, monkeypatch):
    from sonoframe.operators import ranking

    rows = spark.range(5000, numPartitions=7).select("id", F.pmod(F.xxhash64("id"), F.lit(100)).alias("k"))
    keys = [F.desc("k"), F.asc("id")]
    one = sorted(map(tuple, ranking.with_rank(rows, keys).collect()))
    monkeypatch.setattr(ranking, "ONE_TASK", 10)
    assert sorted(map(tuple, ranking.with_rank(rows, keys).collect())) == one
    assert ranking.with_rank(rows.limit(0), keys).count() == 0


def test_segments_and_banks(spark, tmp_path):
    from sonoframe.sources import library

    df = spark.createDataFrame([(0, ["a", "b", "c"]), (1, ["a", "b", "c"]), (4, ["a", "b", "c"]), (2, [])], "turn int, s array<string>")
    pick = lambda how: [r.x for r in df.select(variants.segment_of(F.col("s"), how, F.col("turn")).alias("x")).collect()]
    assert pick(2) == ["b", "b", "b", None] and pick(9) == ["c", "c", "c", None] and pick("round_robin") == ["a", "b", "b", None]
    assert set(pick("random")[:3]) <= {"a", "b", "c"}
    banks = [{"name": "a", "directory": "x", "program": 3}, {"name": "b", "directory": "y", "program": 7}]
    assert [library.program_after(banks, p) for p in (7, 5, None)] == [7, 3, 3] and library.program_after([], 1) is None
    spark.createDataFrame([(1, 3), (2, 7)], "sample_id int, bank int").write.partitionBy("bank").parquet(str(tmp_path / "s"))
    active = library.of_bank(spark.read.parquet(str(tmp_path / "s")), 7)
    assert [r.sample_id for r in active.collect()] == [2] and "PartitionFilters: [isnotnull(bank" in active._jdf.queryExecution().executedPlan().toString()
