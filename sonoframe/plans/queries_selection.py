"""Selection queries: filters, orders, picks and fallbacks over the part table seen as a sample library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonoframe.operators import grid
from sonoframe.operators.ranking import with_rank
from sonoframe.plans import compile as plan
from sonoframe.plans.registry import query, table
from sonoframe.plans.spec import Assignment, Reader, note_map

#: part as samples: columns by name, each as SQL that both engines read alike.
FIELDS = {
    "sample_id": "p_partkey",
    "name": "p_name",
    "filepath": "concat('/lib/', p_brand, '/', p_name, '.wav')",
    "duration": "p_retailprice / 1000.0e0",
    "onset_count": "p_size",
    "tempo_bpm": "case when p_size % 5 = 0 then 0.0e0 else 60.0e0 + 2 * p_size end",
    "dominant_pitch_hz": "case when p_size % 3 = 0 then 0.0e0 else 55.0e0 * (p_partkey % 12 + 1) end",
    "pitch_confidence": "(p_partkey % 100) / 100.0e0",
    "pitch_stability": "(p_partkey % 70) / 100.0e0",
    "voiced_frame_count": "p_size",
    "voiced_fraction": "(p_partkey % 10) / 10.0e0",
    "harmonic_ratio": "(p_partkey % 7) / 7.0e0",
    "rms": "p_retailprice / 5000.0e0",
}
NESTED = {"rhythm": ["tempo_bpm", "onset_count"], "pitch": ["dominant_pitch_hz", "pitch_confidence", "pitch_stability", "voiced_frame_count"], "spectral": ["voiced_fraction", "harmonic_ratio"], "level": ["rms"]}
SAMPLES = f"samples as (select {', '.join(f'{v} as {k}' for k, v in FIELDS.items())} from part)"
#: A user's events as the energy of a quantised sound: their summed value in each of 16 slots of the day.
SLOTS = """slots as (select user_id, cast(floor(hour(ts) * 16 / 24) as int) as slot, sum(value) as v from events group by 1, 2),
profiles as (select user_id as sample_id, list(coalesce(v, 0.0) order by i) as energy from (select u.user_id, g.i, s.v from (select distinct user_id from slots) u cross join (select unnest(range(0, 16)) as i) g left join slots s on s.user_id = u.user_id and s.slot = g.i) group by 1)"""
COSINE = """list_sum(list_transform(list_zip(b[1:k], p[1:k]), lambda z: z[1] * z[2])) / nullif(sqrt(list_sum(list_transform(b[1:k], lambda z: z * z))) * sqrt(list_sum(list_transform(p[1:k], lambda z: z * z))), 0)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part in the schema of samples: flat columns and the nested structs that specs name."""
    flat = {k: F.expr(v.replace(".0e0", "D")) for k, v in FIELDS.items()}
    nested = {n for names in NESTED.values() for n in names}
    structs = [F.struct(*(flat[n].alias(n) for n in names)).alias(s) for s, names in NESTED.items()]
    return table(spark, sf_dir, "part").select(*(c.alias(k) for k, c in flat.items() if k not in nested), *structs)


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("sample_id"), F.floor(F.hour("ts") * 16 / 24).cast("int").alias("slot"), "value")
    by = e.groupBy("sample_id", "slot").agg(F.sum("value").alias("v"))
    m = by.groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "v"))).alias("m"))
    energy = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    return m.select("sample_id", energy.alias("energy"), F.lit(16).alias("resolution"))


def similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ref, sample_id, score): embeddings 0 to 4 as references of all the others' ids."""
    from sonoframe.operators.similarity import scored

    v = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    refs = v.where("vec_id < 5").select(F.concat(F.lit("ref"), F.col("vec_id").cast("string")).alias("ref"), "v")
    return scored(refs, v.select(F.col("vec_id").alias("sample_id"), "v"))


SIMILARITY = """similarity as (select concat('ref', r.vec_id) as ref, s.vec_id as sample_id, list_cosine_similarity(r.embedding::double[], s.embedding::double[]) as score
 from embeddings r, embeddings s where r.vec_id < 5)"""


def spec(**raw):
    return Reader("query").one(raw)


@query(f"with {SAMPLES} select sample_id, duration, onset_count from samples where duration >= 0.95 and duration < 1.4 and onset_count > 5 and onset_count <= 40")
def range_filter(spark, d):
    s = spec(where={"duration": {"gte": 0.95, "lt": 1.4}, "onsets": {"gt": 5, "lte": 40}})
    return samples(spark, d).where(plan.conditions(s.where)).select("sample_id", "duration", "rhythm.onset_count")


@query(f"with {SAMPLES} select sample_id, onset_count from samples where onset_count = 7")
def range_equal(spark, d):
    return samples(spark, d).where(plan.conditions(spec(where={"onsets": 7}).where)).select("sample_id", "rhythm.onset_count")


@query(f"with {SAMPLES} select sample_id, dominant_pitch_hz from samples where dominant_pitch_hz <= 440 and tempo_bpm >= 90")
def unpitched_pass_upper_bound(spark, d):
    s = spec(where={"pitch": {"lte": "A4"}, "min_tempo": 90})
    return samples(spark, d).where(plan.conditions(s.where)).select("sample_id", "pitch.dominant_pitch_hz")


@query(f"with {SAMPLES} select sample_id, name from samples where name = (select min(p_name) from part)")
def name_filter(spark, d):
    name = table(spark, d, "part").agg(F.min("p_name")).first()[0]
    return samples(spark, d).where(plan.conditions(spec(where={"name": name}).where)).select("sample_id", "name")


@query(f"with {SAMPLES} select sample_id, filepath from samples where starts_with(filepath, '/lib/Brand#1/')")
def directory_filter(spark, d):
    return samples(spark, d).where(plan.conditions(spec(where={"directory": "/lib/x/../Brand#1"}).where)).select("sample_id", "filepath")


@query(f"""with {SAMPLES} select sample_id from samples where dominant_pitch_hz > 0 and voiced_fraction > 0.5 and voiced_frame_count >= 5
 and pitch_confidence > 0.5 and pitch_stability < 0.5 and harmonic_ratio > 0.4 and duration >= 0.1""")
def pitched_filter(spark, d):
    return samples(spark, d).where(plan.conditions(spec(where={"pitched": True}).where)).select("sample_id")


@query(f"""with {SAMPLES}, {SLOTS} select sample_id, len(energy) * 4 / 16e0 as beats from samples join profiles using (sample_id) where len(energy) * 4 / 16e0 >= 2 and onset_count < 30""")
def quantized_beats_filter(spark, d):
    s = spec(where={"quantized_beats": {"gte": 2}, "onsets": {"lt": 30}})
    rows, _ = plan.matches(s, samples(spark, d), variants(spark, d))
    return rows.select("sample_id", "beats")


@query(f"with {SAMPLES} select sample_id, cast(row_number() over (order by onset_count desc, duration, sample_id) as int) as rank from samples where tempo_bpm > 0")
def multi_key_order(spark, d):
    s = spec(where={"tempo": {"gt": 0}}, order=["onsets_desc", {"by": "duration"}])
    return plan.ranked(s, samples(spark, d)).select("sample_id", "rank")


@query(f"with {SAMPLES} select sample_id, cast(row_number() over (order by sample_id desc) as int) as rank from samples where onset_count >= 45")
def default_order(spark, d):
    return plan.ranked(spec(where={"min_onsets": 45}), samples(spark, d)).select("sample_id", "rank")


@query(f"""with {SAMPLES}, {SLOTS}, b as (select s.sample_id, s.duration, len(p.energy) * 4 / 16e0 as beats from samples s left join profiles p using (sample_id))
 select sample_id, cast(row_number() over (order by beats asc nulls last, duration desc, sample_id) as int) as rank_up, cast(row_number() over (order by beats desc nulls last, duration desc, sample_id) as int) as rank_down from b""")
def nulls_last_both_ways(spark, d):
    s = samples(spark, d)
    up = plan.ranked(spec(order=["quantized_beats_asc", "duration_desc"]), s, variants(spark, d)).select("sample_id", F.col("rank").alias("rank_up"))
    down = plan.ranked(spec(order=["quantized_beats_desc", "duration_desc"]), s, variants(spark, d)).select("sample_id", F.col("rank").alias("rank_down"))
    return up.join(down, "sample_id")


@query(f"with {SAMPLES}, r as (select sample_id, row_number() over (order by rms desc, sample_id) as rank, count(*) over () as n from samples where onset_count = 50) select sample_id, cast(rank as int) as rank from r where rank = least(100000, n)")
def pick_clamped(spark, d):
    return plan.picked(spec(where={"onsets": 50}, order="loudest", pick=100000), samples(spark, d)).select("sample_id", "rank")


@query(f"with {SAMPLES} select sample_id, 1 as spec, 3 as rank from samples where onset_count >= 10 order by duration, sample_id limit 1 offset 2")
def fallback_chain(spark, d):
    specs = Reader("query").select([{"where": {"duration": {"gt": 1e9}}, "pick": 3}, {"where": {"onsets": {"gte": 10}}, "order": "duration_asc"}, {"order": "oldest"}])
    return plan.chosen(specs, samples(spark, d)).select("sample_id", "spec", "rank")


@query(f"""with {SAMPLES}, r as (select sample_id, row_number() over (order by duration, sample_id) as rank, count(*) over () as n from samples where onset_count = 12), notes as (select unnest(range(36, 44)) as note)
 select 10 as channel, cast(note as int) as note, 'kit' as assignment, sample_id, cast(rank as int) as rank from notes join r on rank = least(note - 35, n)""")
def rank_distribution(spark, d):
    read = Reader("kit")
    kit = Assignment("kit", 10, tuple(range(36, 44)), read.select({"where": {"onsets": 12}, "order": "duration_asc"}))
    return plan.assigned([kit], note_map([kit]), samples(spark, d))


@query(f"""with {SAMPLES}, {SLOTS}, b as (select sample_id, [ (energy[4*i+1] + energy[4*i+2] + energy[4*i+3] + energy[4*i+4]) / 4 for i in range(0, 4) ] as b, [1.0e0, 0.0e0, 0.5e0] as p, 3 as k from samples join profiles using (sample_id)),
 s as (select sample_id, coalesce({COSINE}, 0.0) as score from b) select sample_id, round(score, 6) as score, cast(row_number() over (order by round(score, 9) desc, sample_id) as int) as rank from s""")
def beat_match(spark, d):
    s = spec(order={"by": "beat_match", "dir": "desc", "pattern": [1, 0, 0.5]})
    rows, _ = plan.matches(s, samples(spark, d), variants(spark, d))
    rows = with_rank(rows.select("sample_id", F.round("key_0", 9).alias("key_0")), [F.desc("key_0"), F.asc("sample_id")])
    return rows.select("sample_id", F.round("key_0", 6).alias("score"), "rank")


@query("""with r as (select unnest([3, 6, 8, 16, 5, 7]) as resolution), e as (select resolution, [cast((i * 37 + resolution) % 11 as double) for i in range(0, 13)] as energy from r),
 c as (select resolution, energy, cast(round_even(13 * 4.0e0 / resolution, 0) as int) as n from e),
 b as (select resolution, n, energy, unnest(range(0, n)) as i from c),
 s as (select resolution, i, 13 // n * i + least(i, 13 % n) as a, 13 // n + case when i < 13 % n then 1 else 0 end as w, energy from b)
 select resolution, cast(i as int) as beat, round(case when w = 0 then 0 else list_sum(energy[a + 1 : a + w]) / w end, 9) as pooled from s""")
def beat_pool(spark, d):
    r = spark.range(1).select(F.explode(F.array(*map(F.lit, [3, 6, 8, 16, 5, 7]))).alias("resolution"))
    energy = F.transform(F.sequence(F.lit(0), F.lit(12)), lambda i: F.pmod(i * 37 + F.col("resolution"), F.lit(11)).cast("double"))
    b = r.withColumn("energy", energy).select("resolution", F.posexplode(grid.beats_of(F.col("energy"), F.col("resolution"))).alias("beat", "pooled"))
    return b.select("resolution", "beat", F.round("pooled", 9).alias("pooled"))


@query(f"""with {SIMILARITY}, r as (select *, cast(row_number() over (partition by ref order by score desc, sample_id) as int) as rank from similarity) select ref, sample_id, round(score, 9) as score, rank from r where rank <= 3""")
def similarity_topk(spark, d):
    from sonoframe.operators.similarity import top

    return top(similarity(spark, d), 3).withColumn("score", F.round("score", 9))


@query(f"""with {SIMILARITY}, r as (select *, cast(row_number() over (partition by ref order by score desc, sample_id) as int) as rank from similarity) select ref, sample_id, rank from r where rank = 8""")
def similarity_rank_lookup(spark, d):
    from sonoframe.operators.similarity import at_rank

    return at_rank(similarity(spark, d), 7).select("ref", "sample_id", "rank")


@query(f"""with {SAMPLES}, {SIMILARITY} select sample_id, cast(row_number() over (order by score, sample_id desc) as int) as rank from samples join similarity using (sample_id) where ref = 'ref2' and onset_count < 25""")
def similarity_filtered_asc(spark, d):
    s = spec(where={"reference": "REF2", "onsets": {"lt": 25}}, order={"by": "similarity", "dir": "asc"})
    return plan.ranked(s, samples(spark, d), similarity=similarity(spark, d)).select("sample_id", "rank")


@query(f"""with {SAMPLES}, {SIMILARITY} select sample_id, cast(row_number() over (order by score desc, sample_id) as int) as rank from samples join similarity using (sample_id) where ref = 'ref1' and tempo_bpm > 100""")
def similarity_default(spark, d):
    return plan.ranked(spec(where={"reference": "ref1", "tempo": {"gt": 100}}), samples(spark, d), similarity=similarity(spark, d)).select("sample_id", "rank")


@query(f"""with {SIMILARITY} select ref, sample_id, round(score, 9) as score, cast(row_number() over (order by score desc, ref) as int) as rank from similarity where sample_id = 77""")
def one_sample_all_references(spark, d):
    from sonoframe.operators.similarity import of_sample

    return of_sample(similarity(spark, d), 77).select("ref", "sample_id", F.round("score", 9).alias("score"), "rank")


@query("""with v as (select vec_id, embedding::double[] as e from embeddings), u as (select vec_id, list_transform(range(0, 4), lambda g: sqrt(list_sum(list_transform(e[g * 16 + 1 : g * 16 + 16], lambda x: x * x)))) as n, e from v),
 w as (select vec_id, list_transform(range(0, 64), lambda i: e[i + 1] / n[i // 16 + 1] * [1.0, 0.5, 2.0, 1.0][i // 16 + 1]) as f from u),
 s as (select r.vec_id as ref, s.vec_id as sample_id, list_cosine_similarity(r.f, s.f) as score from w r, w s where r.vec_id < 5),
 k as (select *, cast(row_number() over (partition by ref order by round(score, 9) desc, sample_id) as int) as rank from s) select ref, sample_id, round(score, 6) as score, rank from k where rank <= 5""")
def weighted_group_similarity(spark, d):
    from sonoframe.operators.similarity import scored, times, top, unit

    v = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    f = F.concat(*(times(unit(F.slice("e", 16 * g + 1, 16)), w) for g, w in enumerate([1.0, 0.5, 2.0, 1.0])))
    v = v.select("vec_id", f.alias("v"))
    s = scored(v.where("vec_id < 5").select(F.col("vec_id").alias("ref"), "v"), v.select(F.col("vec_id").alias("sample_id"), "v"))
    return top(s.withColumn("score", F.round("score", 9)), 5).withColumn("score", F.round("score", 6))


@query(f"""with {SIMILARITY}, c as (select ref, sample_id, score from similarity where ref <> 'ref4' union all select ref, sample_id, score from similarity where ref = 'ref4')
 select ref, count(*) as n, round(sum(score), 6) as total, max(sample_id) as last from c where sample_id % 9 <> 0 group by ref""")
def index_upkeep(spark, d):
    """Samples added, a reference added, samples removed: the index as if made at once."""
    from sonoframe.operators.similarity import add_references, add_samples, remove_samples, scored

    v = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    refs = v.where("vec_id < 5").select(F.concat(F.lit("ref"), F.col("vec_id").cast("string")).alias("ref"), "v")
    every = v.select(F.col("vec_id").alias("sample_id"), "v")
    index = scored(refs.where("ref <> 'ref4'"), every.where("sample_id < 300"))
    index = add_samples(index, refs.where("ref <> 'ref4'"), every)
    index = add_references(index, refs, every)
    index = remove_samples(index, every.where("sample_id % 9 = 0"))
    return index.groupBy("ref").agg(F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("total"), F.max("sample_id").alias("last"))


@query("""with e as (select vec_id, embedding::double[] as e from embeddings), c as (select vec_id, e, (abs(e[61]) + 1) / (abs(e[62]) + 0.2) as crest from e),
 g as (select vec_id, list_concat(e[1:13], [case when crest <= sqrt(2) then 0.0 when crest >= 10 then 1.0 else ln(crest / sqrt(2)) / ln(10 / sqrt(2)) end]) as a, e[15:26] as b, e[28:39] as c, e[41:52] as d, e[53:60] as f from c),
 u as (select vec_id, list_concat(list_transform(a, lambda x: x / sqrt(list_sum(list_transform(a, lambda y: y * y)))), list_concat(list_transform(b, lambda x: x / sqrt(list_sum(list_transform(b, lambda y: y * y)))),
  list_concat(list_transform(c, lambda x: 0.5e0 * x / sqrt(list_sum(list_transform(c, lambda y: y * y)))), list_concat(list_transform(d, lambda x: x / sqrt(list_sum(list_transform(d, lambda y: y * y)))), list_transform(f, lambda x: x / sqrt(list_sum(list_transform(f, lambda y: y * y)))))))) as v from g)
 select vec_id, cast(unnest(range(0, 58)) as int) as i, round(unnest(v), 9) as v from u""")
def feature_vectors(spark, d):
    """58 numbers of each sample: five groups at length 1 times their weights, without MFCC 0."""
    from sonoframe.operators.similarity import SPECTRAL, feature_vector

    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    at = lambda i: F.get("e", F.lit(i))
    spectral = F.struct(*(at(i).alias(c) for i, c in enumerate(SPECTRAL))).alias("spectral")
    timbre = F.struct(*(F.slice("e", 14 + 13 * k, 13).alias(c) for k, c in enumerate(("mfcc", "mfcc_delta", "mfcc_onset")))).alias("timbre")
    band = F.struct(F.slice("e", 53, 4).alias("energy_fractions"), F.slice("e", 57, 4).alias("decay_rates")).alias("band_energy")
    level = F.struct((F.abs(at(60)) + 1).alias("peak"), (F.abs(at(61)) + 0.2).alias("rms")).alias("level")
    v = e.select("vec_id", spectral, timbre, band, level).select("vec_id", F.posexplode(feature_vector()).alias("i", "v"))
    return v.select("vec_id", "i", F.round("v", 9).alias("v"))


@query(f"""with {SIMILARITY}, r as (select *, cast(row_number() over (partition by ref order by round(score, 9) desc, sample_id) as int) as rank from similarity) select ref, sample_id, rank from r where rank <= 4""")
def similarity_by_matrix(spark, d):
    """The same index by products of matrices, for many references."""
    from sonoframe.operators.similarity import scored_by_matrix, top

    v = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    refs = v.where("vec_id < 5").select(F.concat(F.lit("ref"), F.col("vec_id").cast("string")).alias("ref"), "v")
    s = scored_by_matrix(refs, v.select(F.col("vec_id").alias("sample_id"), "v"))
    return top(s.withColumn("score", F.round("score", 9)), 4).select("ref", "sample_id", "rank")


@query("""select * from (values ('a', 'duration', 'gte', 0.5e0), ('a', 'duration', 'lt', 2.0e0), ('a', 'onsets', 'eq', 3.0e0), ('b', 'tempo', 'lte', 140.0e0), ('b', 'pitch_hz', 'gte', 261.625565e0), ('c', 'quantized_beats', 'gt', 4.0e0)) as r(spec, of, op, value)""")
def parsed_ranges(spark, d):
    """Ranges as specs give them: by operator, as a plain number, in the older form, by a note's name."""
    raw = {"a": {"duration": {"gte": 0.5, "lt": 2}, "onsets": 3}, "b": {"max_tempo": 140, "min_pitch": "C4"}, "c": {"quantized_beats": {"gt": 4}}}
    rows = [(name, of, op, round(float(v), 6)) for name, where in raw.items() for of, r in spec(where=where).where.ranges for op, v in r.bounds]
    return spark.createDataFrame(rows, "spec string, of string, op string, value double")


@query("""select * from (values ('newest', 'age', true), ('oldest', 'age', false), ('loudest', 'level', true), ('quietest', 'level', false), ('onsets_desc', 'onsets', true), ('duration_asc', 'duration', false), ('quantized_beats_desc', 'quantized_beats', true)) as o(token, key, descending)""")
def order_words(spark, d):
    """Single words that stand for an order."""
    words = ["newest", "oldest", "loudest", "quietest", "onsets_desc", "duration_asc", "quantized_beats_desc"]
    rows = [(w, (o := spec(order=w).order[0]).by, o.descending) for w in words]
    return spark.createDataFrame(rows, "token string, key string, descending boolean")


@query("""select * from (values ('kicks/deep.wav', '/lib/kicks/deep', 'deep'), ('./hat.flac', '/lib/hat', 'hat'), ('plain', null, 'plain')) as p(given, path, name)""")
def named_by_path(spark, d):
    """A name with a slash or a dot at its start is a path, whose stem the sound has for a name."""
    read = Reader("query", "/lib")
    rows = []
    for given in ("kicks/deep.wav", "./hat.flac", "plain"):
        w = read.one({"where": {"name": given}}).where
        rows.append((given, None if w.name_path is None else w.name_path.rsplit(".", 1)[0], w.name))
    return spark.createDataFrame(rows, "given string, path string, name string")
