"""Queries on scalar functions, grids, matrices and derived sounds."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from sonoframe.functions import scalar
from sonoframe.operators import grid, retention, routing, variants
from sonoframe.plans import compile as plan
from sonoframe.plans import spec
from sonoframe.plans.queries_selection import SAMPLES, samples
from sonoframe.plans.registry import query, table
from sonoframe.sources import library, sidecars


@query("select p_partkey, round(case when p_retailprice <= 950 then 0 when p_retailprice >= 1900 then 1 else ln(p_retailprice / 950) / ln(2) end, 9) as v from part")
def log_normalize(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(scalar.log_normalize(F.col("p_retailprice"), 950, 1900), 9).alias("v"))


@query("select p_partkey, cast(pow(2, round_even(log2((p_partkey * 100 + 8000) * 2048.0e0 / 44100), 0)) as int) as n_fft, cast(pow(2, round_even(log2((p_partkey * 100 + 8000) * 2048.0e0 / 44100), 0)) as int) // 4 as hop from part")
def analysis_window(spark, d):
    n = scalar.analysis_window(F.col("p_partkey") * 100 + 8000)
    return table(spark, d, "part").select("p_partkey", n.alias("n_fft"), F.floor(n / 4).cast("int").alias("hop"))


@query("select p_partkey, round(20 * log10(greatest(p_retailprice / 2000, 1e-10)), 9) as db, round(pow(10, p_size / -20.0e0), 9) as gain from part")
def decibels(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(scalar.decibels(F.col("p_retailprice") / 2000), 9).alias("db"), F.round(scalar.linear(-F.col("p_size")), 9).alias("gain"))


@query("""with n as (select unnest(range(0, 128)) as note) select cast(note as int) as note, round(440 * pow(2, (note - 69) / 12.0e0), 6) as hz,
 concat((['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'])[note % 12 + 1], note // 12 - 1) as label from n""")
def note_table(spark, d):
    hz = scalar.note_frequency(F.col("note"))
    notes = spark.range(128).select(F.col("id").cast("int").alias("note"))
    return notes.select("note", F.round(hz, 6).alias("hz"), scalar.pitch_label(hz * 1.0001, F.lit(1.0), F.col("note") % 12).alias("label"))


@query("""with w as (select s_suppkey, [s_suppkey % 3 * 1.0e0, s_suppkey % 5 * 1.0e0, s_nationkey * 1.0e0] as w from supplier), t as (select s_suppkey, w, list_sum(w) as t from w)
 select s_suppkey, round(case when t > 0 then sqrt(w[1] / t) else 0 end, 9) as g0, round(case when t > 0 then sqrt(w[2] / t) else 0 end, 9) as g1, round(case when t > 0 then sqrt(w[3] / t) else 0 end, 9) as g2 from t""")
def pan_gains(spark, d):
    w = F.array(F.col("s_suppkey") % 3 * 1.0, F.col("s_suppkey") % 5 * 1.0, F.col("s_nationkey") * 1.0)
    s = table(spark, d, "supplier").select("s_suppkey", scalar.pan_gains(w).alias("g"))
    return s.select("s_suppkey", *(F.round(F.get("g", F.lit(i)), 9).alias(f"g{i}") for i in range(3)))


@query("""select p_partkey, round(least(0.1 / (p_retailprice / 20000) * pow((p_partkey % 128) / 127.0e0, 2) * pow(10, (p_size - 25) / 20.0e0), 1 / (p_retailprice / 4000 * 1.5)), 9) as gain from part""")
def voice_gain(spark, d):
    g = scalar.voice_gain(F.col("p_retailprice") / 20000, F.col("p_retailprice") / 4000, F.col("p_partkey") % 128, F.col("p_size") - 25, 0.1, 1.5)
    return table(spark, d, "part").select("p_partkey", F.round(g, 9).alias("gain"))


@query("""with x as (select event_id, (value - 245) / 120 as x from events) select event_id, round(case when abs(x) > 0.8 then greatest(least(sign(x) * (0.8 + 0.2 * tanh((abs(x) - 0.8) / 0.2)), 1), -1) else x end, 9) as y from x""")
def limiter(spark, d):
    return table(spark, d, "events").select("event_id", F.round(scalar.soft_limit((F.col("value") - 245) / 120, 0.8, 1.0), 9).alias("y"))


@query(f"select event_id, round(tanh((value - 245) / 245 * {10 ** 0.3!r}) / {math.tanh(10 ** 0.3)!r}, 9) as y, cast(greatest(least(round_even((value - 245) / 245 * 127, 0), 127), -127) as int) as q from events")
def saturate_and_quantise(spark, d):
    x = (F.col("value") - 245) / 245
    return table(spark, d, "events").select("event_id", F.round(scalar.saturate(x, 6.0), 9).alias("y"), scalar.int8(x).alias("q"))


@query("select cast(i as int) as i, round((1 - cos(pi() * i / 32)) / 2, 9) as gain from (select unnest(range(0, 32)) as i)")
def half_cosine_fade(spark, d):
    return spark.range(32).select(F.col("id").cast("int").alias("i"), F.round(scalar.fade_in(F.col("id"), F.lit(32)), 9).alias("gain"))


@query("""with recursive o as (select user_id, hour(ts) * 3600 + minute(ts) * 60.0e0 + second(ts) as t, row_number() over (partition by user_id order by hour(ts) * 3600 + minute(ts) * 60.0e0 + second(ts), event_id) as n from events),
 s as (select user_id, n, t, greatest(cast(ceil(t / 900 - 0.5) as bigint), 0) as pt from o where n = 1
 union all select o.user_id, o.n, o.t, greatest(cast(ceil(o.t / 900 - 0.5) as bigint), s.pt + 1) from s join o on o.user_id = s.user_id and o.n = s.n + 1)
 select user_id, cast(n - 1 as int) as i, round(t + 0.5 * (pt * 900 - t), 6) as target from s""")
def grid_snap(spark, d):
    t = F.hour("ts") * 3600 + F.minute("ts") * 60.0 + F.floor(F.second("ts"))
    o = table(spark, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct(t.alias("t"), "event_id"))).alias("o"))
    s = o.select("user_id", grid.snap(F.col("o.t"), F.lit(900.0), F.lit(1_000_000), 0.5).alias("s"))
    return s.select("user_id", F.posexplode("s").alias("i", "target")).select("user_id", "i", F.round("target", 6).alias("target"))


@query("""with g as (select s_suppkey, 60.0e0 / (60 + s_nationkey) / 4 as step, s_acctbal as len from supplier where s_acctbal > 0), p as (select s_suppkey, step, unnest(range(0, cast(floor(len / step) as bigint) + 2)) as i from g) select s_suppkey, count(*) as n, round(max(i * step), 6) as last from p group by 1""")
def quantize_grid(spark, d):
    s = table(spark, d, "supplier").where("s_acctbal > 0")
    g = s.select("s_suppkey", grid.grid_times(F.col("s_acctbal"), 60.0 + F.col("s_nationkey"), F.lit(16)).alias("g"))
    return g.select("s_suppkey", F.size("g").cast("bigint").alias("n"), F.round(F.array_max("g"), 6).alias("last"))


@query("""with f as (select s_suppkey, [s_acctbal, s_nationkey * 10.0e0, s_suppkey * 1.0e0, 1.0e0] as x from supplier) select s_suppkey, round((x[1] + x[2] + x[3] + x[4]) / 2, 6) as w, round((x[1] - x[2] + x[3] - x[4]) / 2, 6) as y, round((x[1] - x[2] - x[3] + x[4]) / 2, 6) as z, round((x[1] + x[2] - x[3] - x[4]) / 2, 6) as x from f""")
def ambisonic_encode(spark, d):
    s = table(spark, d, "supplier")
    m = s.select("s_suppkey", routing.applied(routing.A_TO_B, F.array(F.col("s_acctbal"), F.col("s_nationkey") * 10.0, F.col("s_suppkey") * 1.0, F.lit(1.0))).alias("m"))
    return m.select("s_suppkey", *(F.round(F.get("m", F.lit(i)), 6).alias(c) for i, c in enumerate("wyzx")))


@query(f"""select s_suppkey, round(s_acctbal + {math.sqrt(0.5)!r} * s_nationkey + {math.sqrt(0.5)!r} * s_suppkey, 6) as l, round(s_acctbal / 2 + {math.sqrt(0.5)!r} * s_nationkey + {math.sqrt(0.5)!r} * 3, 6) as r from supplier""")
def downmix(spark, d):
    """5.1 (L, R, C, LFE, Ls, Rs) to stereo."""
    frame = F.array(F.col("s_acctbal"), F.col("s_acctbal") / 2, F.col("s_nationkey") * 1.0, F.lit(9.0), F.col("s_suppkey") * 1.0, F.lit(3.0))
    m = table(spark, d, "supplier").select("s_suppkey", routing.applied(routing.matrix(6, 2), frame).alias("m"))
    return m.select("s_suppkey", F.round(F.get("m", F.lit(0)), 6).alias("l"), F.round(F.get("m", F.lit(1)), 6).alias("r"))


@query("select p_partkey, sha256(concat_ws(chr(31), md5(p_name), '13', '44100', concat('[{\"reverse\":{}},{\"saturate\":{\"drive\":', p_size, '}}]'))) as key from part")
def variant_key(spark, d):
    steps = F.concat(F.lit('[{"reverse":{}},{"saturate":{"drive":'), F.col("p_size").cast("string"), F.lit("}}]"))
    return table(spark, d, "part").select("p_partkey", scalar.variant_key(F.md5("p_name"), "13", 44100, steps).alias("key"))


@query("""select d.doc_id as sample_id, n.note as note from documents d cross join (select cast(unnest(range(60, 64)) as int) as note) n left join labels l on l.doc_id = d.doc_id and l.quality = n.note % 2 where l.doc_id is null""")
def missing_variants(spark, d):
    """Wanted variants (a document at four notes) that aren't there yet: only their keys are joined."""
    wanted = variants.requested(table(spark, d, "documents").select(F.col("doc_id").alias("sample_id"), F.md5("text").alias("audio_md5")), '[{"repitch":{}}]', notes=[60, 61, 62, 63])
    there = wanted.join(table(spark, d, "labels").select(F.col("doc_id").alias("sample_id"), "quality"), "sample_id").where("note % 2 = quality")
    return variants.missing(wanted, there).select("sample_id", "note")


@query("select l.doc_id from labels l where not (quality = 1 and toxic = 1)")
def invalidated_variants(spark, d):
    """Variants that stay when those with a stretch step go."""
    steps = F.array(F.lit("repitch"), F.when((F.col("quality") == 1) & (F.col("toxic") == 1), "stretch").otherwise("reverse"))
    return retention.without_step(table(spark, d, "labels").withColumn("steps", steps), "stretch").select("doc_id")


@query("select distinct o_custkey as sample_id, o_orderpriority as spec_hash from orders where (o_custkey, o_orderpriority) not in (select o_custkey, o_orderpriority from orders where o_orderstatus = 'F')")
def distinct_variants(spark, d):
    """What orders ask for, each variant once, less those that are being made (status F)."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("sample_id"), F.col("o_orderpriority").alias("spec_hash"), "o_orderstatus")
    return variants.missing(o, o.limit(0), o.where("o_orderstatus = 'F'")).select("sample_id", "spec_hash")


@query("select doc_id, quality from labels where doc_id not in (select doc_id from documents where n_chars < 1000)")
def cascade_delete(spark, d):
    """Variants whose sound was evicted go with it."""
    return variants.without_parents(table(spark, d, "labels"), table(spark, d, "documents").where("n_chars < 1000"), "doc_id").select("doc_id", "quality")


@query("select event_id, strftime(ts, '%Y-%m-%d_%H-%M-%S-%g') || '.wav' as file, strftime(ts, '%Y-%m-%d_%H-%M-%S-%g') || '.wav.analysis.json' as sidecar from events")
def file_names(spark, d):
    ts = F.col("ts").cast("timestamp")
    return table(spark, d, "events").select("event_id", scalar.file_name(ts).alias("file"), scalar.file_name(ts, ".wav" + sidecars.SUFFIX).alias("sidecar"))


KIT = """
assignments:
  - {name: kick, channel: 10, notes: 36, select: {where: {name: kick}}, process: [{saturate: {drive: {cc: 74, min: 0, max: 12}}}]}
  - {name: snares, channel: 10, notes: [38, 40], select: [{where: {name: snare}}, {where: {name: rim}, pick: 2}]}
  - {name: hats, channel: 10, notes: 42..44, select: {order: quietest}, process: [{filter_low: {freq: {cc: 71, min: 200, max: 9000, channel: 3}}}, reverse]}
  - {name: late, channel: 10, notes: [36, 50], select: {where: {reference: BD}}}
"""


@query("""with m as (select * from (values (36, 'late', 1), (38, 'snares', 1), (40, 'snares', 1), (42, 'hats', 1), (43, 'hats', 2), (44, 'hats', 3), (50, 'late', 2)) as m(note, assignment, pick))
 select event_id, assignment, pick from (select event_id, 36 + event_id % 16 as note from events) e join m using (note)""")
def note_lookup(spark, d):
    """Each event's note to its assignment and pick: of two for a note the last counts, notes of a list take their ranks."""
    picks = spec.note_map(spec.read_map(KIT)[0])
    e = table(spark, d, "events").select("event_id", F.lit(10).alias("channel"), (36 + F.col("event_id") % 16).cast("int").alias("note"))
    return plan.looked_up(e, picks).select("event_id", "assignment", "pick")


@query("select distinct p_brand as name from part where upper(p_brand) in (select upper('brand#' || n_nationkey) from nation)")
def reference_validation(spark, d):
    """Assignments (brands) whose reference exists, in whatever case; the whole assignment goes where it doesn't."""
    known = {f"BRAND#{r.n_nationkey}" for r in table(spark, d, "nation").select("n_nationkey").collect()}
    brands = sorted(r.p_brand for r in table(spark, d, "part").select("p_brand").distinct().collect())
    text = "assignments:\n" + "".join(f"  - {{name: '{b}', channel: 1, notes: 60, select: {{where: {{reference: '{b.lower()}'}}}}}}\n" for b in brands)
    return spark.createDataFrame([(a.name,) for a in spec.read_map(text, references=known)[0]], "name string")


@query("select * from (values (10, 74), (3, 71)) as c(channel, cc)")
def mapped_controllers(spark, d):
    """The controllers that a map's processors follow: their own channel, else the assignment's."""
    return spark.createDataFrame(sorted(spec.controllers_of(spec.read_map(KIT)[0])), "channel int, cc int")


@query("select cast(floor(epoch(ts) / 60) as bigint) as frame, round(sum(value * 0.5), 6) as mixed, count(*) as voices from events group by 1")
def voice_mix(spark, d):
    """Voices summed per frame; sums are taken where the voices are before anything is shuffled."""
    e = table(spark, d, "events").select(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60e6).cast("bigint").alias("frame"), "value", F.lit(0.5).alias("gain"))
    return routing.mixed(e, "frame", "value", "gain").withColumn("mixed", F.round("mixed", 6))


@query("""with t as (select c_nationkey as k, sum(greatest(c_acctbal, 0)) as v from customer group by 1), r as (select k, sum(v) over (order by k) as upto, sum(v) over () as whole, row_number() over (order by k) as n, count(*) over () as m from t),
 e as (select k, case when n = m then 1000 else 16 * n + cast(round_even((1000 - 16 * m) * (upto / whole), 0) as bigint) end as stop from r) select k, cast(stop - coalesce(lag(stop) over (order by k), 0) as int) as height from e""")
def stratum_heights(spark, d):
    """1000 pixels shared out by size, 16 at least each, adding up exactly."""
    t = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.sum(F.greatest("c_acctbal", F.lit(0.0))).alias("v"))
    g = t.agg(F.sort_array(F.collect_list(F.struct("k", "v"))).alias("g"))  # one row for each of a sound's bands
    h = g.select("g", scalar.stratum_heights(F.col("g.v"), 1000).alias("h")).select(F.explode(F.arrays_zip(F.col("g.k").alias("k"), F.col("h").alias("height"))).alias("z"))
    return h.select("z.k", "z.height")


@query("select k, cast(i as int) as i, cast(100 // n + case when i < 100 % n then 1 else 0 end as int) as height from (select r_regionkey as k, r_regionkey + 7 as n from region) cross join range(0, 12) t(i) where i < n")
def equal_heights(spark, d):
    """Where the least heights don't fit all are equal, the first a pixel more."""
    r = table(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.transform(F.sequence(F.lit(1), F.col("r_regionkey") + 7), lambda i: i * 1.0).alias("t"))
    return r.select("k", F.posexplode(scalar.stratum_heights(F.col("t"), 100)).alias("i", "height"))


@query(f"""with {SAMPLES} select sample_id, printf('%s %.2fs  tempo %.1f (%d onsets)  pitch %.1f Hz (%.2f)  rms %.3f', name, round(duration, 2), tempo_bpm, onset_count, dominant_pitch_hz, round(pitch_confidence, 2), round(rms, 3)) as text from samples""")
def described(spark, d):
    return library.described(samples(spark, d))


@query("""with c as (select p_partkey, p_size / 50.0e0 as sure, p_partkey % 14 - 1 as class, (p_partkey % 11) / 10.0e0 as centroid from part), h as (select *, sure >= 0.4 and class between 0 and 11 as own from c),
 v as (select *, case when own then class / 12.0e0 else 0.6 - 0.5 * centroid end as hue, case when own then 0.55e0 else 0.45e0 end as sat, case when own then 0.85e0 else 0.8e0 end as val from h),
 w as (select *, cast(floor(hue * 6) as int) % 6 as side, hue * 6 - floor(hue * 6) as f, val * (1 - sat) as p, val * (1 - sat * (hue * 6 - floor(hue * 6))) as q, val * (1 - sat * (1 - (hue * 6 - floor(hue * 6)))) as t from v),
 x as (select *, [val, q, p, p, t, val][side + 1] as r, [t, val, val, q, p, p][side + 1] as g, [p, p, t, val, val, q][side + 1] as b from w)
 select p_partkey, cast(case when own or centroid > 0 then round_even(255 * r, 0) else 180 end as int) as r, cast(case when own or centroid > 0 then round_even(255 * g, 0) else 180 end as int) as g, cast(case when own or centroid > 0 then round_even(255 * b, 0) else 200 end as int) as b from x""")
def accent_colour(spark, d):
    c = scalar.accent(F.col("p_size") / 50.0, F.col("p_partkey") % 14 - 1, F.col("p_partkey") % 11 / 10.0)
    a = table(spark, d, "part").select("p_partkey", c.alias("c"))
    return a.select("p_partkey", *(F.get("c", F.lit(i)).alias(n) for i, n in enumerate("rgb")))


@query("""with e as (select user_id, ts, case when ts > lag(ts) over (partition by user_id order by ts) + interval 6 hours then 1 when lag(ts) over (partition by user_id order by ts) is null then 1 else 0 end as new from events),
 s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as s from e) select user_id, count(*) as n, epoch_us(min(ts)) as start from s group by user_id, s""")
def session_counts(spark, d):
    """Sessions with gaps of under six hours, as a batch; streaming.detect.session_counts is the same with a watermark."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = e.groupBy("user_id", F.session_window("ts", "6 hours 1 microsecond").alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", "n", F.unix_micros("w.start").alias("start"))


@query(f"select s_suppkey, round({math.sqrt(2)!r} * s_acctbal, 6) as w, round(s_suppkey * 1.0e0, 6) as y, 5.0e0 as z, round(s_nationkey * 10.0e0, 6) as x from supplier")
def fuma_to_ambix(spark, d):
    """W, X, Y, Z of one convention to W, Y, Z, X of the other."""
    s = table(spark, d, "supplier")
    m = s.select("s_suppkey", routing.applied(routing.FUMA_TO_AMBIX, F.array(F.col("s_acctbal"), F.col("s_nationkey") * 10.0, F.col("s_suppkey") * 1.0, F.lit(5.0))).alias("m"))
    return m.select("s_suppkey", *(F.round(F.get("m", F.lit(i)), 6).alias(c) for i, c in enumerate("wyzx")))


@query(f"""with f as (select s_suppkey, s_acctbal as w, s_nationkey * 1.0e0 as y, 3.0e0 as z, s_suppkey * 1.0e0 as x from supplier), a as (select s_suppkey, w, {math.cos(0.3)!r} * y - {math.sin(0.3)!r} * z as y, {math.sin(0.3)!r} * y + {math.cos(0.3)!r} * z as z, x from f),
 b as (select s_suppkey, w, y, -{math.sin(0.2)!r} * x + {math.cos(0.2)!r} * z as z, {math.cos(0.2)!r} * x + {math.sin(0.2)!r} * z as x from a)
 select s_suppkey, round(w, 6) as w, round({math.cos(0.5)!r} * y + {math.sin(0.5)!r} * x, 6) as y, round(z, 6) as z, round({math.cos(0.5)!r} * x - {math.sin(0.5)!r} * y, 6) as x from b""")
def ambisonic_rotation(spark, d):
    """Turned about x, then y, then z."""
    f = F.array(F.col("s_acctbal"), F.col("s_nationkey") * 1.0, F.lit(3.0), F.col("s_suppkey") * 1.0)
    m = table(spark, d, "supplier").select("s_suppkey", routing.applied(routing.rotation(0.5, 0.2, 0.3), f).alias("m"))
    return m.select("s_suppkey", *(F.round(F.get("m", F.lit(i)), 6).alias(c) for i, c in enumerate("wyzx")))


@query(f"""select s_suppkey, round(s_acctbal / 2 + {math.sin(math.radians(30)) / math.sqrt(3) / 2!r} * s_nationkey + {math.cos(math.radians(30)) / math.sqrt(3) / 2!r} * s_suppkey, 6) as l,
 round(s_acctbal / 2 - {math.sin(math.radians(30)) / math.sqrt(3) / 2!r} * s_nationkey + {math.cos(math.radians(30)) / math.sqrt(3) / 2!r} * s_suppkey, 6) as r, round(s_acctbal / 2, 6) as lfe from supplier""")
def ambisonic_decode(spark, d):
    """To two speakers at 30 degrees and an LFE that gets W alone."""
    f = F.array(F.col("s_acctbal"), F.col("s_nationkey") * 1.0, F.lit(3.0), F.col("s_suppkey") * 1.0)
    m = table(spark, d, "supplier").select("s_suppkey", routing.applied(routing.decoder([(30, 0), (-30, 0), None]), f).alias("m"))
    return m.select("s_suppkey", *(F.round(F.get("m", F.lit(i)), 6).alias(c) for i, c in enumerate(("l", "r", "lfe"))))


@query("""with recursive p as (select user_id, list(t order by t, e) as s, list(t * 1.1e0 - e % 3 * 20000 order by t, e) as g from (select user_id, event_id as e, hour(ts) * 3600 + minute(ts) * 60.0e0 as t from events) group by 1),
 f as (select user_id, 1 as i, 0.0e0 as a, 0.0e0 as b, 0 as n, s, g from p union all select user_id, i + 1, case when s[i] > a and g[i] > b then s[i] else a end, case when s[i] > a and g[i] > b then g[i] else b end, n + case when s[i] > a and g[i] > b then 1 else 0 end, s, g from f where i <= len(s))
 select user_id, cast(max(n) + 2 as int) as points, round(max(a), 6) as last from f group by user_id""")
def time_map(spark, d):
    """Points of a stretch that rise in both source and target, with the two ends."""
    t = F.hour("ts") * 3600 + F.minute("ts") * 60.0
    e = table(spark, d, "events").select("user_id", F.struct(t.alias("t"), F.col("event_id").alias("e"), (t * 1.1 - F.col("event_id") % 3 * 20000).alias("g")).alias("s"))
    p = e.groupBy("user_id").agg(F.sort_array(F.collect_list("s")).alias("s"))
    m = p.select("user_id", grid.time_map(F.col("s.t"), F.col("s.g"), F.lit(90000.0), F.lit(99000.0)).alias("m"))
    return m.select("user_id", F.size("m").alias("points"), F.round(F.element_at("m", -2)["source"], 6).alias("last"))


@query("select p_partkey from part where case when p_size % 5 = 0 then 0 else 60 + 2 * p_size end > 0 and p_size >= 2")
def rhythmic_gate(spark, d):
    """Sounds with a tempo and two beats or more: those that can be put on a grid."""
    beats = F.transform(F.sequence(F.lit(1), F.col("p_size")), lambda i: i * 0.5)
    s = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 5 == 0, 0).otherwise(60 + 2 * F.col("p_size")).alias("tempo"), beats.alias("beats"))
    return s.where(scalar.rhythmic(F.col("tempo"), F.col("beats"))).select("p_partkey")


HALF = math.sqrt(0.5)
#: Gains that aren't on the diagonal: from, to, output, input (from 0), gain; and the layouts' sizes.
GAINS = [(2, 1, 0, 0, HALF), (2, 1, 0, 1, HALF), (4, 2, 0, 2, HALF), (4, 2, 1, 3, HALF), (6, 2, 0, 2, HALF), (6, 2, 1, 2, HALF), (6, 2, 0, 4, HALF), (6, 2, 1, 5, HALF), (6, 1, 0, 0, HALF), (6, 1, 0, 1, HALF), (6, 1, 0, 2, 1.0), (6, 1, 0, 4, 0.5), (6, 1, 0, 5, 0.5),
         (6, 4, 0, 2, HALF), (6, 4, 1, 2, HALF), (6, 4, 2, 4, 1.0), (6, 4, 3, 5, 1.0), (8, 2, 0, 2, HALF), (8, 2, 1, 2, HALF), (8, 2, 0, 4, HALF), (8, 2, 1, 5, HALF), (8, 2, 0, 6, HALF), (8, 2, 1, 7, HALF), (8, 6, 4, 6, HALF), (8, 6, 5, 7, HALF)]


@query(f"""with p as (select * from (values (2, 1), (4, 2), (6, 2), (6, 1), (6, 4), (8, 2), (8, 6), (1, 2), (2, 6), (6, 6)) as p(source, target)), g as (select * from (values {", ".join(map(str, GAINS))}) as g(source, target, o, i, gain)),
 a as (select source, target, cast(unnest(range(0, target)) as int) as o from p), b as (select source, target, o, cast(unnest(range(0, source)) as int) as i from a)
 select source, target, o, i, round(coalesce(cast(g.gain as double), case when o = i and (source, target) not in ((2, 1), (6, 1)) and not ((source, target) = (6, 4) and i > 1) then 1 else 0 end), 9) as gain from b left join g using (source, target, o, i)""")
def mix_matrices(spark, d):
    """Every layout to smaller and larger ones."""
    pairs = [(2, 1), (4, 2), (6, 2), (6, 1), (6, 4), (8, 2), (8, 6), (1, 2), (2, 6), (6, 6)]
    rows = [(a, b, o, i, round(float(g), 9)) for a, b in pairs for o, r in enumerate(routing.matrix(a, b)) for i, g in enumerate(r)]
    return spark.createDataFrame(rows, "source int, target int, o int, i int, gain double")


@query(f"""with s as (select s_suppkey, s_acctbal as l, s_nationkey * 1.0e0 as r from supplier) select s_suppkey, round(sqrt(0.75e0) * l, 6) as c1, 0.0e0 as c2, round(0.5e0 * r, 6) as c4, round(sqrt(0.75e0) * l * {HALF!r} + 0.5e0 * r * {HALF!r}, 6) as mono from s""")
def panned_and_routed(spark, d):
    """Stereo weighted three to one, sent to channels 4 and 1 of a device; and folded to mono."""
    frame = F.array(F.col("s_acctbal"), F.col("s_nationkey") * 1.0)
    pan = routing.pan_matrix(2, [3.0, 1.0])
    m = table(spark, d, "supplier").select("s_suppkey", routing.applied(routing.route(pan, [1, 4], 4), frame).alias("m"), routing.applied(routing.pan_matrix(2, [3.0, 1.0], 1), frame).alias("mono"))
    return m.select("s_suppkey", *(F.round(F.get("m", F.lit(i)), 6).alias(f"c{i + 1}") for i in (0, 1, 3)), F.round(F.get("mono", F.lit(0)), 6).alias("mono"))


@query("""with a as (select * from (values (2, 0, 45.0e0), (2, 1, -45.0e0), (6, 0, 30.0e0), (6, 1, -30.0e0), (6, 2, 0.0e0), (6, 3, null), (6, 4, 110.0e0), (6, 5, -110.0e0)) as a(n, o, az)),
 f as (select n, o, case when n = 2 then 2 else 5 end as active, radians(az) as az from a), r as (select n, o, 1.0e0 / active as w, coalesce(sin(az), 0) / sqrt(3) / active as y, coalesce(cos(az), 0) / sqrt(3) / active as x from f)
 select n, o, 'b_format_ambix' as format, round(w, 9) as w, round(y * cos(radians(20)) + x * -sin(radians(20)), 9) as y, 0.0e0 as z, round(y * sin(radians(20)) + x * cos(radians(20)), 9) as x from r
 union all select 1, 0, 'b_format_ambix', 1.0e0, 0.0e0, 0.0e0, 0.0e0 union all select 2, 0, 'pcm', 1.0e0, 0.0e0, round(sqrt(0.5e0), 9), 0.0e0 union all select 2, 1, 'pcm', 0.0e0, 1.0e0, 0.0e0, round(sqrt(0.5e0), 9)""")
def mix_by_format(spark, d):
    """Four channels are decoded, turned by 20 degrees, if they are ambisonic (W alone for one output), else mixed."""
    mixes = [("b_format_ambix", n) for n in (1, 2, 6)] + [("pcm", 2)]
    rows = [(n, o, f, *(round(float(g), 9) + 0.0 for g in row)) for f, n in mixes for o, row in enumerate(routing.mix_for(f, 4, n, turn=(20.0, 0.0, 0.0)))]
    return spark.createDataFrame(rows, "n int, o int, format string, w double, y double, z double, x double")


@query("""with b as (select * from (values (0, 0, 11), (1, 25, 44), (2, 50, 74)) as b(j, start, stop)), e as (select event_id, cast((row_number() over (partition by user_id order by ts, event_id) - 1) % 3 as int) as j from events)
 select event_id, cast(start as bigint) as start, cast(stop as bigint) as stop from e join b using (j)""")
def segments_in_turn(spark, d):
    """The segment of a variant that each event plays, one after the other for each user."""
    bounds = F.array(*(F.struct(F.lit(a).cast("bigint").alias("start"), F.lit(b).cast("bigint").alias("stop")) for a, b in ((0, 11), (25, 44), (50, 74))))
    e = retention.round_robin(table(spark, d, "events"), ["user_id"], 1 << 30, "ts", "event_id").withColumn("bounds", bounds)
    s = e.select("event_id", variants.segment_of(F.col("bounds"), "round_robin", F.col("turn_of")).alias("s"))
    return s.select("event_id", "s.start", "s.stop")


@query("""select * from (values (0, '[{"saturate":{"drive":0.0}},{"filter_low":{"freq":4600.0}},{"reverse":{}}]'), (1, '[{"saturate":{"drive":12.0}},{"filter_low":{"freq":4600.0}},{"reverse":{}}]'), (2, '[{"saturate":{"drive":6.0}},{"filter_low":{"freq":200.0}},{"reverse":{}}]')) as c(state, steps)""")
def controlled_steps(spark, d):
    """Steps whose parameters follow controllers, at three states: low, high, and none yet but another's of channel 3."""
    kick, hats = (a for a in spec.read_map(KIT)[0] if a.name in ("kick", "hats"))
    states = [{(10, 74): 0}, {(10, 74): 127}, {(3, 71): 0}]
    rows = [(i, variants.canonical(kick.process + hats.process, s, 10)) for i, s in enumerate(states)]
    return spark.createDataFrame(rows, "state int, steps string")


@query("""with w as (select p_partkey as sample_id, p_size % 3 as how from part), v as (select p_partkey as sample_id, 'exact' as h from part where p_partkey % 2 = 0 union all select p_partkey, 'base' from part where p_partkey % 3 = 0)
 select sample_id, case when sample_id % 2 = 0 then 'exact' when sample_id % 3 = 0 then 'base' end as found from w""")
def served_variants(spark, d):
    """Each sound's variant, else its base, else none."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("sample_id"))
    there = p.where("sample_id % 2 = 0").withColumn("spec_hash", F.lit("exact")).union(p.where("sample_id % 3 = 0").withColumn("spec_hash", F.lit("base")))
    return variants.served(p.withColumn("spec_hash", F.lit("exact")), there, "base").select("sample_id", "found")


@query("select p_partkey as sample_id, p_size % 3 <> 0 and p_size % 3 <> 1 as stays, p_size % 3 = 0 as again from part")
def tempo_change(spark, d):
    """Stretched variants are made again for a new tempo, padded ones go, others stay."""
    step = F.when(F.col("p_size") % 3 == 0, "stretch_quantize").when(F.col("p_size") % 3 == 1, "pad_quantize").otherwise("reverse")
    v = table(spark, d, "part").select(F.col("p_partkey").alias("sample_id"), F.col("p_name").alias("spec_hash"), F.array(F.lit("saturate"), step).alias("steps"))
    stays, again = variants.after_tempo_change(v)
    out = v.select("sample_id").join(stays.select("sample_id", F.lit(True).alias("stays")), "sample_id", "left").join(again.select("sample_id", F.lit(True).alias("again")), "sample_id", "left")
    return out.select("sample_id", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("stays", "again")))


@query("with r as (select p_partkey, sum(p_size) over (order by p_partkey desc) as s from part) select p_partkey from r where s <= 10000")
def variants_on_disk(spark, d):
    """The most recently used that fit a budget on disk."""
    v = table(spark, d, "part").select("p_partkey", F.col("p_partkey").alias("last_used"), F.col("p_size").alias("bytes"))
    return variants.on_disk(v, 10_000).select("p_partkey")


@query("select p_partkey as sample_id, spec, case spec when 'a' then '[{\"reverse\":{}}]' else '[{\"saturate\":{\"drive\":' || case when p_size % 2 = 0 then '6.0' else '3.0' end || '}}]' end as steps from part cross join (values ('a'), ('b')) as s(spec)")
def stored_variants(spark, d):
    """Appended in two batches, by the key's first digits, and read back by key."""
    from sonoframe.operators.shared import shared_folder

    path = f"{shared_folder(spark)}/variants-{uuid.uuid4().hex}"
    p = table(spark, d, "part").select(F.col("p_partkey").alias("sample_id"), "p_size")
    drive = F.when(F.col("p_size") % 2 == 0, "6.0").otherwise("3.0")
    for name, steps in (("a", F.lit('[{"reverse":{}}]')), ("b", F.concat(F.lit('[{"saturate":{"drive":'), drive, F.lit("}}]")))):
        variants.append(p.select("sample_id", F.lit(name).alias("spec"), steps.alias("steps"), F.sha2(F.concat(F.col("sample_id").cast("string"), F.lit(name)), 256).alias("spec_hash")), path)
    return spark.read.parquet(path).where("prefix = substring(spec_hash, 1, 2)").select("sample_id", "spec", "steps")
