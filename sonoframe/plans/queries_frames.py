"""Queries over frames, windows, retention and lookups: the events table as streams of frames, one per user."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonoframe.operators import frames, retention
from sonoframe.operators.detector import Detector, ambient, ordered, segments
from sonoframe.plans.registry import ORACLE_SQL, query, table

NUMBERED = "f as (select user_id, row_number() over (partition by user_id order by ts, event_id) - 1 as i, value, ts, event_type, event_id from events)"


def numbered(spark: SparkSession, d: str) -> DataFrame:
    """A user's events in the SQL's order, where what has no time comes last."""
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "value", "event_type")
    order = [F.asc_nulls_last(c) for c in ("ts", "event_id")]
    return e.withColumn("i", (F.row_number().over(Window.partitionBy("user_id").orderBy(*order)) - 1).cast("bigint"))


@query(f"""with {NUMBERED}, w as (select user_id, i // 4 as w, sqrt(avg(value * value)) as r, count(*) as n from f group by 1, 2), q as (select user_id, quantile_cont(r, 0.05) as q from w where n = 4 group by 1),
 l as (select user_id, max(abs(value)) as peak, sqrt(avg(value * value)) as rms from f group by 1)
 select user_id, round(peak, 6) as peak, round(rms, 6) as rms, round(peak / rms, 6) as crest_factor, round(20 * log10(peak / rms), 6) as crest_factor_db, round(coalesce(q, rms), 6) as noise_floor from l left join q using (user_id)""")
def level_stats(spark, d):
    out = frames.levels(numbered(spark, d), "user_id", "i", "value", 4)
    return out.select("user_id", *(F.round(c, 6).alias(c) for c in out.columns[1:]))


@query(f"""with {NUMBERED}, t as (select *, max(value) over (partition by user_id) as top from f),
 g as (select user_id, min(case when value = top then i end) as p, min(case when value >= 0.1 * top then i end) as a, max(case when value >= 0.1 * top then i end) as b from t group by user_id),
 s as (select user_id, (p - a) * 0.02e0 as x, (b - p) * 0.02e0 as y from g)
 select user_id, round(case when x <= 0.001 then 0 when x >= 2 then 1 else ln(x / 0.001) / ln(2000) end, 6) as attack, round(case when y <= 0.001 then 0 when y >= 2 then 1 else ln(y / 0.001) / ln(2000) end, 6) as release from s""")
def attack_release(spark, d):
    out = frames.attack_release(numbered(spark, d), "user_id", "i", "value", 0.02)
    return out.select("user_id", F.round("attack", 6).alias("attack"), F.round("release", 6).alias("release"))


@query("""with b as (select user_id, cast(hour(ts) + 1 as double) * 40 as hz, 10 * log10(value + 1) as db from events),
 s as (select user_id, regr_slope(db, log2(hz)) as s from b group by user_id)
 select user_id, round(coalesce(greatest(least((s + 6) / 8, 1), 0), 0.5), 6) as slope from s""")
def spectral_slope(spark, d):
    b = table(spark, d, "events").select("user_id", ((F.hour("ts") + 1) * 40.0).alias("hz"), (10 * F.log10(F.col("value") + 1)).alias("db"))
    out = frames.slope(b, "user_id", "hz", "db")
    return out.select("user_id", F.round("slope", 6).alias("slope"))


@query(f"""with {NUMBERED}, r as (select user_id, i // 5 as slot, sqrt(avg(value * value)) as rms, count(*) as n from f group by 1, 2), k as (select * from r where n = 5 or slot = 0), m as (select *, max(rms) over (partition by user_id) as top from k)
 select user_id, cast(slot as int) as slot, round(rms / top, 6) as energy from m""")
def grid_energy_profile(spark, d):
    from sonoframe.operators.grid import energy_profile

    return energy_profile(numbered(spark, d), "user_id", "i", "value", 5).select("user_id", F.posexplode("energy").alias("slot", "energy")).withColumn("energy", F.round("energy", 6))


@query(f"""with {NUMBERED}, c as (select *, count(*) over (partition by user_id) as n from f), b as (select user_id, value,
 case when i < (n % 8) * (n // 8 + 1) then i // (n // 8 + 1) else n % 8 + (i - (n % 8) * (n // 8 + 1)) // greatest(n // 8, 1) end as bin from c)
 select user_id, cast(bin as bigint) as bin, min(value) as low, max(value) as high from b group by 1, 2""")
def envelope_minmax(spark, d):
    return frames.envelope(numbered(spark, d), "user_id", "i", "value", 8)


@query("select user_id, event_type, round(sqrt(avg(value * value)), 6) as rms from events group by 1, 2")
def chunk_rms(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.round(frames.rms("value"), 6).alias("rms"))


@query("""with b as (select user_id, cast(hour(ts) as double) * 800 as hz, value * value as p from events), s as (select user_id, sum(case when hz >= 20 and hz < 250 then p else 0 end) as b0, sum(case when hz >= 250 and hz < 2000 then p else 0 end) as b1,
 sum(case when hz >= 2000 and hz < 6000 then p else 0 end) as b2, sum(case when hz >= 6000 and hz < 20000 then p else 0 end) as b3, sum(p) as t from b group by user_id)
 select user_id, round(b0 / t, 6) as b0, round(b1 / t, 6) as b1, round(b2 / t, 6) as b2, round(b3 / t, 6) as b3 from s""")
def band_energy(spark, d):
    b = table(spark, d, "events").select("user_id", (F.hour("ts") * 800.0).alias("hz"), (F.col("value") * F.col("value")).alias("p"))
    out = frames.band_shares(b, "user_id", "hz", "p")
    return out.select("user_id", *(F.round(c, 6).alias(c) for c in out.columns[1:]))


@query(f"""with {NUMBERED} select user_id, i, round(case when count(*) over w = 4 then avg(value) over w else 0 end, 6) as moving from f window w as (partition by user_id order by i rows between current row and 3 following)""")
def moving_mean(spark, d):
    return frames.moving_mean(numbered(spark, d), "user_id", "i", "value", 4).select("user_id", "i", F.round("moving", 6).alias("moving"))


@query(f"""with {NUMBERED}, q as (select user_id, i, floor(value / 50) as v from f), n as (select *, case when v is distinct from lag(v) over (partition by user_id order by i) then 1 else 0 end as new from q),
 r as (select *, sum(new) over (partition by user_id order by i) as run from n), g as (select user_id, run, min(i) as a, max(i) as b, min(v) as v from r group by 1, 2),
 x as (select *, lag(v) over (partition by user_id order by run) as p, lead(v) over (partition by user_id order by run) as nx from g) select user_id, cast((a + b) // 2 as bigint) as peak_at, cast(v as bigint) as peak from x where v > p and v > nx""")
def local_maxima(spark, d):
    f = numbered(spark, d).select("user_id", "i", F.floor(F.col("value") / 50).alias("v"))
    return frames.local_maxima(f, "user_id", "i", "v")


@query(f"""with {NUMBERED}, o as (select user_id, i, max(case when value >= 400 then i end) over (partition by user_id order by i) as last from f) select user_id, i, coalesce(i - last <= 2, false) as open from o""")
def hold_gate(spark, d):
    return frames.hold_gate(numbered(spark, d), "user_id", "i", "value", 400, 2).select("user_id", "i", "open")


@query(f"""with {NUMBERED}, g as (select user_id, min(i) as lo, max(i) as hi, min(case when value >= 450 then i end) as a, max(case when value >= 450 then i end) as b from f group by 1)
 select user_id, greatest(coalesce(a - 2, lo), lo) as start, least(coalesce(b + 3, hi), hi) + 1 as stop from g""")
def trim_bounds(spark, d):
    return frames.trim(numbered(spark, d), "user_id", "i", "value", 450, 2, 3)


@query("""with o as (select user_id, epoch(ts) as t from events), p as (select distinct user_id, t from o), l as (select user_id, t, lag(t) over (partition by user_id order by t) as b from p)
 select user_id, round(t, 3) as t, round(greatest(t - 3600, coalesce((t + b) / 2, 0)), 3) as earliest from l""")
def onset_midpoint(spark, d):
    o = table(spark, d, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t")).distinct()
    out = frames.refine_onsets(o, "user_id", "t", 3600)
    return out.select("user_id", F.round("t", 3).alias("t"), F.round("earliest", 3).alias("earliest"))


@query(f"""with {NUMBERED}, s as (select user_id, i, max(i) over (partition by user_id) + 1 as e from f where i % 7 = 0) select user_id, i as start, coalesce(lead(i) over (partition by user_id order by i), e) as stop from s""")
def segment_bounds(spark, d):
    f = numbered(spark, d).where("i % 7 = 0").withColumn("e", F.max("i").over(Window.partitionBy("user_id")) + 1)
    return frames.segments_of(f, "user_id", "i", "e").select("user_id", F.col("i").alias("start"), "stop")


@query("""with r as (select doc_id, n_chars, sum(n_chars) over (order by doc_id desc) as s from documents) select doc_id, n_chars from r where s <= 400000 or doc_id = (select max(doc_id) from documents)""")
def fifo_budget(spark, d):
    return retention.newest_within(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars", 400_000)


@query("""with r as (select source, doc_id, n_chars, sum(n_chars) over (partition by source order by doc_id desc) as s, row_number() over (partition by source order by doc_id desc) as n from documents) select source, doc_id from r where s <= 30000 or n = 1""")
def fifo_budget_by_bank(spark, d):
    return retention.newest_within(table(spark, d, "documents").select("source", "doc_id", "n_chars"), "doc_id", "n_chars", 30_000, "source").select("source", "doc_id")


@query("""with p as (select o_custkey, min(o_orderkey) as first, sum(cast(o_totalprice as bigint)) as size from orders group by 1), r as (select o_custkey, sum(size) over (order by first desc) as s from p)
 select o.o_orderkey, o.o_custkey from orders o join r using (o_custkey) where s <= 300000000""")
def family_eviction(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.round("o_totalprice").cast("bigint").alias("size"))
    return retention.families_within(o, "o_custkey", "o_orderkey", "size", 300_000_000).drop("size")


@query("select user_id, event_type, arg_max(value, (ts, event_id)) as value from events group by 1, 2")
def latest_cc(spark, d):
    return retention.latest(table(spark, d, "events"), ["user_id", "event_type"], "value", "ts", "event_id")


@query("""with l as (select user_id, event_type, arg_max(value, (ts, event_id)) as v from events group by 1, 2), u as (select distinct user_id from events)
 select u.user_id, round(coalesce(20 + (cast(floor(l.v) as bigint) % 128) / 127.0e0 * 180, 110), 6) as parameter from u left join l on l.user_id = u.user_id and l.event_type = 'purchase'""")
def controller_parameter(spark, d):
    from sonoframe.functions.scalar import controller

    e = table(spark, d, "events")
    now = retention.latest(e, ["user_id", "event_type"], "value", "ts", "event_id").where("event_type = 'purchase'").select("user_id", "value")
    out = e.select("user_id").distinct().join(now, "user_id", "left")
    return out.select("user_id", F.round(controller(F.pmod(F.floor("value").cast("bigint"), F.lit(128)), 20, 200), 6).alias("parameter"))


@query("select doc_id, text from documents where doc_id not in (select doc_id from labels)")
def anti_known(spark, d):
    """Sounds (documents) that no record (label) knows yet."""
    return retention.unknown(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "labels"), "doc_id")


@query("""with a as (select n_name as name, 1 as library from nation), b as (select r_name as name, 2 as library from region) select * from a union all select * from b where name not in (select name from a)""")
def merged_libraries(spark, d):
    a = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.lit(1).alias("library"))
    b = table(spark, d, "region").select(F.col("r_name").alias("name"), F.lit(2).alias("library"))
    return retention.merged(a, b, "name")


@query("select event_id, cast((row_number() over (partition by user_id, event_type order by ts, event_id) - 1) % 4 as int) as turn_of from events")
def round_robin(spark, d):
    return retention.round_robin(table(spark, d, "events"), ["user_id", "event_type"], 4, "ts", "event_id").select("event_id", "turn_of")


@query("select count(*) as n, cast(sum(n_chars) as bigint) as bytes, round((1 - sum(n_chars) / 100000000.0e0) * 100, 6) as free from documents")
def memory_accounting(spark, d):
    return retention.usage(table(spark, d, "documents"), "n_chars", 100_000_000).withColumn("free", F.round("free", 6))


@query("select p_partkey, coalesce(l.q, p.p_size) as used from part p left join (select l_partkey, max(l_linenumber) as q from lineitem where l_quantity > 45 group by 1) l on l_partkey = p_partkey")
def dispatch_fallback(spark, d):
    q = table(spark, d, "lineitem").where("l_quantity > 45").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_linenumber").alias("q"))
    return table(spark, d, "part").join(q, "p_partkey", "left").select("p_partkey", retention.first_available("q", "p_size").alias("used"))


@query("""with o as (select user_id, list(value order by ts, event_id) as v from events group by 1)
 select user_id, round(list_reduce(v[2:], lambda a, r: 0.1 * r + 0.9 * a, greatest(v[1], 1e-6)), 6) as ambient from o""")
def ambient_ema(spark, d):
    o = ordered(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value")
    return o.select("user_id", F.round(ambient(F.col("chunks"), 0.1), 6).alias("ambient"))


#: The SQL's ambient level starts at a stream's first value and at no later one.
DETECTOR = Detector(snr_db=3.0, alpha=0.1, hold=2, warm_up=1, longest=8, chunk=1, anew=False)


@query("""with recursive e as (select user_id, row_number() over (partition by user_id order by ts, event_id) as n, value as r from events),
 s as (select user_id, n, 1 as mode, greatest(r, 1e-6) as ambient, 0 as hold, cast(0 as bigint) as start, cast(null as bigint) as a, cast(null as bigint) as b from e where n = 1
  union all select user_id, n, case when mode = 1 then case when loud then 2 else 1 end when n - start >= 8 then 1 when loud then 2 when hold <= 1 then 1 else 2 end,
   heard, case when loud then 2 else hold - 1 end, case when mode = 1 then n - 1 else start end,
   case when mode = 2 and (n - start >= 8 or (not loud and hold <= 1)) then start end, case when mode = 2 and (n - start >= 8 or (not loud and hold <= 1)) then n end
  from (select *, 20 * log10(r / greatest(heard, 1e-6)) >= 3 and r > 1e-6 as loud from (select e.user_id, e.n, e.r, s.mode, s.hold, s.start, case when s.mode = 2 then s.ambient else 0.1 * e.r + 0.9 * s.ambient end as heard from s join e on e.user_id = s.user_id and e.n = s.n + 1)))
 select user_id, a as start, b as stop from s where a is not null""")
def segment_detect(spark, d):
    return segments(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value", DETECTOR)


@query(ORACLE_SQL["segment_detect"])
def segment_detect_stream(spark, d):
    """The same detector as a stream over the same chunks; tests/test_detector.py holds it against segment_detect."""
    from sonoframe.streaming.detect import segments as streamed
    from sonoframe.streaming.sinks import run_once

    schema = table(spark, d, "events").schema
    chunks = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    out = streamed(chunks.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id", "value"), DETECTOR, "user_id", ("at", "event_id"), "value")
    return run_once(out, "segments")
