"""Queries on sounds as samples: an embedding is a sound of 64 frames at 1000 Hz, run through the processors and analysis."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonoframe.functions import analysis, dsp
from sonoframe.plans.registry import query, table
from sonoframe.sources import audio

RATE = 1000
SOUNDS = "s as (select vec_id, unnest(range(0, 64)) as i, cast(unnest(embedding) as double) as v from embeddings)"
PEAK = "p as (select vec_id, max(abs(v)) as peak from s group by vec_id)"


def sounds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"))


def through(df: DataFrame, f: Callable[[np.ndarray], np.ndarray], kind: str = "double", digits: int = 6) -> DataFrame:
    """(vec_id, i, y): the frames of f(x) for each sound x (frames x 1)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"vec_id": batch.vec_id, "y": [np.asarray(f(np.array(x)[:, None])).reshape(-1).tolist() for x in batch.x]})

    out = df.mapInPandas(run, f"vec_id bigint, y array<{kind}>").select("vec_id", F.posexplode("y").alias("i", "y")).withColumn("i", F.col("i").cast("bigint"))
    return out.withColumn("y", F.round("y", digits)) if kind == "double" else out


@query(f"with {SOUNDS} select vec_id, 63 - i as i, round(v, 6) as y from s")
def reversed_sound(spark, d):
    return through(sounds(spark, d), lambda x: dsp.reverse(x, RATE))


@query(f"with {SOUNDS} select vec_id, i, round(tanh(v * {dsp.db(9.0)!r}) / tanh({dsp.db(9.0)!r}), 6) as y from s")
def saturated_sound(spark, d):
    return through(sounds(spark, d), lambda x: dsp.saturate(x, RATE, drive=9.0))


def distorted(wet: str) -> str:
    return f"""with {SOUNDS}, {PEAK}, w as (select vec_id, i, {wet} as w from s), t as (select vec_id, max(abs(w)) as top from w group by vec_id)
 select vec_id, i, round(w * peak / top, 6) as y from w join t using (vec_id) join p using (vec_id)"""


@query(distorted(f"greatest(least(v * {dsp.db(18.0)!r}, 1), -1)"))
def distort_clip(spark, d):
    return through(sounds(spark, d), lambda x: dsp.distort(x, RATE, "hard_clip", drive=18.0, tone=1.0))


@query(distorted(f"abs((v * {dsp.db(18.0)!r} + 1) - 4 * floor((v * {dsp.db(18.0)!r} + 1) / 4) - 2) - 1"))
def distort_fold(spark, d):
    return through(sounds(spark, d), lambda x: dsp.distort(x, RATE, "fold", drive=18.0, tone=1.0))


@query(distorted(f"round_even(v * {dsp.db(6.0)!r} * 8, 0) / 8"))
def distort_crush(spark, d):
    return through(sounds(spark, d), lambda x: dsp.distort(x, RATE, "bit_crush", drive=6.0, tone=1.0, bits=3))


@query(distorted("first_value(v) over (partition by vec_id, i // 5 order by i)").replace("over (partition", "over (partition"))
def distort_downsample(spark, d):
    return through(sounds(spark, d), lambda x: dsp.distort(x, RATE, "downsample", drive=0.0, tone=1.0, factor=5))


@query(f"""with {SOUNDS}, {PEAK}, w as (select vec_id, i, greatest(least(v * {dsp.db(18.0)!r}, 1), -1) as w, v from s), t as (select vec_id, max(abs(w)) as top from w group by vec_id)
 select vec_id, i, round(0.25 * w * peak / top + 0.75 * v, 6) as y from w join t using (vec_id) join p using (vec_id)""")
def distort_mix(spark, d):
    return through(sounds(spark, d), lambda x: dsp.distort(x, RATE, "hard_clip", drive=18.0, tone=1.0, mix=0.25))


def ballistics(target: str, fast: float, slow: float, first: str = "0.0e0") -> str:
    """SQL: g follows the column t of target (vec_id, i, t) at the pace of fast ms downwards and slow ms upwards."""
    a, b = (float(np.exp(-1 / max(RATE * ms / 1000, 1e-9))) for ms in (fast, slow))
    step = lambda g: f"t.t + case when t.t < {g} then {a!r} else {b!r} end * ({g} - t.t)"
    return f"""t as ({target}), g as (select t.vec_id, t.i, {step(first)} as g from t where i = 0 union all select t.vec_id, t.i, {step("g.g")} as g from g join t on t.vec_id = g.vec_id and t.i = g.i + 1)"""


def over(threshold: float, knee: float) -> str:
    o = f"(20 * log10(greatest(abs(v), 1e-10)) - ({threshold}))"
    return f"case when {o} <= -{knee / 2} then 0 when {o} < {knee / 2} then ({o} + {knee / 2}) * ({o} + {knee / 2}) / (2 * {max(knee, 1e-10)}) else {o} end"


@query(f"with recursive {SOUNDS}, {ballistics(f'select vec_id, i, -(1 - 1 / 4.0e0) * {over(-24.0, 6.0)} as t from s', 2.0, 10.0)} select vec_id, i, round(v * pow(10, (g + 3) / 20), 6) as y from s join g using (vec_id, i)")
def compressed(spark, d):
    return through(sounds(spark, d), lambda x: dsp.compress(x, RATE, threshold=-24.0, ratio=4.0, attack=2.0, release=10.0, knee=6.0, makeup=3.0))


@query(f"""with recursive {SOUNDS}, {PEAK}, o as (select vec_id, i, v, 20 * log10(greatest(abs(v), 1e-10)) - (20 * log10(peak + 1e-10) - 6) as o from s join p using (vec_id)),
 {ballistics("select vec_id, i, -(1 - 1 / 2.0e0) * case when o <= -3 then 0 when o < 3 then (o + 3) * (o + 3) / 12 else o end as t from o", 23.75, 97.5)} select vec_id, i, round(v * pow(10, g / 20), 6) as y from s join g using (vec_id, i)""")
def compressed_by_analysis(spark, d):
    """Threshold from the peak, times from the spectral attack and release."""
    return through(sounds(spark, d), lambda x: dsp.compress(x, RATE, ratio=2.0, analysis={"attack": 0.215517241379310345, "release": 0.25}))


@query(f"""with recursive {SOUNDS}, a as (select vec_id, i, coalesce(lead(v, 2) over (partition by vec_id order by i), last_value(v) over (partition by vec_id order by i rows between unbounded preceding and unbounded following)) as v from s),
 {ballistics(f'select vec_id, i, -(1 - 1 / 100.0e0) * {over(-18.0, 0.0)} as t from a', 0.01, 5.0)} select vec_id, i, round(v * pow(10, g / 20), 6) as y from s join g using (vec_id, i)""")
def limited(spark, d):
    return through(sounds(spark, d), lambda x: dsp.limit(x, RATE, threshold=-18.0, release=5.0, lookahead=2.0))


@query(f"""with recursive {SOUNDS}, o as (select vec_id, i, max(case when 20 * log10(abs(v) + 1e-10) >= -16 then i end) over (partition by vec_id order by i) as last from s),
 w as (select vec_id, i, case when i - last <= 2 then 0.0e0 else -1.0e0 end as t from o), {ballistics("select * from w", 3.0, 1.0, "t.t")}
 select vec_id, i, round(coalesce(lag(v) over (partition by vec_id order by i), 0) * (1 + g), 6) as y from s join g using (vec_id, i)""")
def gated(spark, d):
    return through(sounds(spark, d), lambda x: dsp.gate(x, RATE, threshold=-16.0, attack=1.0, release=3.0, hold=2.0, lookahead=1.0))


@query(f"""with {SOUNDS}, {PEAK}, o as (select vec_id, min(i) as o from s join p using (vec_id) where abs(v) > 0.1 * peak group by vec_id)
 select vec_id, i, round(v * case when i < o then 0 when i < o + 10 then (i - o) / 9.0e0 when i < o + 15 then 1 when i < o + 25 then 1 - 0.5 * (i - o - 15) / 9.0e0 when i < 49 then 0.5
  else (1 - (i - greatest(49, o + 25)) / greatest(63.0e0 - greatest(49, o + 25), 1)) end, 6) as y from s join o using (vec_id)""")
def reshaped(spark, d):
    return through(sounds(spark, d), lambda x: dsp.reshape(x, RATE, attack=10.0, hold=5.0, decay=10.0, sustain=0.5, release=15.0))


@query(f"""with {SOUNDS}, m as (select vec_id, arg_max(i, (abs(v), -i)) as m from s group by vec_id)
 select vec_id, i, round(v * case when i < greatest(m, 44) then 1 else 1 - (i - greatest(m, 44)) / greatest(63.0e0 - greatest(m, 44), 1e-9) end, 6) as y from s join m using (vec_id)""")
def reshaped_tail(spark, d):
    """The release alone: everything up to the peak, and up to 20 ms before the end, stays."""
    return through(sounds(spark, d), lambda x: dsp.reshape(x, RATE, release=20.0, attacks=[0.0]))


def filtered(*sections: np.ndarray) -> str:
    """SQL: second-order sections one after the other, each in its transposed form from frame to frame."""
    parts, source = [SOUNDS], "s"
    for n, c in enumerate(sections):
        b0, b1, b2, a1, a2 = (repr(float(v)) for v in c)
        state = lambda v, z1, z2: f"{b0} * {v} + {z1} as y, {b1} * {v} - {a1} * ({b0} * {v} + {z1}) + {z2} as z1, {b2} * {v} - {a2} * ({b0} * {v} + {z1}) as z2"  # noqa: B023, E731
        parts.append(f"f{n} as (select vec_id, i, {state('v', '0', '0')} from {source} where i = 0 union all select s.vec_id, s.i, {state('s.v', 'f.z1', 'f.z2')} from f{n} f join {source} s on s.vec_id = f.vec_id and s.i = f.i + 1)")
        parts.append(f"y{n} as (select vec_id, i, y as v from f{n})")
        source = f"y{n}"
    return f"with recursive {', '.join(parts)} select vec_id, i, round(v, 6) as y from {source}"


def butterworth(kind: str, hz: float) -> np.ndarray:
    """The textbook second-order section, from its closed form."""
    k, q = np.tan(np.pi * hz / RATE), np.sqrt(2)
    n = 1 + q * k + k * k
    b = np.array([k * k, 2 * k * k, k * k]) if kind == "low" else np.array([1.0, -2.0, 1.0])
    return np.concatenate([b, [2 * (k * k - 1), 1 - q * k + k * k]]) / n


@query(filtered(butterworth("low", 120.0)))
def low_passed(spark, d):
    return through(sounds(spark, d), lambda x: dsp.filter_low(x, RATE, freq=120.0))


@query(filtered(butterworth("high", 90.0)))
def high_passed(spark, d):
    return through(sounds(spark, d), lambda x: dsp.filter_high(x, RATE, freq=90.0))


@query(filtered(dsp.high_shelf(200.0, 4.0, RATE)))
def shelved(spark, d):
    return through(sounds(spark, d), lambda x: dsp.sos(x, [dsp.high_shelf(200.0, 4.0, RATE)]))


@query(f"""with {SOUNDS}, m as (select * from (values (0, 11, 10), (25, 19, 21), (50, 24, 40)) as m(goal, n, src)), g as (select vec_id, goal + i - src as i, v from s join m on i >= src and i < src + n)
 select o.vec_id, o.i, round(coalesce(g.v, 0), 6) as y from (select vec_id, unnest(range(0, 74)) as i from embeddings) o left join g on g.vec_id = o.vec_id and g.i = o.i""")
def pad_quantized(spark, d):
    """Attacks at 10, 21 and 40 ms put on a grid of 25 ms: the second and the third are moved, with silence between."""
    return through(sounds(spark, d), lambda x: dsp.pad_quantize(x, RATE, tempo=600, grid=16, attacks=[0.010, 0.021, 0.040]))


@query(f"with {SOUNDS} select vec_id, i, cast(greatest(least(round_even(greatest(least(v * 3, 1), -1) * 32768, 0), 32767), -32768) as bigint) as y from s")
def stored_pcm(spark, d):
    return through(sounds(spark, d), lambda x: audio.to_pcm(x * 3, 16), "bigint")


@query(f"with {SOUNDS} select vec_id, i, cast(trunc(greatest(least(v * 3, 1), -1) * 8388607) as bigint) as y from s")
def device_pcm(spark, d):
    """To a device's 24 bits and read back from its bytes."""
    return through(sounds(spark, d), lambda x: audio.unpack(audio.for_device(x * 3, 24), 24, 1).astype(np.int64) >> 8, "bigint")


@query(f"with {SOUNDS} select vec_id, i, round(cast(greatest(least(round_even(v * 8388608, 0), 8388607), -8388608) as bigint) / 8388608.0e0, 6) as y from s")
def pcm_round_trip(spark, d):
    """24 bits packed to three bytes each, unpacked, and as numbers of -1 to 1 again."""
    return through(sounds(spark, d), lambda x: audio.to_float(audio.unpack(audio.pack24(audio.to_pcm(x, 24)), 24, 1)).astype(np.float64))


@query("""with r as (select o_orderkey, (o_orderkey * 7919) % 4294967296 - 2147483648 as v from orders) select o_orderkey, v, (v >> 8) * 256 as kept, (v % 65536 + 98304) % 65536 - 32768 as low from r""")
def unpacked_pcm(spark, d):
    """32-bit frames as they are, by their upper 24 and by their lower 16 bits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            v = ((batch.o_orderkey.to_numpy() * 7919) % (1 << 32) - (1 << 31)).astype(np.int32)
            whole = audio.unpack(v.astype("<i4").tobytes(), 32, 1)[:, 0]
            kept = audio.unpack(audio.pack24(v), 24, 1)[:, 0]
            low = audio.unpack(v.view(np.uint32).astype("<u2").tobytes(), 16, 1)[:, 0]
            yield pd.DataFrame({"o_orderkey": batch.o_orderkey, "v": whole.astype(np.int64), "kept": kept.astype(np.int64), "low": low.astype(np.int64)})

    return table(spark, d, "orders").select("o_orderkey").mapInPandas(run, "o_orderkey bigint, v bigint, kept bigint, low bigint")


@query(f"""with {SOUNDS}, m as (select vec_id, i, round_even(v * 32768, 0) / 32768 as v from s), l as (select vec_id, min(case when abs(v) >= 0.2 then i end) as a, max(case when abs(v) >= 0.2 then i end) as b from m group by 1),
 k as (select m.vec_id, m.v, m.i, greatest(coalesce(a - 3, 0), 0) as x, least(coalesce(b + 5, 63), 63) as z, coalesce(a, 0) as a, coalesce(b, 63) as b from m join l using (vec_id))
 select vec_id, i - x as i, round(case when i < a and a > x then v * (1 - cos(pi() * (i - x) / greatest(a - x, 1))) / 2 when i > b and z > b then v * (1 - cos(pi() * (z - i) / greatest(z - b, 1))) / 2 else v end, 6) as y from k where i between x and z""")
def trimmed_sound(spark, d):
    """Silence cut off both ends, with fades over what is kept of it."""
    return through(sounds(spark, d), lambda x: audio.trim(np.rint(x * 32768) / 32768, 0.2, 3, 5))


# ---------------------------------------------------------------- analysis

#: Power of each of 33 frequencies in six frames of 64 under a Hann window, 16 apart, over the sound with 32 zeros before it.
SPECTRA = f"""{SOUNDS}, f as (select vec_id, f, i - 16 * f + 32 as t, v from s cross join (select unnest(range(0, 6)) as f) where i - 16 * f + 32 between 0 and 63),
 w as (select k, t, (0.5 - 0.5 * cos(2 * pi() * t / 64)) * cos(2 * pi() * k * t / 64) as c, (0.5 - 0.5 * cos(2 * pi() * t / 64)) * sin(2 * pi() * k * t / 64) as d from (select unnest(range(0, 33)) as k) cross join (select unnest(range(0, 64)) as t)),
 b as (select vec_id, f, k, k * 15.625e0 as hz, pow(sum(v * c), 2) + pow(sum(v * d), 2) as power from f join w using (t) group by vec_id, f, k)"""


def share(v: str, low: float, high: float) -> str:
    return f"case when {v} <= {low} then 0 when {v} >= {high} then 1 else ln({v} / {low}) / ln({high / low!r}) end"


def features(df: DataFrame, f: Callable[[np.ndarray], list], names: list[str]) -> DataFrame:
    """(vec_id, names): numbers worked out of each sound."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [f(np.array(x)) for x in batch.x]
            yield pd.DataFrame({"vec_id": batch.vec_id} | {n: [float(r[i]) for r in rows] for i, n in enumerate(names)})

    out = df.mapInPandas(run, "vec_id bigint, " + ", ".join(f"{n} double" for n in names))
    return out.select("vec_id", *(F.round(n, 6).alias(n) for n in names))


def of_block(df: DataFrame, block: str, names: list[str]) -> DataFrame:
    return features(df, lambda x: [analysis.analyse(x, RATE)[block][n] for n in names], names)


@query(f"""with {SPECTRA}, c as (select vec_id, f, sum(sqrt(power) * hz) / sum(sqrt(power)) as centre, sum(sqrt(power)) as total from b group by 1, 2),
 m as (select vec_id, f, any_value(centre) as centre, sqrt(sum(sqrt(power) * pow(hz - centre, 2)) / any_value(total)) as spread from b join c using (vec_id, f) group by 1, 2), a as (select vec_id, avg(centre) as centre, avg(spread) as spread from m group by 1)
 select vec_id, round({share("centre", 20.0, 500.0)}, 6) as spectral_centroid, round({share("spread", 20.0, 500.0)}, 6) as spectral_bandwidth from a""")
def centroid_and_bandwidth(spark, d):
    return of_block(sounds(spark, d), "spectral", ["spectral_centroid", "spectral_bandwidth"])


@query(f"""with {SPECTRA}, u as (select vec_id, f, hz, sum(power) over (partition by vec_id, f order by k) as upto, sum(power) over (partition by vec_id, f) as whole from b), r as (select vec_id, f, min(hz) as hz from u where upto >= 0.85 * whole group by 1, 2),
 a as (select vec_id, avg(hz) as hz from r group by 1), g as (select vec_id, f, exp(avg(ln(greatest(power, 1e-10)))) / avg(greatest(power, 1e-10)) as flat from b group by 1, 2), h as (select vec_id, avg(flat) as flat from g group by 1)
 select vec_id, round({share("hz", 20.0, 500.0)}, 6) as spectral_rolloff, round({share("flat", 1e-5, 0.9)}, 6) as spectral_flatness from a join h using (vec_id)""")
def rolloff_and_flatness(spark, d):
    return of_block(sounds(spark, d), "spectral", ["spectral_rolloff", "spectral_flatness"])


@query(f"""with {SPECTRA}, l as (select vec_id, f, k, 10 * log10(greatest(power, 1e-10)) as db from b), q as (select vec_id, f, k, greatest(db, max(db) over (partition by vec_id) - 80) as db, db as raw from l),
 r as (select vec_id, f, k, case when f = 0 then greatest(db - raw, 0) else greatest(db - lag(db) over (partition by vec_id, k order by f), 0) end as rise from q), m as (select vec_id, f, avg(rise) as rise from r group by 1, 2),
 a as (select vec_id, avg(rise) as flux, arg_max(f, (rise, -f)) as peak, max(rise) as top from m group by 1), o as (select m.vec_id, min(f) as first from m join a using (vec_id) where rise >= 0.1 * top group by 1)
 select vec_id, round({share("flux", 0.01, 5.0)}, 6) as spectral_flux, round({share("(peak - first) * 0.016e0", 0.001, 2.0)}, 6) as log_attack_time from a join o using (vec_id)""")
def flux_and_log_attack(spark, d):
    return of_block(sounds(spark, d), "spectral", ["spectral_flux", "log_attack_time"])


@query(f"""with {SPECTRA}, m as (select vec_id, hz, avg(sqrt(power)) as size from b group by vec_id, hz), r as (select vec_id, regr_slope(20 * log10(size), log2(hz)) as k from m where hz >= 20 and size > 1e-10 group by 1)
 select vec_id, round(greatest(least((k + 6) / 8, 1), 0), 6) as spectral_slope from r""")
def slope_of_sounds(spark, d):
    return of_block(sounds(spark, d), "spectral", ["spectral_slope"])


@query(f"""with {SPECTRA}, e as (select * from (values (0.0e0, 200.0e0), (200.0e0, 400.0e0), (400.0e0, 800.0e0)) as e(low, high)), n as (select vec_id, f, low, sqrt(power) as size, row_number() over (partition by vec_id, f, low order by power) as r, count(*) over (partition by vec_id, f, low) as n from b join e on hz >= low and hz < high),
 v as (select vec_id, f, low, avg(case when r > n - greatest(1, round_even(0.2e0 * n, 0)) then size end) as top, avg(case when r <= greatest(1, round_even(0.2e0 * n, 0)) then size end) as bottom from n group by 1, 2, 3),
 c as (select vec_id, low, avg(20 * log10((top + 1e-10) / (bottom + 1e-10))) as db from v group by 1, 2) select vec_id, round(greatest(least(avg(db) / 40, 1), 0), 6) as spectral_contrast from c group by vec_id""")
def contrast_of_sounds(spark, d):
    return of_block(sounds(spark, d), "spectral", ["spectral_contrast"])


@query(f"""with {SOUNDS}, z as (select vec_id, i, case when (v < 0) <> (lag(v) over (partition by vec_id order by i) < 0) then 1.0e0 else 0 end as c from s), a as (select vec_id, avg(c) as c from z where i > 0 group by 1)
 select vec_id, round(least(c / 0.5e0, 1), 6) as zcr from a""")
def zero_crossings(spark, d):
    return of_block(sounds(spark, d), "spectral", ["zcr"])


@query(f"""with {SOUNDS}, l as (select vec_id, max(abs(v)) as peak, sqrt(avg(v * v)) as rms from s group by 1) select vec_id, round(peak, 6) as peak, round(rms, 6) as rms, round(peak / rms, 6) as crest_factor, round(20 * log10(peak / rms), 6) as crest_factor_db, round(rms, 6) as noise_floor from l""")
def level_of_sounds(spark, d):
    return of_block(sounds(spark, d), "level", ["peak", "rms", "crest_factor", "crest_factor_db", "noise_floor"])


@query(f"""with {SPECTRA}, t as (select vec_id, sum(power) as total, sum(case when hz >= 20 and hz < 250 then power else 0 end) as b0, sum(case when hz >= 250 and hz < 500 then power else 0 end) as b1 from b group by 1),
 r as (select vec_id, f, sqrt(sum(case when hz >= 20 and hz < 250 then power else 0 end)) as r from b group by 1, 2), p as (select vec_id, max(r) as top, arg_max(f, (r, -f)) as a from r group by 1),
 e as (select r.vec_id, any_value(a) as a, min(case when f >= a and r < 0.1 * top then f end) as f from r join p using (vec_id) group by 1)
 select vec_id, round(b0 / total, 6) as low, round(b1 / total, 6) as mid, round({share("(coalesce(f, 6) - a) * 0.016e0", 0.001, 2.0)}, 6) as decay from t join e using (vec_id)""")
def band_energy_of_sounds(spark, d):
    return features(sounds(spark, d), lambda x: [*(b := analysis.band_energy(analysis.Sound(x, RATE)))["energy_fractions"][:2], b["decay_rates"][0]], ["low", "mid", "decay"])


@query(f"""with {SPECTRA}, c as (select vec_id, cast(round_even(12 * log2(hz / 440) + 69, 0) as bigint) % 12 as class, avg(power) as p from b where hz >= 27.5 group by vec_id, hz), g as (select vec_id, class, sum(p) as p from c group by 1, 2)
 select vec_id, class as dominant_pitch_class from g qualify row_number() over (partition by vec_id order by p desc, class) = 1""")
def dominant_class(spark, d):
    return of_block(sounds(spark, d), "pitch", ["dominant_pitch_class"]).withColumn("dominant_pitch_class", F.col("dominant_pitch_class").cast("bigint"))


#: The mean of 13 cepstral numbers: a cosine transform of the level in 40 triangles on the mel scale.
MELS = """mm as (select unnest(range(0, 42)) as m, 2595 * log10(1 + 500 / 700.0e0) as top), cc as (select m, 700 * (pow(10, top * m / 41 / 2595) - 1) as hz from mm),
 tt as (select c.m, a.hz as low, c.hz as centre, z.hz as high from cc c join cc a on a.m = c.m - 1 join cc z on z.m = c.m + 1)"""


@query(f"""with {SPECTRA}, {MELS}, e as (select vec_id, f, m, 10 * log10(greatest(sum(power * greatest(0, least((b.hz - low) / (centre - low), (high - b.hz) / (high - centre))) * 2 / (high - low)), 1e-10)) as db from b cross join tt group by 1, 2, 3),
 q as (select vec_id, f, m - 1 as m, greatest(db, max(db) over (partition by vec_id) - 80) as db from e), a as (select vec_id, m, avg(db) as db from q group by 1, 2)
 select vec_id, k, round(sum(db * sqrt(2 / 40.0e0) * cos(pi() * k * (m + 0.5e0) / 40)) * case when k = 0 then sqrt(0.5e0) else 1 end, 5) as mfcc from a cross join (select unnest(range(0, 13)) as k) group by vec_id, k""")
def cepstra(spark, d):
    out = through(sounds(spark, d), lambda x: np.array(analysis.timbre(analysis.Sound(x[:, 0], RATE))["mfcc"]), digits=5)
    return out.select("vec_id", F.col("i").alias("k"), F.col("y").alias("mfcc"))


# ---------------------------------------------------------------- derived sounds


def pcm(spark: SparkSession, d: str) -> DataFrame:
    """The sounds as requests' PCM: 32 bits, mono."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"sample_id": batch.vec_id, "pcm": [audio.to_pcm(np.array(x)[:, None], 32).tobytes() for x in batch.x]})

    made = sounds(spark, d).mapInPandas(run, "sample_id bigint, pcm binary")
    return made.select("sample_id", F.lit("h").alias("spec_hash"), F.lit(RATE).alias("sample_rate"), F.lit(32).alias("bit_depth"), F.lit(1).alias("channels"), "pcm")


#: The sounds at a peak of 0.9, as a chain has them.
LEVELLED = f"{SOUNDS}, {PEAK}, n as (select vec_id, i, v * 0.9e0 / peak as v from s join p using (vec_id))"


@query(f"""with {LEVELLED}, y as (select vec_id, tanh(v * {dsp.db(6.0)!r}) / tanh({dsp.db(6.0)!r}) as y from n) select vec_id as sample_id, 0.064e0 as duration, round(max(abs(y)), 5) as peak, round(sqrt(avg(y * y)), 5) as rms from y group by vec_id""")
def derived_level(spark, d):
    """Variants by a chain of two steps; their level is worked out anew."""
    v = dsp.derive(pcm(spark, d).withColumn("steps", F.lit('[{"reverse":{}},{"saturate":{"drive":6.0}}]')))
    return v.select("sample_id", "duration", F.round("level.peak", 5).alias("peak"), F.round("level.rms", 5).alias("rms"))


QUANTISED = '[{"pad_quantize":{"tempo":1500.0,"grid":16}}]'
#: Slots of 10 ms: six whole ones.
ENERGY = f"{LEVELLED}, r as (select vec_id, i // 10 as slot, sqrt(avg(v * v)) as r from n where i < 60 group by 1, 2), e as (select vec_id, slot, r / max(r) over (partition by vec_id) as e from r)"


@query(f"with {ENERGY} select vec_id as sample_id, slot, round(e, 5) as energy from e")
def derived_energy(spark, d):
    v = dsp.derive(pcm(spark, d).withColumn("steps", F.lit(QUANTISED)))
    return v.select("sample_id", F.posexplode("energy").alias("slot", "energy")).select("sample_id", F.col("slot").cast("bigint").alias("slot"), F.round("energy", 5).alias("energy"))


@query("""select vec_id as sample_id, cast(j as bigint) as segment, cast(start as bigint) as start, cast(stop as bigint) as stop from embeddings cross join (values (0, 0, 11), (1, 25, 44), (2, 50, 74)) as b(j, start, stop)""")
def derived_bounds(spark, d):
    """The segments of a quantised variant, from the record's attack times."""
    rhythm = F.struct(F.array(*map(F.lit, [0.010, 0.021, 0.040])).alias("attack_times"), F.lit(600.0).alias("tempo_bpm"))
    v = dsp.derive(pcm(spark, d).withColumn("rhythm", rhythm).withColumn("steps", F.lit('[{"pad_quantize":{"tempo":600.0,"grid":16}}]')))
    return v.select("sample_id", F.posexplode("bounds").alias("segment", "b")).select("sample_id", F.col("segment").cast("bigint").alias("segment"), "b.start", "b.stop")


@query(f"""with {ENERGY}, k as (select vec_id, max(case when slot = 0 then e end) * 0 as z, list(e order by slot) as e from e group by 1),
 b as (select vec_id, [(e[1] + e[2] + e[3]) / 3, (e[4] + e[5] + e[6]) / 3] as b from k), c as (select vec_id, (b[1] + 0.25e0 * b[2]) / (sqrt(b[1] * b[1] + b[2] * b[2]) * sqrt(1.0625e0)) as score from b)
 select vec_id as sample_id, round(score, 5) as score from c""")
def beat_match_from_pcm(spark, d):
    """From PCM to a rhythm's score: variants are derived, and their energies pooled and compared by a spec."""
    from sonoframe.plans import compile as plan
    from sonoframe.plans.spec import Reader

    v = dsp.derive(pcm(spark, d).withColumn("steps", F.lit(QUANTISED.replace("16", "12").replace("1500.0", "2000.0"))))
    s = Reader("query").one({"order": {"by": "beat_match", "dir": "desc", "pattern": [1, 0.25]}})
    rows, _ = plan.matches(s, v.select("sample_id").withColumn("duration", F.lit(0.064)), v.select("sample_id", "energy", "resolution"))
    return rows.select("sample_id", F.round("key_0", 5).alias("score"))


@query(f"""with {LEVELLED}, c as (select vec_id, i, v from n) select vec_id as sample_id, round(max(abs(v)), 4) as peak, true as heard from c group by vec_id""")
def vocoded(spark, d):
    """A carrier that the spec names is read as a sound; the result has the peak of the sound it follows."""
    x = np.sin(np.arange(200) * 0.9)[:, None] * 0.5
    carrier = spark.createDataFrame([("/lib/carrier.wav", RATE, 32, 1, bytearray(audio.to_pcm(x, 32).tobytes()))], "path string, sample_rate int, bit_depth int, channels int, pcm binary")
    v = dsp.derive(pcm(spark, d).withColumn("steps", F.lit('[{"vocoder":{"carrier":"/lib/carrier.wav","bands":4}}]')), carrier)
    return v.select("sample_id", F.round("level.peak", 4).alias("peak"), (F.col("level.rms") > 0).alias("heard"))


# ---------------------------------------------------------------- more of the processors and the analysis


@query(f"""with {SOUNDS}, t as (select j, k, greatest(least(2 * j - 31 + k, 63), 0) as i, 2 * j - (2 * j - 31 + k) as away from (select unnest(range(0, 32)) as j) cross join (select unnest(range(0, 64)) as k)),
 g as (select j, i, case when abs(away) < 32 then 0.5 + 0.5 * cos(pi() * away / 32) else 0 end * 0.5 * case when away = 0 then 1 else sin(pi() * 0.5e0 * away) / (pi() * 0.5e0 * away) end as g from t), n as (select j, sum(g) as whole from g group by j)
 select vec_id, j as i, round(sum(v * g / whole), 6) as y from s join g using (i) join n using (j) group by vec_id, j""")
def resampled(spark, d):
    """To half the rate, by a windowed sinc of half the bandwidth."""
    return through(sounds(spark, d), lambda x: audio.resample(x, RATE, 500))


@query(filtered(*dsp.sections("band", (80.0, 200.0), RATE)))
def band_passed(spark, d):
    """Two sections, one after the other."""
    return through(sounds(spark, d), lambda x: dsp.sos(x, dsp.sections("band", (80.0, 200.0), RATE)))


@query(f"""with {SOUNDS}, m as (select a.vec_id, a.i, avg(abs(b.v)) as m, count(*) as n from s a join s b on b.vec_id = a.vec_id and b.i between a.i and a.i + 31 group by 1, 2), e as (select vec_id, i, case when n = 32 then m else 0 end as m from m where i < 56),
 v as (select vec_id, arg_min(i, (m, i)) as a, min(m) as low from e where i < 33 group by 1), p as (select vec_id, max(m) as top from e group by 1),
 x as (select e.vec_id, min(case when e.i >= v.a and e.m >= low + 0.2 * (top - low) then e.i end) as i from e join v using (vec_id) join p using (vec_id) group by 1)
 select vec_id, round(least(coalesce(i, 56), 40) / 1000.0e0, 6) as attack from x""")
def refined_attacks(spark, d):
    """Where the sound of an onset at 40 ms begins, looked for up to 16 frames past it."""
    return features(sounds(spark, d), lambda x: [analysis.attack_of(x, RATE, 0.04, None, 16)], ["attack"])


@query(f"""with {SPECTRA}, {MELS}, e as (select vec_id, f, m, 10 * log10(greatest(sum(power * greatest(0, least((b.hz - low) / (centre - low), (high - b.hz) / (high - centre))) * 2 / (high - low)), 1e-10)) as db from b cross join tt group by 1, 2, 3),
 q as (select vec_id, f, m - 1 as m, greatest(db, max(db) over (partition by vec_id) - 80) as db from e), c as (select vec_id, f, k, sum(db * sqrt(2 / 40.0e0) * cos(pi() * k * (m + 0.5e0) / 40)) * case when k = 0 then sqrt(0.5e0) else 1 end as c from q cross join (select unnest(range(0, 13)) as k) group by vec_id, f, k),
 o as (select vec_id, k, sum(c * exp(-f * 16 / 50.0e0)) / sum(exp(-f * 16 / 50.0e0)) as onset from c group by 1, 2),
 d as (select a.vec_id, a.k, avg(a.delta) as delta from (select t.vec_id, t.k, t.f, sum(j * u.c) / 10.0e0 as delta from c t cross join (select unnest(range(-2, 3)) as j) join c u on u.vec_id = t.vec_id and u.k = t.k and u.f = greatest(least(t.f + j, 5), 0) group by 1, 2, 3) a group by 1, 2)
 select vec_id, k, round(onset, 5) as onset, round(delta, 5) as delta from o join d using (vec_id, k)""")
def cepstra_at_onset(spark, d):
    """Cepstra weighted to the sound's start, and their slopes from frame to frame."""
    both = lambda x: np.stack([(t := analysis.timbre(analysis.Sound(x[:, 0], RATE)))["mfcc_onset"], t["mfcc_delta"]])
    out = through(sounds(spark, d), both, digits=5)
    return out.groupBy("vec_id", (F.col("i") % 13).alias("k")).agg(F.max(F.when(F.col("i") < 13, F.col("y"))).alias("onset"), F.max(F.when(F.col("i") >= 13, F.col("y"))).alias("delta"))


@query(f"""with {SOUNDS}, q as (select vec_id, i // 4 as bin, min(v) as low, max(v) as high from s group by 1, 2)
 select vec_id, bin, cast(greatest(least(round_even(low * 127, 0), 127), -127) as bigint) as low, cast(greatest(least(round_even(high * 127, 0), 127), -127) as bigint) as high from q""")
def preview_outline(spark, d):
    """A sound's outline for a preview: the least and greatest value of each of 16 runs, as signed bytes."""
    both = lambda x: np.concatenate([(e := analysis.envelopes(x[:, 0], RATE, 16))["low"], e["high"]]).astype(np.int64)
    out = through(sounds(spark, d), both, "bigint")
    return out.groupBy("vec_id", (F.col("i") % 16).alias("bin")).agg(F.max(F.when(F.col("i") < 16, F.col("y"))).alias("low"), F.max(F.when(F.col("i") >= 16, F.col("y"))).alias("high"))


def tones(spark: SparkSession, first: int = 50, last: int = 80) -> DataFrame:
    """(vec_id: a note, x: half a second of it at 8000 Hz)."""
    hz = 440 * F.pow(F.lit(2.0), (F.col("vec_id") - 69) / 12)
    i = F.sequence(F.lit(0), F.lit(3999))
    return spark.range(first, last + 1).select(F.col("id").alias("vec_id")).select("vec_id", F.transform(i, lambda k: 0.5 * F.sin(2 * np.pi * hz * k / 8000)).alias("x"))


@query("select note as vec_id, cast(note as double) as note, cast(note % 12 as double) as class, true as pitched from (select unnest(range(69, 88)) as note)")
def pitch_of_tones(spark, d):
    """The note, its class and whether it counts as pitched, of pure tones."""

    def of(x: np.ndarray) -> list:
        a = analysis.analyse(x, 8000)
        p = a["pitch"]
        return [np.round(69 + 12 * np.log2(p["dominant_pitch_hz"] / 440)), p["dominant_pitch_class"], p["pitch_confidence"] > 0.5 and a["spectral"]["voiced_fraction"] > 0.5 and p["pitch_stability"] < 0.5 and a["spectral"]["harmonic_ratio"] > 0.4]

    out = features(tones(spark, 69, 87), of, ["note", "class", "pitched"])
    return out.withColumn("pitched", F.col("pitched") == 1)


@query("select note as vec_id, cast(note + 5 as double) as note, cast(4000 as double) as n from (select unnest(range(50, 76)) as note)")
def repitched_tones(spark, d):
    """Tones moved up by five notes: the length stays, and the strongest frequency is the new note's."""

    def of(x: np.ndarray) -> list:
        note = np.round(69 + 12 * np.log2(np.abs(np.fft.rfft(x * np.hanning(4000), 32000)).argmax() / 4 / 440))
        y = dsp.repitch(x[:, None], 8000, note=int(note) + 5, hz=440 * 2 ** ((note - 69) / 12))[:, 0]
        top = np.abs(np.fft.rfft(y * np.hanning(len(y)), 32000)).argmax() / 4
        return [np.round(69 + 12 * np.log2(top / 440)), len(y)]

    return features(tones(spark).where("vec_id < 76"), of, ["note", "n"])


@query("select 80 + 10 * k as vec_id, cast(round_even(4000 * (80 + 10 * k) / 120.0e0, 0) as double) as n from (select unnest(range(0, 8)) as k)")
def stretched_tones(spark, d):
    """A tone of each of some tempi stretched to 120."""
    x = (0.5 * np.sin(np.arange(4000) * 0.3))[:, None]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"vec_id": batch.vec_id, "n": [float(len(dsp.stretch_quantize(x, 8000, tempo=120.0, bpm=float(b)))) for b in batch.vec_id]})

    return spark.range(8).select((80 + 10 * F.col("id")).alias("vec_id")).mapInPandas(run, "vec_id bigint, n double")


@query("select 90 + 15 * k as vec_id, true as close, true as attacks from (select unnest(range(0, 5)) as k)")
def tempo_of_clicks(spark, d):
    """Clicks at some tempi: the tempo is within 4 %, and each click but the ends has an attack within 3 ms."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for b in batch.vec_id:
                at = 0.25 + np.arange(int(7 * b / 60)) * 60 / b
                x = np.zeros(8 * 22050)
                for t in at:
                    x[int(t * 22050) : int(t * 22050) + 400] += np.sin(np.arange(400) * 0.9) * np.exp(-np.arange(400) / 80)
                r = analysis.rhythm(analysis.Sound(x, 22050))
                near = [np.abs(np.array(r["attack_times"]) - t).min() < 0.003 for t in at[1:-1]]
                rows.append((b, abs(r["tempo_bpm"] / b - 1) < 0.04, all(near)))
            yield pd.DataFrame(rows, columns=["vec_id", "close", "attacks"])

    return spark.range(5).select((90 + 15 * F.col("id")).alias("vec_id")).mapInPandas(run, "vec_id bigint, close boolean, attacks boolean")


@query("select note as vec_id, true as tonal, true as sharp from (select unnest(range(50, 81)) as note)")
def harmonic_split(spark, d):
    """A tone with a click on it: the harmonic part has the tone, the percussive the click, and they add up."""

    def of(x: np.ndarray) -> list:
        click = np.zeros(4000)
        click[2000:2004] = 0.9
        h, p = (dsp.hpss((x + click)[:, None], 8000, keep=k)[:, 0] for k in ("harmonic", "percussive"))
        inside = slice(1000, 3000)
        return [(h[inside] @ x[inside]) > 0.8 * (x[inside] @ x[inside]), np.abs(p[inside]).argmax() in range(995, 1010) and np.allclose(h + p, x + click, atol=1e-6)]

    out = features(tones(spark), of, ["tonal", "sharp"])
    return out.select("vec_id", *((F.col(c) == 1).alias(c) for c in ("tonal", "sharp")))


@query(f"with {LEVELLED} select vec_id as sample_id, round(max(abs(v)) / 4, 5) as peak from n group by vec_id")
def user_processor(spark, d):
    """A processor that a user has added is read in specs, and runs on the executors."""
    from sonoframe.operators.variants import canonical
    from sonoframe.plans import spec

    if "quieter" not in dsp.PROCESSORS:
        dsp.register_processor("quieter", lambda x, rate, by=2.0, **_: x / by)
    steps = spec.Reader("mine").process([{"quieter": {"by": 4.0}}])
    v = dsp.derive(pcm(spark, d).withColumn("steps", F.lit(canonical(steps))))
    return v.select("sample_id", F.round("level.peak", 5).alias("peak"))
