"""Musical grids: per-beat energy, quantising to a grid, and time maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, use) -> Column:
    """use(x) with x bound to value, which is worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def mean(x: Column) -> Column:
    """0 of an empty array."""
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / F.greatest(F.size(x), F.lit(1))


def beats_of(energy: Column, resolution: Column) -> Column:
    """Energy per quarter note from energy per grid slot (resolution slots to a bar).

    The mean of resolution / 4 slots where that divides; else the slots are split into as many runs as there are beats
    (rounded, halves to even), the first of which are one longer.
    """
    size = F.size(energy)
    n = F.bround(size * 4.0 / resolution).cast("int")
    per = (resolution / 4).cast("int")
    even = F.transform(F.sequence(F.lit(0), n - 1), lambda i: mean(F.slice(energy, i * per + 1, per)))
    short, longer = F.floor(size / n).cast("int"), F.pmod(size, n)
    split = F.transform(F.sequence(F.lit(0), n - 1), lambda i: mean(F.slice(energy, i * short + F.least(i, longer) + 1, short + F.when(i < longer, 1).otherwise(0))))
    divides = (resolution % 4 == 0) & (F.pmod(size, F.greatest(per, F.lit(1))) == 0)
    return F.when((size > 0) & (resolution > 0) & (n > 0), F.when(divides, even).otherwise(split)).otherwise(F.array().cast("array<double>"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def truncated_cosine(a: Column, b: Column) -> Column:
    """Cosine of the parts that both have, from the left; 0 where one has no length; null where one is empty."""

    def cut(b: Column) -> Column:
        k = F.least(F.size(a), F.size(b))
        x, y = F.slice(a, 1, k), F.slice(b, 1, k)
        parts = F.struct(dot(x, y).alias("xy"), F.sqrt(dot(x, x)).alias("nx"), F.sqrt(dot(y, y)).alias("ny"))
        return F.when(k > 0, let(parts, lambda p: F.when((p["nx"] == 0) | (p["ny"] == 0), 0.0).otherwise(p["xy"] / (p["nx"] * p["ny"]))))

    return let(b, cut)


def slot_seconds(bpm: Column, resolution: Column) -> Column:
    return 60.0 / bpm / (resolution / 4.0)


def grid_times(length: Column, bpm: Column, resolution: Column, least: int = 0) -> Column:
    """Times of grid points from 0 to past the end: floor(length / step) + 2 of them, or more to have the least number."""
    step = slot_seconds(bpm, resolution)
    n = F.greatest(F.floor(length / step).cast("int") + 2, F.lit(least))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: i * step)


def snap(onsets: Column, step: Column, points: Column, strength: float = 1.0) -> Column:
    """Each onset, from the left, to its nearest grid point (ties: the earlier) after the one that the last onset took.

    The grid has points times from 0, step apart. With a strength below 1 an onset goes only that share of its way.
    """
    start = F.struct(F.lit(-1).alias("at"), F.array().cast("array<double>").alias("out"))

    def take(s: Column, t: Column) -> Column:
        best = F.least(F.greatest(F.ceil(t / step - 0.5).cast("int"), s["at"] + 1), points - 1)
        return F.struct(best.alias("at"), F.concat(s["out"], F.array(t + strength * (best * step - t))).alias("out"))

    return F.aggregate(onsets, start, take)["out"]


def time_map(sources: Column, targets: Column, length: Column, stretched: Column) -> Column:
    """(from, to) pairs for a stretch: 0 to 0, then those pairs that rise in both, then the ends."""
    pairs = F.arrays_zip(sources.alias("source"), targets.alias("target"))
    start = F.array(F.struct(F.lit(0.0).alias("source"), F.lit(0.0).alias("target")))
    kept = F.aggregate(F.transform(pairs, lambda p: F.struct(p["source"].alias("source"), p["target"].alias("target"))), start, lambda a, p: F.when((p["source"] > F.element_at(a, -1)["source"]) & (p["target"] > F.element_at(a, -1)["target"]), F.concat(a, F.array(p))).otherwise(a))
    return F.concat(kept, F.array(F.struct(length.alias("source"), stretched.alias("target"))))


def energy_profile(frames: DataFrame, key: str, at: str, value: str, slot: int) -> DataFrame:
    """(key, energy): the root mean square of value in each whole slot of slot frames, divided by the largest of them.

    Frames are numbered by at, from 0. What is left after the last whole slot isn't counted, but a sound shorter than one
    is one. Slots are pre-aggregated where the frames are, so only one row per slot is shuffled.
    """
    by = frames.groupBy(key, F.floor(F.col(at) / slot).cast("int").alias("_slot")).agg(F.sqrt(F.avg(F.col(value) * F.col(value))).alias("_rms"), F.count("*").alias("_n"))
    by = by.where((F.col("_n") == slot) | (F.col("_slot") == 0))
    g = by.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_slot", "_rms"))).alias("_s"), F.max("_rms").alias("_top"))
    return g.select(key, F.transform("_s", lambda x: F.when(F.col("_top") > 0, x["_rms"] / F.col("_top")).otherwise(0.0)).alias("energy"))
