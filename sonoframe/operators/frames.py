"""Features of sounds given as rows of frames, one row per frame, keyed by sound and frame number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonoframe.functions.scalar import log_normalize


def levels(frames: DataFrame, key: str, at: str, value: str, width: int = 2048) -> DataFrame:
    """Peak, root mean square, crest factor (also in dB) and noise floor of values numbered by at, from 0.

    The noise floor is the 5th percentile, between neighbours, of the root mean squares of whole frames of width values;
    of a sound shorter than one, of all it has. Frames are summed up where the values are; a row for each is shuffled.
    """
    v = F.col(value)
    f = frames.groupBy(key, F.floor(F.col(at) / width).alias("_frame")).agg(F.count("*").alias("_n"), F.max(F.abs(v)).alias("_top"), F.sum(v * v).alias("_power"))
    whole = F.when(F.col("_n") == width, F.sqrt(F.col("_power") / width))
    g = f.groupBy(key).agg(F.max("_top").alias("peak"), F.sqrt(F.sum("_power") / F.sum("_n")).alias("rms"), F.percentile(whole, F.lit(0.05)).alias("_floor"))
    crest = F.when(F.col("rms") > 1e-10, F.col("peak") / F.col("rms")).otherwise(0.0)
    return g.select(key, "peak", "rms", crest.alias("crest_factor"), F.when(crest > 1e-10, 20 * F.log10(crest)).otherwise(0.0).alias("crest_factor_db"), F.coalesce("_floor", "rms").alias("noise_floor"))


def attack_release(frames: DataFrame, key: str, at: str, rms: str, seconds_per_frame: float) -> DataFrame:
    """How long the level takes from its first frame at a tenth of the peak to the peak, and from there to the last.

    Both are log-normalised from 1 ms to 2 s. The peak is the first of the loudest frames.
    """
    w = Window.partitionBy(key)
    f = frames.select(key, F.col(at).alias("i"), F.col(rms).alias("r")).withColumn("top", F.max("r").over(w))
    g = f.groupBy(key).agg(F.min(F.when(F.col("r") == F.col("top"), F.col("i"))).alias("peak"), F.min(F.when(F.col("r") >= 0.1 * F.col("top"), F.col("i"))).alias("first"), F.max(F.when(F.col("r") >= 0.1 * F.col("top"), F.col("i"))).alias("last"))
    seconds = lambda a, b: log_normalize((F.col(b) - F.col(a)) * seconds_per_frame, 0.001, 2.0)
    return g.select(key, seconds("first", "peak").alias("attack"), seconds("peak", "last").alias("release"))


def slope(bins: DataFrame, key: str, hz: str, db: str) -> DataFrame:
    """Least-squares slope of level over octaves, -6 to +2 dB per octave as 0 to 1; half where there is none."""
    g = bins.groupBy(key).agg(F.regr_slope(F.col(db), F.log2(hz)).alias("s"))
    return g.select(key, F.coalesce(F.greatest(F.least((F.col("s") + 6) / 8, F.lit(1.0)), F.lit(0.0)), F.lit(0.5)).alias("slope"))


def envelope(frames: DataFrame, key: str, at: str, value: str, bins: int) -> DataFrame:
    """Least and greatest value in each of bins runs of a sound's frames, of which the first are one longer.

    Frame numbers are consecutive from any start, which is found by an aggregate rather than a sort.
    """
    ends = frames.groupBy(key).agg(F.min(at).alias("first"), F.count("*").alias("n"))
    i = F.col(at) - F.col("first")
    short, longer = F.floor(F.col("n") / bins), F.pmod("n", F.lit(bins))
    head = longer * (short + 1)
    b = F.when(i < head, F.floor(i / (short + 1))).otherwise(longer + F.floor((i - head) / F.greatest(short, F.lit(1))))
    g = frames.join(ends, key).withColumn("bin", b.cast("bigint")).groupBy(key, "bin")
    return g.agg(F.min(value).alias("low"), F.max(value).alias("high"))


def moving_mean(frames: DataFrame, key: str, at: str, value: str, width: int = 32) -> DataFrame:
    """Mean of each frame and those after it, width in all; 0 where there are fewer."""
    w = Window.partitionBy(key).orderBy(at).rowsBetween(0, width - 1)
    return frames.withColumn("moving", F.when(F.count("*").over(w) == width, F.avg(value).over(w)).otherwise(0.0))


def local_maxima(frames: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Frames higher than both neighbours; of a run of equal frames the middle one (the earlier of two)."""
    order = Window.partitionBy(key).orderBy(at)
    f = frames.withColumn("new", F.coalesce((F.col(value) != F.lag(value).over(order)).cast("int"), F.lit(1)))
    f = f.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = f.groupBy(key, "run").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.first(value).alias("v"))
    by_run = Window.partitionBy(key).orderBy("run")
    runs = runs.withColumn("before", F.lag("v").over(by_run)).withColumn("after", F.lead("v").over(by_run))
    return runs.where("v > before and v > after").select(key, F.floor((F.col("first") + F.col("last")) / 2).alias("peak_at"), F.col("v").alias("peak"))


def hold_gate(frames: DataFrame, key: str, at: str, value: str, threshold: float, hold: int) -> DataFrame:
    """Whether a gate is open: at or over the threshold, and for hold frames after that."""
    order = Window.partitionBy(key).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    opened = F.last(F.when(F.col(value) >= threshold, F.col(at)), ignorenulls=True).over(order)
    return frames.withColumn("open", F.coalesce(F.col(at) - opened <= hold, F.lit(False)))


def trim(frames: DataFrame, key: str, at: str, value: str, threshold: float, before: int = 0, after: int = 0) -> DataFrame:
    """(key, start, stop): from the first to the last frame at or over the threshold, padded; the whole if none is."""
    loud = F.abs(F.col(value)) >= threshold
    g = frames.groupBy(key).agg(F.min(at).alias("low"), F.max(at).alias("high"), F.min(F.when(loud, F.col(at))).alias("first"), F.max(F.when(loud, F.col(at))).alias("last"))
    return g.select(key, F.greatest(F.coalesce(F.col("first") - before, "low"), "low").alias("start"), (F.least(F.coalesce(F.col("last") + after, "high"), "high") + 1).alias("stop"))


def refine_onsets(onsets: DataFrame, key: str, at: str, most: float) -> DataFrame:
    """How far back each onset may be moved: to the middle between it and the one before, and by most at the utmost."""
    order = Window.partitionBy(key).orderBy(at)
    before = F.lag(at).over(order)
    return onsets.withColumn("earliest", F.greatest(F.col(at) - most, F.coalesce((F.col(at) + before) / 2, F.lit(0.0))))


def segments_of(starts: DataFrame, key: str, at: str, end: str) -> DataFrame:
    """(start, stop) of each start: up to the next one, the last up to the end."""
    return starts.withColumn("stop", F.coalesce(F.lead(at).over(Window.partitionBy(key).orderBy(at)), F.col(end)))


def band_shares(bins: DataFrame, key: str, hz: str, power: str, edges: tuple[float, ...] = (20.0, 250.0, 2000.0, 6000.0, 20000.0)) -> DataFrame:
    """The share of all the power in each band [edge, next edge); all 0 in silence."""
    cols = [F.sum(F.when((F.col(hz) >= a) & (F.col(hz) < b), F.col(power)).otherwise(0.0)).alias(f"b{i}") for i, (a, b) in enumerate(zip(edges, edges[1:]))]
    g = bins.groupBy(key).agg(*cols, F.sum(power).alias("_all"))
    names = [f"b{i}" for i in range(len(edges) - 1)]
    return g.select(key, *(F.when(F.col("_all") > 1e-20, F.col(n) / F.col("_all")).otherwise(0.0).alias(n) for n in names))


def rms(x: str | Column) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.sqrt(F.avg(x * x))
