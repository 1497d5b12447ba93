"""Cosine similarity to reference sounds: feature vectors, the index of scores, and its upkeep."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonoframe.functions.scalar import log_normalize
from sonoframe.operators.grid import dot, let

#: The fields of the spectral group in order, before the normalised crest factor.
SPECTRAL = ["spectral_flatness", "attack", "release", "spectral_centroid", "spectral_bandwidth", "zcr", "harmonic_ratio", "spectral_contrast", "voiced_fraction", "log_attack_time", "spectral_flux", "spectral_rolloff", "spectral_slope"]
#: The default weights of the five groups.
WEIGHTS = {"spectral": 1.0, "timbre": 1.0, "timbre_delta": 0.5, "timbre_onset": 1.0, "band_energy": 1.0}
TINY = 1e-9
#: Rows and cells of references up to which they are broadcast; more are scored block by block.
BROADCAST_ROWS, BROADCAST_CELLS = 20_000, 2_000_000


def unit(v: Column) -> Column:
    """v at length 1; all zeros where its length is next to none."""
    return let(length(v), lambda n: F.transform(v, lambda x: F.when(n < TINY, 0.0).otherwise(x / n)))


def times(v: Column, weight: float) -> Column:
    return F.transform(v, lambda x: x * weight)


def feature_vector(weights: Mapping[str, float] = WEIGHTS) -> Column:
    """58 numbers of a sample: each group at length 1, times its weight; groups of weight 0 are left out.

    MFCC 0 says how loud a sound is, not what it is like, and is left out.
    """
    crest = F.when(F.col("level.rms") > 1e-10, log_normalize(F.col("level.peak") / F.col("level.rms"), 2**0.5, 10.0)).otherwise(0.0)
    rest = lambda c: F.slice(F.col(c), 2, 12)
    groups = {
        "spectral": F.array(*(F.col(f"spectral.{c}").cast("double") for c in SPECTRAL), crest),
        "timbre": rest("timbre.mfcc"),
        "timbre_delta": rest("timbre.mfcc_delta"),
        "timbre_onset": rest("timbre.mfcc_onset"),
        "band_energy": F.concat("band_energy.energy_fractions", "band_energy.decay_rates"),
    }
    parts = [times(unit(v), weights[g]) for g, v in groups.items() if weights.get(g, 0.0) > 0]
    return F.concat(*parts) if parts else F.array().cast("array<double>")


def length(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column, na: Column | None = None, nb: Column | None = None) -> Column:
    """na and nb are the lengths of a and b, where these are known."""
    na, nb = length(a) if na is None else na, length(b) if nb is None else nb
    return F.when((na < TINY) | (nb < TINY), 0.0).otherwise(dot(a, b) / (na * nb))


def scored(references: DataFrame, samples: DataFrame) -> DataFrame:
    """(ref, sample_id, score) for each reference (ref, v) and sample (sample_id, v).

    References are few; they are broadcast behind a check of their size, so samples are read once and never shuffled.
    More of them are taken in blocks of that size, each held against all samples.
    """
    size = references.agg(F.count("*").alias("n"), F.sum(F.size("v")).alias("cells")).first()
    blocks = max(-(-size.n // BROADCAST_ROWS), -(-(size.cells or 0) // BROADCAST_CELLS), 1)
    r = references.select("ref", F.col("v").alias("rv"), length(F.col("v")).alias("rn"))
    samples = samples.select("sample_id", "v", length(F.col("v")).alias("n"))
    out = None
    for i in range(blocks):
        part = r if blocks == 1 else r.where(F.pmod(F.xxhash64("ref"), F.lit(blocks)) == i)
        hit = samples.join(F.broadcast(part)).select("ref", "sample_id", cosine(F.col("rv"), F.col("v"), F.col("rn"), F.col("n")).alias("score"))
        out = hit if out is None else out.union(hit)
    return out


def scored_by_matrix(references: DataFrame, samples: DataFrame) -> DataFrame:
    """What scored() gives, by a matrix product for each Arrow batch of samples and block of references.

    For many references or long vectors: a product in numpy costs a hundredth of the same in expressions, but starting
    Python costs more than a few small batches do. Blocks are bounded as in scored(); all vectors have one length.
    """
    size = references.agg(F.count("*").alias("n"), F.sum(F.size("v")).alias("cells")).first()
    blocks = max(-(-size.n // BROADCAST_ROWS), -(-(size.cells or 0) // BROADCAST_CELLS), 1)
    kinds = [references.schema["ref"].dataType.simpleString(), samples.schema["sample_id"].dataType.simpleString()]
    out = None
    for i in range(blocks):
        part = references.where(F.pmod(F.xxhash64("ref"), F.lit(blocks)) == i).select("ref", "v").toArrow()
        names = part.column("ref").combine_chunks()
        matrix = unit_rows(rows_of(part.column("v").combine_chunks()))

        def run(batches: Iterator[pa.RecordBatch], names=names, matrix=matrix) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows and len(names):
                    product = unit_rows(rows_of(batch.column("v"))) @ matrix.T
                    at = pa.array(np.repeat(np.arange(batch.num_rows), len(names)))
                    ref = pa.array(np.tile(np.arange(len(names)), batch.num_rows))
                    yield pa.RecordBatch.from_arrays([names.take(ref), batch.column("sample_id").take(at), pa.array(product.ravel())], ["ref", "sample_id", "score"])

        hit = samples.select("sample_id", "v").mapInArrow(run, f"ref {kinds[0]}, sample_id {kinds[1]}, score double")
        out = hit if out is None else out.union(hit)
    return out


def rows_of(v: pa.ListArray) -> np.ndarray:
    return v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1) if len(v) else np.empty((0, 1))


def unit_rows(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n >= TINY)


def _order() -> list[Column]:
    return [F.desc("score"), F.asc("sample_id")]


def top(scores: DataFrame, n: int = 0) -> DataFrame:
    """The n best samples of each reference with their rank from 1, ties by sample; 0 for all of them.

    The limit reaches below the shuffle (WindowGroupLimit): each task sends only its own n best.
    """
    out = scores.withColumn("rank", F.row_number().over(Window.partitionBy("ref").orderBy(*_order())))
    return out.where(F.col("rank") <= n) if n else out


def at_rank(scores: DataFrame, rank: int) -> DataFrame:
    """The sample at a rank from 0 of each reference; nothing where there are fewer."""
    return top(scores, rank + 1).where(F.col("rank") == rank + 1)


def of_sample(scores: DataFrame, sample_id: int) -> DataFrame:
    """One sample's scores, best reference first."""
    mine = scores.where(F.col("sample_id") == sample_id)
    return mine.withColumn("rank", F.row_number().over(Window.partitionBy("sample_id").orderBy(F.desc("score"), F.asc("ref"))))


def add_samples(scores: DataFrame, references: DataFrame, new: DataFrame) -> DataFrame:
    """The index with new samples; those in it already stay as they are."""
    fresh = new.join(scores.select("sample_id").distinct(), "sample_id", "left_anti")
    return scores.unionByName(scored(references, fresh))


def add_references(scores: DataFrame, references: DataFrame, samples: DataFrame) -> DataFrame:
    """The index with references added that it hasn't yet (names in upper case)."""
    known = scores.select(F.upper("ref").alias("known")).distinct()
    fresh = references.join(known, F.upper("ref") == F.col("known"), "left_anti")
    return scores.unionByName(scored(fresh, samples))


def remove_samples(scores: DataFrame, gone: DataFrame) -> DataFrame:
    return scores.join(gone.select("sample_id").distinct(), "sample_id", "left_anti")
