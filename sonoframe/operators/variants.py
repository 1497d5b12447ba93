"""Derived sounds as a table keyed by sound and specification: what is there, what is missing, what goes."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonoframe.operators.retention import families_within, running_total
from sonoframe.plans.spec import Controller, Step

VERSION = "1"


def canonical(steps: tuple[Step, ...], controls: dict[tuple[int, int], int] | None = None, channel: int = 0) -> str:
    """Steps as JSON in a fixed form, with controllers at their present values (of any channel if their own has none)."""
    now = controls or {}

    def value(v):
        if not isinstance(v, Controller):
            return v
        own = now.get((channel if v.channel is None else v.channel, v.cc))
        anywhere = next((x for (_, cc), x in sorted(now.items()) if cc == v.cc), None)
        return v.at(anywhere if own is None and v.channel is None else own)

    return json.dumps([{s.name: {k: value(v) for k, v in sorted(s.params)}} for s in steps], sort_keys=True, separators=(",", ":"))


def requested(samples: DataFrame, steps: str, rate: int = 44100, notes: list[int] | None = None) -> DataFrame:
    """(sample_id, note, steps, spec_hash) wanted of samples (sample_id, audio_md5): one each, or one for each note."""
    rows = samples.select("sample_id", "audio_md5", F.lit(steps).alias("steps"))
    if notes:
        rows = rows.withColumn("note", F.explode(F.array(*map(F.lit, notes))))
    else:
        rows = rows.withColumn("note", F.lit(None).cast("int"))
    return spec_hash(rows, rate)


def spec_hash(rows: DataFrame, rate: int = 44100) -> DataFrame:
    """rows (audio_md5, steps, note) with the key of the variant that they ask for."""
    return rows.withColumn("spec_hash", F.sha2(F.concat_ws("\x1f", "audio_md5", F.lit(VERSION), F.lit(str(rate)), "steps", F.col("note").cast("string")), 256))


def missing(wanted: DataFrame, variants: DataFrame, running: DataFrame | None = None) -> DataFrame:
    """What is wanted, once, and neither there nor being made. Only keys take part in the join."""
    keys = variants.select("sample_id", "spec_hash")
    if running is not None:
        keys = keys.union(running.select("sample_id", "spec_hash"))
    return wanted.dropDuplicates(["sample_id", "spec_hash"]).join(keys, ["sample_id", "spec_hash"], "left_anti")


def without_parents(variants: DataFrame, gone: DataFrame, on: str = "sample_id") -> DataFrame:
    """Variants whose sound isn't among those that are gone."""
    return variants.join(gone.select(on).distinct(), on, "left_anti")


def served(wanted: DataFrame, variants: DataFrame, base_hash: str) -> DataFrame:
    """For each wanted sound its variant, else its base variant, else null: the raw sound is played."""
    v = variants.select("sample_id", "spec_hash")
    exact = v.withColumn("exact", F.col("spec_hash"))
    base = v.where(F.col("spec_hash") == base_hash).select("sample_id", F.col("spec_hash").alias("base"))
    out = wanted.join(exact, ["sample_id", "spec_hash"], "left").join(base, "sample_id", "left")
    return out.withColumn("found", F.coalesce("exact", "base")).drop("exact", "base")


def after_tempo_change(variants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What stays when the tempo changes, and what is to be made again: stretches are, padded ones only go."""
    has = lambda name: F.exists("steps", lambda s: s == name)
    stays = variants.where(~has("stretch_quantize") & ~has("pad_quantize"))
    return stays, variants.where(has("stretch_quantize")).select("sample_id", "spec_hash", "steps")


def in_memory(variants: DataFrame, budget: int) -> DataFrame:
    """Families of the most recent sounds that fit the budget; a family goes or stays whole."""
    return families_within(variants, "sample_id", "inserted", "bytes", budget)


def on_disk(variants: DataFrame, budget: int) -> DataFrame:
    """The most recently used variants that fit the budget."""
    return running_total(variants, "last_used", "bytes").where(F.col("_sum") <= budget).drop("_sum")


def append(variants: DataFrame, path: str) -> None:
    """Add to the stored table, in folders by the key's first digits so that lookups read few files."""
    variants.withColumn("prefix", F.substring("spec_hash", 1, 2)).repartition("prefix").write.mode("append").partitionBy("prefix").parquet(path)


def segment_of(bounds, how: str | int, turn=None):
    """The segment of a variant that an event plays: a number from 1 (past the last: the last), the next in turn, or one
    by chance, which is the same for the same turn. Null without segments."""
    n = F.size(bounds)
    if how == "round_robin":
        at = F.pmod(turn, n) + 1
    elif how == "random":
        at = F.pmod(F.xxhash64(turn), n) + 1
    else:
        at = F.least(F.greatest(F.lit(int(how)), F.lit(1)), n)
    return F.when(n > 0, F.get(bounds, (at - 1).cast("int")))
