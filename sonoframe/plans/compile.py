"""From specs to DataFrame plans.

samples has the schema of sources.sidecars.SAMPLES. variants (sample_id, bpm, resolution, energy) has the energy of each
sample's quantised form per grid slot; it is joined only where a spec asks for it. similarity (ref, sample_id, score) is a
stored index. Ranks start at 1; ties go to the lower sample_id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonoframe.functions.scalar import inside
from sonoframe.operators.grid import beats_of, truncated_cosine
from sonoframe.operators.ranking import with_rank
from sonoframe.plans.spec import USER_SCORERS, Assignment, Order, Range, Select, Where

FIELDS = {"duration": "duration", "onsets": "rhythm.onset_count", "tempo": "rhythm.tempo_bpm", "pitch_hz": "pitch.dominant_pitch_hz", "quantized_beats": "beats"}
SCORES = {"duration": "duration", "pitch": "pitch.dominant_pitch_hz", "onsets": "rhythm.onset_count", "tempo": "rhythm.tempo_bpm", "level": "level.rms", "age": "sample_id", "quantized_beats": "beats"}


def holds(x: Column, bounds: Range) -> Column:
    """All bounds. A NaN fails none but eq, as a comparison rejects only what it finds out of bounds."""
    tests = {"gte": x.__ge__, "lte": x.__le__, "gt": x.__gt__, "lt": x.__lt__}
    whole = [F.isnan(x.cast("double")) | tests[op](v) if op in tests else (x == v) & ~F.isnan(x.cast("double")) for op, v in bounds.bounds]
    return reduce(Column.__and__, whole, F.lit(True))


def stable_pitch() -> Column:
    """What counts as pitched: seven conditions that all have to hold."""
    tests = ["pitch.dominant_pitch_hz > 0", "spectral.voiced_fraction > 0.5D", "pitch.voiced_frame_count >= 5", "pitch.pitch_confidence > 0.5D", "pitch.pitch_stability < 0.5D", "spectral.harmonic_ratio > 0.4D", "duration >= 0.1D"]
    return F.expr(" and ".join(tests))


def conditions(where: Where) -> Column:
    """The row filter of a spec: plain comparisons on (nested) columns, which reach the Parquet scan."""
    tests = [holds(F.col(FIELDS[of]), bounds) for of, bounds in where.ranges if bounds.bounds]
    if where.pitched is not None:
        tests.append(stable_pitch() if where.pitched else ~stable_pitch())
    if where.name is not None:
        tests.append(F.col("name") == where.name)
    if where.directory is not None:
        tests.append(inside(F.col("filepath"), where.directory))
    return reduce(Column.__and__, tests, F.lit(True))


def needs_variants(spec: Select) -> bool:
    return bool(spec.where.range("quantized_beats").bounds) or any(c.by in ("quantized_beats", "beat_match") for c in spec.order)


def with_variants(samples: DataFrame, variants: DataFrame) -> DataFrame:
    """Adds profile (energy, resolution) and beats, null where a sample has no quantised form."""
    v = variants.select("sample_id", F.struct("energy", "resolution").alias("profile"), (F.size("energy") * 4.0 / F.col("resolution")).alias("beats"))
    return samples.join(v, "sample_id", "left")


def score(clause: Order) -> Column:
    if clause.by == "beat_match":
        pattern = F.array(*map(F.lit, dict(clause.params)["pattern"]))
        beats = beats_of(F.col("profile.energy"), F.col("profile.resolution"))
        return F.when(F.size("profile.energy") > 0, truncated_cosine(pattern, beats))
    if clause.by in USER_SCORERS:
        return USER_SCORERS[clause.by][0](dict(clause.params))
    return F.col(SCORES[clause.by]).cast("double")


def drops_missing(clause: Order) -> bool:
    return clause.by == "beat_match" or USER_SCORERS.get(clause.by, (None, False))[1]


def matches(spec: Select, samples: DataFrame, variants: DataFrame | None = None, similarity: DataFrame | None = None) -> tuple[DataFrame, list[Column]]:
    """The rows a spec matches, and the keys it orders them by."""
    if needs_variants(spec):
        if variants is None:
            return samples.limit(0), [F.col("sample_id")]
        samples = with_variants(samples, variants)
    rows = samples.where(conditions(spec.where))
    clauses = spec.order or (Order("age", True),)
    if clauses[0].by == "similarity":
        if spec.where.reference is None:
            raise ValueError("similarity needs where.reference")
        if similarity is None:
            return rows.limit(0).withColumn("score", F.lit(0.0)), [F.col("sample_id")]
        ranked = similarity.where(F.upper("ref") == spec.where.reference.upper()).select("sample_id", "score")
        rows = rows.join(ranked, "sample_id")
        down = clauses[0].descending
        return rows, [F.desc("score"), F.asc("sample_id")] if down else [F.asc("score"), F.desc("sample_id")]
    keys = []
    for i, clause in enumerate(clauses):
        name = f"key_{i}"
        rows = rows.withColumn(name, score(clause))
        if drops_missing(clause):
            rows = rows.where(F.col(name).isNotNull())
        keys.append(F.col(name).desc_nulls_last() if clause.descending else F.col(name).asc_nulls_last())
    return rows, [*keys, F.asc("sample_id")]


def ranked(spec: Select, samples: DataFrame, variants: DataFrame | None = None, similarity: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """The matches with their rank; with a limit only the first, which a top-k sort finds without a total order."""
    rows, keys = matches(spec, samples, variants, similarity)
    if limit is None:
        return with_rank(rows, keys)
    return rows.orderBy(*keys).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*keys)))


def picked(spec: Select, samples: DataFrame, variants: DataFrame | None = None, similarity: DataFrame | None = None, pick: int | None = None) -> DataFrame:
    """The sample at the spec's pick, or the last if there are fewer."""
    rows, keys = matches(spec, samples, variants, similarity)
    first = rows.orderBy(*keys).limit(spec.pick if pick is None else pick)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(*keys))).orderBy(F.desc("rank")).limit(1)


def chosen(specs: tuple[Select, ...], samples: DataFrame, variants: DataFrame | None = None, similarity: DataFrame | None = None) -> DataFrame:
    """The pick of the first spec with any match. The pick is the first spec's, whichever matches."""
    found = [picked(s, samples, variants, similarity, specs[0].pick).select("sample_id", "name", "rank", F.lit(i).alias("spec")) for i, s in enumerate(specs)]
    return reduce(DataFrame.unionByName, found).orderBy("spec").limit(1)


def assigned(assignments: list[Assignment], picks: dict[tuple[int, int], tuple[Assignment, int]], samples: DataFrame, variants: DataFrame | None = None, similarity: DataFrame | None = None) -> DataFrame:
    """One plan for a whole note map: (channel, note, assignment, sample_id, rank), a row for each note with a match.

    Each spec's matches are ranked up to the highest pick that any of its notes asks for; notes then join their rank,
    clamped to the number of matches, of the first spec that has any.
    """
    spark = samples.sparkSession
    notes = [(c, n, a.name, int(p)) for (c, n), (a, p) in picks.items()]
    wanted = spark.createDataFrame(notes, "channel int, note int, assignment string, pick int")
    parts = []
    for a in assignments:
        most = max((p for _, _, name, p in notes if name == a.name), default=0)
        if most:
            parts += [ranked(s, samples, variants, similarity, most).select(F.lit(a.name).alias("assignment"), F.lit(i).alias("spec"), "sample_id", "rank") for i, s in enumerate(a.select)]
    if not parts:
        return wanted.limit(0).select("channel", "note", "assignment", F.lit(0).cast("bigint").alias("sample_id"), F.lit(0).alias("rank"))
    every = reduce(DataFrame.unionByName, parts)
    first = Window.partitionBy("assignment")
    every = every.withColumn("best", F.min("spec").over(first)).where("spec = best").withColumn("found", F.count("*").over(first))
    out = wanted.join(every, "assignment").where(F.col("rank") == F.least(F.col("pick").cast("bigint"), F.col("found")))
    return out.select("channel", "note", "assignment", "sample_id", "rank")


def looked_up(events: DataFrame, picks: dict[tuple[int, int], tuple[Assignment, int]]) -> DataFrame:
    """events (channel, note, ...) that have an assignment, with its name and pick.

    A map has 16 x 128 entries at most, so it is broadcast.
    """
    rows = [(c, n, a.name, int(p)) for (c, n), (a, p) in picks.items()]
    known = events.sparkSession.createDataFrame(rows, "channel int, note int, assignment string, pick int")
    return events.join(F.broadcast(known), ["channel", "note"])


def variant_requests(assignments: list[Assignment], picks: dict[tuple[int, int], tuple[Assignment, int]], samples: DataFrame, variants: DataFrame | None = None, similarity: DataFrame | None = None, controls: dict[tuple[int, int], int] | None = None, rate: int = 44100) -> DataFrame:
    """The distinct variants (sample_id, note, steps, spec_hash) that a whole map will ask for: those of the picks of all
    its notes, at the note where a sound is repitched. Notes without steps ask for none. samples have audio_md5.
    """
    from sonoframe.operators.variants import canonical, spec_hash

    spark = samples.sparkSession
    steps = [(a.name, canonical(a.process, controls, a.channel), any(s.name == "repitch" for s in a.process)) for a in assignments if a.process]
    chains = spark.createDataFrame(steps, "assignment string, steps string, by_note boolean")
    rows = assigned(assignments, picks, samples, variants, similarity).join(F.broadcast(chains), "assignment")
    rows = rows.withColumn("note", F.when(F.col("by_note"), F.col("note"))).select("sample_id", "note", "steps").distinct()
    return spec_hash(rows.join(samples.select("sample_id", "audio_md5"), "sample_id"), rate).select("sample_id", "note", "steps", "spec_hash")


def default_requests(samples: DataFrame, tempo: float, grid: int, rate: int = 44100) -> DataFrame:
    """Each rhythmic sound's variant at the set's own tempo and grid; none where the tempo is 0."""
    from sonoframe.functions.scalar import rhythmic
    from sonoframe.operators.variants import canonical, requested
    from sonoframe.plans.spec import Step

    step = Step("stretch_quantize", (("tempo", tempo), ("grid", grid)))
    own = samples.where(rhythmic(F.col("rhythm.tempo_bpm"), F.col("rhythm.beat_times"))) if tempo > 0 else samples.limit(0)
    return requested(own, canonical((step,)), rate)


def pitched_requests(samples: DataFrame, notes: list[int], rate: int = 44100) -> DataFrame:
    """Each steadily pitched sound's variants at the notes."""
    from sonoframe.operators.variants import canonical, requested
    from sonoframe.plans.spec import Step

    return requested(samples.where(stable_pitch()), canonical((Step("repitch", ()),)), rate, notes)
