"""Analysis sidecars: one JSON file per sound, read with a fixed schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonoframe.functions.scalar import analysis_window
from sonoframe.operators.ranking import with_rank
from sonoframe.operators.retention import newest_within

SPECTRAL = "spectral_flatness double, attack double, release double, spectral_centroid double, spectral_bandwidth double, zcr double, harmonic_ratio double, spectral_contrast double, voiced_fraction double, log_attack_time double, spectral_flux double, spectral_rolloff double, spectral_slope double"
BLOCKS = {
    "params": "n_fft int, hop_length int, sample_rate int",
    "spectral": SPECTRAL,
    "rhythm": "tempo_bpm double, beat_times array<double>, pulse_peak_times array<double>, onset_times array<double>, attack_times array<double>, pulse_curve array<float>, onset_count int",
    "pitch": "dominant_pitch_hz double, pitch_confidence double, pitch_stability double, chroma_profile array<double>, dominant_pitch_class int, voiced_frame_count int",
    "timbre": "mfcc array<double>, mfcc_delta array<double>, mfcc_onset array<double>",
    "level": "peak double, rms double, crest_factor double, crest_factor_db double, noise_floor double",
    "band_energy": "energy_fractions array<double>, decay_rates array<double>",
    "preview": "version int, envelope_min string, envelope_max string, bands array<string>, band_totals array<double>",
}
SIDECAR = "analysis_version string, audio_md5 string, sample_rate int, bit_depth int, channels int, channel_format string, duration double, captured_at string, " + ", ".join(f"{b}: struct<{x}>" for b, x in BLOCKS.items()).replace(": struct", " struct")
#: Required blocks; a file without one, or with an array of a wrong length, is not a sample.
REQUIRED = ["params", "spectral", "rhythm", "pitch", "timbre", "duration"]
LENGTHS = {"pitch.chroma_profile": 12, "timbre.mfcc": 13, "timbre.mfcc_delta": 13, "timbre.mfcc_onset": 13}
SUFFIX = ".analysis.json"


def _fields(block: str) -> dict[str, str]:
    """Name and type of a block's fields."""
    return dict(x.strip().split(" ", 1) for x in BLOCKS[block].split(", "))


def with_defaults(block: str, given: dict[str, object] | None = None):
    """The block with missing numbers 0, missing arrays empty (or zeros of their length)."""
    out = []
    for name, kind in _fields(block).items():
        n = LENGTHS.get(f"{block}.{name}", 4 if block == "band_energy" else 0)
        value = (given or {}).get(name, -1 if name == "dominant_pitch_class" else 0)
        other = F.array(*[F.lit(0.0)] * n).cast(kind) if kind.startswith("array") else F.lit(value if kind != "string" else None).cast(kind)
        out.append(F.coalesce(F.col(f"{block}.{name}"), other).alias(name))
    return F.struct(*out).alias(block)


def raw(spark: SparkSession, path: str) -> DataFrame:
    """Every sidecar under path with its place; a file that is no JSON object has nulls and goes in read()."""
    return spark.read.schema(SIDECAR).option("multiLine", True).option("mode", "PERMISSIVE").option("pathGlobFilter", "*" + SUFFIX).json(path).withColumn("sidecar", F.col("_metadata.file_path"))


def decoded(sidecars: DataFrame, versions: tuple[str, ...]) -> DataFrame:
    """Samples of the sidecars that are whole and of one of the versions, with defaults filled in."""
    whole = F.col("analysis_version").isin(*versions)
    for block in REQUIRED:
        whole = whole & F.col(block).isNotNull()
    for array, n in LENGTHS.items():
        whole = whole & F.coalesce(F.size(array) == n, F.lit(True))
    for array in ("energy_fractions", "decay_rates"):
        whole = whole & F.coalesce(F.size(f"band_energy.{array}") == 4, F.lit(True))
    path = F.regexp_replace("sidecar", SUFFIX.replace(".", "\\.") + "$", "")
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), "\\.[^.]*$", "")
    blocks = [with_defaults("params", {"n_fft": 2048, "hop_length": 512, "sample_rate": 44100}), *(with_defaults(b) for b in ("spectral", "rhythm", "pitch", "timbre", "level", "band_energy"))]
    return sidecars.where(whole).select(
        name.alias("name"), path.alias("filepath"), "duration", F.coalesce("channel_format", F.lit("pcm")).alias("channel_format"), "analysis_version", "audio_md5", "sample_rate", "bit_depth", "channels", F.to_timestamp("captured_at").alias("captured_at"), *blocks, "preview",
    )


def numbered(samples: DataFrame) -> DataFrame:
    """sample_id from 1 in the order of paths: the same whatever order files are read in."""
    return with_rank(samples, [F.asc("filepath")], "sample_id").withColumn("sample_id", F.col("sample_id").cast("bigint"))


def references(spark: SparkSession, path: str, versions: tuple[str, ...] = ("13",)) -> DataFrame:
    """Reference sounds by name in upper case; of a name given twice the last counts. No audio is needed."""
    s = decoded(raw(spark, path), versions).withColumn("ref", F.upper("name"))
    last = F.row_number().over(Window.partitionBy("ref").orderBy(F.desc("filepath")))
    return s.withColumn("_n", last).where("_n = 1").drop("_n")


def instruments(spark: SparkSession, path: str, versions: tuple[str, ...] = ("13",), audio: DataFrame | None = None, budget: int | None = None) -> DataFrame:
    """Samples of a library. With audio (path, length, md5) given, only those whose file is there, with the same content;
    with a budget too, of these the last loaded whose files fit that many bytes.

    Sidecars without a sound are left out, never deleted.
    """
    s = decoded(raw(spark, path), versions)
    if audio is None:
        return numbered(s)
    files = audio.select(F.col("path").alias("filepath"), F.col("md5").alias("audio_md5"), F.col("length").alias("_bytes"))
    if budget is None:
        return numbered(s.join(files, ["filepath", "audio_md5"], "left_semi"))
    return newest_within(numbered(s.join(files, ["filepath", "audio_md5"])), "sample_id", "_bytes", budget).drop("_bytes")


def audio_files(spark: SparkSession, path: str, pattern: str = "*.wav") -> DataFrame:
    """(path, length, md5) of sound files; the bytes stay on the executors."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length", F.md5("content").alias("md5"))


def missing(audio: DataFrame, samples: DataFrame) -> DataFrame:
    """Sound files without a valid sidecar, which are to be analysed."""
    return audio.join(samples.select(F.col("filepath").alias("path"), F.col("audio_md5").alias("md5")), ["path", "md5"], "left_anti")


def save(samples: DataFrame, path: str, batch: int | None = None) -> None:
    """Samples as a Parquet table, which the analytics read instead of the sidecars.

    Without batch they replace it; with one they are added under it, in a folder of its own, so that a batch that is
    written again replaces itself alone. saved() then has each sound's last.
    """
    if batch is None:
        samples.write.mode("overwrite").parquet(path)
    else:
        samples.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")


def saved(spark: SparkSession, path: str) -> DataFrame:
    """The table that batches were added to: of a sound (filepath) the row of its last batch."""
    s = spark.read.parquet(path)
    last = s.groupBy("filepath").agg(F.max("batch").alias("batch"))
    return s.join(last, ["filepath", "batch"], "left_semi").drop("batch")


def of_analysis(analysed: DataFrame) -> DataFrame:
    """Sounds as functions.analysis.analyse_sounds gives them, in the columns of raw()."""
    window = analysis_window(F.col("sample_rate"))
    params = F.struct(window.alias("n_fft"), F.floor(window / 4).cast("int").alias("hop_length"), "sample_rate").alias("params")
    null = lambda c, kind: F.lit(None).cast(kind).alias(c)
    blocks = [F.col(b) for b in ("spectral", "rhythm", "pitch", "timbre", "level", "band_energy")]
    whole = ["analysis_version", "audio_md5", "sample_rate", "bit_depth", "channels", null("channel_format", "string"), "duration", null("captured_at", "string")]
    return analysed.select(*whole, params, *blocks, null("preview", f"struct<{BLOCKS['preview']}>"), F.concat("path", F.lit(SUFFIX)).alias("sidecar"))


def as_files(raw_: DataFrame) -> DataFrame:
    """(path, content, md5): rows in the columns of raw() as sidecar files, for library.write_files."""
    text = F.to_json(F.struct(*(F.col(c) for c in raw_.columns if c != "sidecar")))
    files = raw_.select(F.col("sidecar").alias("path"), F.encode(text, "UTF-8").alias("content"))
    return files.withColumn("md5", F.md5("content"))


def envelope(encoded, bins: int = 400, clamp: bool = False):
    """An int8 envelope from base64, null unless it has bins values; with clamp, negatives are 0."""
    raw_ = F.unbase64(encoded)
    n = F.length(raw_)
    byte = lambda i: F.conv(F.hex(F.substring(raw_, i, F.lit(1))), 16, 10).cast("int")
    signed = F.transform(F.sequence(F.lit(1), F.lit(bins)), lambda i: F.when(byte(i) > 127, F.lit(0) if clamp else byte(i) - 256).otherwise(byte(i)))
    return F.when(n == bins, signed)
