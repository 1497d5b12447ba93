"""Weak supervision over quality rules: votes, accuracies by expectation-maximisation, posteriors (operator 5).

Everything here is a DataFrame expression; nothing runs in Python on the executors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sonoframe.llm._common import cut, table

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
ENDS = ".!?…"
#: Words of one mark alone.
LONE = list("|#*$%&<>-_=+~^/\\@\"'()[]{}.,;:!?•·")

#: Name, measure (SQL over the features), good below, bad above. Between the two the rule abstains.
RULES = [
    ("symbols", "n_symbols / n_words", 0.05, 0.3),
    ("capitals", "n_upper / greatest(n_upper + n_lower, 1)", 0.3, 0.6),
    ("repeats", "n_repeat_words / n_words", 0.1, 0.3),
    ("lines", "n_dup_lines / n_lines", 0.1, 0.3),
    ("shouts", "n_shouts / n_words", 0.05, 0.3),
    ("small", "1 - n_lower / greatest(word_chars, 1)", 0.3, 0.5),
    ("lone", "n_lone / n_words", 0.05, 0.2),
    ("length", "abs(ln(greatest(word_chars, 1) / n_words / 5.5))", 0.55, 0.9),
    ("unended", "1 - n_ends / n_lines", 0.5, 0.95),
]


def let(value: Column, use) -> Column:
    """use(x) with x bound to value, which is worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _lacking(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def repeat_words(words: Column) -> Column:
    """How many words stand in 3-word windows that occur twice or more.

    Windows are one hash each; only in a text in which two are alike are they sorted with their places, so that equal
    ones are neighbours: n log n for any length.
    """
    empty = F.expr("array()").cast("array<int>")
    windows = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def repeated(s: Column) -> Column:
        same = lambda a, b: F.get(s, a)["h"] == F.get(s, b)["h"]
        found = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: ((k > 0) & same(k - 1, k)) | F.coalesce(same(k + 1, k), F.lit(False)))
        return F.sort_array(F.transform(found, lambda k: F.get(s, k)["i"]))

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - i, F.lit(3))))
        return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

    def alike(h: Column) -> Column:
        placed = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), empty).otherwise(let(F.sort_array(placed), repeated))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(let(windows(words), alike), covered)).cast("bigint")


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: the counts that the rules look at. Null texts count as texts without words."""
    d = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    d = d.withColumn("w", F.filter(F.split("t", "[ \\t\\n\\x0B\\f\\r]+"), lambda x: x != ""))
    lines = F.filter(F.split("t", "\n", -1), lambda x: _lacking(x, SPACE) != "")
    t = F.col("t")
    n_chars = F.length(t)
    d = d.select(
        id_col,
        F.size("w").cast("bigint").alias("n_words"),
        F.length(_lacking(t, SPACE)).cast("bigint").alias("word_chars"),
        (n_chars - F.length(_lacking(t, SYMBOLS))).cast("bigint").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("bigint").alias("n"), F.size(F.array_distinct(x)).cast("bigint").alias("distinct"), F.size(F.filter(x, lambda y: F.substring(F.rtrim(y), -1, 1).isin(*ENDS))).cast("bigint").alias("ended"))).alias("lines"),
        repeat_words(F.col("w")).alias("n_repeat_words"),
        F.size(F.filter("w", lambda x: x.isin(*LONE))).cast("bigint").alias("n_lone"),
        (n_chars - F.length(_lacking(t, "!"))).cast("bigint").alias("n_shouts"),
        F.length(F.regexp_replace(t, "\\P{Lu}+", "")).cast("bigint").alias("n_upper"),
        F.length(F.regexp_replace(t, "\\P{Ll}+", "")).cast("bigint").alias("n_lower"),
    )
    return d.select(id_col, "n_words", "word_chars", "n_symbols", (F.col("lines.n") - F.col("lines.distinct")).alias("n_dup_lines"), "n_repeat_words", F.col("lines.n").alias("n_lines"), F.col("lines.ended").alias("n_ends"), "n_lone", "n_shouts", "n_upper", "n_lower")


def votes(rules=RULES) -> Column:
    """1 for good, -1 for bad, 0 for no vote, a number for each rule; no rule votes on a text without words."""
    return F.array(*(F.when(F.expr("n_words = 0"), 0).when(F.expr(f"({m}) < {good}D"), 1).when(F.expr(f"({m}) > {bad}D"), -1).otherwise(0) for _, m, good, bad in rules))


def em_sql(rules: int, rounds: int) -> str:
    """The model fitted to p, an array of (v: votes, n: documents with them), as one expression.

    Each class gives each rule a probability of voting good, bad and not at all (Dawid and Skene's model). The first
    guess takes a pattern for good by its share of good votes, a bad one counting three times. Counts are smoothed by
    adding one, so no probability is 0. The state is (prior, good, bad); good[j] holds ln P(v) for v = -1, 0, 1.
    """
    first = "transform(p, x -> 1D / (1D + exp(3D * aggregate(x.v, 0, (a, y) -> a + if(y < 0, 1, 0)) - aggregate(x.v, 0, (a, y) -> a + if(y > 0, 1, 0)) / 2D)))"
    table_ = lambda q: f"transform(sequence(0, {rules - 1}), j -> transform(array(-1, 0, 1), k -> ln((1D + aggregate(zip_with(p, {q}), 0D, (a, z) -> a + if(z.p.v[j] = k, z.p.n * z.q, 0D))) / (3D + aggregate(zip_with(p, {q}), 0D, (a, z) -> a + z.p.n * z.q)))))"
    pair = "(x, y) -> named_struct('p', x, 'q', y)"
    inverse = "transform(q, y -> 1D - y)"
    m_step = f"named_struct('prior', (1D + aggregate(zip_with(p, q, {pair}), 0D, (a, z) -> a + z.p.n * z.q)) / (2D + aggregate(p, 0D, (a, x) -> a + x.n)), 'good', {table_('q')}, 'bad', {table_(inverse)})".replace("zip_with(p, q)", f"zip_with(p, q, {pair})").replace(f"zip_with(p, {inverse})", f"zip_with(p, {inverse}, {pair})")
    e_step = "transform(p, x -> 1D / (1D + exp(ln((1D - s.prior) / s.prior) + aggregate(zip_with(x.v, zip_with(s.good, s.bad, (g, b) -> zip_with(g, b, (c, d) -> d - c)), (y, r) -> r[y + 1]), 0D, (a, y) -> a + y))))"
    step = lambda q: f"transform(array({q}), q -> {m_step})[0]"
    return f"aggregate(sequence(1, {rounds}), {step(first)}, (s, i) -> {step(e_step)})"


def fit(voted: DataFrame, rules: int, rounds: int = 25) -> DataFrame:
    """One row: the fitted model. It is learnt from the counts of vote patterns over all rows, 3**rules at most."""
    patterns = voted.groupBy("v").agg(F.count("*").cast("double").alias("n"))
    gathered = patterns.agg(F.sort_array(F.collect_list(F.struct("v", "n"))).alias("p"))
    return gathered.select(F.expr(em_sql(rules, rounds)).alias("model"))


def posterior(model, v: Column) -> Column:
    """The probability that a row with votes v is good, under a fitted model (a Row)."""
    odds = F.lit(math.log(model.prior / (1 - model.prior)))
    for j, (good, bad) in enumerate(zip(model.good, model.bad, strict=True)):
        weights = [g - b for g, b in zip(good, bad, strict=True)]
        odds = odds + F.when(v[j] < 0, weights[0]).when(v[j] > 0, weights[2]).otherwise(weights[1])
    return 1 / (1 + F.exp(-odds))


def judge(docs: DataFrame, rules=RULES, threshold: float = 0.5, rounds: int = 25, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per input row: id, features, votes, base_failed, p_good and kept.

    A text fails the base with under 50 words or over half of them in repeated 3-word windows; otherwise it is kept if
    its posterior reaches threshold. The model is learnt from all texts that pass the base. Null and empty texts fail;
    repeated rows each count; an empty table gives an empty result; other columns are not read.
    """
    f = cut(features(docs, id_col, text_col).withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")).withColumn("v", votes(rules)))
    model = fit(f.where("not base_failed"), len(rules), rounds).first().model
    return f.withColumn("p_good", posterior(model, F.col("v"))).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("p_good", 6).alias("p_good"))
