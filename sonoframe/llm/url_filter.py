"""URL filter: host rules first, then the likelihood ratio of two character models (operator 6).

Everything here is a DataFrame expression; nothing runs in Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sonoframe.llm._common import cut, table

#: (rule, verdict) of the contract's query.
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORDER = 3
SMOOTH = 2.0
FOLDS = 5


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path: the text after the first :// up to / ? # or the end (A-Z lower-cased), then that up to ? or #."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "(?s)^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "(?s)^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as (rule, verdict); null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        domain, _, rest = rule.partition("/")
        fits = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit("/" + rest))
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def symbols(text: Column) -> Column:
    """Lower-cased, with digits as 0, other characters as themselves, and ^ and $ at the ends."""
    return F.concat(F.lit("^"), F.translate(F.lower(text), "123456789", "000000000"), F.lit("$"))


def grams(text: Column, order: int) -> Column:
    """Each symbol with up to order symbols before it, as (context, symbol), the first symbol left out."""
    at = F.sequence(F.lit(2), F.length(text))
    return F.transform(at, lambda i: F.struct(F.substring(text, F.greatest(i - order, F.lit(1)), F.least(i - 1, F.lit(order))).alias("context"), F.substring(text, i, F.lit(1)).alias("symbol")))


def counts(texts: DataFrame, order: int) -> DataFrame:
    """For each class and each length up to order: how often a symbol follows a context, and how often any does."""
    g = texts.groupBy("text", "good").agg(F.count("*").alias("n")).select("good", "n", F.explode(grams(F.col("text"), order)).alias("g"))
    g = g.groupBy("good", "g.context", "g.symbol").agg(F.sum("n").alias("n"))
    g = g.select("good", "symbol", "n", F.explode(F.expr(f"transform(sequence(0, least({order}, length(context))), k -> right(context, k))")).alias("context"))
    return g.groupBy("context", "symbol").agg(*(F.sum(F.when(F.col("good") == flag, F.col("n"))).alias(name) for name, flag in (("good", True), ("bad", False))))


def gram_scores(model: DataFrame, wanted: DataFrame, order: int, smooth: float) -> DataFrame:
    """ln P(symbol | context) under the accepted less that under the rejected URLs, for each wanted (context, symbol).

    P of the longest context starts from a uniform share of the alphabet and at each length k becomes
    (n(context_k symbol) + smooth * P_(k-1)) / (n(context_k) + smooth).
    """
    totals = model.groupBy("context").agg(F.sum("good").alias("all_good"), F.sum("bad").alias("all_bad"))
    ask = wanted.select("context", "symbol", F.explode(F.expr(f"transform(sequence(0, least({order}, length(context))), k -> right(context, k))")).alias("suffix"))
    found = ask.join(model.withColumnRenamed("context", "suffix"), ["suffix", "symbol"], "left").join(totals.withColumnRenamed("context", "suffix"), "suffix", "left")
    found = found.groupBy("context", "symbol").agg(F.sort_array(F.collect_list(F.struct(F.length("suffix").alias("k"), *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("good", "all_good", "bad", "all_bad"))))).alias("found"))
    chance = lambda n, of: F.aggregate("found", F.lit(1 / 64), lambda p, x: (x[n] + smooth * p) / (x[of] + smooth))
    return found.select("context", "symbol", (F.log(chance("good", "all_good")) - F.log(chance("bad", "all_bad"))).alias("score"))


def judge(pages: DataFrame, rules=RULES, order: int = ORDER, smooth: float = SMOOTH, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """A row per input row: id, host, path, rule (null if none fits), verdict, score.

    URLs that a rule decides train two smoothed variable-order Markov models, of the allowed and of the blocked; one
    fold in FOLDS of their texts (host and path) is left out to set the threshold, the difference of length-normalised
    log-likelihoods that balances the errors on it best. Both count each text once, however many rows have it. Other URLs are allowed from that threshold on, and where there
    are not texts of both classes. Null URLs have an empty host and path; repeated rows are judged each; an empty table
    gives an empty result; other columns are not read.
    """
    host, path = parts(F.col(url_col))
    u = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    u = u.withColumn("fit", rule_for(F.col("host"), F.col("path"), rules)).select(id_col, "host", "path", "fit.rule", F.col("fit.verdict").alias("ruled"), symbols(F.concat("host", "path")).alias("text"))
    texts = cut(u.groupBy("text", "ruled").agg(F.count("*").alias("n"))).withColumn("fold", F.pmod(F.conv(F.substring(F.md5("text"), 1, 8), 16, 10).cast("bigint"), F.lit(FOLDS)))
    known = texts.where("ruled is not null and fold > 0").select("text", (F.col("ruled") == "allow").alias("good"))
    model = counts(known, order)
    asked = texts.where("ruled is null or fold = 0").select("text").distinct()
    pieces = asked.select("text", F.explode(grams(F.col("text"), order)).alias("g")).groupBy("text", "g.context", "g.symbol").agg(F.count("*").alias("times"))
    scores = gram_scores(model, pieces.select("context", "symbol").distinct(), order, smooth)
    scored = pieces.join(scores, ["context", "symbol"]).groupBy("text").agg((F.sum(F.col("times") * F.col("score")) / F.sum("times")).alias("score"))
    scored = cut(scored)
    held = texts.where("ruled is not null and fold = 0").join(scored, "text").select(F.round(F.least(F.greatest("score", F.lit(-9.0)), F.lit(9.0)), 2).alias("score"), "ruled", F.lit(1).alias("n"))
    both = known.select("good").distinct().count() == 2
    limit = threshold(held) if both else float("-inf")
    out = u.join(scored, "text", "left")
    verdict = F.coalesce(F.col("ruled"), F.when(F.col("score") < limit, "block").otherwise("allow"))
    return out.select(id_col, "host", "path", "rule", verdict.alias("verdict"), F.when(F.col("ruled").isNull(), F.col("score")).alias("score"))


def threshold(held: DataFrame) -> float:
    """The score (of at most 1801 rounded ones) from which on to allow; 0 where a class is missing."""
    by = held.groupBy("score").agg(*(F.coalesce(F.sum(F.when(F.col("ruled") == v, F.col("n"))), F.lit(0)).alias(v) for v in ("allow", "block"))).orderBy("score").collect()
    good, bad = sum(r.allow for r in by), sum(r.block for r in by)
    best, at, below_good, below_bad = 1.0, 0.0, 0, 0
    if not good or not bad:
        return at
    for last, r in zip([by[0], *by], by):
        error = below_good / good + (bad - below_bad) / bad
        if error < best:
            best, at = error, (last.score + r.score) / 2
        below_good, below_bad = below_good + r.allow, below_bad + r.block
    return at


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).withColumn("score", F.round("score", 6))
