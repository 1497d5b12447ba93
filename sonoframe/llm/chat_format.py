"""Reply trees formatted as conversations with a loss mask (operator 7).

Everything here is a DataFrame expression; nothing runs in Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonoframe.llm._common import cut, table

#: A turn is OPEN role MID escaped text CLOSE. Escaped text has no < and no > of its own.
OPEN, MID, CLOSE = "<turn:", ">\n", "\n</turn>\n"
ESCAPES = [("<", "\\l"), (">", "\\g")]


def escape(text: Column) -> Column:
    """Backslash to two, < and > to \\l and \\g: no control string of the template is left."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for plain, coded in ESCAPES:
        out = F.replace(out, F.lit(plain), F.lit(coded))
    return out


def unescape(text: Column) -> Column:
    """The inverse of escape. Doubled backslashes are cut out first, from the left, so that none starts a code."""

    def plain(part: Column) -> Column:
        for raw, coded in ESCAPES:
            part = F.replace(part, F.lit(coded), F.lit(raw))
        return part

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), plain), "\\")


def keyed(df: DataFrame) -> DataFrame:
    """df with conv_id in a struct, which joins where it is null too."""
    return df.withColumn("conv_id", F.struct("conv_id"))


def unkeyed(df: DataFrame) -> DataFrame:
    return df.withColumn("conv_id", F.col("conv_id.conv_id"))


def tree_paths(nodes: DataFrame, paths: int | None = 1) -> DataFrame:
    """The nodes (conv_id, path, node, depth) of the best root-to-leaf paths under each root, or of all if paths is None.

    A path's id is its leaf. Rows with a null conv_id are one conversation.

    Self-joins double the step: after round k each node knows its ancestor 2**k up and the scores on the way, so a path
    of n nodes takes log2 n rounds, in which only nodes that have not reached their root take part, and no row ever
    holds a whole path. Branches rank by mean score, then by more nodes,
    then by the lower leaf. From the leaves that are taken the same steps, largest first, mark their ancestors. A parent that is not
    there makes a root; nodes in a loop are under no root and are left out.
    """
    nodes = keyed(nodes)
    real = nodes.select("conv_id", F.col("node").alias("parent")).withColumn("has", F.lit(True))
    step = nodes.select("conv_id", "node", "parent", "score").join(real, ["conv_id", "parent"], "left")
    step = cut(step.select("conv_id", "node", F.when(F.col("has"), F.col("parent")).alias("up"), F.lit(1).cast("bigint").alias("far"), F.coalesce(F.col("score"), F.lit(0.0)).alias("sum"), F.col("node").alias("root")))
    whole, climbing, limit = step.where("up is null"), step.where("up is not null"), step.count()
    hops = []
    while (1 << len(hops)) <= 2 * max(limit, 1) and not climbing.isEmpty():
        hops.append(climbing.select("conv_id", "node", "up"))
        ahead = whole.union(climbing).select("conv_id", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("far").alias("far2"), F.col("sum").alias("sum2"), F.col("root").alias("root2"))
        j = climbing.join(ahead, ["conv_id", "up"])
        j = cut(j.select("conv_id", "node", F.col("up2").alias("up"), (F.col("far") + F.col("far2")).alias("far"), (F.col("sum") + F.col("sum2")).alias("sum"), F.col("root2").alias("root")))
        whole, climbing = whole.union(j.where("up is null")), j.where("up is not null")
    inner = step.where("up is not null").select("conv_id", F.col("up").alias("node")).distinct()
    leaves = whole.join(inner, ["conv_id", "node"], "left_anti")
    ranked = leaves.groupBy("conv_id", "node").agg(F.min(F.struct((-F.col("sum") / F.col("far")).alias("mean"), (-F.col("far")).alias("far"), "root")).alias("key"))
    if paths is not None:
        order = Window.partitionBy("conv_id", "key.root").orderBy("key.mean", "key.far", "node")
        ranked = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= paths)
    best = cut(ranked.select("conv_id", F.col("node").alias("path"), "node"))
    for hop in reversed(hops):
        best = cut(best.union(best.join(hop, ["conv_id", "node"]).select("conv_id", "path", F.col("up").alias("node"))))
    return unkeyed(best.join(whole.select("conv_id", "node", (F.col("far") - 1).alias("depth")), ["conv_id", "node"]).select("conv_id", "path", "node", "depth"))


def format_paths(nodes: DataFrame, loss_role: str = "assistant", paths: int | None = 1) -> DataFrame:
    """A row per path of tree_paths: conv_id, path, formatted (the path's turns) and spans, the loss mask.

    spans has for each turn the first character of its masked text in formatted, from 0, and its length; both 0 where
    the turn is not of loss_role. Null roles and texts are empty. Of nodes with the same (conv_id, node), which a
    caller must number apart, all are taken. Rows with a null conv_id are one conversation, other columns are not read,
    and an empty table gives an empty result.
    """
    nodes = nodes.select("conv_id", "node", "parent", "score", "role", "text")
    chosen = unkeyed(keyed(nodes).join(keyed(tree_paths(nodes, paths)), ["conv_id", "node"]))
    head = F.concat(F.lit(OPEN), escape(F.coalesce("role", F.lit(""))), F.lit(MID))
    t = chosen.select("conv_id", "path", "depth", head.alias("head"), escape(F.coalesce("text", F.lit(""))).alias("body"), (F.coalesce("role", F.lit("")) == loss_role).alias("loss"))
    t = t.select("conv_id", "path", "depth", F.concat("head", "body", F.lit(CLOSE)).alias("turn"), F.length("head").alias("skip"), F.length("body").alias("n"), "loss")
    upto = Window.partitionBy("conv_id", "path").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("at", F.coalesce(F.sum(F.length("turn").cast("bigint")).over(upto), F.lit(0)) + F.col("skip"))
    held = lambda x: F.when(F.col("loss"), F.col(x).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    span = F.struct(held("at").alias("start"), held("n").alias("length"))
    g = t.groupBy("conv_id", "path").agg(F.sort_array(F.collect_list(F.struct("depth", "turn", span.alias("span")))).alias("g"))
    return g.select("conv_id", "path", F.concat_ws("", "g.turn").alias("formatted"), F.col("g.span").alias("spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """What can be read from format_paths' output alone: turns (role, text), the text under the mask, and all's length.

    Rows stay where format_paths has put them, by (conv_id, path), so that nothing is shuffled again.
    """
    pieces = formatted.select("conv_id", "path", F.length("formatted").cast("bigint").alias("chars"), F.split("formatted", CLOSE, -1).alias("turn"), F.col("spans").alias("span"))
    pieces = pieces.select("conv_id", "path", "chars", F.posexplode(F.arrays_zip("turn", "span")).alias("pos", "of")).where("of.span is not null")
    pieces = pieces.select("conv_id", "path", "pos", "chars", "of.turn", "of.span")
    before = Window.partitionBy("conv_id", "path").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("conv_id", "path", "pos", "turn", "chars", "span", F.coalesce(F.sum(F.length("turn").cast("bigint") + len(CLOSE)).over(before), F.lit(0)).alias("at"))
    mid = F.instr("turn", MID)
    role = F.substring(F.col("turn"), F.lit(len(OPEN) + 1), mid - len(OPEN) - 1)
    text = F.substring(F.col("turn"), mid + len(MID), F.length("turn"))
    masked = F.when(F.col("span.length") > 0, F.substring(F.col("turn"), (F.col("span.start") - F.col("at") + 1).cast("int"), F.col("span.length").cast("int"))).otherwise("")
    return pieces.select("conv_id", "path", "pos", "chars", unescape(role).alias("role"), unescape(text).alias("text"), unescape(masked).alias("masked"))


def linear(turns: DataFrame) -> DataFrame:
    """Reply trees of plain conversations: each row answers the one before it in the order of turn (ties: role, text)."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    n = F.row_number().over(order).cast("bigint")
    return turns.select("conv_id", n.alias("node"), (n - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    return digest(format_paths(linear(turns)))


def digest(formatted: DataFrame) -> DataFrame:
    """The columns of the contract, from the formatted conversations."""
    turn = F.struct("pos", F.concat("role", F.lit("\n"), "text", F.lit("\n")).alias("turn"), "masked")
    said = read_back(formatted).groupBy("conv_id", "path").agg(F.sort_array(F.collect_list(turn)).alias("g"), F.first("chars").alias("formatted_chars"))
    lost = F.concat_ws("", "g.masked")
    return said.select("conv_id", F.size("g").cast("bigint").alias("n_turns"), F.sha2(F.concat_ws("", "g.turn"), 256).alias("turns_sha256"), F.length(lost).cast("bigint").alias("loss_chars"), F.sha2(lost, 256).alias("loss_sha256"), "formatted_chars")
