"""Chat formatting: reply trees to training conversations, DataFrame operations only.

Messages form trees. Self-joins of a jump table (each node's 2^i-th ancestor, with the number and
the scores of the messages before it) double the reach until no node has an ancestor that far,
so a path of n messages takes log2(n) rounds and each leaf knows the mean score of its path. The best
branches of a conversation are chosen; only their paths are enumerated, by the same jump tables, and each
becomes one text with the spans under the loss mask.

Template, for each turn: ``<|im_start|>role\\ntext<|im_end|>\\n``. In a role or
text a backslash is doubled and ``<|`` becomes ``<\\|`` (in a role a newline
becomes ``<\\n`` too), so no control string can stand in a turn and both are
restored exactly.

Defined results: null texts and roles are empty; a null conversation id is a
conversation of its own; repeated rows of a node count once (the greatest
parent, score, role and text); a parent that does not exist makes a root;
messages on a cycle, or answering one, have no path from a root and are left
out; ties between branches go to the longer and then to the smaller leaf; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from edgeloom.llm.common import cut, remove

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(x: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))
    return F.replace(out, F.lit("\n"), F.lit("<\\n")) if role else out


def unescape(x: Column, role: bool = False) -> Column:
    out = F.replace(x, F.lit("<\\n"), F.lit("\n")) if role else x
    return F.replace(F.replace(out, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def tree(messages: DataFrame, conv: str, node: str, parent: str, role: str, text: str, score: str | None) -> DataFrame:
    """One row for each node: conv_key, conv, node, parent (null: root), role, text, score."""
    worth = F.coalesce(F.col(score).cast("double"), F.lit(0.0)) if score else F.lit(0.0)
    rows = messages.select(
        F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit("")).alias("conv_key"),
        F.col(conv).alias("conv"),
        F.col(node).cast("long").alias("node"),
        F.struct(
            F.col(parent).cast("long").alias("parent"),
            worth.alias("score"),
            F.coalesce(F.col(role), F.lit("")).alias("role"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
        ).alias("m"),
    )
    once = rows.groupBy("conv_key", "node").agg(F.max("conv").alias("conv"), F.max("m").alias("m"))
    return once.select("conv_key", "conv", "node", "m.*")


def jumps(nodes: DataFrame) -> list[DataFrame]:
    """Written tables, the i-th with each node's 2^i-th ancestor: conv_key, node, up (null: above the
    root), and of the messages from the node to just below ``up``: total (score), n."""
    up = nodes.select("conv_key", "node", F.col("parent").alias("up"), F.col("score").alias("total"), F.lit(1).cast("long").alias("n"))
    known = nodes.select("conv_key", F.col("node").alias("up"))
    some = up.filter("up IS NOT NULL")
    below = some.join(known.hint("merge"), ["conv_key", "up"], "left_semi").select(up.columns)
    above = some.join(known.hint("merge"), ["conv_key", "up"], "left_anti").unionByName(up.filter("up IS NULL")).withColumn("up", F.lit(None).cast("long"))
    levels = [cut(below.unionByName(above.select(up.columns)), "tree-jump")]
    largest = nodes.groupBy("conv_key").count().agg(F.max("count")).first()[0] or 0
    while 1 << len(levels) - 1 < largest and not levels[-1].filter("up IS NOT NULL").isEmpty():
        last = levels[-1]
        far = last.select("conv_key", F.col("node").alias("up"), F.col("up").alias("_up"), F.col("total").alias("_total"), F.col("n").alias("_n"))
        on = last.filter("up IS NOT NULL").join(far.hint("merge"), ["conv_key", "up"])
        on = on.select("conv_key", "node", F.col("_up").alias("up"), (F.col("total") + F.col("_total")).alias("total"), (F.col("n") + F.col("_n")).alias("n"))
        levels.append(cut(last.filter("up IS NULL").unionByName(on), "tree-jump"))
    return levels


def best_leaves(levels: list[DataFrame], n_best: int | None) -> DataFrame:
    """conv_key, leaf, place of the ``n_best`` (all if None) branches of each
    conversation by mean score. One aggregation for each place: a conversation
    with very many branches never meets in one sort."""
    parents = levels[0].filter("up IS NOT NULL").select("conv_key", F.col("up").alias("node"))
    rooted = levels[-1].filter("up IS NULL").join(parents.hint("merge"), ["conv_key", "node"], "left_anti")
    scored = rooted.select("conv_key", F.col("node").alias("leaf"), F.struct((F.col("total") / F.col("n")).alias("mean"), "n", (-F.col("node")).alias("minus_leaf")).alias("rank"))
    if n_best is None:
        return scored.select("conv_key", "leaf", F.lit(0).alias("place"))
    scored = cut(scored, "tree-scores") if n_best > 1 else scored
    chosen, rest = [], scored
    for place in range(n_best):
        best = rest.groupBy("conv_key").agg(F.max("rank").alias("rank"))
        best = best.select("conv_key", (-F.col("rank.minus_leaf")).alias("leaf"), F.lit(place).alias("place"))
        best = cut(best, "tree-best") if n_best > 1 else best
        chosen.append(best)
        if place + 1 < n_best:
            rest = rest.join(best.hint("merge"), ["conv_key", "leaf"], "left_anti")
    out = chosen[0]
    for more in chosen[1:]:
        out = out.unionByName(more)
    return out


def paths(chosen: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """conv_key, leaf, place, node, up (messages below it on the path) of the chosen leaves' paths to their roots."""
    reach = chosen.select("conv_key", "leaf", "place", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("up"))
    for i, level in enumerate(levels):
        far = level.filter("up IS NOT NULL").select("conv_key", "node", F.col("up").alias("_over"))
        reach = cut(reach, "tree-reach")
        more = reach.join(far.hint("merge"), ["conv_key", "node"])
        reach = reach.unionByName(more.select("conv_key", "leaf", "place", F.col("_over").alias("node"), (F.col("up") + (1 << i)).alias("up")))
    return cut(reach, "tree-paths")


def chat_format(messages: DataFrame, conv: str = "conv_id", node: str = "node", parent: str = "parent", role: str = "role", text: str = "text", score: str | None = None, n_best: int | None = 1, loss_role: str = "assistant") -> DataFrame:
    """``conv``, leaf, place, formatted, loss_spans (array of start and length, in
    code points, of the texts of ``loss_role``) of each chosen path."""
    nodes = cut(tree(messages, conv, node, parent, role, text, score), "tree-nodes")
    levels = jumps(nodes)
    steps = paths(best_leaves(levels, n_best), levels)
    for level in levels:
        remove(level)
    rows = steps.join(nodes.hint("merge"), ["conv_key", "node"])
    header = F.concat(F.lit(START), escape(F.col("role"), role=True), F.lit("\n"))
    body = escape(F.col("text"))
    rows = rows.select("conv_key", "conv", "leaf", "place", "up", header.alias("header"), body.alias("body"), (F.col("role") == loss_role).alias("loss"))
    before = W.partitionBy("conv_key", "leaf").orderBy(F.desc("up")).rowsBetween(W.unboundedPreceding, -1)
    size = F.length("header") + F.length("body") + len(END)
    start = F.coalesce(F.sum(size).over(before), F.lit(0)) + F.length("header")
    rows = rows.withColumn("start", start.cast("long"))
    turn = F.struct(
        (-F.col("up")).alias("at"),
        F.concat("header", "body", F.lit(END)).alias("turn"),
        F.struct("start", F.length("body").cast("long").alias("length")).alias("span"),
        "loss",
    )
    whole = rows.groupBy("conv_key", "leaf").agg(F.max("conv").alias("conv"), F.max("place").alias("place"), F.sort_array(F.collect_list(turn)).alias("turns"))
    return whole.select(
        F.col("conv").alias(conv),
        "leaf",
        "place",
        F.array_join(F.col("turns.turn"), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["span"]).alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    turns = F.filter(F.split(formatted, "<\\|im_end\\|>\n", -1), lambda t: t != "")
    role = lambda t: F.substring_index(F.substring(t, len(START) + 1, 2**31 - 1 - len(START)), "\n", 1)
    return F.transform(
        turns,
        lambda t: F.struct(
            unescape(role(t), role=True).alias("role"),
            unescape(F.substr(t, F.length(role(t)) + len(START) + 2)).alias("text"),
        ),
    )


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
