"""Chat formatting: reply trees to one conversation text per chosen branch.

DataFrame functions only. Paths come from pointer doubling: round k joins every node with the
ancestor table of 2^k steps, so a tree of depth d needs ceil(log2(d)) self-joins, not d.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

#: The template. HEAD opens a turn, END closes it; both are escaped inside roles and texts.
HEAD, SEP, END = "###", ": ", "</turn>"


def escape(text: Column) -> Column:
    """Make control strings vanish from a text: backslash, HEAD and END become two-character codes."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit(HEAD), F.lit("\\h"))
    return F.replace(text, F.lit(END), F.lit("\\t"))


def unescape(text: Column) -> Column:
    """The inverse of `escape`: codes are undone between the doubled backslashes."""
    def plain(part: Column) -> Column:
        return F.replace(F.replace(part, F.lit("\\h"), F.lit(HEAD)), F.lit("\\t"), F.lit(END))

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), plain), "\\")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(":"), F.lit("\\c"))


def unescape_role(role: Column) -> Column:
    def plain(part: Column) -> Column:
        part = F.replace(F.replace(part, F.lit("\\h"), F.lit(HEAD)), F.lit("\\t"), F.lit(END))
        return F.replace(part, F.lit("\\c"), F.lit(":"))

    return F.array_join(F.transform(F.split(role, r"\\\\", -1), plain), "\\")


def branch_paths(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """Root-to-leaf paths of the best branches of each tree.

    messages: tree_id, message_id, parent_id, score (others are ignored). A branch's score is
    the sum of its messages' scores (null counts 0). Returns tree_id, leaf_id, rank, message_id
    and up, the steps from the leaf. branches: how many leaves of each tree stay, best first,
    ties by smallest leaf_id; None keeps all.

    Rows with a null tree_id or message_id belong to no tree. A repeated message_id in a tree
    counts once (smallest parent, then highest score). A parent that is not there makes a root.
    Messages on or under a cycle reach no root and are left out.
    """
    nodes = materialize(
        messages.filter("tree_id is not null and message_id is not null")
        .groupBy("tree_id", "message_id")
        .agg(F.min(F.struct("parent_id", -F.coalesce("score", F.lit(0.0)).cast("double"))).alias("m"))
        .select("tree_id", "message_id", F.col("m.parent_id").alias("parent_id"), (-F.col("m.col2")).alias("score"))
    )
    known = nodes.select("tree_id", F.col("message_id").alias("parent_id"), F.lit(True).alias("known"))
    steps = materialize(
        nodes.join(known, ["tree_id", "parent_id"], "left")
        .select("tree_id", "message_id", F.when(F.col("known"), F.col("parent_id")).alias("up"), "score")
    )
    total, doubling = nodes.count(), [steps]
    while steps.filter("up is not null").limit(1).count():
        if 2 ** (len(doubling) - 1) > total:
            break  # whatever still has an ancestor is on or under a cycle
        far = steps.select("tree_id", F.col("message_id").alias("up"), F.col("up").alias("up2"), F.col("score").alias("more"))
        # only nodes that still have an ancestor at this distance are joined on
        further = (
            steps.filter("up is not null").join(far, ["tree_id", "up"])
            .select("tree_id", "message_id", F.col("up2").alias("up"), (F.col("score") + F.col("more")).alias("score"))
        )
        steps = materialize(further.union(steps.filter("up is null").select("tree_id", "message_id", "up", "score")))
        doubling.append(steps)
    parents = nodes.filter("parent_id is not null").select("tree_id", F.col("parent_id").alias("message_id"))
    leaves = steps.filter("up is null").join(parents, ["tree_id", "message_id"], "left_anti")
    best = Window.partitionBy("tree_id").orderBy(F.desc("score"), F.asc("message_id"))
    if branches is None:
        leaves = leaves.withColumn("rank", F.lit(None).cast("int"))
    else:
        leaves = leaves.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= branches)
    paths = materialize(
        leaves.select("tree_id", F.col("message_id").alias("leaf_id"), "rank", "message_id", F.lit(0).cast("long").alias("up"))
    )
    for k, jump in enumerate(doubling[:-1]):
        jump = jump.filter("up is not null").select("tree_id", "message_id", F.col("up").alias("ancestor"))
        paths = materialize(
            paths.union(
                paths.join(jump, ["tree_id", "message_id"])
                .select("tree_id", "leaf_id", "rank", F.col("ancestor").alias("message_id"), F.col("up") + F.lit(2**k))
            )
        )
    return paths


def format_reply_trees(messages: DataFrame, branches: int | None = 1, loss_role: str = "assistant") -> DataFrame:
    """One conversation text per chosen branch, with the spans that count for the loss.

    messages: tree_id, message_id, parent_id, role, text, score. Null role and text count as
    empty. Returns tree_id, leaf_id, rank, formatted and loss_spans, an array of
    (start, length) in code points of `formatted` that covers the text of every turn of
    loss_role. An empty table gives an empty result. A path is one conversation and is built in
    one row; nothing else is gathered.
    """
    path = Window.partitionBy("tree_id", "leaf_id").orderBy(F.desc("up"))
    said = (
        messages.filter("tree_id is not null and message_id is not null")
        .groupBy("tree_id", "message_id")
        .agg(F.min(F.struct("parent_id", -F.coalesce("score", F.lit(0.0)).cast("double"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))).alias("m"))
        .select("tree_id", "message_id", "m.role", "m.text")
    )
    turns = (
        branch_paths(messages, branches).join(said, ["tree_id", "message_id"])
        .withColumn("head", F.concat(F.lit(HEAD + " "), escape_role(F.col("role")), F.lit(SEP)))
        .withColumn("body", escape(F.col("text")))
        .withColumn("piece", F.concat("head", "body", F.lit(END + "\n")))
        .withColumn("before", F.coalesce(F.sum(F.length("piece").cast("long")).over(path.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("span", F.when(F.col("role") == loss_role, F.struct((F.col("before") + F.length("head")).cast("int").alias("start"), F.length("body").alias("length"))))
    )
    return (
        turns.groupBy("tree_id", "leaf_id")
        .agg(F.max("rank").alias("rank"), F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("at"), "piece", "span"))).alias("turns"))
        .select(
            "tree_id", "leaf_id", "rank",
            F.array_join(F.col("turns.piece"), "").alias("formatted"),
            F.filter(F.col("turns.span"), lambda s: s.isNotNull()).alias("loss_spans"),
        )
    )


def parse_turns(formatted: Column) -> Column:
    """Read the turns back from a formatted text: an array of (role, text)."""
    def turn(piece: Column) -> Column:
        at = F.instr(piece, SEP)
        return F.struct(
            unescape_role(F.substring(piece, F.lit(len(HEAD) + 2), at - F.lit(len(HEAD) + 2))).alias("role"),
            unescape(F.substring(piece, at + F.lit(len(SEP)), F.length(piece))).alias("text"),
        )

    return F.transform(F.filter(F.split(formatted, END + "\n", -1), lambda x: x != ""), turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped and joined without anything between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")


def conversations_as_trees(conversations: DataFrame) -> DataFrame:
    """Linear conversations as reply trees: each turn answers the one before it and scores its length.

    Order is turn, then role, then text, nulls first, so repeated rows become turns of their own.
    Rows with a null conv_id belong to no conversation.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    at = conversations.filter("conv_id is not null").withColumn("at", F.row_number().over(order).cast("long"))
    return at.select(
        F.col("conv_id").alias("tree_id"), F.col("at").alias("message_id"),
        F.when(F.col("at") > 1, F.col("at") - 1).alias("parent_id"), "role", "text", F.length(F.coalesce("text", F.lit(""))).cast("double").alias("score"),
    )
