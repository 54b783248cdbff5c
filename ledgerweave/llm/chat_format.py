"""Chat formatting over reply trees (native expressions only).

Messages form trees by parent. Self-joins that double the reach of every step find each message's depth and
score sum to its root; every leaf is a branch, the best one per conversation is chosen, and its
messages are found by joins of the same doubled steps in reverse. Only ids and sums move in
these rounds; texts join once, at the end. Depth d takes about 2 log2(d) joins.

The template marks turns as ``<|im_start|>role``, line feed, text, ``<|im_end|>``, line feed. Inside texts and roles a
backslash doubles, and one is put after the first character of every control string, so that
none is left; removing the escapes restores the text.

Cases: null text and null role count as empty; a null conversation id is a conversation of its
own; a parent that does not exist makes a root; among equal branches the smallest leaf id wins; repeated
ids raise, as does a ring of parents; an empty table gives an empty result; extra columns are not carried. The query adds a conversation
-1 of its own; turns of that id in the table would join it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.session import durable

START, STOP = "<|im_start|>", "<|im_end|>"
#: Control strings of common public chat templates, which must not survive inside a text.
CONTROL = r"(<)(?=\||/?s>|<SYS>>|</SYS>>)|(\[)(?=/?INST\])"
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), CONTROL, r"$1$2\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def best_branches(messages: DataFrame) -> DataFrame:
    """conv, node, depth (1 at the root) for the messages of each conversation's best branch.

    ``messages``: conv (string), node, parent (long), score (double). A branch's score is the sum over its messages.
    """
    up = messages.select("conv", F.col("node").alias("parent"))
    state = messages.join(up, ["conv", "parent"], "left_semi").select("conv", "node", F.col("parent").alias("far"), "score")
    roots = messages.join(up, ["conv", "parent"], "left_anti").select("conv", "node", F.lit(None).cast("long").alias("far"), "score")
    state = durable(state.unionByName(roots).withColumn("depth", F.lit(1).cast("long")))
    total = state.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("conv", "node").alias("u")).first()
    if total["n"] != total["u"]:
        raise ValueError("a message id occurs twice in a conversation")
    # Messages that have reached their root leave the rounds; only those still on their way are joined again.
    active, done, steps = state.where("far is not null"), [state.where("far is null")], []
    while active.limit(1).count():
        if len(steps) > max(total["n"], 1).bit_length():
            raise ValueError("the parents form a ring")
        steps.append(active.select("conv", "node", "far"))
        every = active
        for part in done:
            every = every.unionByName(part)
        above = every.select("conv", F.col("node").alias("far"), F.col("far").alias("_far"), F.col("score").alias("_s"), F.col("depth").alias("_d"))
        step = durable(
            active.join(above, ["conv", "far"]).select(
                "conv", "node", F.col("_far").alias("far"), (F.col("score") + F.col("_s")).alias("score"), (F.col("depth") + F.col("_d")).alias("depth")
            )
        )
        done.append(step.where("far is null"))
        active = step.where("far is not null")
    state = done[0]
    for part in done[1:]:
        state = state.unionByName(part)
    parents = messages.select("conv", F.col("parent").alias("node")).where("node is not null").distinct()
    leaves = state.join(parents, ["conv", "node"], "left_anti")
    best = leaves.groupBy("conv").agg(F.max(F.struct("score", (-F.col("node")).alias("minus"))).alias("b"))
    path = durable(best.select("conv", (-F.col("b.minus")).alias("node")))
    for step in reversed(steps):
        path = durable(path.unionByName(path.join(step, ["conv", "node"]).select("conv", F.col("far").alias("node"))))
    return path.join(state.select("conv", "node", "depth"), ["conv", "node"])


def format_branches(messages: DataFrame, path: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_mask (array of start and length in code points, assistant texts only).

    ``messages``: conv, conv_id, node, role, text. A conversation becomes one string, as its result is one row.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(START), F.regexp_replace(escape(role), "\n", "\\\\\n"), F.lit("\n"))
    turns = messages.join(path, ["conv", "node"]).select(
        "conv", "conv_id", "depth", (role == ASSISTANT).alias("learn"), head.alias("head"), escape(text).alias("body")
    )
    order = Window.partitionBy("conv").orderBy("depth")
    length = F.length("head") + F.length("body") + len(STOP) + 1
    turns = turns.withColumn("at", F.sum(length).over(order) - length)
    rows = turns.groupBy("conv").agg(
        F.first("conv_id").alias("conv_id"),
        F.sort_array(
            F.collect_list(
                F.struct("depth", F.concat("head", "body", F.lit(STOP + "\n")).alias("turn"), "learn", (F.col("at") + F.length("head")).alias("start"), F.length("body").alias("length"))
            )
        ).alias("t"),
    )
    mask = F.transform(F.filter("t", lambda x: x["learn"]), lambda x: F.struct(x["start"].cast("int").alias("start"), x["length"].alias("length")))
    return rows.select("conv_id", F.array_join(F.transform("t", lambda x: x["turn"]), "").alias("formatted"), mask.alias("loss_mask"))


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) from a formatted conversation."""
    pieces = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda x, i: i > 0)
    head = lambda x: F.regexp_extract(x, r"^((?:[^\\\n]|\\(?s:.))*)\n", 1)
    body = lambda x: F.substring(x, F.length(head(x)) + 2, F.length(x) - F.length(head(x)) - 1 - len(STOP) - 1)
    return F.transform(pieces, lambda x: F.struct(unescape(head(x)).alias("role"), unescape(body(x)).alias("text")))


def loss_text(formatted: Column, mask: Column) -> Column:
    return F.array_join(F.transform(mask, lambda m: unescape(F.substring(formatted, m["start"] + 1, m["length"]))), "")


def format_conversations(rows: DataFrame) -> DataFrame:
    """Format linear conversations (conv_id, turn, role, text): each turn replies to the one before.

    Turns with one number follow each other by role and text.
    """
    rows = rows.select("conv_id", "turn", "role", "text").withColumn("conv", F.to_json(F.struct("conv_id")))
    place = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    messages = durable(rows.withColumn("node", F.row_number().over(place).cast("long")))
    tree = messages.select(
        "conv", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(1.0).alias("score")
    )
    return format_branches(messages, best_branches(tree))


def op10_query(conversations: DataFrame) -> DataFrame:
    probe = conversations.sparkSession.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit(ASSISTANT)).alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    done = format_conversations(conversations.select("conv_id", "turn", "role", "text").unionByName(probe))
    done = done.withColumn("_turns", read_turns(F.col("formatted"))).withColumn("_loss", loss_text(F.col("formatted"), F.col("loss_mask")))
    spoken = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(spoken.cast("binary"), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
