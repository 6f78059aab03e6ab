"""Reply trees to formatted conversations, with a loss mask; DataFrame functions only.

Root-to-leaf paths are enumerated by iterated self-joins, each of which doubles the
levels that a message looks up, so a path of n messages takes about log2(n) of them. They
carry ids and scores but no texts. The branches of a tree are ranked by their mean score;
the texts of chosen paths are joined at the end.

A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. A control string in a text gets a
backslash after its first character; one that has backslashes there gets one more. So
no text holds a control string, and dropping one backslash restores it.

Defined results: null text or role is empty. A message whose parent is missing or null
is a root. A null tree id is a tree of its own. Messages on a cycle, or
below one, have no root and belong to no path. Of equal scores the smaller leaf id ranks
first. Rows that share a tree and message id are alternatives, as of one message: the
least (role, text) counts. In a linear conversation repeated rows are turns of their own.
A conversation with all its texts is one value, so it must fit in a task. An empty table
gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinefield.llm import common

START, END = "<|im_start|>", "<|im_end|>"
#: What follows the first character of the control strings that are escaped in texts.
_TAILS = r"\|im_start\|>|\|im_end\|>|/?s>|/?INST\]|</?SYS>>"
ESCAPE = (rf"([<\[])(\\*)({_TAILS})", r"$1$2\\$3")
UNESCAPE = (rf"([<\[])\\(\\*)({_TAILS})", "$1$2$3")


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(ESCAPE[0]), F.lit(ESCAPE[1]))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(UNESCAPE[0]), F.lit(UNESCAPE[1]))


def _role(role: Column) -> Column:
    """On one line, reversibly."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _role_back(role: Column) -> Column:
    plain = F.regexp_replace(unescaped(role), F.lit(r"(?<!\\)((?:\\\\)*)\\n"), F.lit("$1\n"))
    return F.replace(plain, F.lit("\\\\"), F.lit("\\"))


def paths(messages: DataFrame, top: int, scratch: common.Scratch) -> DataFrame:
    """(tree, branch, path_score, pos, step): messages of the ``top`` best paths of each tree."""
    links = messages.groupBy("tree", "msg").agg(F.min("parent").alias("parent"), F.max("score").alias("score"))
    links = scratch.table(links, "links")
    tree = F.col("tree").eqNullSafe(F.col("ct"))
    parents = links.filter("parent is not null").select(F.col("tree").alias("ct"), F.col("parent").alias("cm")).distinct()
    known = links.select(F.col("tree").alias("ct"), F.col("msg").alias("cm"), F.lit(True).alias("known"))
    # Whether each message is answered, and its parent if that is there.
    links = links.join(parents.withColumn("answered", F.lit(True)), tree & (F.col("msg") == F.col("cm")), "left")
    links = links.drop("ct", "cm").join(known, tree & (F.col("parent") == F.col("cm")), "left")
    # ``up``: the ancestor 2**k levels up in round k; ``total`` and ``size`` are of the
    # messages from this one up to it, or to the root where there is none.
    nodes = links.select(
        "tree",
        "msg",
        F.when(F.col("known"), F.col("parent")).alias("up"),
        F.col("score").alias("total"),
        F.lit(1).alias("size"),
        F.col("answered").isNull().alias("leaf"),
    )
    jumps = []
    while True:
        nodes = scratch.table(nodes, f"round-{len(jumps)}")
        # Only a cycle leads further up than there are messages.
        if nodes.filter("up is not null").isEmpty() or nodes.count() < 1 << len(jumps):
            break
        jumps.append(nodes.filter("up is not null").select(F.col("tree").alias("ct"), F.col("msg").alias("cm"), "up"))
        above = nodes.select(
            F.col("tree").alias("ct"),
            F.col("msg").alias("cm"),
            F.col("up").alias("further"),
            F.col("total").alias("ctotal"),
            F.col("size").alias("csize"),
        )
        risen = nodes.join(above, tree & (F.col("up") == F.col("cm"))).select(
            "tree",
            "msg",
            F.col("further").alias("up"),
            (F.col("total") + F.col("ctotal")).alias("total"),
            (F.col("size") + F.col("csize")).alias("size"),
            "leaf",
        )
        nodes = risen.unionByName(nodes.filter("up is null"))
    best = Window.partitionBy("tree").orderBy(F.col("path_score").desc(), F.col("msg"))
    leaves = nodes.filter("leaf and up is null").withColumn("path_score", F.col("total") / F.col("size"))
    steps = (
        leaves.withColumn("branch", F.row_number().over(best))
        .filter(F.col("branch") <= top)
        .select("tree", "branch", "path_score", F.col("msg").alias("step"), (F.col("size") - 1).alias("pos"))
    )
    # From the largest jump down, each known message adds the one that far above it.
    for k in reversed(range(len(jumps))):
        here = F.struct("step", "pos")
        there = F.struct(F.col("up").alias("step"), (F.col("pos") - (1 << k)).alias("pos"))
        both = F.when(F.col("up").isNull(), F.array(here)).otherwise(F.array(here, there))
        steps = (
            steps.join(jumps[k], tree & (F.col("step") == F.col("cm")), "left")
            .select("tree", "branch", "path_score", F.explode(both).alias("s"))
            .select("tree", "branch", "path_score", "s.step", "s.pos")
        )
    return steps


def format_threads(messages: DataFrame, top: int = 1, loss_role: str = "assistant") -> DataFrame:
    """(tree, branch, path_score, n_turns, formatted, loss_spans).

    ``messages``: tree, msg, parent, role, text, score. ``loss_spans``: starts and ends in
    code points of ``formatted`` of the texts of ``loss_role``.
    """
    scratch = common.Scratch(messages.sparkSession, "chat")
    messages = messages.select(
        F.col("tree"),
        F.col("msg"),
        F.col("parent"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
    )
    chosen = paths(messages, top, scratch)
    said = messages.groupBy(F.col("tree").alias("mt"), F.col("msg").alias("mm")).agg(F.min(F.struct("role", "text")).alias("m"))
    turns = chosen.join(said, F.col("tree").eqNullSafe(F.col("mt")) & (F.col("step") == F.col("mm")))
    head = F.concat(F.lit(START), _role(F.col("m.role")), F.lit("\n"))
    turn = F.struct(
        "pos",
        (F.col("m.role") == loss_role).alias("loss"),
        F.length(head).alias("head"),
        F.concat(head, escaped(F.col("m.text")), F.lit(END + "\n")).alias("piece"),
    )
    whole = turns.groupBy("tree", "branch", "path_score").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    tail = len(END) + 1
    spans = F.aggregate(
        "turns",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + F.length(t["piece"])).alias("at"),
            F.when(
                t["loss"],
                F.concat(
                    acc["spans"],
                    F.array(
                        F.struct(
                            (acc["at"] + t["head"]).alias("start"),
                            (acc["at"] + F.length(t["piece"]) - tail).alias("end"),
                        )
                    ),
                ),
            )
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
    )
    return whole.select(
        "tree",
        "branch",
        "path_score",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        spans["spans"].alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    pieces = F.split(formatted, r"<\|im_end\|>\n")
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def parse(piece: Column) -> Column:
        body = F.substr(piece, F.lit(len(START) + 1))
        role = F.substring_index(body, "\n", 1)
        text = F.substr(body, F.length(role) + 2)
        return F.struct(_role_back(role).alias("role"), unescaped(text).alias("text"))

    return F.transform(pieces, parse)


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(
        F.transform(spans, lambda s: unescaped(F.substr(formatted, s["start"] + 1, s["end"] - s["start"]))), ""
    )


def conversation_messages(conversations: DataFrame) -> DataFrame:
    """Linear conversations as reply trees: each turn answers the one before it.

    Rows of one turn stand in the order of role and text.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select(F.col("conv_id").cast("long"), "turn", "role", "text")
    rows = rows.withColumn("msg", F.row_number().over(order).cast("long"))
    parent = F.when(F.col("msg") > 1, F.col("msg") - 1)
    return rows.select(F.col("conv_id").alias("tree"), "msg", parent.alias("parent"), "role", "text", F.lit(0.0).alias("score"))
