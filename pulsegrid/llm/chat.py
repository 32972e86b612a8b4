r"""Chat formatting of reply trees, with DataFrame functions only.

Messages form trees: each has a node and the node it replies to.  Iterated self-joins double the distance at which
ancestors are known (parents, grandparents, ...), so a tree of depth d takes about log2(d) rounds; walking the rounds
back from the largest distance lists every node of every root-to-leaf path.  The branches of a tree are ranked by the
mean score of their messages, and each chosen branch is formatted as one conversation.

Template: a turn is ``<|role|>`` newline, text, ``</s>`` newline.  Inside roles and texts the characters ``\ < > [ ]``
are written as ``\\ \l \g \b \e``, so no control string can stand inside a text, and the escaping can be undone.
The loss mask is a list of (start, end) code point positions in the formatted text: the texts of assistant turns.

Cases: a null text or role counts as empty.  Texts of any length are kept whole.  Null keys form one conversation of their own.  A node whose parent is
missing is a root.  Nodes that lie on, or below, a cycle have no root and are in no path.  Branches of equal score rank
by leaf.  Two messages may not have the same node; ``linear_nodes`` numbers rows with equal turns apart, by role and
text.  Columns beyond those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut_lineage

#: The escape character itself comes first.
ESCAPES = (("\\", "\\\\"), ("<", "\\l"), (">", "\\g"), ("[", "\\b"), ("]", "\\e"))
END = "</s>\n"


def escape(col: Column) -> Column:
    for plain, written in ESCAPES:
        col = F.replace(col, F.lit(plain), F.lit(written))
    return col


def unescape(col: Column) -> Column:
    """Written backslashes are pairs, so splitting at them leaves only the other escapes."""

    def part(x: Column) -> Column:
        for plain, written in ESCAPES[1:]:
            x = F.replace(x, F.lit(written), F.lit(plain))
        return x

    return F.array_join(F.transform(F.split(col, r"\\\\"), part), "\\")


def linear_nodes(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text as reply chains: each row replies to the row before it in its conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    order = Window.partitionBy("conv_id").orderBy("turn", role, text)
    return conversations.select(
        F.col("conv_id").alias("tree"), (F.row_number().over(order) - 1).cast("long").alias("node"), role.alias("role"), text.alias("text"),
        F.lit(0.0).alias("score"),
    ).withColumn("parent", F.when(F.col("node") > 0, F.col("node") - 1))


def root_to_leaf_paths(nodes: DataFrame) -> DataFrame:
    """nodes: tree, node, parent.  Returns tree, leaf, node, up (distance from the leaf), one row per node of each path."""
    all_nodes = nodes.select("tree", "node", "parent")
    known = all_nodes.select("tree", "node")
    links = all_nodes.where("parent IS NOT NULL").alias("a").join(
        known.alias("b"), F.col("a.tree").eqNullSafe(F.col("b.tree")) & (F.col("a.parent") == F.col("b.node"))
    ).select("a.tree", F.col("a.node").alias("node"), F.col("a.parent").alias("anc"))
    links = cut_lineage(links)
    replied = links.select(F.col("tree").alias("t"), F.col("anc").alias("p")).distinct()
    leaves = known.join(replied, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("p")), "left_anti")

    rounds, step = [], links
    most = known.groupBy("tree").count().agg(F.max("count").alias("n")).first()["n"] or 1
    while not step.isEmpty() and 2 ** len(rounds) < most:
        rounds.append(step)
        step = cut_lineage(
            step.alias("a").join(step.alias("b"), F.col("a.tree").eqNullSafe(F.col("b.tree")) & (F.col("a.anc") == F.col("b.node")))
            .select("a.tree", F.col("a.node").alias("node"), F.col("b.anc").alias("anc"))
        )
    paths = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    for k in range(len(rounds) - 1, -1, -1):
        higher = paths.alias("p").join(
            rounds[k].alias("r"), F.col("p.tree").eqNullSafe(F.col("r.tree")) & (F.col("p.node") == F.col("r.node"))
        ).select("p.tree", "p.leaf", F.col("r.anc").alias("node"), (F.col("p.up") + 2**k).alias("up"))
        paths = cut_lineage(paths.unionByName(higher))
    if step.isEmpty():
        return paths
    # An ancestor farther away than the tree has nodes: its path runs into a cycle.
    cyclic = paths.alias("p").join(step.alias("s"), F.col("p.tree").eqNullSafe(F.col("s.tree")) & (F.col("p.leaf") == F.col("s.node")), "left_semi")
    cyclic = cyclic.select(F.col("tree").alias("t"), F.col("leaf").alias("l")).distinct()
    return paths.join(cyclic, F.col("tree").eqNullSafe(F.col("t")) & (F.col("leaf") == F.col("l")), "left_anti")


def format_branches(nodes: DataFrame, best: int | None = 1, loss_role: str = "assistant") -> DataFrame:
    """nodes: tree, node, parent, role, text, score.  best: branches kept per tree, None for all.

    Returns tree, leaf, branch_rank, branch_score, formatted (text) and loss_spans (array of start, end).
    """
    paths = root_to_leaf_paths(nodes)
    key = F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("m"))
    scores = nodes.select(F.col("tree").alias("t"), F.col("node").alias("m"), F.coalesce("score", F.lit(0.0)).alias("score"))
    order = Window.partitionBy("tree").orderBy(F.desc("branch_score"), "leaf")
    ranks = paths.join(scores, key).groupBy("tree", "leaf").agg(F.avg("score").alias("branch_score")).withColumn("branch_rank", F.row_number().over(order))
    if best is not None:
        ranks = ranks.where(F.col("branch_rank") <= best)
    ranks = ranks.select(F.col("tree").alias("rt"), F.col("leaf").alias("rl"), "branch_score", "branch_rank")
    body = nodes.select(F.col("tree").alias("t"), F.col("node").alias("m"), escape(F.coalesce("role", F.lit(""))).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turn = F.struct((-F.col("up")).alias("at"), F.col("role"), F.concat(F.lit("<|"), "role", F.lit("|>\n")).alias("head"), escape(F.col("text")).alias("body"))
    chosen = (
        paths.join(ranks, F.col("tree").eqNullSafe(F.col("rt")) & (F.col("leaf") == F.col("rl")))
        .join(body, key)  # only the texts of branches that stay
        .groupBy("tree", "leaf", "branch_rank", "branch_score")
        .agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    )
    spans = F.aggregate(
        "turns",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + F.length(t["head"]) + F.length(t["body"]) + len(END)).alias("at"),
            F.when(
                t["role"] == loss_role,
                F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.length(t["head"])).alias("start"), (acc["at"] + F.length(t["head"]) + F.length(t["body"])).alias("end")))),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    return chosen.select(
        "tree", "leaf", "branch_rank", "branch_score",
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("formatted"),
        spans["spans"].alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """Array of (role, text), unescaped, from a formatted conversation."""
    parts = F.filter(F.split(formatted, "</s>\n"), lambda x: x != "")
    return F.transform(
        parts,
        lambda x: F.struct(
            unescape(F.substring_index(x.substr(F.lit(3), F.length(x)), "|>\n", 1)).alias("role"),
            unescape(x.substr(F.locate("|>\n", x) + 3, F.length(x))).alias("text"),
        ),
    )


def read_loss(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(formatted.substr(s["start"] + 1, s["end"] - s["start"]))), "")
