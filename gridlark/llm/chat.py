"""Reply trees as chat conversations, with DataFrame functions only.

``paths`` enumerates root-to-leaf paths by iterative self-joins with pointer doubling: after round i every leaf knows its
2^i nearest ancestors, so a tree of depth d takes log2(d) rounds and each round joins on the unique key (tree, node).
``ranked_branches`` scores and ranks the paths of a tree, and ``formatted`` writes each chosen path as one conversation.

Template, per turn: ``<|im_start|>role\\ntext<|im_end|>\\n``.  Inside roles and texts ``&`` becomes ``&amp;`` and ``<|``
becomes ``&lt;|`` (roles also escape line feeds), so no text can forge a turn and ``unescape`` restores it.  ``loss_spans``
gives start and length (code points, in the formatted string) of what assistants say.

Edge cases: null text is the empty text, null role the empty role; a node whose parent is absent is a root; nodes in a
parent cycle are on no root-to-leaf path and are left out; rows that repeat a (tree, node) key keep the smallest (parent,
role, text); null trees form one tree, rows with null nodes are left out; an empty table gives no conversations; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

START, END = "<|im_start|>", "<|im_end|>"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def _escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("&#10;"))


def _unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("&#10;"), F.lit("\n")))


def linear_tree(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows in order of ``turn`` as a tree in which each row replies to the one before; equal turns go by role and text."""
    w = Window.partitionBy("tree").orderBy(F.col(turn).asc_nulls_first(), F.col(role).asc_nulls_first(), F.col(text).asc_nulls_first())
    node = turns.select(F.col(conv).alias("tree"), F.col(turn), F.col(role), F.col(text)).withColumn("node", F.row_number().over(w).cast("long"))
    return node.select(
        "tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"), F.lit(0.0).alias("score")
    )


def unique_nodes(nodes: DataFrame) -> DataFrame:
    best = F.min(F.struct("parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score")))
    return nodes.where(F.col("node").isNotNull()).groupBy("tree", "node").agg(best.alias("b")).select("tree", "node", "b.*")


def paths(nodes: DataFrame) -> DataFrame:
    """tree, leaf, node, up (steps from the leaf) for all nodes on root-to-leaf paths.  ``nodes`` has unique (tree, node) keys and is a written table."""
    same = F.col("tree").eqNullSafe(F.col("t"))
    key = nodes.select("tree", "node", "parent")
    known = key.select(F.col("tree").alias("t"), F.col("node").alias("p"))
    jumps = [staged(key.join(known, same & (F.col("parent") == F.col("p")), "left").select("tree", "node", F.col("p").alias("to")), "jump")]
    largest = key.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    endless = None
    while True:  # jumps[i] leads 2^i steps up
        there = jumps[-1].where("to is not null")
        if there.isEmpty():
            break
        if 1 << (len(jumps) - 1) >= largest:  # still going after as many steps as there are nodes: a cycle
            endless = there.select(F.col("tree").alias("t"), F.col("node").alias("p"))
            break
        onward = there.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("to").alias("far"))
        jumps.append(staged(there.join(onward, same & (F.col("to") == F.col("n"))).select("tree", "node", F.col("far").alias("to")), "jump"))
    inner = key.where("parent is not null").select(F.col("tree").alias("t"), F.col("parent").alias("p")).distinct()
    leaves = key.join(inner, same & (F.col("node") == F.col("p")), "left_anti")
    if endless is not None:
        leaves = leaves.join(endless, same & (F.col("node") == F.col("p")), "left_anti")
    member = staged(leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")), "member")
    for i, jump in enumerate(jumps):
        there = jump.where("to is not null").select(F.col("tree").alias("t"), F.col("node").alias("n"), "to")
        more = member.join(there, same & (F.col("node") == F.col("n"))).select("tree", "leaf", F.col("to").alias("node"), (F.col("up") + (1 << i)).alias("up"))
        member = member.unionByName(staged(more, "member"))
    return member


def ranked_branches(nodes: DataFrame, members: DataFrame, keep: int | None = 1) -> DataFrame:
    """tree, leaf, branch_score (mean node score), branch_rank; ties go to the longer path, then the smaller leaf."""
    scored = members.join(nodes.select(F.col("tree").alias("t"), F.col("node").alias("n"), "score"), F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")))
    branch = scored.groupBy("tree", "leaf").agg(F.avg("score").alias("branch_score"), F.count("*").alias("n_turns"))
    w = Window.partitionBy("tree").orderBy(F.desc("branch_score"), F.desc("n_turns"), "leaf")
    ranked = branch.withColumn("branch_rank", F.row_number().over(w))
    return ranked if keep is None else ranked.where(F.col("branch_rank") <= keep)


def formatted(nodes: DataFrame, members: DataFrame, branches: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One conversation a chosen branch: ``formatted`` and ``loss_spans`` (start, length in code points)."""
    b = branches.select(F.col("tree").alias("bt"), F.col("leaf").alias("bl"), "branch_rank")
    chosen = members.join(b, F.col("tree").eqNullSafe(F.col("bt")) & (F.col("leaf") == F.col("bl")))
    text = nodes.select(F.col("tree").alias("t"), F.col("node").alias("n"), "role", "text")
    turns = chosen.join(text, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")))
    head = F.concat(F.lit(START), _escape_role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    turn = F.struct((-F.col("up")).alias("at"), F.concat(head, body, F.lit(END + "\n")).alias("s"), F.char_length(head).alias("head"), F.char_length(body).alias("body"), F.col("role").isin(*loss_roles).alias("loss"))
    one = turns.groupBy("tree", "leaf", "branch_rank").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    # spans: running start of each turn plus its head
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start:long,length:long>>)").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        span = F.array(F.struct((acc["at"] + x["head"]).cast("long").alias("start"), x["body"].cast("long").alias("length")))
        return F.struct((acc["at"] + F.char_length(x["s"])).cast("long").alias("at"), F.when(x["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return one.select(
        "tree", "leaf", "branch_rank", F.array_join(F.transform("turns", lambda x: x["s"]), "").alias("formatted"), F.aggregate("turns", zero, step, lambda acc: acc["spans"]).alias("loss_spans")
    )


def parsed_turns(text: Column) -> Column:
    """The turns of a formatted conversation as array<struct<role, text>>, unescaped."""
    blocks = F.filter(F.split(text, r"<\|im_end\|>\n"), lambda x: x != "")
    inner = F.transform(blocks, lambda x: F.substr(x, F.lit(len(START) + 1)))
    return F.transform(inner, lambda x: F.struct(_unescape_role(F.substring_index(x, "\n", 1)).alias("role"), unescape(F.substr(x, F.instr(x, "\n") + 1)).alias("text")))


def loss_texts(text: Column, spans: Column) -> Column:
    """What stands under the loss mask, unescaped, one string a span."""
    return F.transform(spans, lambda s: unescape(F.substr(text, (s["start"] + 1).cast("int"), s["length"].cast("int"))))


def format_trees(nodes: DataFrame, keep: int | None = 1) -> DataFrame:
    """Reply trees (tree, node, parent, role, text, score) to conversations: tree, leaf, branch_rank, formatted, loss_spans."""
    nodes = staged(unique_nodes(nodes), "nodes")
    members = staged(paths(nodes), "paths")
    return formatted(nodes, members, ranked_branches(nodes, members, keep))
