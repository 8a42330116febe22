"""Reply trees as chat-formatted conversations, with DataFrame operations only.

A tree's rows name their parents. Iterative self-joins double the distance that each row sees upward
(1, 2, 4, ... ancestors, with the sum of the scores on the way). By the same tables, from the longest distance
to the shortest, each leaf climbs to its root and has the score of its branch: as many joins as the depth
has bits, a row for each leaf. Branches are ranked, and only the chosen ones are then enumerated, as rows (leaf, node)
by the same tables: as many rows as these paths have nodes. Each becomes one conversation.

Template: `<|im_start|>role\\ntext<|im_end|>\\n` for each turn. In roles and texts a backslash is doubled
and `<|` becomes `<\\|`, in roles a line feed becomes `\\n`: no control string is left in them, and
unescaped() gives the original. The loss mask is the spans of the assistant's texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabscout.llm.shared import written

START, END = "<|im_start|>", "<|im_end|>\n"
TRAINED = "assistant"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\n"))


def unescaped(text: Column) -> Column:
    """The original of an escaped text or role: what stands between doubled backslashes, each with its escapes undone."""
    part = F.transform(F.split(text, r"\\\\", -1), lambda x: F.replace(F.replace(x, F.lit("<\\|"), F.lit("<|")), F.lit("\\n"), F.lit("\n")))
    return F.array_join(part, "\\")


def _same(a: DataFrame, b: DataFrame, node: str) -> Column:
    return a["tree"].eqNullSafe(b["t"]) & (a[node] == b["n"])


def _ancestors(nodes: DataFrame) -> list[DataFrame]:
    """Tables (t, n, up, gain): for k = 0, 1, ... the ancestor of each node 2**k steps up, where there is one, and the scores from the parent up to it.

    Nodes on a cycle, or below one, are in a last table of their own length; see paths().
    """
    own = nodes.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.coalesce("score", F.lit(0.0)).alias("gain"))
    linked = nodes.where(F.col("parent").isNotNull()).select("tree", "node", "parent")
    step = written(linked.join(own, _same(linked, own, "parent")).select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("parent").alias("up"), "gain"), "ancestors")
    most = nodes.groupBy("tree").count().agg(F.max("count").alias("m")).first()["m"] or 0
    levels = [step]
    while 1 << (len(levels) - 1) <= most and not levels[-1].isEmpty():
        a = levels[-1].select(F.col("t").alias("tree"), F.col("n").alias("from"), F.col("up").alias("mid"), F.col("gain").alias("first"))
        b = levels[-1]
        levels.append(written(a.join(b, _same(a, b, "mid")).select(F.col("tree").alias("t"), F.col("from").alias("n"), "up", (F.col("first") + F.col("gain")).alias("gain")), "ancestors"))
    return levels


def _branches(leaves: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """Rows (tree, leaf, node, score, depth): the root, the sum of the scores and the steps of each leaf's branch; `leaves` has tree, leaf and score."""
    now = leaves.select("tree", "leaf", F.col("leaf").alias("node"), "score", F.lit(0).alias("depth"))
    for k in range(len(levels) - 1, -1, -1):
        step = levels[k]
        climbed = F.col("up").isNotNull()
        now = now.join(step, _same(now, step, "node"), "left").select("tree", "leaf", F.coalesce("up", "node").alias("node"), (F.col("score") + F.coalesce("gain", F.lit(0.0))).alias("score"), (F.col("depth") + F.when(climbed, 1 << k).otherwise(0)).alias("depth"))
        now = written(now, "branches")
    return now


def paths(nodes: DataFrame, best: int | None = 1) -> DataFrame:
    """Rows (tree, leaf, up, node) of the best root-to-leaf paths of each tree; `up` steps above the leaf.

    `nodes` has tree, node (unique in its tree, not null), parent and score. A parent that is null or not
    in the tree makes a root. Nodes on a cycle or below one are on no path. Paths rank by the sum of
    their scores (null: 0), ties by depth and then by the smaller leaf; best=None keeps all.
    """
    levels = _ancestors(nodes)
    endless, levels = levels[-1], levels[:-1]  # empty, unless there are cycles
    parents = nodes.where(F.col("parent").isNotNull()).select(F.col("tree").alias("t"), F.col("parent").alias("n"))
    leaves = nodes.join(parents, _same(nodes, parents, "node"), "left_anti")
    leaves = leaves.join(endless, _same(leaves, endless, "node"), "left_anti").select("tree", F.col("node").alias("leaf"), F.coalesce("score", F.lit(0.0)).alias("score"))
    if best is not None:
        rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), F.desc("depth"), "leaf"))
        leaves = _branches(leaves, levels).withColumn("rank", rank).where(F.col("rank") <= best)
    found = written(leaves.select("tree", "leaf", F.col("leaf").alias("node"), F.lit(0).alias("up")), "paths")
    for k in range(len(levels) - 1, -1, -1):
        above = levels[k].select("t", "n", F.col("up").alias("above"))
        more = found.join(above, _same(found, above, "node")).select("tree", "leaf", F.col("above").alias("node"), (F.col("up") + (1 << k)).alias("up"))
        found = written(found.unionByName(more), "paths")
    return found


def formatted(nodes: DataFrame, best: int | None = 1) -> DataFrame:
    """Rows (tree, leaf, n_turns, conversation, loss array<struct<start,end>>), one for each chosen path.

    `nodes` has tree, node, parent, score, role and text. `loss` has the spans (code points of the
    conversation, end exclusive) of the escaped texts of the assistant. Null roles and texts are empty. Rows that
    repeat a node's id count once, as the smallest by parent, role and text. A null tree is a tree. An
    empty table gives no rows.
    """
    clean = nodes.where(F.col("node").isNotNull()).select("tree", "node", F.struct("parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "score").alias("x"))
    clean = written(clean.groupBy("tree", "node").agg(F.min("x").alias("x")).select("tree", "node", "x.*"), "nodes")
    told = clean.select(F.col("tree").alias("t"), F.col("node").alias("n"), escaped_role(F.col("role")).alias("role"), escaped(F.col("text")).alias("text"), (F.col("role") == TRAINED).alias("trained"))
    steps = paths(clean.select("tree", "node", "parent", "score"), best)
    rows = steps.join(told, _same(steps, told, "node")).select("tree", "leaf", "up", "role", "text", "trained")
    rows = rows.withColumn("turn", F.concat(F.lit(START), "role", F.lit("\n"), "text", F.lit(END)))
    earlier = Window.partitionBy("tree", "leaf").orderBy(F.desc("up")).rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.length("turn").cast("long")).over(earlier), F.lit(0)) + F.length("role") + len(START) + 1
    rows = rows.withColumn("start", at).withColumn("end", F.col("start") + F.length("text"))
    turns = F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("place"), "turn", "trained", "start", "end")))
    out = rows.groupBy("tree", "leaf").agg(turns.alias("turns"))
    spans = F.transform(F.filter("turns", lambda x: x["trained"]), lambda x: F.struct(x["start"], x["end"]))
    return out.select("tree", "leaf", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.transform("turns", lambda x: x["turn"]), "").alias("conversation"), spans.alias("loss"))


def read_back(conversation: Column) -> Column:
    """array<struct<role,text>> of the turns of a formatted conversation, unescaped."""
    marked = F.filter(F.split(conversation, r"<\|im_start\|>", -1), lambda x: x != "")
    bare = F.transform(marked, lambda x: F.substring(x, F.lit(1), F.length(x) - len(END)))
    role = lambda x: F.substring_index(x, "\n", 1)
    return F.transform(bare, lambda x: F.struct(unescaped(role(x)).alias("role"), unescaped(F.substring(x, F.length(role(x)) + 2, F.length(x))).alias("text")))


def trained_text(conversation: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(loss, lambda s: unescaped(F.substring(conversation, s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")))), "")


def chains(rows: DataFrame, tree_column: str = "conv_id", order_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """Linear conversations as trees for formatted(): each row's parent is the row before it.

    Rows go by `order_column`, nulls first, ties by role and text.
    """
    own = rows.select(F.col(tree_column).alias("tree"), F.col(order_column).alias("place"), F.col(role_column).cast("string").alias("role"), F.col(text_column).cast("string").alias("text"))
    number = F.row_number().over(Window.partitionBy("tree").orderBy("place", "role", "text")).cast("long")
    own = own.withColumn("node", number)
    return own.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")
