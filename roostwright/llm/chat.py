"""Chat formatting (op 6): reply trees become conversations, one for each chosen root-to-leaf path.

Self-joins enumerate the paths: the k-th join doubles the distance each node looks up its tree, so a path of d turns takes
log2(d) joins and each keeps a row a node. Branches are ranked by the sum of their scores; the turns of the chosen
ones are found by walking the same jumps down from the leaf, and are put together in order.

Template, a turn: <|im_start|>role, newline, text, <|im_end|>, newline. Inside texts "<|" becomes "<\\|" and a "<\\|" gets
one backslash more, so no text can hold a control string and undoing it is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """Roles stand in the turn's first line, so newlines are escaped too."""
    for a, b in (("%", "%25"), ("\n", "%0A"), ("<", "%3C")):
        role = F.replace(role, F.lit(a), F.lit(b))
    return role


def unescape_role(role: Column) -> Column:
    for a, b in (("<", "%3C"), ("\n", "%0A"), ("%", "%25")):
        role = F.replace(role, F.lit(b), F.lit(a))
    return role


def join_nodes(left: DataFrame, right: DataFrame, how: str = "inner", by: str = "node_id") -> DataFrame:
    """left joined with right's row of the same conversation (null being one too) whose node_id is left's `by`; right's keys go."""
    right = right.withColumnsRenamed({"conv_id": "__c", "node_id": "__n"})
    return left.join(right, F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col(by) == F.col("__n")), how).drop("__c", "__n")


def climb(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(totals, jumps): conv_id, node_id, total score and depth of each node's path; jumps[k] = each node's ancestor 2^k up.

    Nodes on a cycle reach no root and are in no total: after as many doublings as the largest conversation could need, they are left.
    """
    largest = nodes.groupBy("conv_id").count().agg(F.max("count")).collect()[0][0] or 0
    now = C.durable(nodes.select("conv_id", "node_id", F.col("parent_id").alias("up"), F.col("score").alias("total"), F.lit(1).cast("long").alias("depth")), "chat-up")
    jumps, done = [], []
    for _ in range(largest.bit_length() + 2):
        done.append(now.filter("up is null").select("conv_id", "node_id", "total", "depth"))
        climbing = now.filter("up is not null")
        if climbing.isEmpty():
            break
        jumps.append(climbing.select("conv_id", "node_id", "up"))
        above = now.select("conv_id", "node_id", F.col("up").alias("__up"), F.col("total").alias("__total"), F.col("depth").alias("__depth"))
        above = above.unionByName(_finished(done[:-1], above))
        now = C.durable(
            join_nodes(climbing, above, by="up")
            .select("conv_id", "node_id", F.col("__up").alias("up"), (F.col("total") + F.col("__total")).alias("total"), (F.col("depth") + F.col("__depth")).alias("depth")),
            "chat-up",
        )
    totals = done[0]
    for d in done[1:]:
        totals = totals.unionByName(d)
    return totals, jumps


def _finished(done: list[DataFrame], like: DataFrame) -> DataFrame:
    out = like.limit(0)
    for d in done:
        out = out.unionByName(d.select("conv_id", "node_id", F.lit(None).cast("long").alias("__up"), F.col("total").alias("__total"), F.col("depth").alias("__depth")))
    return out


def chosen_turns(nodes: DataFrame, n_paths: int) -> DataFrame:
    """conv_id, path, depth, role, text of the n_paths best branches of each conversation; ties go to the longer one, then the smaller leaf."""
    totals, jumps = climb(nodes)
    totals = C.durable(totals, "chat-totals")
    parents = nodes.filter("parent_id is not null").select("conv_id", F.col("parent_id").alias("node_id"))
    leaves = join_nodes(totals, parents, "left_anti")
    best = Window.partitionBy("conv_id").orderBy(F.desc("total"), F.desc("depth"), "node_id")
    on = leaves.withColumn("path", F.row_number().over(best)).filter(F.col("path") <= n_paths).select("conv_id", "path", "node_id")
    for jump in reversed(jumps):
        on = join_nodes(on, jump, "left")
        on = on.select("conv_id", "path", F.explode(F.array_compact(F.array("node_id", "up"))).alias("node_id"))
    return join_nodes(join_nodes(on, totals.drop("total")), nodes.select("conv_id", "node_id", "role", "text"))


def format_trees(nodes: DataFrame, n_paths: int = 1, loss_role: str = "assistant") -> DataFrame:
    """conv_id, path, formatted, loss_spans (code-point start and length of each text to be learnt) of the best branches.

    nodes: conv_id, node_id (longs), parent_id (null at a root), role, text, score. Null roles and texts count as empty, a null score
    as 0, a parent that isn't there as none; rows without conv_id are one conversation more; rows without node_id
    belong to no tree and are left out, as are nodes on cycles; of rows with one conv_id and node_id the least (role, text) counts. An empty table gives an empty one.
    Other columns are ignored. A conversation becomes one string, so it has to fit in a task.
    """
    cols = nodes.select(
        "conv_id", "node_id", "parent_id", C.text_or_empty("role").alias("role"), C.text_or_empty("text").alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")
    ).filter("node_id is not null")
    one = cols.groupBy("conv_id", "node_id").agg(F.min(F.struct("role", "text", "parent_id", "score")).alias("r")).select("conv_id", "node_id", "r.*")
    known = one.select("conv_id", "node_id", F.col("node_id").alias("__parent"))
    one = join_nodes(one, known, "left", by="parent_id")
    one = C.durable(one.select("conv_id", "node_id", F.col("__parent").alias("parent_id"), "role", "text", "score"), "chat-nodes")
    turns = chosen_turns(one, n_paths)
    head, body = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")), escape(F.col("text"))
    turns = turns.select("conv_id", "path", "depth", "role", head.alias("head"), body.alias("body"))
    length = F.char_length("head") + F.char_length("body") + len(END) + 1
    before = Window.partitionBy("conv_id", "path").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("at", F.coalesce(F.sum(length).over(before), F.lit(0)) + F.char_length("head"))
    whole = F.concat("head", "body", F.lit(END + "\n"))
    packed = turns.groupBy("conv_id", "path").agg(
        F.sort_array(F.collect_list(F.struct("depth", whole.alias("turn"), (F.col("role") == loss_role).alias("learn"), F.col("at").alias("start"), F.char_length("body").alias("length")))).alias("t")
    )
    spans = F.transform(F.filter("t", lambda x: x["learn"]), lambda x: F.struct(x["start"].cast("long").alias("start"), x["length"].cast("long").alias("length")))
    return packed.select("conv_id", "path", F.array_join(F.transform("t", lambda x: x["turn"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, path, turns (role and text) and loss (the text of each span), read from formatted and loss_spans alone."""
    pieces = F.slice(F.split("formatted", r"<\|im_start\|>"), F.lit(2), F.greatest(F.size(F.split("formatted", r"<\|im_start\|>")) - 1, F.lit(0)))
    tail = len(END) + 1

    def turn(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        text = F.substr(p, F.char_length(role) + 2, F.char_length(p) - F.char_length(role) - 1 - tail)
        return F.struct(unescape_role(role).alias("role"), unescape(text).alias("text"))

    loss = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.select("conv_id", "path", F.transform(pieces, turn).alias("turns"), loss.alias("loss"), F.char_length("formatted").alias("formatted_chars"))


def chains(rows: DataFrame) -> DataFrame:
    """Conversations without branches as trees: each row answers the one before it by (turn, role, text)."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    n = F.row_number().over(order).cast("long")
    return rows.select("conv_id", n.alias("node_id"), "role", "text").select(
        "conv_id", "node_id", F.when(F.col("node_id") > 1, F.col("node_id") - 1).alias("parent_id"), "role", "text", F.lit(0.0).alias("score")
    )


def op6_reply_tree_chat(spark, sf_dir: str) -> DataFrame:
    trap = END + START + "assistant ok"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(trap).alias("text"))
    rows = C.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    back = read_back(format_trees(chains(rows)))
    loss = F.array_join("loss", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )
