"""Record trees with all their variations, as rows.

A record's text is cut into brackets and nodes by one pattern, whose values may hold anything escaped. The tree follows
from running sums over these tokens: how deep each lies, which group of its level it is in, the last node before a
bracket. Every node has its place and the place where its group ends, so one node is below another exactly if its place
lies between the two; no task walks a text by character, and all windows share one shuffle by record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Brackets and nodes; a value runs to a closing bracket that is not escaped, or to the end of a text that is cut off.
TOKEN = r"(?s)[()]|;(?:[^;()\[]++|\[(?:[^\]\\]++|\\.)*+(?:\]|\\?\z))*+"
MOVE = r"^\s*([BW])\[([a-s]{2}|tt|)\]"


def record_nodes(records: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """key, tree, node, parent, depth, branch, left, right, last, played, properties: a row for each node of each record.

    Nodes are numbered from 0 in the order of the text; ``last`` is the number of the last one below a node, or its own. A node's parent is the one before it in its sequence or, for the
    first of a variation, the last one before the bracket; branch counts the children of a parent from 0. Nodes below
    x are those with left between x's left and right. The played line is the first branch at every fork of the first
    tree. A variation with nothing before it hangs nowhere and is left out, as is what follows an unmatched closing
    bracket; a record without nodes has no rows. Records of equal keys must not occur.
    """
    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    split = records.select(F.col(key).alias("key"), tokens.alias("tokens")).filter(F.size("tokens") > 0)
    rows = split.select("key", F.size("tokens").alias("end"), F.posexplode("tokens").alias("left", "token"))
    opens, closes = F.col("token") == "(", F.col("token") == ")"
    is_node = ~opens & ~closes
    text_order = Window.partitionBy("key").orderBy("left")
    upto = text_order.rowsBetween(Window.unboundedPreceding, 0)
    before = text_order.rowsBetween(Window.unboundedPreceding, -1)
    depth = F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(upto)
    read = rows.withColumn("after", depth).withColumn("least", F.min("after").over(upto)).filter("least >= 0")
    level = F.when(closes, F.col("after") + 1).otherwise(F.col("after"))
    # an opening bracket begins a group of its level and stands as a fork in the group around it
    roles = F.array(
        F.struct(level.alias("level"), F.when(opens, "open").when(closes, "close").otherwise("node").alias("role")),
        F.when(opens, F.struct((level - 1).alias("level"), F.lit("fork").alias("role"))),
    )
    placed = read.select("*", F.explode(F.filter(roles, lambda r: r["level"] > 0)).alias("r")).select("key", "end", "left", "token", "r.level", "r.role")
    role = F.col("role")
    at = lambda which, value: F.when(role == which, value)
    on_level = Window.partitionBy("key", "level").orderBy("left").rowsBetween(Window.unboundedPreceding, 0)
    group = Window.partitionBy("key", "level", "group")
    last_node = F.last(at("node", F.col("number")), ignorenulls=True).over(group.orderBy("left").rowsBetween(Window.unboundedPreceding, -1))
    text_rows = Window.partitionBy("key").orderBy("left", F.desc("level"))
    numbered = placed.withColumns(
        {
            "number": F.sum(at("node", 1).cast("int")).over(text_rows.rowsBetween(Window.unboundedPreceding, 0)) - 1,
            "tree": F.sum(F.when((role == "open") & (F.col("level") == 1), 1)).over(text_rows.rowsBetween(Window.unboundedPreceding, 0)) - 1,
            "group": F.sum(F.when(role == "open", 1).otherwise(0)).over(on_level),
        }
    )
    joined = numbered.withColumns(
        {
            "previous": last_node,
            "right": F.coalesce(F.max(at("close", F.col("left"))).over(group), F.col("end")),
            "in_group": F.count(at("node", 1)).over(group),
            "last": F.coalesce(F.max(at("close", F.col("number"))).over(group), F.max("number").over(Window.partitionBy("key"))),
        }
    )
    forked = joined.withColumn("anchor", F.max(at("fork", F.col("previous"))).over(Window.partitionBy("key", "left")))
    line = Window.partitionBy("key").orderBy("left", F.desc("level"))
    hung = forked.withColumns(
        {
            "parent": F.coalesce("previous", F.max(at("open", F.col("anchor"))).over(group)),
            # nodes open at their place and close with their group
            "depth": F.coalesce(
                F.sum(F.when(role == "node", 1).when(role == "close", -F.col("in_group")).otherwise(0)).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ),
        }
    ).filter("role = 'node'")
    nodes = Window.partitionBy("key").orderBy("left").rowsBetween(Window.unboundedPreceding, 0)
    loose = F.max(F.when(F.col("parent").isNull() & (F.col("level") > 1), F.col("right"))).over(nodes)
    kept = hung.withColumn("loose", loose).filter(F.col("loose").isNull() | (F.col("loose") < F.col("left")))
    branched = kept.withColumn("branch", F.row_number().over(Window.partitionBy("key", "parent").orderBy("left")) - 1)
    beside = F.max(F.when(F.col("branch") > 0, F.col("right"))).over(nodes)
    return branched.withColumn("beside", beside).select(
        F.col("key").alias(key), "tree", F.col("number").alias("node"), "parent", F.col("depth").cast("int").alias("depth"), "branch", "left", "right", "last",
        (F.col("beside").isNull() | (F.col("beside") < F.col("left"))).alias("played"), F.substring("token", F.lit(2), F.length("token")).alias("properties"),
    )


def node_move(properties: Column) -> Column:
    """struct<color, point> of a node that begins with a move, the point empty for a pass; null for other nodes."""
    color, point = F.regexp_extract(properties, MOVE, 1), F.regexp_extract(properties, MOVE, 2)
    return F.when(color != "", F.struct(color.alias("color"), F.when(point != "tt", point).otherwise("").alias("point")))


def played_moves(nodes: DataFrame, key: str = "path") -> DataFrame:
    """key, moves: the moves of each record's played line after its root, in order."""
    line = nodes.filter("played and depth > 0").withColumn("move", node_move(F.col("properties"))).filter("move is not null")
    return line.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("left", "move"))), lambda s: s["move"]).alias("moves"))


def straight_moves(text: Column) -> Column:
    """The moves that ``played_moves`` gives for a record of one tree without variations, from its tokens alone; null for all others."""
    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))

    def of(found: Column) -> Column:
        inner = F.slice(found, F.lit(2), F.greatest(F.size(found) - 1, F.lit(0)))
        nodes = F.when(F.element_at(inner, -1) == ")", F.slice(inner, F.lit(1), F.size(inner) - 1)).otherwise(inner)
        single = (F.get(found, F.lit(0)) == "(") & (F.size(inner) > 0) & ~F.exists(nodes, lambda t: t.isin("(", ")"))
        moves = F.transform(F.slice(nodes, F.lit(2), F.greatest(F.size(nodes) - 1, F.lit(0))), lambda t: node_move(F.substring(t, F.lit(2), F.length(t))))
        return F.when(single, F.filter(moves, lambda m: m.isNotNull()))

    return F.transform(F.array(tokens), of)[0]  # the tokens are bound once


def last_moves(nodes: DataFrame, key: str = "path") -> DataFrame:
    """key, node, branch_depth: every line's last node, with how many of its nodes lie off the played line."""
    parents = nodes.select(key, F.col("parent").alias("node")).distinct()
    ends = nodes.join(parents, [key, "node"], "left_anti")
    return ends.select(key, "node", "depth", "played")
