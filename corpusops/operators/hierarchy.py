"""Trees kept as node and link tables: paths, levels and ancestors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusops.session import stored

MAX_LEVEL = 10


def tree_paths(nodes: DataFrame, links: DataFrame, node: str, name: str, child: str, parent: str,
               max_level: int = MAX_LEVEL) -> DataFrame:
    """(node, name, parent, level, path, chain) of every node reached from a root.

    Roots are the nodes without a link of their own; links with a missing child are ignored.
    A node below several parents appears once per path; nodes on a cycle, below a missing
    parent or deeper than ``max_level`` do not appear.

    By pointer doubling: a walk is kept with its top, and a round hangs every open walk (one whose top is no root)
    on the walks of its top, so the length of open walks doubles and a tree of depth d takes about log2(d) rounds.
    Each round is written once, so the plan does not grow; an open walk longer than ``max_level`` is
    dropped, which ends cycles. Parents with very many children make one side of a join skewed, which
    adaptive execution splits.
    """
    named = nodes.select(F.col(node).alias("node"), F.col(name).alias("name"))
    up = links.filter(F.col(child).isNotNull()).select(
        F.col(child).alias("node"), F.col(parent).alias("parent")
    )
    edges = up.filter(F.col("parent").isNotNull()).join(named, "node")
    roots = named.join(up.select("node"), "node", "left_anti").withColumn("parent", F.lit(None).cast(up.schema["parent"].dataType))
    ids, names = F.array(F.col("node").cast("string")).alias("chain"), F.array("name").alias("names")
    own = ["node", "name", "parent"]
    walks = stored(
        roots.select(*own, F.lit(0).alias("level"), F.col("parent").alias("top"), F.lit(False).alias("open"), ids, names)
        .unionByName(edges.select(*own, F.lit(1).alias("level"), F.col("parent").alias("top"), F.lit(True).alias("open"), ids, names)),
        "walks",
    )
    reach = 1
    while reach <= max_level:
        above = walks.select(
            F.col("node").alias("_node"), F.col("level").alias("_level"), F.col("top").alias("_top"), F.col("open").alias("_open"),
            F.col("chain").alias("_chain"), F.col("names").alias("_names"),
        )
        longer = walks.filter("open").join(above, F.col("top") == F.col("_node")).filter(F.col("level") + F.col("_level") <= max_level)
        longer = longer.select(
            *own, (F.col("level") + F.col("_level")).alias("level"), F.col("_top").alias("top"), F.col("_open").alias("open"),
            F.concat("_chain", "chain").alias("chain"), F.concat("_names", "names").alias("names"),
        )
        walks = stored(walks.filter(~F.col("open")).unionByName(longer), "walks")
        reach *= 2
        if walks.filter("open").isEmpty():
            break
    path = F.when(F.col("level") == 0, F.col("name")).otherwise(F.concat_ws(" > ", "names"))
    return walks.filter(~F.col("open")).select(*own, "level", path.alias("path"), "chain")


def ancestor_at(chain: Column, level: Column | int) -> Column:
    """Id of the ancestor at a level (0 = root), null where the node is above it."""
    lvl = F.lit(level) if isinstance(level, int) else level
    return F.get(chain, lvl)
