"""Links between pages: edges, bounded breadth-first expansion, and rules of which the first that matches wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import checkpointed
from .ordering import ordinals


def expand(seeds: DataFrame, edges: DataFrame, depth: int, per_node: int = 10) -> DataFrame:
    """(node, depth) reached from seeds (node) over edges (source, target, position); of a node the first links only."""
    ranked = edges.withColumn("__r", F.row_number().over(Window.partitionBy("source").orderBy("position", "target"))).where(F.col("__r") <= per_node).select("source", "target")
    seen = seeds.select("node", F.lit(0).alias("depth"))
    frontier = seen
    for d in range(1, depth + 1):
        step = frontier.join(ranked, frontier["node"] == ranked["source"]).select(F.col("target").alias("node")).distinct()
        frontier = step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(d))
        seen = seen.unionByName(frontier)
    return seen


def first_rule(rules: list[tuple[Column, str]], default: str) -> Column:
    """Value of the first rule whose condition holds."""
    out = F.lit(default)
    for condition, value in reversed(rules):
        out = F.when(condition, value).otherwise(out)
    return out


def glob(c: Column, pattern: str) -> Column:
    """Shell pattern with * and ? over a whole value."""
    import re

    return c.rlike("^" + re.escape(pattern).replace(r"\*", ".*").replace(r"\?", ".") + "$")


def crawl(seeds: DataFrame, edges: DataFrame, depth: int, pages: int, per_node: int = 10) -> DataFrame:
    """(node, depth, rank) of the first `pages` nodes that a queue takes from seeds (node) over edges (source, target, position,
    and priority if there is one): breadth first, within a depth by priority, then in the order in which nodes were taken and
    their links stand; of a node the first per_node links count, and a node is taken once.

    A level is a few joins and ends in a checkpoint, so that lineage doesn't grow; levels end at the depth, at the page cap, or
    where nothing new is found."""
    priority = F.col("priority") if "priority" in edges.columns else F.lit(0)
    first = F.row_number().over(Window.partitionBy("source").orderBy("position", "target"))
    links = edges.select("source", "target", "position", priority.alias("priority"), first.alias("n")).where(F.col("n") <= per_node)
    level = ordinals(seeds.select("node").distinct(), "node", name="rank").select("node", F.lit(0).alias("depth"), "rank")
    seen, taken = checkpointed(level.where(F.col("rank") <= pages)), 0
    level = seen
    for d in range(1, depth + 1):
        taken += level.count()
        if taken >= pages:
            break
        found = level.join(links, F.col("node") == F.col("source")).groupBy("target").agg(F.min(F.struct((-F.col("priority")).alias("p"), F.col("rank").alias("r"), F.col("position").alias("at"))).alias("first"))
        new = found.join(seen.select(F.col("node").alias("target")), "target", "left_anti").select(F.col("target").alias("node"), "first.*")
        placed = ordinals(new, "p", "r", "at", "node", name="k")
        level = checkpointed(placed.select("node", F.lit(d).alias("depth"), (F.col("k") + taken).alias("rank")).where(F.col("rank") <= pages))
        if level.isEmpty():
            break
        seen = checkpointed(seen.unionByName(level))
    return seen
