"""Reachability and components by rounds of joins.

Every round writes its frontier once to the folder that executors share, so plans stay short and survive lost
executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemill.operators.rounds import done_with, written


def hops(edges: DataFrame, starts: DataFrame, most: int) -> DataFrame:
    """(start, node, hops): nodes within ``most`` hops of each start, by fewest hops; the start itself is 0."""
    step = edges.select(F.col("caller").alias("from"), F.col("callee").alias("to")).distinct()
    seen = frontier = written(starts.select("start", F.col("start").alias("node"), F.lit(0).alias("hops")))
    for n in range(1, most + 1):
        ahead = frontier.join(step, F.col("node") == F.col("from")).select("start", F.col("to").alias("node")).distinct()
        frontier = written(ahead.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("hops", F.lit(n)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that each node is connected with."""
    both = written(edges.select(F.col("caller").alias("a"), F.col("callee").alias("b")).unionByName(edges.select(F.col("callee").alias("a"), F.col("caller").alias("b"))).distinct())
    labels = held = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).withColumnRenamed("a", "node"))
    while True:
        # files that are small may hold many labels: none of them goes through the driver, as it would to be broadcast
        near = both.join(labels.withColumnRenamed("node", "b").hint("merge"), "b").groupBy("a").agg(F.min("label").alias("near"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = written(labels.join(near.hint("merge"), F.col("node") == F.col("a")).join(jump.hint("merge"), "label").select("node", F.least("label", "near", "further").alias("label"), F.col("label").alias("old")))
        if new.where("label != old").isEmpty():
            done_with(held, both)
            return new.select("node", F.col("label").alias("component"))
        done_with(held)
        labels, held = new.select("node", "label"), new


def roots(links: DataFrame) -> DataFrame:
    """(node, root): the end of each node's chain of ``canonical`` nodes, by pointer jumping.

    A link that is null or does not lead to a smaller node is none, so chains end; a canonical node without
    a row of its own is a root.
    """
    at = held = written(links.select("node", F.when(F.col("canonical") < F.col("node"), F.col("canonical")).otherwise(F.col("node")).alias("root")))
    while True:
        up = at.select(F.col("node").alias("root"), F.col("root").alias("further"))
        new = written(at.join(up, "root", "left").select("node", F.coalesce("further", "root").alias("root"), F.col("root").alias("old")))
        if new.where("root != old").isEmpty():
            done_with(held)
            return new.select("node", "root")
        done_with(held)
        at, held = new.select("node", "root"), new


def reachable(edges: DataFrame, starts: DataFrame, most: int) -> DataFrame:
    """(node): what any of the starts (node) leads to within ``most`` calls, the starts included."""
    step = edges.select(F.col("caller").alias("from"), F.col("callee").alias("to")).distinct()
    seen = frontier = written(starts.select("node").dropna().distinct())
    for _ in range(most):
        ahead = frontier.join(step, F.col("node") == F.col("from")).select(F.col("to").alias("node")).distinct()
        frontier = written(ahead.join(seen, "node", "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen
