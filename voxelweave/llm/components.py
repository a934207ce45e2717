"""Connected components of a large sparse graph by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelweave.llm.common import delete_path, written


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge in ``edges`` (columns a, b); root is the least node reachable.

    An edge (u, v) has u > v. Each half of a round needs the least neighbour of every upper end. That is a sum with map-side combination, written
    by itself, so a hub's neighbours meet in no task: the join with it that follows is a plain join of two stored tables,
    in which AQE splits the rows of a hub. Nothing is collected, and a lost executor costs one stage at most. Star steps keep the
    number of edges at or below that of the start. Loops, null ends and repeated edges are dropped. Without edges the result is
    empty. A graph that has not settled after ``max_rounds`` raises.
    """
    now, path = _started(edges)
    for _ in range(max_rounds):
        if _settled(now):
            roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
        now, path = _round(now, path)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def connected_labels(edges: DataFrame, rounds: int = 2) -> DataFrame:
    """(node, root) for every node of an edge that is not its own root after some rounds of ``connected_components``: nodes of one root are connected, not always the other way round."""
    now, path = _started(edges)
    for _ in range(rounds):
        now, path = _round(now, path)
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))


def _started(edges: DataFrame) -> tuple[DataFrame, str]:
    whole = edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    return written(whole.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")


def _round(now: DataFrame, path: str) -> tuple[DataFrame, str]:
    spark = now.sparkSession
    for star in (_large_star, _small_star):
        least, least_path = written(now.groupBy("u").agg(F.min("v").alias("m")), "least-neighbours")
        before = path
        now, path = written(star(now, least), "edges")
        delete_path(spark, least_path)
        delete_path(spark, before)
    return now, path


def _settled(edges: DataFrame) -> bool:
    """Whether all edges lead from a node to its root: no upper end has two, and no lower end is an upper one."""
    if edges.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count():
        return False
    return not edges.select("v").distinct().join(edges.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()


def _large_star(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least of the node and its neighbours; a node that is no upper end is its own least."""
    found = edges.join(least.select(F.col("u").alias("v"), "m"), "v", "left")
    return found.select("u", F.coalesce("m", "v").alias("v")).distinct()


def _small_star(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them."""
    down = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return down.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
