"""Connected components of link tables, without a big task and without the driver."""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankbench.session import checkpointed


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links as (node, smallest node of its component); roots are left out.

    For use inside a task: it turns any number of links between the same nodes
    into fewer links than nodes, with the same components.
    """
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        before = root.copy()
        low = np.minimum(root[left], root[right])
        np.minimum.at(root, root[left], low)
        np.minimum.at(root, root[right], low)
        while True:  # every node points to the end of its chain
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        if np.array_equal(before, root):
            break
    child = root != np.arange(len(nodes))
    return nodes[child], nodes[root[child]]


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, root): the smallest node reachable; each component's root is left out.

    Alternating large-star and small-star steps: each step is a grouped minimum
    and a join on the node, both of which Spark may split when a node has very
    many links.  Links are checkpointed to the shared folder after each round,
    so a lost executor costs one round.  Runs jobs.
    """
    edges = checkpointed(
        links.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        # every larger neighbour of a node is linked to the node's smallest neighbour
        large = (
            both.where("v > u")
            .join(low, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        # every smaller neighbour, and the node itself, likewise
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
            .where("u != v")
            .distinct()
        )
        edges = checkpointed(small)
        mark = edges.agg(
            F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))
        ).first()
        if mark == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = mark
