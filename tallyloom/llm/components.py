"""Connected components of an edge list by repeated contraction.

Each round hooks every node to its smallest neighbour, follows the hooks, renames both
ends of every edge and drops loops and repeats. Edges leave quickly (a star is gone after one
round), nothing is collected, and each round is written to the shared folder, so a
lost executor repeats one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` of longs -> ``(node, root)``; one root for each component.

    Loops and repeated edges are allowed; null ends are dropped. An empty edge list
    gives no rows. Nodes without an edge don't appear.
    """
    live = edges.where("a is not null and b is not null and a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    )
    live = stored(live.distinct(), "edges")
    renamed: DataFrame | None = None
    for _ in range(max_rounds):
        if live.isEmpty():
            break
        hooks = (
            live.select(F.col("a").alias("node"), F.col("b").alias("to"))
            .unionByName(live.select(F.col("b").alias("node"), F.col("a").alias("to")))
            .groupBy("node")
            .agg(F.min("to").alias("low"))
            .select("node", F.least("node", "low").alias("parent"))
        )
        hooks = stored(hooks, "hooks")
        for _ in range(2):
            up = hooks.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
            hooks = hooks.join(up, "parent").select("node", F.col("above").alias("parent"))
        hooks = stored(hooks, "hooks")
        at = lambda c: hooks.select(F.col("node").alias(c), F.col("parent").alias(f"{c}_up"))
        live = (
            live.join(at("a"), "a")
            .join(at("b"), "b")
            .where("a_up <> b_up")
            .select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b"))
            .distinct()
        )
        live = stored(live, "edges")
        if renamed is None:
            renamed = hooks.withColumnRenamed("parent", "root")
        else:
            renamed = renamed.join(at("root"), "root", "left").select(
                "node", F.coalesce("root_up", "root").alias("root")
            )
            renamed = stored(renamed, "roots")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    if renamed is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    return renamed
