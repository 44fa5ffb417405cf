"""Connected components of a graph given as links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowtide.llm.common import discard, keep


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node that has a link; nodes of one component share the root.

    Each round maps every node to the least of itself and its neighbours, follows that once more
    and keeps the links between different images. Rounds with the nodes' own order dissolve stars,
    rounds with a hashed order halve chains, so the number of rounds is logarithmic. A round is
    written to the shared folder, so a lost executor costs no more than one round. Links with a
    null end and loops are ignored; no links give an empty result.
    """
    links = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    rest = keep(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    steps: list[DataFrame] = []
    while not rest.isEmpty():
        rank = F.lit(0).cast("long") if len(steps) % 2 == 0 else F.xxhash64("b", F.lit(len(steps)))
        ends = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ends = ends.unionByName(rest.select("a", F.col("a").alias("b"))).unionByName(rest.select(F.col("b").alias("a"), "b"))
        near = ends.groupBy("a").agg(F.min(F.struct(rank.alias("rank"), F.col("b"))).alias("least"))
        near = keep(near.select(F.col("a").alias("node"), F.col("least.b").alias("to")), "near")
        far = near.select(F.col("node").alias("to"), F.col("to").alias("root"))
        step = keep(near.join(far, "to").select("node", "root"), "step")
        discard(near)
        left = step.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = step.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = rest.join(left, "a").join(right, "b").where("ra <> rb")
        before, rest = rest, keep(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links")
        discard(before)
        steps.append(step)
    if not steps:
        return rest.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = steps[0]
    for step in steps[1:]:
        on = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
        out = out.join(on, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return out
