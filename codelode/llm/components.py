"""Connected components by repeated contraction.

In each round every node looks at itself and its neighbours, and joins the one with the smallest
hash of that round. Edges are renamed to the nodes that are left, loops and repeats go. A fixed
share of the nodes vanishes per round on average, whatever the order of the names, so long chains
take few rounds too. Rounds are saved tables: a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from codelode.llm.common import bounded
from codelode.sources.scratch import saved


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` to ``(node, component)``, one row per node that has an edge to another
    one. The component is the name of one of its nodes. No edges give no rows."""
    edges = saved(edges.where(F.col("a") != F.col("b")), "edges")
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        key = lambda c: F.xxhash64(F.lit(len(rounds)), c)  # noqa: B023, E731
        both = edges.union(edges.select("b", "a"))
        near = both.groupBy("a").agg(F.min(F.struct(key(F.col("b")).alias("h"), "b")).alias("n"))
        own = F.struct(key(F.col("a")).alias("h"), F.col("a").alias("b"))
        found = saved(near.select(F.col("a").alias("node"),
                                  F.least(own, F.col("n"))["b"].alias("to")), "round")
        rounds.append(found)
        left = found.withColumnsRenamed({"node": "__a", "to": "x"})
        right = found.withColumnsRenamed({"node": "__b", "to": "y"})
        edges = saved(edges.join(bounded(left), F.col("a") == F.col("__a"))
                      .join(bounded(right), F.col("b") == F.col("__b"))
                      .where(F.col("x") != F.col("y"))
                      .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
                      .distinct(), "edges")
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = rounds.pop().withColumnRenamed("to", "component")
    while rounds:
        later = saved(out.withColumnRenamed("node", "__node"), "components")
        out = (rounds.pop().join(bounded(later), F.col("to") == F.col("__node"), "left")
               .select("node", F.coalesce("component", "to").alias("component")))
    return saved(out, "components")
