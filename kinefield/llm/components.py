"""Connected components by local contraction.

In each round every node takes the neighbour (or itself) of least priority, a hash
of node and round, as its new name; edges are renamed and those within one name go.
The edges that remain shrink by a constant factor a round, whatever the shape, so
chains take logarithmically many rounds. Nothing is collected to the driver but
one count a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinefield.llm.common import Scratch


def connected(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, label) of all nodes of ``edges`` (a, b); label: the component's smallest id."""
    rest = edges.select("a", "b").filter("a != b")
    names = None  # (id, label)
    turn = 0
    while True:
        both = rest.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
        rank = F.struct(F.xxhash64("e.b", F.lit(turn)).alias("r"), F.col("e.b").alias("x"))
        own = F.struct(F.xxhash64("old", F.lit(turn)).alias("r"), F.col("old").alias("x"))
        best = both.groupBy(F.col("e.a").alias("old")).agg(F.min(rank).alias("m"))
        step = scratch.table(best.select("old", F.least("m", own)["x"].alias("new")), f"{name}-step{turn}")
        if names is None:
            names = step.select(F.col("old").alias("id"), F.col("new").alias("label"))
        else:
            names = names.join(step, F.col("label") == F.col("old"), "left").select(
                "id", F.coalesce("new", "label").alias("label")
            )
        rest = (
            rest.join(step.select(F.col("old").alias("a"), F.col("new").alias("na")), "a")
            .join(step.select(F.col("old").alias("b"), F.col("new").alias("nb")), "b")
            .filter("na != nb")
            .select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"))
            .distinct()
        )
        rest = scratch.table(rest, f"{name}-rest{turn}")
        turn += 1
        if rest.isEmpty():
            break
    names = scratch.table(names, f"{name}-names")
    low = names.groupBy("label").agg(F.min("id").alias("low"))
    return scratch.table(names.join(low, "label").select("id", F.col("low").alias("label")), name)


def joined(labels: DataFrame | None, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``labels`` (id, label) after further ``links`` (a, b) between their ids or new ones."""
    if labels is None:
        return connected(links, scratch, name)
    for end in ("a", "b"):
        links = (
            links.join(labels.select(F.col("id").alias(end), "label"), end, "left")
            .withColumn(end, F.coalesce("label", end))
            .drop("label")
        )
    merged = connected(links.distinct(), scratch, f"{name}-merged").select(F.col("id").alias("old"), F.col("label").alias("new"))
    out = labels.join(merged, F.col("label") == F.col("old"), "left")
    out = out.select("id", F.coalesce("new", "label").alias("label"))
    # Nodes that had no label yet, and old labels' own rows, come from the merged part.
    out = out.unionByName(merged.select(F.col("old").alias("id"), F.col("new").alias("label"))).distinct()
    return scratch.table(out, name)
