"""Connected components as joins and minima; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, hot_join


def components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """From links (a, b) to (node, label): the smallest node that each can reach.

    Nodes that are the smallest of their component have no row.  Every round
    hooks each node to its smallest smaller neighbour, follows the pointers to
    the roots by joining the pointers with themselves, and keeps the links
    between different roots.  Rounds grow with the logarithm of the size of a
    component.  A root that very many nodes point to is broadcast with its
    pointer and never gathers them in one task.
    """
    edges = scratch.keep(
        links.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("lo < hi").distinct(), "edges"
    )
    mapping = None
    while True:
        parent = scratch.keep(edges.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("label")), "parent")
        while True:
            up = _pointers(scratch, parent, parent)
            jumped = scratch.keep(
                hot_join(scratch, parent, up, {"label": "up"}, "held", how="left", cheap=True).select(
                    "node", F.coalesce("higher", "label").alias("label"), F.col("higher").isNotNull().alias("moved")
                ),
                "jumped",
            )
            parent = jumped.select("node", "label")
            if jumped.where("moved").isEmpty():
                break
        if mapping is None:
            mapping = parent
        else:
            up = _pointers(scratch, mapping, parent)
            mapping = scratch.keep(
                hot_join(scratch, mapping, up, {"label": "up"}, "held", how="left", cheap=True)
                .select("node", F.coalesce("higher", "label").alias("label"))
                .unionByName(parent),
                "mapping",
            )
        written = edges
        for own in ("lo", "hi"):
            ends = _pointers(scratch, written.select(F.col(own).alias("label")), parent)
            edges = hot_join(scratch, edges, ends, {own: "up"}, "held", how="left", cheap=own == "lo")
            edges = edges.withColumn(own, F.coalesce("higher", own)).select("lo", "hi")
        edges = scratch.keep(
            edges.where("lo <> hi").select(F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi")).distinct(), "edges"
        )
        if edges.isEmpty():
            return mapping


def _pointers(scratch: Scratch, nodes: DataFrame, parent: DataFrame) -> DataFrame:
    """(up, higher, held): the pointers of those roots that rows of ``nodes`` name in ``label``, and how many do."""
    held = nodes.groupBy(F.col("label").alias("h")).agg(F.count(F.lit(1)).alias("held"))
    up = parent.select(F.col("node").alias("up"), F.col("label").alias("higher"))
    return scratch.keep(up.join(held, F.col("up") == F.col("h")).drop("h"), "pointers")
