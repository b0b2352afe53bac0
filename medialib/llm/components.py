"""Connected components of a graph of links, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame) -> DataFrame:
    """node, component (its lowest node) for each node of links (a, b).

    Each round a node takes the lowest component among its own and its
    neighbours', and then that component's own, which halves the way to go.
    Rounds stop when none has changed; each is a written table.
    """
    both = written(
        links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links"
    )
    state = written(
        both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("component")), "components"
    )
    while True:
        near = (
            both.join(state.select(F.col("node").alias("b"), "component"), "b")
            .groupBy("a").agg(F.min("component").alias("near")).withColumnRenamed("a", "node")
        )
        lower = state.join(near, "node").select("node", F.col("component").alias("before"), F.least("component", "near").alias("component"))
        lower = written(lower, "components")
        further = lower.select(F.col("node").alias("component"), F.col("component").alias("next"))
        new = written(
            lower.join(further, "component", "left")
            .select("node", "before", F.least("component", F.coalesce("next", "component")).alias("component")),
            "components",
        )
        state = new.select("node", "component")
        if new.where("before <> component").isEmpty():
            return state
