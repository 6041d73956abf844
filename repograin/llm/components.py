"""Connected components of a link table, by hooking and contraction.

Each round every node takes its smallest neighbour as parent if that is smaller than itself; parents form trees, whose
roots are found by pointer jumping; then links are rewritten to roots. Every node that is not the least of its
surroundings disappears in a round, so rounds grow with the logarithm of the number of nodes, whatever the shape.
Nothing but a count comes to the driver. Hubs are safe: minima are pre-aggregated, joins are plain exchanges that can
be split, and each table is written before it is joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repograin.llm.scratch import written


def _roots(parents: DataFrame) -> DataFrame:
    """``node, root`` from ``node, parent`` (parents smaller than their nodes; roots are absent as nodes)."""
    current = parents.select("node", F.col("parent").alias("root"))
    while True:
        step = current.select(F.col("node").alias("root"), F.col("root").alias("_next"))
        moved = written(
            current.join(step, "root", "left").select(
                "node", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")
            ),
            "roots",
        )
        current = moved.select("node", "root")
        if not moved.where("_moved").take(1):
            return current


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links`` (``a, b``, comparable ids): the smallest node it is linked to.

    Links may repeat, go either way or from a node to itself; an empty table gives an empty result.
    """
    open_links = written(links.select("a", "b").where("a <> b"), "links")
    nodes = written(links.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
    found = nodes.select("node", F.col("node").alias("component"))
    while open_links.take(1):
        both = open_links.unionByName(open_links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent")).where("parent < node")
        roots = written(_roots(written(parents, "parents")), "roots")
        to = lambda name: roots.select(F.col("node").alias(name), F.col("root").alias(f"_{name}"))
        open_links = written(
            open_links.join(to("a"), "a", "left")
            .join(to("b"), "b", "left")
            .select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
            .where("a <> b")
            .distinct(),
            "links",
        )
        found = written(
            found.join(to("component"), "component", "left").select("node", F.coalesce("_component", "component").alias("component")),
            "components",
        )
    return found
