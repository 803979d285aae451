"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise


def _state(edges: DataFrame) -> tuple:
    """What tells two edge sets apart."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame) -> DataFrame:
    """links: a, b (long, not null). Gives node, root: the smallest node of its component; nodes
    without a link to another do not appear.

    Each round is a written table, so nothing depends on one executor, and only counts reach the
    driver. Rounds grow with the logarithm of a component's width. Minima are combined before the
    shuffle, so a hub costs no task more than its share; joins on hubs are ordinary sort-merge joins
    that adaptive execution may split.
    """
    edges = materialise(links.filter("a <> b").selectExpr("greatest(a, b) a", "least(a, b) b").distinct(), "links")
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.selectExpr("b a", "a b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a", "least(a, m) m")
        large = both.filter("b > a").join(least, "a").selectExpr("b a", "m b").filter("a <> b").distinct()
        large = large.selectExpr("greatest(a, b) a", "least(a, b) b")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").selectExpr("b a", "m b").unionByName(least.selectExpr("a", "m b")).distinct()
        edges = materialise(small, "links")
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.selectExpr("a node", "b root").unionByName(edges.selectExpr("b node", "b root")).distinct()
