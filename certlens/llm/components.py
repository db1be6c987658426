"""Connected components of a link table, by alternating star contractions.

Each round replaces links by links to smaller neighbours (large star: the larger
neighbours of a node move to its smallest neighbour; small star: the smaller
ones do). Both are one aggregation and one join; all rounds stay on Spark, and
only the link count and a checksum come back for the stop test.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from certlens.llm.shared import discard, keep


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    # every edge points from the larger (u) to the smaller node (v)
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u")
    return moved.select("u", F.col("m").alias("v")).union(
        moved.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
    return row[0], row[1]


def contract(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """(a, b) links of long ids -> links (a, b) with the same components, a above
    b. Without ``rounds`` until every id is linked with its component's smallest
    alone; after a few rounds most are, and what is left can be contracted later.
    Null ids and self links are ignored; an empty table gives an empty result.
    Repeated links and ties do no harm."""
    edges = keep(links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links", True)
    before = _state(edges) if rounds is None else (1, None)
    while before[0] and rounds != 0:
        last, edges = edges, keep(_small_star(_large_star(edges)).filter("u != v").distinct(), "links", True)
        discard(last)
        if rounds is not None:
            rounds -= 1
            continue
        now = _state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("a"), F.col("v").alias("b"))


def roots(contracted: DataFrame) -> DataFrame:
    """(id, root) of contracted links: one root for each id, the smallest one."""
    return contracted.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("root"))


def components(links: DataFrame) -> DataFrame:
    """(a, b) links -> (id, root) for every linked id other than its component's
    smallest."""
    return roots(contract(links))
