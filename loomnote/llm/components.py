"""Connected components by alternating large and small stars.

Each round points every node to the least node around it: first its greater neighbours (large star), then itself and
its smaller ones (small star). It ends when every component is a star around its least node, after about log n
rounds. Minima are aggregated before they are shuffled, so a hub with very many links is no hot group, and each
round is written to the shared folder, so a lost executor costs a stage and not the whole history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # a: the centre; b: its neighbours, greater ones for the large star and smaller ones for the small star.
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    around = both.where(F.col("b") > F.col("a")) if large else both.where(F.col("b") < F.col("a"))
    near = around.join(least, "a").select(F.col("b").alias("u"), "m")
    if not large:
        near = near.unionAll(least.select(F.col("a").alias("u"), "m"))
    return near.where(F.col("u") != F.col("m")).select(F.greatest("u", "m").alias("a"), F.least("u", "m").alias("b")).distinct()


def connected(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """``edges`` (a, b), of any comparable type, to ``(node, component)``: the least node that each can reach.

    Only nodes with a link appear. Repeated links, links both ways and self links are harmless.
    """
    edges = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 30)))).first())

    before = mark(edges)
    for _ in range(most_rounds):
        if not before[0]:
            break
        edges = _star(_star(edges, True), False).checkpoint()
        after = mark(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
