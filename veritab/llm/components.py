"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._packed import written

#: Parts that a key's rows are dealt to at least; and rows of a part at most, on average, of a key that has all rows.
PARTS, PART_ROWS = 64, 1 << 20


def with_group(rows: DataFrame, n_rows: int, key: str, deal: Column, partial: Column, whole, name: str) -> DataFrame:
    """rows with an aggregate of their key's rows, such that the rows of a hot key never meet in one task.

    Rows are dealt to parts by `deal`; `partial` is taken part by part, `whole`
    (a function of the partial column) over at most as many rows a key as there
    are parts, and the result goes back to the parts that have rows. The joins
    are merges, which Spark can split and which don't inherit an uneven input.
    """
    parts = max(PARTS, -(-n_rows // PART_ROWS))
    dealt = rows.withColumn("__part", F.pmod(F.xxhash64(deal), F.lit(parts)))
    small = dealt.groupBy(key, "__part").agg(partial.alias("__partial")).groupBy(key).agg(whole(F.col("__partial")).alias(name), F.collect_list("__part").alias("__parts"))
    return dealt.join(small.select(key, F.explode("__parts").alias("__part"), name).hint("merge"), [key, "__part"]).drop("__part")


def _with_least(edges: DataFrame, n: int) -> DataFrame:
    """edges with m, the least b of their a."""
    return with_group(edges, n, "a", F.col("b"), F.min("b"), F.min, "m")


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Each node's larger neighbours are tied to its least one."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _with_least(both, 2 * n).filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.least("a", "m").alias("b"))


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Each node and its smaller neighbours are tied to the least of them. Edges run from larger to smaller."""
    each = _with_least(edges, n)
    inner = each.filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return inner.unionByName(each.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge and isn't its component's least node, which is the root.

    edges: two long columns a and b, in any direction, repeated or not. Each
    round is written to the shared folder; its edges never outnumber the first
    round's. Only a count and a checksum come to the driver.
    """
    edges = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    n, before = edges.count(), None
    while n:
        edges = written(_small_star(_large_star(edges, n), n))
        now = tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())
        if now == before:
            break
        n, before = now[0], now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
