"""Connected components of a link table by alternating star contractions (large star, small star)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.session import checkpointed


def components(links: DataFrame) -> DataFrame:
    """(node, component): every node of ``links`` (columns a, b) with the smallest node reachable from it.

    Each round links the larger neighbours of every node, and then all smaller ones, to the smallest neighbour; the number of
    rounds grows with the logarithm of the longest path.  A round keeps at most the links it got.  Minima are combined
    before the shuffle and stored before they are joined back, so a node with very many links is split by the join.
    Loops and repeated links are harmless; nulls are dropped.
    """
    edges = checkpointed(links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
                         .filter("lo is not null and a is not null and b is not null and lo <> hi").distinct())
    seen = None
    while True:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select("lo", "hi"))
        low = checkpointed(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = checkpointed(large)
        low = checkpointed(large.groupBy("hi").agg(F.min("lo").alias("m")))
        small = large.join(low, "hi").select(F.explode(F.array(
            F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")),
            F.struct(F.col("hi"), F.col("m").alias("lo")))).alias("e")).select("e.hi", "e.lo")
        edges = checkpointed(small.filter("hi <> lo").distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    roots = edges.select("lo").distinct()
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(
        roots.select("lo", F.col("lo")))
