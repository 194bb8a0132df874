"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from reelfold.llm.tables import stored
from reelfold.operators.skew import join_unique


def _downwards(links: DataFrame) -> DataFrame:
    """(u, v), u > v, each once."""
    return (
        links.filter(F.col("u") != F.col("v"))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )


def _mark(links: DataFrame) -> tuple:
    sums = links.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.expr("xxhash64(v, u) div 65536")))
    return tuple(sums.first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v): the smallest node that it is connected with.

    Rounds of large and small stars: every node points its larger neighbours, then its smaller ones, to
    the smallest it knows of. Links never become more, and about log(nodes) rounds leave a star for each
    component. Each round is written to the shared folder. A hub that holds much of the links meets its
    one minimum by broadcast (``join_unique``).
    """
    links = stored(_downwards(links), "links")
    mark = _mark(links)
    while mark[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = join_unique(both.filter(F.col("v") > F.col("u")), least, "u", "inner")
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = join_unique(large, least, "u", "inner").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = stored(_downwards(small.unionByName(least.select("u", F.col("m").alias("v")))), "links")
        before, mark = mark, _mark(links)
        if mark == before:
            break
    roots = links.select(F.col("v").alias("node")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.select("node", F.col("node").alias("root"))
    )
