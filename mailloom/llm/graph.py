"""Connected components of a graph of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailloom.llm import store


def _with_least(links: DataFrame) -> DataFrame:
    """u, v and m, the least v of u; by an aggregate that is joined, so the links of one node needn't be in one task."""
    return links.join(links.groupBy("u").agg(F.min("v").alias("m")), "u")


def components(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """node and root for each node of links (src, dst) but the roots: the least node that links connect it to.

    Alternates large-star and small-star steps, each round a written table, until a round changes nothing; the number of rounds grows
    with the logarithm of the nodes.  No links give no rows.
    """
    now = links.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct()
    before = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()
        least = _with_least(large)
        pairs = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))
        small = least.select(F.explode(pairs).alias("p")).select("p.u", "p.v").where("u <> v").distinct()
        last, now = now, store.written(small, "components")
        if before is not None:
            store.remove(last)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components not settled in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
