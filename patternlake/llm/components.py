"""Connected components of a link table, without leaving the cluster.

Alternating large-star and small-star steps (Kiveris et al., "Connected Components in
MapReduce and Beyond") rewire every node to the smallest node of its component in a
number of rounds that grows with the logarithm of the component's diameter.  Every round
is cut in the shared checkpoint folder; nothing but two totals reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patternlake.plans.lineage import cut


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # Cut, so that the join below has a plain exchange on either side and a hub can be split.
    least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = cut(down.groupBy("u").agg(F.min("v").alias("m")))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(u, v) links to (u, v) with ``v`` the smallest node of ``u``'s component.

    Nodes that are the smallest of their component have no row.  Self-links and repeated
    links change nothing; nulls must not occur; an empty table gives an empty table.
    """
    now = cut(links.select("u", "v").filter("u <> v").distinct())
    state = _state(now)
    while state[0]:
        now = cut(_small_star(cut(_large_star(now))))
        before, state = state, _state(now)
        if before == state:
            break
    return now
