"""Connected components of graphs of links, by alternating large and small stars.

Each round sends links towards smaller ids, so that a component ends as a star round its
smallest id after a number of rounds that grows with the logarithm of its size.  Rounds are
DataFrame operations; each one's links are written to the shared folder.  Several graphs, told apart
by a number, share the rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaicore.llm.common import discard, place_of, written

#: Links that a task works on; tables of few links are not spread over all partitions.
LINKS = 100_000


def components_of(links: DataFrame, tasks: int | None = None) -> DataFrame:
    """links (g int, a long, b long) to (g, node, component): the smallest id reachable in graph g, for every linked node.

    links are read once; tasks: the most that write their distinct ones.
    """

    def seen(table: DataFrame) -> tuple:
        return tuple(table.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("g", "u", "v"))).first())

    edges = written(links.where("a != b").select("g", F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links", tasks)
    state = seen(edges)
    if not state[0]:
        return edges.select("g", F.col("u").alias("node"), F.col("v").alias("component"))
    while True:
        tasks = max(1, -(-2 * state[0] // LINKS))
        # large star: every larger neighbour of u links to the smallest of u and its neighbours
        both = edges.unionByName(edges.select("g", F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("g", "u").agg(F.min("v").alias("m")).select("g", "u", F.least("u", "m").alias("m"))
        least = written(least.coalesce(tasks), "least")  # so that the join can be split where a node has very many links
        large = both.join(least, ["g", "u"]).where("v > u").select("g", F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct().coalesce(tasks)
        # small star: u and its smaller neighbours link to the smallest of them
        low = large.groupBy("g", "u").agg(F.min("v").alias("m"))
        small = large.join(low, ["g", "u"]).where("v != m").select("g", F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.withColumnRenamed("m", "v")).distinct().coalesce(tasks)
        edges, before, used = written(small, "links"), state, (edges, least)
        discard(links.sparkSession, *map(place_of, used))
        state = seen(edges)
        if state == before:
            break
    return edges.select("g", F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select("g", F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def components(links: DataFrame, tasks: int | None = None) -> DataFrame:
    """links (a, b) to (node, component)."""
    return components_of(links.select(F.lit(0).alias("g"), "a", "b"), tasks).drop("g")
