"""Connected components of an edge table, without bringing nodes or edges to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.store import Tables


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable id of every node of ``edges(a, b)``: ``id, component_id``, as a stored table.

    Rounds of large-star and small-star relinking, each a pre-aggregated minimum by node and a join
    back to the edges. The minima are written before they are joined, so the edges of a hub, which may be
    a third of all, are dealt to several tasks by the skew rule. Self-links, repeated and reversed edges
    are harmless; nulls are ignored. The driver sees only whether a round changed anything. Nodes without
    an edge aren't returned.
    """
    tables = Tables(edges.sparkSession)
    links = tables.write(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    nodes = tables.write(links.select(F.explode(F.array("u", "v")).alias("id")).distinct(), "nodes")
    seen = None
    while True:
        both = links.union(links.select("v", "u"))
        low = tables.write(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "low")
        large = tables.write(both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "large")
        tables.drop(links, low)
        down = tables.write(large.groupBy("u").agg(F.min("v").alias("m")), "down")
        small = large.join(down, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        links = tables.write(small.filter("u <> v").distinct(), "links")
        tables.drop(large, down)
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == seen:
            break
        seen = now
    roots = links.groupBy("u").agg(F.min("v").alias("component_id"))
    out = nodes.join(roots, nodes["id"] == roots["u"], "left").select("id", F.coalesce("component_id", "id").alias("component_id"))
    out = tables.write(out, "components")
    tables.drop(links, nodes)
    return out
