"""Connected components by repeated contraction, without collecting any vertex."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageweave.functions.scratch import saved


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` of any orderable type -> ``(vertex, component)``; component = smallest vertex reachable.

    Each round maps every vertex to the smallest of itself and its neighbours and contracts the edge table
    with that map, so the edge table shrinks geometrically; the maps are then composed. Rows with a null end,
    loops and repeated edges are ignored; only vertices of some proper edge are returned. Each round's tables
    are written to the shared folder, which cuts the lineage.
    """
    live = saved(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .filter("a <> b")
        .distinct(),
        "edges",
    )
    maps = []
    for _ in range(max_rounds):
        both = live.select("a", "b").union(live.select(F.col("b"), F.col("a")))
        step = saved(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "step")
        maps.append(step)
        high = step.select(F.col("a"), F.col("m").alias("ma"))
        low = step.select(F.col("a").alias("b"), F.col("m").alias("mb"))
        live = saved(
            live.join(high, "a")
            .join(low, "b")
            .select(F.greatest("ma", "mb").alias("a"), F.least("ma", "mb").alias("b"))
            .filter("a <> b")
            .distinct(),
            "edges",
        )
        if live.isEmpty():
            break
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    out = maps[0].select(F.col("a").alias("vertex"), F.col("m").alias("component"))
    for step in maps[1:]:
        nxt = step.select(F.col("a").alias("component"), F.col("m").alias("further"))
        out = out.join(nxt, "component", "left").select(
            "vertex", F.coalesce("further", "component").alias("component")
        )
    return out
