"""Breadth-first walks over a table of links, level by level in the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lodeline.session import checkpointed


def walk(edges: DataFrame, seeds: DataFrame, depth: int, limit: int | None = None, kept: DataFrame | None = None) -> DataFrame:
    """(url, depth): pages reached from the seeds (url) over edges (url, link) in at most ``depth`` steps, with the fewest steps.

    Visited pages are taken off each frontier by an anti join. With ``limit``
    the walk ends once so many pages are visited, the last level cut in the
    order of addresses. With ``kept`` (url) only those pages and the seeds pass
    on their links.
    """
    frontier = checkpointed(seeds.select("url").distinct().withColumn("depth", F.lit(0)))
    visited = frontier
    for level in range(1, depth + 1):
        room = None if limit is None else limit - visited.count()
        if room is not None and room <= 0:
            break
        from_ = frontier if kept is None or level == 1 else frontier.join(kept.select("url"), "url", "left_semi")
        fresh = from_.join(edges, "url").select(F.col("link").alias("url")).distinct().join(visited.select("url"), "url", "left_anti").withColumn("depth", F.lit(level))
        if room is not None:
            fresh = fresh.orderBy("url").limit(room)
        frontier = checkpointed(fresh)
        if frontier.isEmpty():
            break
        visited = checkpointed(visited.unionByName(frontier))
    return visited.orderBy("depth", "url").limit(limit) if limit is not None and limit < visited.count() else visited
