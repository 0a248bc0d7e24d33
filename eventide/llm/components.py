"""Connected components of a graph that may not fit in one place."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.llm.common import HOT_ROWS, dropped, spread_join, written


def _looked_up(rows: DataFrame, side: DataFrame, key: str, degrees: DataFrame, total: int, hot_rows: int) -> DataFrame:
    """rows joined with side, a row for each key; degrees: (key, n). A key of very many rows is split over several tasks."""
    return rows.join(side, key) if total <= hot_rows else spread_join(rows, side, [key], degrees, total=total, hot_rows=hot_rows)


def connected_components(links: DataFrame, a: str = "a", b: str = "b", *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(id, root) for every id in a link; root is the smallest id of its component.

    Each round hooks every vertex to its smallest neighbour and contracts the links to those. What
    a vertex reads is a minimum, made before the shuffle too, and the links of a vertex that has very many
    are split over several tasks, as are the ids of a large component, so no task ever holds all of
    a vertex's neighbours. The rounds grow with the logarithm of the longest chain of links. Every
    round's tables are written, and the ones before it are deleted.
    """
    spark = links.sparkSession
    edges = written(links.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).filter("u < v").distinct())
    roots = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parent = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("p"), F.count("*").alias("n")))
        total = edges.count()
        ends = edges
        for end in ("u", "v"):
            side = parent.select(F.col("u").alias(end), F.col("p").alias(f"p{end}"))
            ends = _looked_up(ends, side, end, parent.select(F.col("u").alias(end), "n"), total, hot_rows)
        new_edges = written(ends.filter("pu <> pv").select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct())
        new_roots = parent.select(F.col("u").alias("id"), F.col("p").alias("root"))
        if roots is not None:  # a root that no link is left at keeps its ids
            side = roots.select("root").distinct().join(parent.select(F.col("u").alias("root"), "p"), "root", "left")
            new_roots = _looked_up(roots, side, "root", roots.groupBy("root").agg(F.count("*").alias("n")), roots.count(), hot_rows)
            new_roots = new_roots.select("id", F.coalesce("p", "root").alias("root"))
        new_roots = written(new_roots)
        for old in (edges, parent, roots):
            if old is not None:
                dropped(spark, old)
        edges, roots = new_edges, new_roots
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")) if roots is None else roots


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest position that each of n positions reaches over the links (a, b)."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == root).all():
            return root
        root = new
