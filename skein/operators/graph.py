"""Traversal of property graphs held as two frames: vertices (id, ...) and edges (edge_pos, source_id, target_id, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.plans.layout import cut


def neighbours(edges: DataFrame, ident: str, relation: str | None = None) -> DataFrame:
    rows = edges.where(F.col("source_id") == ident)
    return rows.where(F.col("relation_type") == relation) if relation is not None else rows


def vertex(vertices: DataFrame, ident: str) -> DataFrame:
    """The vertex of an id; no row where there is none."""
    return vertices.where(F.col("id") == ident)


def traverse_all(edges: DataFrame, starts: DataFrame, max_depth: int = 2, max_nodes: int = 10) -> DataFrame:
    """Breadth-first visits of every query along outgoing edges: (query_id, depth, visit, id, parent_id, edge_pos).

    starts has (query_id, start_pos, id), at depth 0. Nodes are visited in the order of their parents, then of the
    edges, and reported with the edge that found them first. A parent is expanded only while fewer than max_nodes nodes
    of its query were visited before it, so its own neighbours may overshoot the cap. Repeated starts count once, null
    ids not at all. Each level is one join of all queries' frontiers, which the cap bounds but for the last parent's
    edges.
    """
    first = starts.where(F.col("id").isNotNull()).groupBy("query_id", "id").agg(F.min("start_pos").alias("_p"))
    kind = edges.schema["source_id"].dataType.simpleString()
    per = Window.partitionBy("query_id")
    frontier = cut(first.select("query_id", F.lit(0).alias("depth"), F.row_number().over(per.orderBy("_p", "id")).cast("long").alias("visit"), "id", F.lit(None).cast(kind).alias("parent_id"), F.lit(None).cast("int").alias("edge_pos")))
    visited = frontier
    out = edges.select(F.col("source_id").alias("parent_id"), F.col("target_id").alias("id"), F.col("edge_pos").cast("int").alias("edge_pos"))
    for depth in range(1, max_depth + 1):
        counts = visited.groupBy("query_id").agg(F.count("*").alias("_count")).where(F.col("_count") < max_nodes)
        found = frontier.select("query_id", F.col("id").alias("parent_id"), F.col("visit").alias("_order")).join(counts, "query_id").join(out, "parent_id").join(visited.select("query_id", "id"), ["query_id", "id"], "left_anti")
        once = found.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "id").orderBy("_order", "edge_pos"))).where("_n = 1")
        # nodes that parents before this one added, on top of all visited so far
        per_parent = once.groupBy("query_id", "_order").agg(F.count("*").alias("_k"))
        before = F.coalesce(F.sum("_k").over(per.orderBy("_order").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        open_ = per_parent.select("query_id", "_order", before.alias("_before"))
        fresh = once.join(open_, ["query_id", "_order"]).where(F.col("_before") + F.col("_count") < max_nodes)
        place = F.row_number().over(per.orderBy("_order", "edge_pos", "id")) + F.col("_count")
        frontier = cut(fresh.select("query_id", F.lit(depth).alias("depth"), place.cast("long").alias("visit"), "id", "parent_id", "edge_pos"))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited


def traverse(edges: DataFrame, starts: DataFrame, max_depth: int = 2, max_nodes: int = 10) -> DataFrame:
    """traverse_all for the one query of starts (start_pos, id)."""
    return traverse_all(edges, starts.withColumn("query_id", F.lit(0)), max_depth, max_nodes).drop("query_id")


def describe(visits: DataFrame, vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Visits with the names of both ends and the relation; nodes without a vertex row are dropped."""
    v = vertices.select("id", "name", "description")
    parent = vertices.select(F.col("id").alias("parent_id"), F.col("name").alias("parent_name"))
    kinds = edges.select(F.col("edge_pos").cast("int").alias("edge_pos"), "relation_type")
    return visits.join(v, "id").join(parent, "parent_id", "left").join(kinds, "edge_pos", "left").where("depth = 0 or parent_name is not null")
