"""Who depends on an entity (reverse breadth-first search) and what surrounds it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.graph import Graph
from skein.operators.iterate import settle

FOLLOWED = ("calls", "references")


def find_target(nodes: DataFrame, name: str) -> DataFrame:
    """At most one node. An exact label first (calls, files, fields and namespaces don't count); else of
    the labels that contain the name, a dotted one of a method, class or function, else the first."""
    usable = ~F.col("type").isin("call", "file", "field", "namespace")
    has = F.contains("label", F.lit(name))
    dotted = has & F.col("type").isin("method", "class", "function") & F.contains("label", F.lit("."))
    rank = F.when((F.col("label") == name) & usable, 0).when(dotted, 1).when(has, 2)
    return nodes.withColumn("rank", rank).where("rank is not null").orderBy("rank", "ord").limit(1).drop("rank")


def reverse_impact(edges: DataFrame, starts: DataFrame, depth: int = 2, limit: int = 50, relations: tuple[str, ...] = FOLLOWED) -> DataFrame:
    """start_id, node_id, parent_id, depth, pos: dependents of each start (start_id), level by level.

    A node belongs to the first parent that reaches it, in queue order; after ``limit`` nodes of a
    start the search ends. Every level is one join of the frontier with edges by target."""
    depth = min(depth, 5)
    back = settle(edges.where(F.col("relation").isin(*relations)).select(F.col("target").alias("at"), F.col("source").alias("node_id"), "ord"))
    frontier = starts.select("start_id", F.col("start_id").alias("at"), F.lit(0).cast("long").alias("pos"))
    seen = settle(starts.select("start_id", F.col("start_id").alias("node_id")))
    out = None
    counted = starts.select("start_id", F.lit(0).cast("long").alias("before"))
    for level in range(1, max(depth, 1) + 1):
        reached = back.join(frontier, "at").groupBy("start_id", "node_id").agg(F.min(F.struct("pos", "ord", "at")).alias("first"))
        new = reached.join(seen, ["start_id", "node_id"], "left_anti")
        order = Window.partitionBy("start_id").orderBy("first.pos", "first.ord")
        numbered = new.withColumn("n", F.row_number().over(order)).join(counted, "start_id").withColumn("pos", F.col("before") + F.col("n")).where(F.col("pos") <= limit)
        numbered = settle(numbered.select("start_id", "node_id", F.col("first.at").alias("parent_id"), F.lit(level).alias("depth"), "pos"))
        out = numbered if out is None else out.unionByName(numbered)
        if numbered.isEmpty():
            break
        seen = settle(seen.unionByName(numbered.select("start_id", "node_id")))
        counted = settle(counted.join(numbered.groupBy("start_id").agg(F.max("pos").alias("p")), "start_id", "left").select("start_id", F.coalesce("p", "before").alias("before")))
        frontier = numbered.select("start_id", F.col("node_id").alias("at"), "pos")
    return out


def class_methods(graph: Graph, target_file: str) -> DataFrame:
    """Starts for a class without dependents of its own: the methods of its file."""
    return graph.nodes.where((F.col("type") == "method") & (F.col("source_file") == target_file)).select(F.col("id").alias("start_id"))


def tree_lines(rows: list, labels: dict[str, str]) -> list[str]:
    """Box-drawn tree of one start's rows (node_id, parent_id, pos)."""
    kids: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: r["pos"]):
        kids.setdefault(r["parent_id"], []).append(r["node_id"])
    out: list[str] = []

    def walk(at: str, indent: str) -> None:
        mine = kids.get(at, [])
        for i, k in enumerate(mine):
            last = i == len(mine) - 1
            out.append(f"{indent}{'└── ' if last else '├── '}{labels.get(k, k)}")
            walk(k, indent + ("    " if last else "│   "))

    if rows:
        walk(next(iter(kids)), "")
    return out


def explain_match(nodes: DataFrame, text: str) -> DataFrame:
    needle = F.lit(text.lower())
    return nodes.where(F.contains(F.lower("label"), needle) | F.contains(F.lower("id"), needle)).orderBy("ord").limit(1)


def incident(graph: Graph, ids: DataFrame) -> DataFrame:
    """Edges of each id with an arrow, the other end's id, label and type, and the edge's confidence."""
    e = graph.edges
    out = e.join(ids, e["source"] == ids["id"]).select("id", "relation", "confidence", "ord", F.lit("→").alias("arrow"), F.col("target").alias("other"))
    back = e.where("source <> target").join(ids, F.col("target") == ids["id"]).select("id", "relation", "confidence", "ord", F.lit("←").alias("arrow"), F.col("source").alias("other"))
    return out.unionByName(back).join(graph.nodes.select(F.col("id").alias("other"), "label", "type"), "other")


def details(graph: Graph, ids: DataFrame, shown: int = 15) -> DataFrame:
    """id, relation, n, first, shown: as neighbourhood(), with type and confidence on each line; first: where a relation begins."""
    named = incident(graph, ids)
    line = F.concat(F.col("arrow"), F.lit(" **"), F.col("label"), F.lit("** ("), F.col("type"), F.lit(") _"), F.col("confidence"), F.lit("_"))
    ranked = named.withColumn("r", F.row_number().over(Window.partitionBy("id", "relation").orderBy("ord", "arrow")))
    few = ranked.where(F.col("r") <= shown).groupBy("id", "relation").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", line.alias("t")))), lambda x: x["t"]).alias("shown"))
    return named.groupBy("id", "relation").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first")).join(few, ["id", "relation"])


def neighbourhood(graph: Graph, ids: DataFrame, shown: int = 15) -> DataFrame:
    """id, relation, n, shown: incident edges of each id by relation, the first ``shown`` with arrow and
    label. Two equi-joins stand for source = id or target = id; a self-loop counts once."""
    named = incident(graph, ids)
    ranked = named.withColumn("r", F.row_number().over(Window.partitionBy("id", "relation").orderBy("ord", "arrow")))
    counts = named.groupBy("id", "relation").agg(F.count(F.lit(1)).alias("n"))
    few = ranked.where(F.col("r") <= shown).groupBy("id", "relation").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", F.concat_ws(" ", "arrow", "label").alias("t")))), lambda x: x["t"]).alias("shown"))
    return counts.join(few, ["id", "relation"])
