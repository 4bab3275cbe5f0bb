"""Aggregates behind the report, the visualisation and the file map."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import token_estimate
from skein.operators.graph import Graph, file_ranking

#: Patterns of paths that the file map leaves out.
MAP_SKIPPED = (r"^tests?/", r"^__tests__/", r"\.test\.", r"\.spec\.", r"fixtures", r"node_modules", r"package\.json", r"tsconfig", r"\.config\.")


def files_by_extension(files: DataFrame) -> DataFrame:
    return files.groupBy("ext").agg(F.count(F.lit(1)).alias("n_files"))


def average_degree(graph: Graph) -> DataFrame:
    n, e = graph.nodes.agg(F.count(F.lit(1)).alias("n")), graph.edges.agg(F.count(F.lit(1)).alias("e"))
    return n.join(e).select(F.when(F.col("n") > 0, F.format_string("%.1f", 2 * F.col("e") / F.col("n"))).otherwise(F.lit("0")).alias("average_degree"))


def community_sizes(nodes: DataFrame, labels: int = 3) -> DataFrame:
    """community, size, name (most central member), labels (first members), largest first."""
    own = nodes.where("community is not null")
    few = own.withColumn("r", F.row_number().over(Window.partitionBy("community").orderBy("ord"))).where(F.col("r") <= labels)
    first = few.groupBy("community").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "label"))), lambda x: x["label"]), ", ").alias("labels"))
    sizes = own.groupBy("community").agg(F.count(F.lit(1)).alias("size"), F.max_by("label", F.struct("centrality", (-F.col("ord")).alias("o"))).alias("name"))
    return sizes.join(first, "community")


def surprises(graph: Graph, shown: int = 10) -> DataFrame:
    """Extracted edges that cross communities, with the communities' names, in order."""
    of = graph.nodes.select("id", "label", "community").where("community is not null")
    names = community_sizes(graph.nodes).select("community", "name")
    side = lambda c: of.join(names, "community").select(F.col("id").alias(c), F.col("label").alias(f"{c}_label"), F.col("community").alias(f"{c}_community"), F.col("name").alias(f"{c}_name"))
    crossing = graph.edges.where("confidence = 'EXTRACTED'").join(side("source"), "source").join(side("target"), "target").where("source_community <> target_community")
    return crossing.orderBy("ord").limit(shown).select("source_label", "relation", "target_label", "source_name", "target_name", "ord")


def file_map(graph: Graph, limit: int = 50, budget: int = 1500) -> DataFrame:
    """Ranked files with symbols until the budget is spent; the first that doesn't fit ends the map."""
    rows = file_ranking(graph, limit)
    rows = rows.where(~F.coalesce(F.col("source_file"), F.lit("")).rlike("|".join(MAP_SKIPPED)))
    line = F.concat(F.lit("- "), F.col("source_file"), F.when(F.size("symbols") > 0, F.concat(F.lit(": "), F.array_join("symbols", ", "))).otherwise(F.lit("")))
    order = Window.orderBy(F.desc("score"), "ord")
    return rows.withColumn("line", line).withColumn("used", F.sum(token_estimate("line")).over(order)).where(F.col("used") <= budget).select("source_file", "score", "line", "used")


def view_nodes(graph: Graph, limit: int = 1500) -> DataFrame:
    d = F.col("degree")
    rows = graph.degrees().where("type <> 'file'").orderBy(F.desc("degree"), "ord").limit(limit)
    size = F.greatest(F.lit(5.0), F.least(F.lit(25.0), F.log2(d + 2) * 8))
    return rows.select("id", "label", "type", "source_file", "community", "degree", size.alias("size"), F.pmod(F.coalesce("community", F.lit(0)), F.lit(25)).alias("colour"), "ord")


def view_edges(graph: Graph, shown: DataFrame, limit: int = 4000) -> DataFrame:
    ids = shown.select("id")
    inside = graph.edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return inside.orderBy("ord").limit(limit).withColumn("dashed", F.col("confidence") != "EXTRACTED")


def legend(nodes: DataFrame, limit: int = 50) -> DataFrame:
    own = nodes.where("community is not null").groupBy("community").agg(F.count(F.lit(1)).alias("size"), F.min_by("label", "ord").alias("label"))
    return own.orderBy(F.desc("size"), "community").limit(limit)


def questions(graph: Graph, most: int = 8) -> list[str]:
    """Suggested questions from the busiest entities, the two largest communities and the imports. The wording is fixed."""
    top = [r["label"] for r in graph.top_nodes(3).collect()]
    out = []
    if len(top) > 1:
        out.append(f"How does **{top[0]}** connect to **{top[1]}**?")
    if top:
        out.append(f"What calls **{top[0]}** and what does it depend on?")
    if "community" in graph.nodes.columns:
        own = graph.nodes.where("community is not null").groupBy("community").agg(F.count(F.lit(1)).alias("size"), F.min("ord").alias("first"), F.min_by("label", "ord").alias("label"))
        pair = [r["label"] for r in own.orderBy(F.desc("size"), "first").limit(2).collect()]
        if len(pair) == 2:
            out.append(f"Trace the data flow between **{pair[0]}** and **{pair[1]}**")
    if graph.edges.where("relation = 'imports'").limit(6).count() > 5:
        out.append("Which modules have the most dependencies?")
    out.append(f"Show me the architecture of the `{top[0] if top else 'main'}` subsystem")
    out.append("What is the most heavily connected module in the codebase?")
    return out[:most]


def report_text(graph: Graph, files: DataFrame | None = None) -> str:
    """Markdown assembled from bounded aggregates."""
    s = graph.stats().first()
    lines = ["# Code graph", "", f"- Nodes: {s['n_nodes']}", f"- Edges: {s['n_edges']}", f"- Communities: {s['n_communities']}", f"- Average degree: {average_degree(graph).first()[0]}", ""]
    if files is not None:
        lines += ["## Files", "", *[f"- {r['ext']}: {r['n_files']}" for r in files_by_extension(files).orderBy(F.desc("n_files"), "ext").collect()], ""]
    lines += ["## Most connected", "", "| Entity | Type | Degree | File |", "|---|---|---|---|", *[f"| {r['label']} | {r['type']} | {r['degree']} | {r['source_file']} |" for r in graph.top_nodes(5).collect()], ""]
    if {"community", "centrality"} <= set(graph.nodes.columns):
        lines += ["## Communities", "", *[f"- {r['name']} ({r['size']}): {r['labels']}" for r in community_sizes(graph.nodes).orderBy(F.desc("size"), "community").limit(20).collect()], ""]
        lines += ["## Surprises", "", *[f"- {r['source_label']} {r['relation']} {r['target_label']} ({r['source_name']} / {r['target_name']})" for r in surprises(graph).collect()], ""]
    return "\n".join([*lines, "## Questions", "", *[f"- {q}" for q in questions(graph)], ""])


def view_html(graph: Graph, most_nodes: int = 5000) -> str | None:
    """A page that draws the capped graph on a canvas; None for graphs beyond ``most_nodes``."""
    import json

    if graph.nodes.limit(most_nodes + 1).count() > most_nodes:
        return None
    nodes = view_nodes(graph)
    data = {"nodes": [r.asDict() for r in nodes.drop("ord").collect()], "edges": [{"from": r["source"], "to": r["target"], "relation": r["relation"], "dashed": r["dashed"]} for r in view_edges(graph, nodes).collect()], "legend": [r.asDict() for r in legend(graph.nodes).collect()]}
    text = json.dumps(data).replace("</", "<\\/")
    return f'<!doctype html><meta charset="utf-8"><title>Code graph</title><canvas id="g" width="1200" height="800"></canvas><script>const data={text};{_DRAW}</script>'


_DRAW = """
const c=document.getElementById('g').getContext('2d'),at={};
data.nodes.forEach((n,i)=>{const a=i*2.399963,r=12*Math.sqrt(i);at[n.id]=[600+r*Math.cos(a),400+r*Math.sin(a)];});
for(const e of data.edges){const p=at[e.from],q=at[e.to];c.setLineDash(e.dashed?[4,4]:[]);c.strokeStyle='#9998';c.beginPath();c.moveTo(...p);c.lineTo(...q);c.stroke();}
for(const n of data.nodes){const p=at[n.id];c.fillStyle=`hsl(${n.colour*14.4} 60% 55%)`;c.beginPath();c.arc(p[0],p[1],n.size/3,0,7);c.fill();c.fillStyle='#222';c.fillText(n.label,p[0]+6,p[1]);}
"""
