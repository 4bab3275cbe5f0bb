"""Ranked, token-budgeted subgraph queries.

Term statistics are tables that can be kept between questions; a question joins its few terms to
them. Selection is a fold over the ranked nodes and their ranked neighbours, read in blocks: a node
that once failed to fit never fits later, so only its first occurrence matters.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions.text import STOP_WORDS, token_estimate, words_of
from skein.operators.graph import Graph, first_by
from skein.operators.iterate import dense_rank, settle

#: Ranked nodes that are read at a time until a question's budget is spent.
_BLOCK = 4096


@dataclass
class TermTables:
    """docs: id, doc_text, norm; terms: t, id, tf; idf: t, idf."""

    docs: DataFrame
    terms: DataFrame
    idf: DataFrame

    def save(self, path: str) -> None:
        for name in ("docs", "terms", "idf"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TermTables:
        return cls(*(spark.read.parquet(f"{path}/{name}") for name in ("docs", "terms", "idf")))


def term_tables(nodes: DataFrame) -> TermTables:
    # Words of label, description and type, in that order.
    text = F.concat(F.col("label"), F.lit(" "), F.coalesce("description", F.lit("")), F.lit(" "), F.col("type"))
    docs = nodes.select("id", "ord", "label", words_of(text).alias("tokens"))
    terms = docs.select("id", F.explode("tokens").alias("t")).groupBy("t", "id").agg(F.count(F.lit(1)).alias("tf"))
    n = docs.where(F.size("tokens") > 0).agg(F.count(F.lit(1)).alias("n"))
    df = terms.groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    # n is one row; its value goes into a scalar subquery's place.
    total = n.first()["n"]
    idf = df.select("t", (F.log((F.lit(total) + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    norms = terms.join(idf, "t").groupBy("id").agg(F.sqrt(F.sum(F.pow(F.col("tf") * F.col("idf"), 2))).alias("norm"))
    named = docs.select("id", "ord", "label", F.array_join("tokens", " ").alias("doc_text")).join(norms, "id", "left")
    return TermTables(named, terms, idf)


def relevance(tables: TermTables, question: str) -> DataFrame:
    """id, ord, score of every node; 0 where nothing matches."""
    spark = tables.docs.sparkSession
    q = spark.sql("select 1").select(words_of(F.lit(question)).alias("q")).first()["q"]
    if not q:
        return tables.docs.select("id", "ord", F.lit(0.0).alias("score"))
    asked = spark.createDataFrame([(t, q.count(t)) for t in sorted(set(q))], "t string, times int")
    known = F.broadcast(asked).join(tables.idf.where(F.col("t").isin(sorted(set(q)))), "t", "left").select("t", "times", F.coalesce("idf", F.lit(0.5)).alias("idf"))
    # A question's terms: a handful of rows.
    weights = {r["t"]: (r["times"], r["idf"]) for r in known.collect()}
    qnorm = sum(n * w * w for n, w in weights.values()) ** 0.5
    value = F.create_map(*[x for t, (_, w) in weights.items() for x in (F.lit(t), F.lit(w))])
    matched = tables.terms.where(F.col("t").isin(list(weights)))
    dots = matched.groupBy("id").agg(F.sum(F.col("tf") * F.pow(F.element_at(value, F.col("t")), 2)).alias("dot"))
    bonus = sum((F.when(F.contains("doc_text", F.lit(t)), F.lit(0.3 * n)).otherwise(F.lit(0.0)) for t, (n, _) in weights.items()), F.lit(0.0))
    cosine = F.coalesce(F.col("dot") / (F.lit(qnorm) * F.nullif(F.col("norm"), F.lit(0.0))), F.lit(0.0))
    base = F.least(F.lit(1.0), cosine + bonus)
    label, whole = F.regexp_replace(F.lower("label"), "[^a-z0-9]", ""), "".join(q)
    strong = (F.length(label) >= 8) & F.contains(F.lit(whole), label)
    fair = F.lit(len(whole) >= 4 and whole not in STOP_WORDS) & F.contains(label, F.lit(whole)) & (F.length(label) <= len(whole) + 12)
    score = F.when(strong, F.greatest(base, F.lit(0.95))).when(fair, F.greatest(base, F.lit(0.9))).otherwise(base)
    return tables.docs.join(dots, "id", "left").select("id", "ord", score.alias("score"))


def node_text(prefix: str = "") -> F.Column:
    """A node's block in an answer, with the blank line after it; its format is fixed, as its size counts."""
    c = lambda n: F.col(f"{prefix}{n}")
    text = lambda x: F.coalesce(x, F.lit(""))
    where = F.when(c("source_location").isNotNull(), F.format_string(" · centrality: %.2f", F.coalesce(c("centrality"), F.lit(0.0)))).otherwise(F.lit(""))
    return F.concat(F.lit("### "), text(c("label")), F.lit(" ("), text(c("type")), F.lit(")"), where, text(F.concat(F.lit("\n"), c("description"))), F.lit("\n→ File: "), text(c("source_file")), text(F.concat(F.lit(" "), c("source_location"))), F.lit("\n\n"))


def header_cost(header: str) -> int:
    """Tokens of an answer's header: a quarter of its UTF-16 units, rounded up."""
    return -(-len(header.encode("utf-16-be")) // 8)


def select_nodes(graph: Graph, scored: DataFrame, budget: int = 4000, min_score: float = 0.15, header: str = "") -> DataFrame:
    """pos, id, cost of the chosen nodes: ranked order with one hop of ranked neighbours, until 0.9 of the
    budget is used; a node that would pass 0.95 of it is skipped."""
    nodes = graph.nodes if "centrality" in graph.nodes.columns else graph.nodes.withColumn("centrality", F.lit(None).cast("double"))
    ranked = dense_rank(scored.where(F.col("score") >= min_score).withColumn("less", -F.col("score")), ["less", "ord"], "r").drop("less")
    hops = ranked.select(F.col("id").alias("at"), "r").join(graph.adjacency().withColumnRenamed("id", "at"), "at").select("r", (F.col("nbr_ord") + 1).alias("k"), F.col("nbr").alias("id"))
    near = hops.join(ranked.select("id"), "id", "left_semi")
    steps = first_by(ranked.select("r", F.lit(0).cast("long").alias("k"), "id").unionByName(near), [F.col("id")], [F.col("r"), F.col("k")])
    costs = steps.join(nodes, "id").select("r", "k", "id", token_estimate(node_text()).alias("cost"))
    used = header_cost(header)
    # The sequence is read in blocks of bounded size, as far as the budget goes; the chosen cost a token each at least.
    placed = settle(dense_rank(costs, ["r", "k"], "at").select("at", "id", "cost"))
    total, done, chosen = placed.count(), 0, []
    while done < total and used < 0.9 * budget:
        for row in placed.where((F.col("at") > done) & (F.col("at") <= done + _BLOCK)).orderBy("at").collect():
            if used < 0.9 * budget and used + row["cost"] <= 0.95 * budget:
                used += row["cost"]
                chosen.append((len(chosen), row["id"], row["cost"]))
        done += _BLOCK
    return graph.nodes.sparkSession.createDataFrame(chosen, "pos int, id string, cost long")


def select_deep(graph: Graph, scored: DataFrame, budget: int = 4000, depth: int = 5, width: int = 3, header: str = "") -> list[str]:
    """Depth-first choice from the best node: at most ``width`` unvisited neighbours by score, ``depth`` levels.

    The neighbourhood is at most width^depth nodes and is gathered by one frontier join a level."""
    start = scored.orderBy(F.desc("score"), "ord").limit(1).select("id")
    adj = graph.adjacency().join(scored.select(F.col("id").alias("nbr"), "score"), "nbr")
    best = adj.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "nbr_ord"))).where(F.col("r") <= width + width**2)
    around: dict[str, list[str]] = {}
    frontier = [r["id"] for r in start.collect()]
    first = list(frontier)
    for _ in range(depth):
        todo = [i for i in frontier if i not in around]
        if not todo:
            break
        rows = best.where(F.col("id").isin(todo)).orderBy("id", "r").collect()
        for i in todo:
            around[i] = [r["nbr"] for r in rows if r["id"] == i]
        frontier = [n for i in todo for n in around[i]]
    nodes = graph.nodes if "centrality" in graph.nodes.columns else graph.nodes.withColumn("centrality", F.lit(None).cast("double"))
    known = set(around) | {n for v in around.values() for n in v}
    costs = {r["id"]: r["cost"] for r in nodes.where(F.col("id").isin(list(known) or [""])).select("id", token_estimate(node_text()).alias("cost")).collect()}
    used, visited, chosen = header_cost(header), set(), []

    def visit(i: str, level: int) -> None:
        nonlocal used
        if i in visited or level > depth or used >= 0.9 * budget:
            return
        visited.add(i)
        if used + costs.get(i, 0) <= 0.95 * budget:
            used += costs.get(i, 0)
            chosen.append(i)
        for n in [n for n in around.get(i, []) if n not in visited][:width]:
            visit(n, level + 1)

    for i in first:
        visit(i, 0)
    return chosen


def induced_edges(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """Edges with both ends chosen, the first of each unordered pair."""
    ids = chosen.select("id")
    inside = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return first_by(inside, [F.least("source", "target"), F.greatest("source", "target")], [F.col("ord")])


def snippets(chosen: DataFrame, files: DataFrame, budget: int, most_files: int = 3, a_file: int = 3) -> DataFrame:
    """source_file, label, first, last, snippet: source lines of chosen functions, methods and classes.

    chosen: pos, label, type, source_file, source_location; files: path, content (string)."""
    allowed = min(1200, budget // 4)
    line = F.regexp_extract("source_location", r"^L(\d+)", 1)
    rows = chosen.where(F.col("type").isin("function", "method", "class") & (line != "")).withColumn("first", line.cast("int"))
    w = Window.partitionBy("source_file")
    few = rows.withColumn("next", F.lead("first").over(w.orderBy("first"))).withColumn("r", F.row_number().over(w.orderBy("pos"))).withColumn("f", F.min("pos").over(w)).where(F.col("r") <= a_file)
    ranked = few.withColumn("fr", F.dense_rank().over(Window.orderBy("f"))).where(F.col("fr") <= most_files)
    cut = ranked.join(files, F.col("source_file") == F.col("path")).withColumn("lines", F.split("content", "\r?\n"))
    last = F.least(F.coalesce(F.col("next") - 1, F.col("first") + 30), F.col("first") + 39, F.size("lines"))
    text = cut.withColumn("last", last).withColumn("snippet", F.array_join(F.slice("lines", F.col("first"), F.greatest(F.lit(1), F.col("last") - F.col("first") + 1)), "\n"))
    running = text.withColumn("used", F.sum(token_estimate("snippet")).over(Window.orderBy("fr", "pos")))
    return running.where((F.col("used") <= allowed) & F.lit(allowed >= 100)).select("source_file", "label", "first", "last", "snippet", "pos")
