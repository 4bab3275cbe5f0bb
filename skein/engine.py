"""The engine's front: build a graph of a source tree, keep it as Parquet, refresh it, and ask questions of it.

A store is a folder of tables: nodes, edges, cache (extracted files), and what answers are made from, so that
no question makes it again: the text index, term statistics and the class index; ``built`` has a row of what
the last build did.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import answers, impact, relevance, report, resolve
from skein.operators import graph as g
from skein.operators.iterate import settle
from skein.operators.search import TextIndex
from skein.sources import extract, files

#: Class methods whose dependents stand for those of a class without any of its own.
CLASS_METHODS = 20


class Engine:
    def __init__(self, spark: SparkSession, store: str):
        self.spark, self.store = spark, store.rstrip("/")

    def build(self, root: str, force: bool = False, routes: str | None = None, sweeps: int = 50, exact_communities: bool = True, directed: bool = False) -> g.Graph:
        """Scan, extract what changed, link, resolve calls, rank, cluster, and write all tables."""
        return self._write(root, None, force, routes, sweeps, exact_communities, directed)

    def refresh(self, root: str, routes: str | None = None, watched: bool = False, sweeps: int = 50, exact_communities: bool = True) -> tuple[bool, str]:
        """(whether anything was done, why). A stale graph is extended by what files say now: known nodes and
        edges stay. A fresh one gets its routes again, unless a watcher keeps it in step."""
        found = files.scan(self.spark, root, content=False)
        if found.isEmpty():
            return False, "no supported files"
        if not self.exists("nodes"):
            self._write(root, None, False, routes, sweeps, exact_communities, False)
            return True, "initial build"
        old = self.graph()
        if not files.is_stale(found, self.spark.read.parquet(f"{self.store}/built").first()["built_at"]):
            if watched:
                return False, "fresh (watcher active)"
            self._finish(root, self._bare(old), routes, sweeps, exact_communities, None)
            return True, "routes only"
        self._write(root, self._bare(old), False, routes, sweeps, exact_communities, old.directed)
        return True, f"incremental ({self.built()['extracted']} files re-extracted)"

    def build_projects(self, root: str, **options) -> list[tuple[str, str, int]]:
        """(project, its store, nodes) of each project under root, each with a graph of its own; one of the whole
        root where it holds no more than one project."""
        listing = files.scan(self.spark, root, content=False).select("path").unionByName(files.project_marks(self.spark, root)).distinct()
        found = [(r["name"], r["path"]) for r in files.projects(listing).orderBy("path").collect()]
        if len(found) < 2:
            return [("root", self.store, self.build(root, **options).nodes.count())]
        out = []
        for name, path in found:
            own = Engine(self.spark, f"{self.store}/{path or 'root'}")
            out.append((name, own.store, own.build(f"{root.rstrip('/')}/{path}".rstrip("/"), **options).nodes.count()))
        return out

    def _write(self, root: str, old: g.Graph | None, force: bool, routes: str | None, sweeps: int, exact: bool, directed: bool) -> g.Graph:
        found = files.with_hash(files.scan(self.spark, root))
        cached, fresh = files.split_by_cache(found, self._read("cache"), force)
        new = extract.extract_files(fresh).join(fresh.select(F.col("path").alias("file"), "hash"), "file")
        rows = settle(new if cached is None else cached.select(new.columns).unionByName(new))
        kept = 0 if cached is None else cached.count()
        made = extract.as_tables(rows)
        graph = old.merge(*made) if old else g.Graph.from_extraction(*made, directed)
        self._finish(root, graph, routes, sweeps, exact, (kept, rows.count() - kept))
        rows.write.mode("overwrite").parquet(f"{self.store}/cache")
        return self.graph()

    def _finish(self, root: str, graph: g.Graph, routes: str | None, sweeps: int, exact: bool, counts: tuple[int, int] | None) -> None:
        """Routes, calls, ranks, communities and indexes of a graph; all of it is written."""
        if routes:
            graph = graph.merge(*resolve.link_routes(files.read_routes(self.spark, routes), graph.nodes))
        found = files.scan(self.spark, root).where("lang = 'php'")
        index = resolve.class_index(graph, found.select(F.col("path").alias("file"), F.col("content").cast("string").alias("content")))
        graph = resolve.resolve_calls(graph, index)
        graph.nodes, graph.edges = settle(graph.nodes), settle(graph.edges)
        ranked = g.Graph(g.centrality(graph), graph.edges, graph.directed)
        clustered = g.communities(ranked, sweeps) if exact else g.label_propagation(ranked)
        nodes, index.classes, index.props, index.methods = settle(clustered), settle(index.classes), settle(index.props), settle(index.methods)
        for name, df in (("nodes", nodes), ("edges", graph.edges)):
            df.write.mode("overwrite").parquet(f"{self.store}/{name}")
        index.save(f"{self.store}/classes")
        TextIndex.build(nodes).save(f"{self.store}/text")
        relevance.term_tables(nodes).save(f"{self.store}/terms")
        before = self.built() if self.exists("built") else {"cached": 0, "extracted": 0}
        cached, extracted = counts or (before["cached"], before["extracted"])
        built = self.spark.range(1).select(F.current_timestamp().alias("built_at"), F.lit(graph.directed).alias("directed"), F.lit(cached).cast("long").alias("cached"), F.lit(extracted).cast("long").alias("extracted"))
        settle(built).write.mode("overwrite").parquet(f"{self.store}/built")

    @staticmethod
    def _bare(graph: g.Graph) -> g.Graph:
        """A stored graph without ranks and communities, apart from the files that are about to be replaced."""
        return g.Graph(settle(graph.nodes.drop("centrality", "community")), settle(graph.edges), graph.directed)

    def graph(self) -> g.Graph:
        return g.Graph(self.spark.read.parquet(f"{self.store}/nodes"), self.spark.read.parquet(f"{self.store}/edges"), self.built()["directed"])

    def built(self) -> dict:
        return self.spark.read.parquet(f"{self.store}/built").first().asDict()

    def class_index(self) -> resolve.ClassIndex:
        return resolve.ClassIndex.load(self.spark, f"{self.store}/classes")

    def exists(self, name: str) -> bool:
        return files.exists(self.spark, f"{self.store}/{name}")

    def _read(self, name: str) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.store}/{name}") if self.exists(name) else None

    def query(self, question: str, budget: int = 4000, min_score: float = 0.15) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Chosen nodes, edges among them, and one row of tokens used, budget and coverage."""
        graph = self.graph()
        scored = relevance.relevance(relevance.TermTables.load(self.spark, f"{self.store}/terms"), question)
        header = f'## Query: "{question}" (budget: {budget} tokens)\n\n'
        chosen = settle(relevance.select_nodes(graph, scored, budget, min_score, header))
        total = graph.nodes.count()
        stats = chosen.agg((F.coalesce(F.sum("cost"), F.lit(0)) + relevance.header_cost(header)).alias("tokens_used"), F.lit(budget).alias("budget"), (F.count(F.lit(1)) / F.lit(max(total, 1))).alias("coverage"))
        return chosen.join(graph.nodes, "id").orderBy("pos"), relevance.induced_edges(graph.edges, chosen), stats

    def answer(self, question: str, budget: int = 4000, root: str | None = None) -> str:
        """A question's answer as Markdown, with source of the first symbols where root is given."""
        nodes, edges, stats = self.query(question, budget)
        rows = [r.asDict() for r in nodes.collect()]
        text = answers.answer_text(question, rows, [r.asDict() for r in edges.orderBy("ord").limit(10).collect()], stats.first().asDict())
        return text + (self._snippets(nodes, root, budget) if root else "")

    def _snippets(self, nodes: DataFrame, root: str, budget: int) -> str:
        found = files.scan(self.spark, root).select("path", F.col("content").cast("string").alias("content"))
        return answers.snippets_text([r.asDict() for r in relevance.snippets(nodes, found, budget).collect()])

    def explain(self, text: str) -> DataFrame:
        graph = self.graph()
        return impact.neighbourhood(graph, impact.explain_match(graph.nodes, text).select("id"))

    def explain_text(self, text: str) -> str:
        graph = self.graph()
        row = impact.explain_match(graph.nodes, text).first()
        if row is None:
            return f'No entity matches "{text}".'
        ids = graph.nodes.where(F.col("id") == row["id"]).select("id")
        own = graph.adjacency().where(F.col("id") == row["id"]).count()
        return answers.explain_text(row.asDict(), own, [r.asDict() for r in impact.details(graph, ids).orderBy("first").collect()])

    def search(self, query: str, limit: int = 20) -> DataFrame:
        return TextIndex.load(self.spark, f"{self.store}/text").search(query, limit)

    def search_text(self, query: str, limit: int = 20) -> str:
        return answers.search_text(query, [r.asDict() for r in self.search(query, limit).collect()])

    def impact(self, name: str, depth: int = 2, limit: int = 50) -> DataFrame:
        graph = self.graph()
        target = impact.find_target(graph.nodes, name)
        found = impact.reverse_impact(graph.edges, target.select(F.col("id").alias("start_id")), depth, limit)
        row = target.first()
        if row and row["type"] == "class" and found.isEmpty():
            return self._of_methods(graph, row, depth, limit)
        return found

    @staticmethod
    def _of_methods(graph: g.Graph, row, depth: int, limit: int) -> DataFrame:
        """Dependents of the first methods of a class's file that have any."""
        found = impact.reverse_impact(graph.edges, impact.class_methods(graph, row["source_file"]), depth, limit)
        order = graph.nodes.select(F.col("id").alias("start_id"), "ord")
        first = found.select("start_id").distinct().join(order, "start_id").orderBy("ord").limit(CLASS_METHODS).select("start_id")
        return found.join(first, "start_id", "left_semi")

    def impact_text(self, name: str, depth: int = 2, limit: int = 50, root: str | None = None) -> str:
        graph = self.graph()
        target = impact.find_target(graph.nodes, name)
        row = target.first()
        if row is None:
            return f'"{name}" is not in the graph. Try another name, or a search.'
        rows = [r.asDict() for r in self.impact(name, depth, limit).collect()]
        names = graph.nodes.where(F.col("id").isin([x for r in rows for x in (r["node_id"], r["start_id"])] or [""]))
        nodes = {r["id"]: r.asDict() for r in names.collect()}
        own = [r for r in rows if r["start_id"] == row["id"]]
        starts = sorted({r["start_id"] for r in rows} - {row["id"]}, key=lambda i: nodes[i]["ord"])
        methods = [(nodes[i]["label"], [r for r in rows if r["start_id"] == i]) for i in starts]
        text = answers.impact_text(row.asDict(), own, nodes, methods, limit)
        return text + (self._snippets(target.withColumn("pos", F.lit(0)), root, 1200) if root else "")

    def file_map(self, budget: int = 1500) -> DataFrame:
        return report.file_map(self.graph(), budget=budget)

    def report(self) -> str:
        return report.report_text(self.graph())

    def html(self) -> str | None:
        return report.view_html(self.graph())

    def summary(self) -> str:
        """What the last build made, as Markdown."""
        graph, built = self.graph(), self.built()
        by = report.files_by_extension(self._read("cache").select(files.extension("file").alias("ext"))).orderBy("ext") if self.exists("cache") else None
        top = [(r["label"], r["degree"]) for r in graph.top_nodes(5).collect()]
        return answers.summary_text(graph.stats().first().asDict(), [(r["ext"], r["n_files"]) for r in by.collect()] if by else [], built["cached"], built["extracted"], built["directed"], top)

    def write_json(self, path: str) -> None:
        g.write_graph_json(self.graph(), path)


def find_store(spark: SparkSession, start: str, name: str = "graph-out") -> str | None:
    """The store ``name`` in the nearest folder from start upwards that has one with a graph."""
    at = start.rstrip("/")
    while True:
        if files.exists(spark, f"{at}/{name}/nodes"):
            return f"{at}/{name}"
        if "/" not in at.split("://", 1)[-1].rstrip("/"):
            return None
        at = at.rsplit("/", 1)[0]
