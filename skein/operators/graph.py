"""The property graph: construction, set operations, and iterative ranking and clustering.

nodes: id, label, type, source_file, source_location, description, ord
edges: source, target, relation, confidence, confidence_score, call_context, ord

``ord`` is the row's position and decides all ties.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import is_test_path, round_half_up
from skein.operators.iterate import dense_rank, settle

NODE_SCHEMA = "id string, label string, type string, source_file string, source_location string, description string, ord long"
EDGE_SCHEMA = "source string, target string, relation string, confidence string, confidence_score double, call_context string, ord long"


def edge_key(directed: bool) -> list[Column]:
    a, b = (F.col("source"), F.col("target")) if directed else (F.least("source", "target"), F.greatest("source", "target"))
    return [a.alias("ka"), b.alias("kb"), F.col("relation")]


def first_by(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key. Spark limits ranks before the shuffle, so hot keys don't pile up."""
    names = [f"_k{i}" for i in range(len(keys))]
    ranked = df.withColumns(dict(zip(names, keys))).withColumn("_r", F.row_number().over(Window.partitionBy(*names).orderBy(*order)))
    return ranked.where("_r = 1").drop("_r", *names)


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame
    directed: bool = False

    @classmethod
    def from_extraction(cls, nodes: DataFrame, edges: DataFrame, directed: bool = False) -> Graph:
        """The last node of an id counts, in its first position; edges need both ends; repeats stay."""
        place = nodes.groupBy("id").agg(F.min("ord").alias("_first"))
        last = first_by(nodes, [F.col("id")], [F.desc("ord")])
        kept = last.join(place, "id").withColumn("ord", F.col("_first")).drop("_first")
        return cls(kept, with_ends(edges, kept), directed)

    def merge(self, nodes: DataFrame, edges: DataFrame) -> Graph:
        """Insert-only: unknown nodes and unseen edges are appended, known ones stay as they are."""
        shift = (self.nodes.agg(F.coalesce(F.max("ord") + 1, F.lit(0)).alias("s")), self.edges.agg(F.coalesce(F.max("ord") + 1, F.lit(0)).alias("s")))
        at = [x.first()["s"] for x in shift]
        fresh = first_by(nodes.join(self.nodes, "id", "left_anti"), [F.col("id")], [F.col("ord")]).withColumn("ord", F.col("ord") + at[0])
        every = self.nodes.unionByName(fresh, allowMissingColumns=True)
        both = self.edges.unionByName(with_ends(edges, every).withColumn("ord", F.col("ord") + at[1]), allowMissingColumns=True)
        return Graph(every, first_by(both, edge_key(self.directed), [F.col("ord")]), self.directed)

    def adjacency(self) -> DataFrame:
        """id, nbr, nbr_ord: distinct neighbours either way with the first edge that made them."""
        return adjacency(self.edges)

    def degrees(self) -> DataFrame:
        d = self.adjacency().groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
        return self.nodes.join(d, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))

    def top_nodes(self, limit: int = 10) -> DataFrame:
        """Highest degree first, test files left out; the sort keeps only ``limit`` rows a task."""
        return self.degrees().where(~is_test_path("source_file")).orderBy(F.desc("degree"), "ord").limit(limit)

    def stats(self) -> DataFrame:
        communities = F.count_distinct("community") if "community" in self.nodes.columns else F.lit(0)
        a = self.nodes.agg(F.count(F.lit(1)).alias("n_nodes"), communities.alias("n_communities"))
        b = self.edges.agg(F.count(F.lit(1)).alias("n_edges"))
        return a.join(b)


def with_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def adjacency(edges: DataFrame) -> DataFrame:
    out = edges.select(F.col("source").alias("id"), F.col("target").alias("nbr"), "ord")
    back = edges.select(F.col("target").alias("id"), F.col("source").alias("nbr"), "ord")
    return out.unionByName(back).groupBy("id", "nbr").agg(F.min("ord").alias("nbr_ord"))


def power_iteration(ids: DataFrame, arcs: DataFrame, alpha: float = 0.85, eps: float = 1e-6, most: int = 100) -> DataFrame:
    """id, score. arcs (src, dst), distinct. A node without arcs keeps what it gets, so mass leaks as in
    the plain formula. Stops once the summed change is below n * eps, after taking the new scores."""
    n = ids.count()
    if not n:
        return ids.withColumn("score", F.lit(0.0))
    sizes = arcs.groupBy("src").agg(F.count(F.lit(1)).alias("d"))
    # Arcs with their share stay partitioned by source from round to round.
    shares = settle(arcs.join(sizes, "src").select("src", "dst", (F.lit(alpha) / F.col("d")).alias("share")).repartition("src"))
    scores = settle(ids.withColumn("score", F.lit(1.0 / n)))
    for _ in range(most):
        sent = shares.join(scores, shares["src"] == scores["id"]).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("score") * F.col("share")).alias("got"))
        moved = settle(scores.join(sent, "id", "left").select("id", F.col("score").alias("old"), ((1 - alpha) / n + F.coalesce("got", F.lit(0.0))).alias("score")))
        scores = moved.select("id", "score")
        if moved.agg(F.sum(F.abs(F.col("score") - F.col("old")))).first()[0] < n * eps:
            break
    return scores


def centrality(graph: Graph, alpha: float = 0.85, eps: float = 1e-6, most: int = 100) -> DataFrame:
    """nodes with centrality: PageRank over undirected neighbours, three digits, a tenth for test files."""
    arcs = graph.adjacency().select(F.col("id").alias("src"), F.col("nbr").alias("dst"))
    ranked = graph.nodes.join(power_iteration(graph.nodes.select("id"), arcs, alpha, eps, most), "id", "left")
    c = round_half_up(F.coalesce("score", F.lit(0.0)), 3)
    return ranked.withColumn("centrality", F.when(is_test_path("source_file"), round_half_up(c * 0.1, 3)).otherwise(c)).drop("score")


#: Neighbours in a block, as they go to the task that sweeps.
_BLOCK = 1 << 14


def communities(graph: Graph, sweeps: int = 50) -> DataFrame:
    """nodes with community, by sequential sweeps over the nodes in their order.

    Each sweep depends on the label changes before it, so the sweeps run in one task, which holds four bytes
    for each neighbour and twelve for each node; ids are numbered and neighbours sorted across tasks before.
    ``label_propagation`` is the distributed operator. Without edges community stays null."""
    numbered = dense_rank(graph.nodes.select("id", "ord"), ["ord", "id"], "at").select("id", (F.col("at") - 1).cast("int").alias("at"))
    links = graph.adjacency().join(numbered.select("id", F.col("at").alias("i")), "id").join(numbered.select(F.col("id").alias("nbr"), F.col("at").alias("j")), "nbr")
    keys = ("i", "nbr_ord", "nbr")
    packed = links.select(*keys, "j").repartitionByRange(*keys).sortWithinPartitions(*keys).select("i", "j").mapInArrow(pack_links, "part int, seq long, i binary, j binary")
    blocks = settle(packed)
    n, m = numbered.count(), blocks.agg(F.coalesce(F.sum(F.length("j")), F.lit(0))).first()[0] // 4
    if not m:
        return graph.nodes.withColumn("community", F.lit(None).cast("int"))

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        degree, nbrs, at = np.zeros(n, np.int64), np.empty(m, np.int32), 0
        for batch in batches:
            for r in range(batch.num_rows):
                i, j = (np.frombuffer(batch.column(c)[r].as_py(), np.int32) for c in (2, 3))
                which, times = np.unique(i, return_counts=True)
                degree[which] += times
                nbrs[at : at + len(j)] = j
                at += len(j)
        label = swept(np.concatenate([[0], np.cumsum(degree)]), nbrs, sweeps)
        names, first, which = np.unique(label, return_index=True, return_inverse=True)
        number = np.empty(len(names), np.int32)
        number[np.argsort(first)] = np.arange(1, len(names) + 1, dtype=np.int32)
        for a in range(0, n, 50_000):
            some = number[which[a : a + 50_000]]
            yield pa.RecordBatch.from_pydict({"at": np.arange(a, a + len(some), dtype=np.int32), "community": some})

    found = blocks.repartition(1).sortWithinPartitions("part", "seq").mapInArrow(sweep, "at int, community int")
    return graph.nodes.join(settle(found).join(numbered, "at").select("id", "community"), "id", "left")


def pack_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a task's sorted (i, j) rows."""
    from pyspark import TaskContext

    part, seq = TaskContext.get().partitionId(), 0
    for batch in batches:
        i, j = (batch.column(c).to_numpy().astype(np.int32) for c in (0, 1))
        for a in range(0, len(i), _BLOCK):
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int64()), "i": pa.array([i[a : a + _BLOCK].tobytes()], pa.binary()), "j": pa.array([j[a : a + _BLOCK].tobytes()], pa.binary())})
            seq += 1


def swept(starts: np.ndarray, nbrs: np.ndarray, sweeps: int) -> np.ndarray:
    """The label of each node after the sweeps; node i's neighbours are nbrs[starts[i] : starts[i + 1]], in order.

    A node takes the most frequent label of its neighbours other than its own; of equals, the one met first.
    Labels that come back after some sweeps go round from there, so whole rounds are left out."""
    label = np.arange(len(starts) - 1, dtype=np.int32)
    nodes = np.flatnonzero(np.diff(starts)).tolist()
    cuts = starts.tolist()
    known, done, left = {}, 0, sweeps
    while left:
        moved = False
        for i in nodes:
            counts = Counter(label[nbrs[cuts[i] : cuts[i + 1]]].tolist())
            counts.pop(int(label[i]), None)
            if counts:
                label[i], moved = max(counts, key=counts.__getitem__), True
        if not moved:
            break
        done, left = done + 1, left - 1
        state = hashlib.sha256(label.tobytes()).digest()
        if state in known:
            left %= done - known[state]
            known.clear()
        known[state] = done
    return label


def label_propagation(graph: Graph, rounds: int = 10) -> DataFrame:
    """nodes with community: synchronous label propagation, ties to the smaller label; distributed."""
    arcs = settle(graph.adjacency().select("id", "nbr"))
    labels = settle(graph.nodes.select("id", F.col("ord").alias("label")))
    for _ in range(rounds):
        votes = arcs.join(labels.select(F.col("id").alias("nbr"), "label"), "nbr").groupBy("id", "label").agg(F.count(F.lit(1)).alias("n"))
        best = votes.groupBy("id").agg(F.max(F.struct("n", (-F.col("label")).alias("less"))).alias("b")).select("id", (-F.col("b.less")).alias("new"))
        moved = settle(labels.join(best, "id", "left").select("id", F.col("label").alias("old"), F.coalesce("new", "label").alias("label")))
        labels = moved.select("id", "label")
        if moved.where("old <> label").isEmpty():
            break
    return graph.nodes.join(labels.withColumnRenamed("label", "community"), "id")


def file_ranking(graph: Graph, limit: int = 40, symbols: int = 6) -> DataFrame:
    """Files by PageRank over import edges lifted to files, with their most central symbols."""
    nodes = graph.nodes if "centrality" in graph.nodes.columns else centrality(graph)
    files = nodes.where("type = 'file'").select("id", "source_file", "label", "ord")
    owner = first_by(files, [F.col("source_file")], [F.col("ord")]).select("source_file", F.col("id").alias("file_id"))
    of = nodes.select("id", "source_file").join(owner, "source_file").select("id", "file_id")
    imports = graph.edges.where("relation = 'imports'").select("source", "target")
    lifted = imports.join(of.select(F.col("id").alias("source"), F.col("file_id").alias("src")), "source").join(of.select(F.col("id").alias("target"), F.col("file_id").alias("dst")), "target")
    arcs = lifted.where("src <> dst").select("src", "dst").distinct()
    scores = power_iteration(files.select("id"), arcs)
    top = files.join(scores, "id").orderBy(F.desc("score"), "ord").limit(limit)
    ranked = nodes.where("type <> 'file'").join(top.select("source_file"), "source_file", "left_semi").withColumn("r", F.row_number().over(Window.partitionBy("source_file").orderBy(F.desc_nulls_last("centrality"), "ord"))).where(F.col("r") <= symbols)
    named = ranked.groupBy("source_file").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "label"))), lambda x: x["label"]).alias("symbols"))
    return top.join(named, "source_file", "left").select("source_file", round_half_up("score", 3).alias("score"), F.coalesce("symbols", F.array().cast("array<string>")).alias("symbols"), "ord")


def import_graph_json(text: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes and edges of graph documents (one JSON text a row, column ``value``)."""
    node = "array<struct<id:string,label:string,type:string,sourceFile:string,sourceLocation:string,description:string,centrality:double,community:int>>"
    edge = "array<struct<source:string,target:string,relation:string,confidence:string,confidenceScore:double,callContext:string>>"
    doc = text.select(F.from_json("value", f"nodes {node}, edges {edge}").alias("g"))
    nodes = doc.select(F.posexplode("g.nodes").alias("ord", "n")).select("n.id", "n.label", "n.type", F.col("n.sourceFile").alias("source_file"), F.col("n.sourceLocation").alias("source_location"), "n.description", "n.centrality", "n.community", F.col("ord").cast("long"))
    edges = doc.select(F.posexplode("g.edges").alias("ord", "e")).select("e.source", "e.target", "e.relation", "e.confidence", F.col("e.confidenceScore").alias("confidence_score"), F.col("e.callContext").alias("call_context"), F.col("ord").cast("long"))
    return nodes, with_ends(edges, nodes)


def write_graph_json(graph: Graph, path: str) -> None:
    """One JSON document {nodes, edges, directed} at path: rows stream to the driver's writer one at a time.

    For graphs that another tool is to read; node_lines() is the form that grows."""
    import json

    names = {"source_file": "sourceFile", "source_location": "sourceLocation", "confidence_score": "confidenceScore", "call_context": "callContext"}
    jvm, conf = graph.nodes.sparkSession.sparkContext._jvm, graph.nodes.sparkSession.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(conf).create(place, True)
    put = lambda text: out.write(bytearray(text.encode()))
    try:
        put('{"directed":' + json.dumps(graph.directed))
        for name, rows in (("nodes", graph.nodes), ("edges", graph.edges)):
            put(f',"{name}":[')
            for i, r in enumerate(rows.orderBy("ord").drop("ord").toLocalIterator()):
                put("," * (i > 0) + json.dumps({names.get(k, k): v for k, v in r.asDict().items() if v is not None}, ensure_ascii=False))
            put("]")
        put("}")
    finally:
        out.close()


def node_lines(graph: Graph) -> DataFrame:
    """JSON lines of nodes, then edges: a graph document without gathering it in one row."""
    n = graph.nodes.select(F.lit("node").alias("kind"), "ord", F.to_json(F.struct("*")).alias("value"))
    return n.unionByName(graph.edges.select(F.lit("edge").alias("kind"), "ord", F.to_json(F.struct("*")).alias("value")))
