"""Graph construction, ranking and queries on two small fixtures with known values."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators import graph as g
from skein.operators import impact, relevance
from skein.operators.graph import EDGE_SCHEMA, NODE_SCHEMA
from skein.plans import registry

SMALL = [("mod_a", "moduleA", "file", "a.ts"), ("a_login", "login", "function", "a.ts"), ("a_validate", "validate", "function", "a.ts"), ("mod_b", "moduleB", "file", "b.ts"), ("b_process", "process", "function", "b.ts")]
SMALL_EDGES = [("mod_a", "a_login", "contains"), ("mod_a", "a_validate", "contains"), ("a_login", "a_validate", "calls"), ("mod_b", "b_process", "contains"), ("b_process", "a_login", "calls")]
ASKED = [("mod_auth", "auth.ts", "file", "src/auth.ts", None), ("src_auth_authenticateUser", "authenticateUser", "function", "src/auth.ts", "Validates user credentials and returns JWT token"), ("src_auth_validateCredentials", "validateCredentials", "function", "src/auth.ts", "Checks username and password are valid"), ("src_auth_hashPassword", "hashPassword", "function", "src/auth.ts", "Hashes password using bcrypt"), ("mod_middleware", "middleware.ts", "file", "src/middleware.ts", None), ("src_middleware_JWTMiddleware", "JWTMiddleware", "class", "src/middleware.ts", "Intercepts HTTP requests and validates Authorization header")]


def nodes_of(spark, rows):
    return spark.createDataFrame([(r[0], r[1], r[2], r[3], None, r[4] if len(r) > 4 else None, i) for i, r in enumerate(rows)], NODE_SCHEMA)


def edges_of(spark, rows):
    return spark.createDataFrame([(*r, "EXTRACTED", None, None, i) for i, r in enumerate(rows)], EDGE_SCHEMA)


@pytest.fixture(scope="module")
def small(spark):
    return g.Graph.from_extraction(nodes_of(spark, SMALL), edges_of(spark, [*SMALL_EDGES, ("nonexistent", "a_login", "calls")]))


def test_build_drops_loose_edges(small):
    assert small.nodes.count() == 5 and small.edges.count() == 5


def test_merge_is_insert_only(spark, small):
    more = nodes_of(spark, [("mod_c", "moduleC", "file", "c.ts"), ("c_helper", "helper", "function", "c.ts")])
    link = edges_of(spark, [("mod_c", "c_helper", "contains")])
    once = small.merge(more, link)
    twice = once.merge(more, edges_of(spark, [("c_helper", "mod_c", "contains")]))
    assert (once.nodes.count(), once.edges.count()) == (7, 6) == (twice.nodes.count(), twice.edges.count())


def test_centrality(small):
    got = {r.id: r.centrality for r in g.centrality(small).collect()}
    assert got == {"mod_a": 0.192, "a_login": 0.283, "a_validate": 0.192, "mod_b": 0.12, "b_process": 0.213}


def test_communities(small):
    got = {r.id: r.community for r in g.communities(small).collect()}
    assert got["mod_a"] == got["a_validate"] == got["mod_b"] != got["a_login"] == got["b_process"]


def test_reverse_impact(spark, small):
    rows = impact.reverse_impact(small.edges, spark.createDataFrame([("a_validate",)], "start_id string"), 2).collect()
    assert {(r.node_id, r.parent_id, r.depth) for r in rows} == {("a_login", "a_validate", 1), ("b_process", "a_login", 2)}
    assert impact.tree_lines([r.asDict() for r in rows], {}) == ["└── a_login", "    └── b_process"]


def test_label_propagation_and_empty_graph(spark, small):
    assert g.label_propagation(small).where("community is null").count() == 0
    empty = g.Graph(small.nodes.limit(0), small.edges.limit(0))
    assert g.centrality(empty).count() == 0
    assert relevance.relevance(relevance.term_tables(empty.nodes), "anything").count() == 0


@pytest.mark.parametrize(
    "question,want",
    [
        ("authenticate user validation", [0, 1, 0.3, 0, 0, 0]),
        ("JWT middleware authentication", [0, 0.48031, 0, 0, 0.700971, 0.990753]),
        ("auth", [0.953044, 0.9, 0, 0, 0, 0.3]),
        ("quantum chromodynamics meson decay", [0, 0, 0, 0, 0, 0]),
    ],
)
def test_relevance(spark, question, want):
    rows = relevance.relevance(relevance.term_tables(nodes_of(spark, ASKED)), question).orderBy("ord").collect()
    assert [round(r.score, 6) for r in rows] == pytest.approx(want, abs=2e-6)


def test_selection_stays_in_budget(spark):
    graph = g.Graph(nodes_of(spark, ASKED), edges_of(spark, [("src_middleware_JWTMiddleware", "src_auth_authenticateUser", "calls")]))
    scored = relevance.relevance(relevance.term_tables(graph.nodes), "JWT middleware authentication")
    few, many = (relevance.select_nodes(graph, scored, b) for b in (60, 4000))
    assert few.agg(F.sum("cost")).first()[0] <= 57 and few.count() <= many.count()
    assert relevance.induced_edges(graph.edges, many).count() == 1
    assert relevance.select_deep(graph, scored)[0] == "src_middleware_JWTMiddleware"


def test_find_target(spark):
    n = nodes_of(spark, [("f", "login", "file", "x"), ("a", "Auth.login", "method", "x"), ("b", "login", "function", "x")])
    assert impact.find_target(n, "login").first().id == "b"
    assert impact.find_target(n, "Auth").first().id == "a"
    assert impact.find_target(n, "none").count() == 0


def test_sweeps_by_numbers_match_plain_sweeps():
    """Plain sweeps over lists of neighbours, for numbers of sweeps before and after labels go round."""
    rng = random.Random(3)
    for n in (2, 3, 8, 40):
        nbrs = [[j for j in rng.sample(range(n), n) if rng.random() < 3 / n] for _ in range(n)]
        starts = np.concatenate([[0], np.cumsum([len(x) for x in nbrs])])
        for sweeps in (0, 1, 2, 3, 7, 49, 50):
            label = list(range(n))
            for _ in range(sweeps):
                moved = False
                for i, own in enumerate(nbrs):
                    votes = collections.Counter(label[j] for j in own)
                    votes.pop(label[i], None)
                    if votes:
                        label[i], moved = max(votes, key=votes.__getitem__), True
                if not moved:
                    break
            assert g.swept(starts, np.array([j for x in nbrs for j in x], np.int32), sweeps).tolist() == label


def test_communities_in_many_blocks(spark, monkeypatch):
    """A task gets neighbours in blocks, never a row with all of a hub's: 3,000 leaves of one node."""
    monkeypatch.setattr(g, "_BLOCK", 256)
    leaves = [(f"l{i}", f"l{i}", "class", "x") for i in range(3000)]
    graph = g.Graph(nodes_of(spark, [("hub", "hub", "file", "x"), *leaves]), edges_of(spark, [("hub", f"l{i}", "contains") for i in range(3000)]))
    sizes = collections.Counter(r.community for r in g.communities(graph, 3).collect())
    assert sum(sizes.values()) == 3001 and None not in sizes
    alone = g.communities(g.Graph(graph.nodes, graph.edges.limit(0)))
    assert alone.where("community is null").count() == 3001


def test_registered_ranking_takes_the_whole_graph(spark):
    sf = "/root/testdata/sf0.001"
    nodes, edges = registry.nodes(spark, sf).collect(), registry.edges(spark, sf).collect()
    near = {r.id: {} for r in nodes}
    for e in edges:
        for a, b in ((e.source, e.target), (e.target, e.source)):
            near[a][b] = min(e.ord, near[a].get(b, e.ord))
    score, n = {i: 1 / len(near) for i in near}, len(near)
    for _ in range(100):
        new = {i: 0.15 / n + 0.85 * sum(score[j] / len(near[j]) for j in near[i]) for i in near}
        moved, score = sum(abs(new[i] - score[i]) for i in near), new
        if moved < n * 1e-6:
            break
    central = {r.id: r.centrality for r in registry.QUERIES["centrality"](spark, sf).collect()}
    assert central.keys() == score.keys() and all(abs(central[i] - score[i]) < 5.01e-4 for i in score)

    order = [r.id for r in sorted(nodes, key=lambda r: r.ord)]
    label = {i: k for k, i in enumerate(order)}
    for _ in range(50):
        changed = False
        for i in order:
            votes = collections.Counter(label[j] for j, _ in sorted(near[i].items(), key=lambda x: (x[1], x[0])))
            votes.pop(label[i], None)
            if votes:
                label[i], changed = max(votes, key=votes.__getitem__), True
        if not changed:
            break
    number = {}
    want = {i: number.setdefault(label[i], len(number) + 1) for i in order}
    assert {r.id: r.community for r in registry.QUERIES["communities"](spark, sf).collect()} == want

    inside = collections.defaultdict(list)
    for r in sorted(nodes, key=lambda r: (-central[r.id], r.ord)):
        if r.type != "file":
            inside[r.source_file].append(r.label)
    ranked = registry.QUERIES["file_ranking"](spark, sf).collect()
    assert len(ranked) == 30 and all(r.symbols == inside[r.source_file][:6] for r in ranked)
