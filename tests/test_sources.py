"""Scanning, extraction, search, resolution and the engine over a small tree."""

import sqlite3

import pytest

from pyspark.sql import functions as F

from skein.engine import Engine, find_store
from skein.operators import resolve
from skein.operators.graph import EDGE_SCHEMA, NODE_SCHEMA, Graph
from skein.operators.iterate import dense_rank
from skein.operators.search import TextIndex, parse
from skein.sources import extract, files
from skein.streaming import watch

AUTH = "// entry\nexport function authenticateUser(u: string) {\n  validateCredentials(u);\n  createSession(u);\n}\nfunction validateCredentials(u: string) {\n  return true;\n}\n\nfunction createSession(u: string) {\n  return {};\n}\n"
CONTROLLER = "import { authenticateUser } from './auth';\n\nexport class UserController {\n  login(u: string) {\n    return authenticateUser(u);\n  }\n}\n"


@pytest.fixture
def tree(tmp_path):
    for name, text in (("src/auth.ts", AUTH), ("src/controller.ts", CONTROLLER), ("node_modules/x.ts", "function no() {}"), (".hidden/y.ts", "function no() {}"), ("run.sh", "function go() {\n}\nstop() {\n}\n"), ("conf.json", '{"b": 1, "10": 2, "2": 3}'), ("m.py", 'import os\n\ndef f():\n    """Does it."""\n    g()\n\ndef g():\n    pass\n\nclass A(B):\n    def h(self):\n        pass\n'), ("notes.md", "no code")):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(tmp_path)


def test_scan(spark, tree):
    assert {r.path: r.lang for r in files.scan(spark, tree).collect()} == {"src/auth.ts": "typescript", "src/controller.ts": "typescript", "run.sh": "bash", "conf.json": "json", "m.py": "python"}
    with pytest.raises(Exception):
        files.scan(spark, tree + "/none").count()


def test_engine(spark, tree, tmp_path_factory):
    engine = Engine(spark, str(tmp_path_factory.mktemp("store")))
    graph = engine.build(tree)
    nodes = {r.id: (r.type, r.source_location) for r in graph.nodes.collect()}
    assert nodes["src_auth_authenticateUser"] == ("function", "L2") and nodes["src_auth_createSession"] == ("function", "L10")
    assert nodes["src_controller_UserController"] == ("class", "L3") and nodes["src_controller_UserController_login"] == ("method", "L4")
    edges = {(r.source, r.target, r.relation) for r in graph.edges.collect()}
    assert ("src_controller_file", "src_auth_file", "imports") in edges
    assert ("src_auth_authenticateUser", "src_auth_validateCredentials", "calls") in edges
    assert ("m_f", "m_g", "calls") in edges
    chosen, _, stats = engine.query("authenticate user")
    assert chosen.first().id == "src_auth_authenticateUser" and stats.first().tokens_used <= 3800
    assert {r.node_id for r in engine.impact("createSession").collect()} == {"src_auth_authenticateUser"}
    assert engine.search("authenticateuser").first().doc == "src_auth_authenticateUser"
    assert "contains" in {r.relation for r in engine.explain("auth.ts").collect()}
    assert engine.file_map().first().source_file == "src/auth.ts"
    assert "Nodes:" in engine.report() and "<canvas" in engine.html()
    again = engine.build(tree)
    assert again.nodes.count() == len(nodes)


SHOP = "<?php\nnamespace App\\Http;\nuse App\\Pay\\{Bank, Card as Plastic};\nuse App\\Ship\\Van;\nclass Shop extends Base implements Sells {\n  use Loggable;\n  private Bank $bank;\n  public function buy() {\n    $this->bank->take();\n    Van::send();\n    $this->buy();\n  }\n}\n"
BANK = "<?php\nnamespace App\\Pay;\nclass Bank {\n  public function take() { return 1; }\n}\n"
VAN = "<?php\nnamespace App\\Ship;\nclass Van {\n}\n"


def test_calls_across_php_files(spark, tmp_path, tmp_path_factory):
    for name, text in (("Shop.php", SHOP), ("Bank.php", BANK), ("Van.phtml", VAN), ("bin/t.py", "def f():\n    pass\n"), ("c.zsh", "go() {\n}\n")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    engine = Engine(spark, str(tmp_path_factory.mktemp("store")))
    graph = engine.build(str(tmp_path))
    nodes = {r.id: r for r in graph.nodes.collect()}
    calls = {(r.source, r.target) for r in graph.edges.where("relation = 'calls'").collect()}
    # A method that the graph has, one that it hasn't, and one of the caller's own class, which stays as it is.
    assert {("Shop_Shop_buy", "Bank_Bank_take"), ("Shop_Shop_buy", "Van.send"), ("Shop_Shop_buy", "Shop_buy")} <= calls
    assert nodes["Van.send"].type == "method" and nodes["Van.send"].source_file == "Van.phtml"
    assert {("Shop_file", nodes[i].id) for i in nodes if nodes[i].type == "namespace" and "App" in nodes[i].label and i.startswith("Shop_App_P")} <= {(r.source, r.target) for r in graph.edges.where("relation = 'imports'").collect()}
    assert nodes["Shop_App_Http_Base"].label == "App\\Http\\Base" and nodes["Shop_App_Http_Sells"].type == "interface"
    assert {"bin_t_f", "c_go"} <= nodes.keys()
    index = engine.class_index()
    assert {(r.label, r.prop, r.prop_type) for r in index.props.collect()} == {("Shop", "bank", "Bank")}
    assert index.classes.where("label = 'Shop'").first().imports == {"Bank": "App\\Pay\\Bank", "Card": "App\\Pay\\Card", "Van": "App\\Ship\\Van"}
    assert engine.refresh(str(tmp_path), watched=True) == (False, "fresh (watcher active)")
    assert engine.refresh(str(tmp_path))[1] == "routes only" and engine.graph().nodes.count() == len(nodes)
    (tmp_path / "New.php").write_text("<?php\nfunction fresh() { return 2; }\n")
    import os

    os.utime(tmp_path / "New.php", (4 * 10**9, 4 * 10**9))
    assert engine.refresh(str(tmp_path)) == (True, "incremental (1 files re-extracted)")
    assert engine.graph().nodes.where("id = 'New_fresh'").count() == 1 and engine.search("fresh").first().doc == "New_fresh"
    assert "| Files | 6 (5 cached, 1 extracted) |" in engine.summary()


def test_answers(spark, tree, tmp_path):
    engine = Engine(spark, f"{tree}/graph-out")
    engine.build(tree)
    assert find_store(spark, f"{tree}/src/deep") == f"{tree}/graph-out" and find_store(spark, str(tmp_path.parent)) is None
    text = engine.answer("authenticate user", root=tree)
    assert "### authenticateUser (function)" in text and "### Source: authenticateUser (`src/auth.ts:2`)\n```ts\nexport function" in text
    assert "- **authenticateUser** (function) @ `src/auth.ts`" in engine.search_text("authenticateuser") and "No results" in engine.search_text("nothing")
    assert "└── [d=1] authenticateUser (function) @ src/auth.ts:L2" in engine.impact_text("createSession") and "not in the graph" in engine.impact_text("nowhere")
    told = engine.explain_text("auth.ts")
    assert told.startswith("## src/auth.ts (file)") and "#### contains (3)" in told and "→ **authenticateUser** (function) _EXTRACTED_" in told
    engine.write_json(str(tmp_path / "graph.json"))
    import json

    made = json.loads((tmp_path / "graph.json").read_text())
    assert made["directed"] is False and len(made["nodes"]) == engine.graph().nodes.count() and len(made["edges"]) == engine.graph().edges.count()


def test_projects_of_their_own(spark, tmp_path, tmp_path_factory):
    for name, text in (("api/composer.json", "{}"), ("api/artisan", ""), ("api/a.php", "<?php\nfunction a() {}\n"), ("web/package.json", "{}"), ("web/vite.config.ts", "export function c() {}\n"), ("docs/x.py", "def x():\n    pass\n")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    engine = Engine(spark, str(tmp_path_factory.mktemp("store")))
    made = engine.build_projects(str(tmp_path))
    assert [(n, s.rsplit("/", 1)[1]) for n, s, _ in made] == [("api", "api"), ("web", "web")]
    assert Engine(spark, made[0][1]).graph().nodes.where("id = 'a_a'").count() == 1


def test_dense_rank(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), F.lit("x").alias("_x")).repartition(7)
    assert sorted((r.v, r.n) for r in dense_rank(rows, "v", "n").collect()) == [(i, i + 1) for i in range(1000)]
    assert dense_rank(rows.limit(0), "v", "n").count() == 0


def test_native_extractors(spark, tree):
    found = files.scan(spark, tree)
    assert [(r.name, r.line) for r in extract.bash_functions(found.where("lang = 'bash'")).orderBy("line").collect()] == [("go", 1), ("stop", 3)]
    assert [r.key for r in extract.json_keys(found.where("lang = 'json'")).orderBy("pos").collect()] == ["2", "10", "b"]


@pytest.mark.parametrize("lang,text,want", [("go", "package a\nfunc Run() { help() }\ntype T struct {}\nfunc (t *T) Do() {}\n", {("Run", "function"), ("T", "struct"), ("T.Do", "method")}), ("java", "class A extends B {\n  public int go(int x) { return help(x); }\n}\n", {("A", "class"), ("go", "function")}), ("rust", "pub fn run() {}\nstruct S;\n", {("run", "function"), ("S", "struct")}), ("ruby", "class A < B\n  def go\n  end\nend\n", {("A", "class"), ("go", "function")}), ("php", "<?php\nnamespace App;\nclass A extends B { private T $p; function go() { $this->p->run(); } }\n", {("App", "namespace"), ("A", "class"), ("App\\B", "class"), ("A.p", "property"), ("A.go", "method"), ("run", "call")}), ("vue", '<template/><script lang="ts">function a() {}</script>', {("a", "function")})])
def test_languages(lang, text, want):
    got = extract.extract_file(f"x.{lang}", text, lang)
    assert {(n[1], n[2]) for n in got.nodes.values() if n[2] != "file"} == want


def test_search_matches_sqlite(spark):
    rows = [("a", "authenticateUser", "function", "src/auth.ts", "Validates user credentials and returns tokens"), ("b", "hashPassword", "function", "src/auth.ts", "Hashing passwords with relational salts"), ("c", "User", "class", "src/user.ts", "A user of the application"), ("d", "café", "class", "src/x.ts", None), ("e", "other", "class", "src/y.ts", "happily running users")]
    nodes = spark.createDataFrame([(i, label, kind, file, None, about, k) for k, (i, label, kind, file, about) in enumerate(rows)], NODE_SCHEMA)
    index = TextIndex.build(nodes)
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(id, label, type, file, description, tokenize='porter unicode61')")
    db.executemany("insert into t values (?,?,?,?,?)", rows)
    for q in ("users", "user AND validate", "hash OR run", "auth*", '"user of"', "type:class", "class NOT user", "cafe", "label:user", "relational passwords", "NEAR(hashing salts, 5)", "(user OR hashing) AND function"):
        want = db.execute("select id, round(rank, 6) from t where t match ? order by rank, rowid", (q,)).fetchall()
        got = [(r.doc, round(r["rank"], 6)) for r in index.search(q).collect()]
        assert sorted(x[0] for x in got) == sorted(x[0] for x in want), q
        assert dict(got) == pytest.approx(dict(want), abs=2e-6), q
    for bad in ('"', "AND", "a OR", "(a", ""):
        with pytest.raises(ValueError):
            parse(bad)


def test_resolution(spark):
    n = [("f", "A.php", "file"), ("a", "A", "class"), ("am", "A.go", "method"), ("b", "B", "class"), ("bm", "B.run", "method"), ("x", "run", "call"), ("y", "stop", "call")]
    nodes = spark.createDataFrame([(i, label, kind, "A.php" if i in ("f", "a", "am") else "B.php" if i in ("b", "bm") else "", None, None, k) for k, (i, label, kind) in enumerate(n)], NODE_SCHEMA)
    edges = spark.createDataFrame([("am", "x", "calls", "INFERRED", 0.85, "$this->p", 0), ("am", "y", "calls", "INFERRED", 0.85, "B", 1), ("am", "x", "calls", "INFERRED", 0.85, "$this", 2), ("am", "x", "calls", "INFERRED", 0.85, "$q", 3)], EDGE_SCHEMA)
    graph = Graph(nodes, edges)
    sources = spark.createDataFrame([("A.php", "class A { private B $p; }"), ("B.php", "class B {}")], "file string, content string")
    out = resolve.resolve_calls(graph, resolve.class_index(graph, sources))
    assert [r.target for r in out.edges.orderBy("ord").collect()] == ["bm", "B.stop", "x", "x"]
    assert out.nodes.where("id = 'B.stop' and type = 'method'").count() == 1


def test_stream_debounce(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", "a.ts"), ("2024-01-01 00:00:01", "b.TS"), ("2024-01-01 00:00:09", "a.ts"), ("2024-01-01 00:00:09", "node_modules/a.ts"), ("2024-01-01 02:00:00", "a.ts")]
    spark.createDataFrame(rows, "ts string, path string").selectExpr("cast(ts as timestamp) ts", "path").write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, path string").json(str(tmp_path / "in"))
    query = watch.debounced(watch.watched(stream)).writeStream.format("memory").queryName("bursts").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination(120)
    assert sorted(r.n_events for r in spark.table("bursts").collect()) == [1, 2]
    assert watch.banner(list("abcdefg")) == "Pending changes: a, b, c, d, e and 2 more\n"
