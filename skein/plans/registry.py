"""Named queries over the test tables, and SQL that gives the same rows.

The tables make a graph: regions, nations, customers and suppliers are nodes; nations import regions,
customers and suppliers are contained in nations, and customers call the suppliers they buy from. Market
segments and account bands stand for types, nations for source files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text as fn
from skein.operators import graph as g
from skein.operators import impact, relevance, report, resolve
from skein.sources import files as fs
from skein.streaming import watch

FLAGSHIP = "file_ranking"


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda n: _t(spark, sf, n)
    none = F.lit(None).cast("string")
    shape = lambda df, p, key, label, kind, file, about, base: df.select(F.concat(F.lit(p), F.col(key).cast("string")).alias("id"), label.alias("label"), kind.alias("type"), file.alias("source_file"), none.alias("source_location"), about.alias("description"), (F.lit(base) + F.col(key)).cast("long").alias("ord"))
    nation = F.concat(F.lit("src/nation"), F.col("n").cast("string"), F.lit(".ts"))
    r = shape(t("region"), "r", "r_regionkey", F.col("r_name"), F.lit("file"), F.concat(F.lit("src/region"), F.col("r_regionkey").cast("string"), F.lit(".ts")), none, 0)
    n = shape(t("nation").withColumn("n", F.col("n_nationkey")), "n", "n_nationkey", F.col("n_name"), F.lit("file"), nation, none, 1000)
    s = shape(t("supplier").withColumn("n", F.col("s_nationkey")), "s", "s_suppkey", F.col("s_name"), F.lit("class"), nation, F.lit("Delivers parts"), 10**6)
    c = shape(t("customer").withColumn("n", F.col("c_nationkey")), "c", "c_custkey", F.col("c_name"), F.lower("c_mktsegment"), nation, F.concat(F.lit("Buys for "), F.lower("c_mktsegment")), 10**9)
    return r.unionByName(n).unionByName(s).unionByName(c)


def edges(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda n: _t(spark, sf, n)
    link = lambda df, a, b, rel, ord: df.select(a.alias("source"), b.alias("target"), F.lit(rel).alias("relation"), F.lit("INFERRED" if rel == "calls" else "EXTRACTED").alias("confidence"), F.lit(0.85 if rel == "calls" else None).cast("double").alias("confidence_score"), F.lit(None).cast("string").alias("call_context"), ord.cast("long").alias("ord"))
    at = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    bought = t("orders").select("o_orderkey", "o_custkey").join(t("lineitem").select("l_orderkey", "l_suppkey"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "l_suppkey").distinct()
    return link(t("nation"), at("n", "n_nationkey"), at("r", "n_regionkey"), "imports", F.col("n_nationkey")).unionByName(link(t("supplier"), at("n", "s_nationkey"), at("s", "s_suppkey"), "contains", 10**6 + F.col("s_suppkey"))).unionByName(link(t("customer"), at("n", "c_nationkey"), at("c", "c_custkey"), "contains", 10**9 + F.col("c_custkey"))).unionByName(link(bought, at("c", "o_custkey"), at("s", "l_suppkey"), "calls", 10**12 + F.col("o_custkey") * 10**7 + F.col("l_suppkey")))


def table_graph(spark: SparkSession, sf: str) -> g.Graph:
    return g.Graph(nodes(spark, sf), edges(spark, sf))


_GRAPH = """
with nodes as (
    select 'r' || r_regionkey as id, r_name as label, 'file' as type, 'src/region' || r_regionkey || '.ts' as source_file, null as description, r_regionkey as ord from region
    union all select 'n' || n_nationkey, n_name, 'file', 'src/nation' || n_nationkey || '.ts', null, 1000 + n_nationkey from nation
    union all select 's' || s_suppkey, s_name, 'class', 'src/nation' || s_nationkey || '.ts', 'Delivers parts', 1000000 + s_suppkey from supplier
    union all select 'c' || c_custkey, c_name, lower(c_mktsegment), 'src/nation' || c_nationkey || '.ts', 'Buys for ' || lower(c_mktsegment), 1000000000 + c_custkey from customer),
edges as (
    select 'n' || n_nationkey as source, 'r' || n_regionkey as target, 'imports' as relation, 'EXTRACTED' as confidence, cast(n_nationkey as bigint) as ord from nation
    union all select 'n' || s_nationkey, 's' || s_suppkey, 'contains', 'EXTRACTED', 1000000 + s_suppkey from supplier
    union all select 'n' || c_nationkey, 'c' || c_custkey, 'contains', 'EXTRACTED', 1000000000 + c_custkey from customer
    union all select 'c' || o_custkey, 's' || l_suppkey, 'calls', 'INFERRED', 1000000000000 + o_custkey * 10000000 + l_suppkey
        from (select distinct o_custkey, l_suppkey from orders join lineitem on o_orderkey = l_orderkey)),
adj as (
    select id, nbr, min(ord) as nbr_ord from (select source as id, target as nbr, ord from edges union all select target, source, ord from edges) group by id, nbr),
degrees as (select nodes.*, coalesce(d.n, 0) as degree from nodes left join (select id, count(*) as n from adj group by id) d on nodes.id = d.id)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        name = f.__name__.removeprefix("q_")
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


@_query(_GRAPH + "select id, nbr, nbr_ord from adj")
def q_adjacency(spark, sf):
    return table_graph(spark, sf).adjacency()


@_query(_GRAPH + "select id, label, type, degree from degrees order by degree desc, ord limit 25")
def q_top_nodes(spark, sf):
    return table_graph(spark, sf).top_nodes(25).select("id", "label", "type", "degree")


@_query(_GRAPH + "select (select count(*) from nodes) as n_nodes, 0 as n_communities, (select count(*) from edges) as n_edges")
def q_graph_stats(spark, sf):
    return table_graph(spark, sf).stats()


@_query(_GRAPH + "select source, target, relation from edges where source not in ('n3', 'r1') and target not in ('n3', 'r1')")
def q_build_edges(spark, sf):
    """Edges whose two ends exist, after two nodes went."""
    n, e = nodes(spark, sf), edges(spark, sf)
    return g.Graph.from_extraction(n.where("id not in ('n3', 'r1')"), e).edges.select("source", "target", "relation")


@_query(_GRAPH + "select least(source, target) as a, greatest(source, target) as b, relation, min(ord) as first_ord from edges group by all")
def q_merge(spark, sf):
    """A graph merged with the reverse of its own edges gains nothing."""
    n, e = nodes(spark, sf), edges(spark, sf)
    back = e.select(F.col("target").alias("source"), F.col("source").alias("target"), *e.columns[2:])
    merged = g.Graph(n, e).merge(n, back)
    return merged.edges.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), "relation", F.col("ord").alias("first_ord"))


def _ranked(name: str, ids: str, arcs: str) -> str:
    """Power iteration over arcs (src, dst) of ids (id), until it moves less than a millionth a node: name (id, score, k)."""
    return f"""
{name}_size as (select count(*) as n from {ids}),
{name}_arcs as (select src, dst, 0.85::double / count(*) over (partition by src) as share from {arcs}),
{name}_all as (
    select id, 1.0::double / n as score, 0 as k, 1e9::double as moved from {ids}, {name}_size
    union all
    select id, score, k, sum(abs(score - old)) over () from (
        select r.id, r.score as old, r.k + 1 as k, (1 - 0.85::double) / n + coalesce(got, 0) as score
        from {name}_all r cross join {name}_size
        left join (select dst, sum(score * share) as got from {name}_all join {name}_arcs on src = id group by dst) s on dst = r.id
        where r.moved >= n * 1e-6 and r.k < 100)),
{name} as (select id, score from {name}_all where k = (select max(k) from {name}_all))"""


_CENTRAL = _GRAPH.replace("with nodes", "with recursive nodes") + ", steps as (select id as src, nbr as dst from adj)," + _ranked("pagerank", "nodes", "steps") + ", central as (select id, floor(score * 1000 + 0.5) / 1000 as centrality from pagerank)"


@_query(
    _CENTRAL
    + """, owner as (select source_file, min_by(id, ord) as file_id from nodes where type = 'file' group by source_file),
home as (select id, file_id from nodes join owner using (source_file)), files as (select id from nodes where type = 'file'),
lifted as (select distinct a.file_id as src, b.file_id as dst from edges join home a on a.id = source join home b on b.id = target where relation = 'imports' and a.file_id <> b.file_id),"""
    + _ranked("filerank", "files", "lifted")
    + """, inside as (select source_file, list(label order by centrality desc, ord)[:6] as symbols from nodes join central using (id) where type <> 'file' group by source_file)
select source_file, floor(score * 1000 + 0.5) / 1000 as score, coalesce(symbols, []) as symbols
from filerank join nodes using (id) left join inside using (source_file) order by filerank.score desc, ord limit 40"""
)
def q_file_ranking(spark, sf):
    return g.file_ranking(table_graph(spark, sf), 40).drop("ord")


@_query(_CENTRAL + "select id, centrality from central")
def q_centrality(spark, sf):
    return g.centrality(table_graph(spark, sf)).select("id", "centrality")


@_query()
def q_communities(spark, sf):
    return g.communities(table_graph(spark, sf)).select("id", "community")


def _propagated(rounds: int) -> str:
    out = ", l0 as (select id, ord as label from nodes)"
    for k in range(rounds):
        votes = f"select adj.id, label, count(*) as n from adj join l{k} l on l.id = nbr group by all"
        out += f", l{k + 1} as materialized (select l.id, coalesce(best, l.label) as label from l{k} l left join (select id, max_by(label, (n, -label)) as best from ({votes}) group by id) using (id))"
    return out + f" select id, label as community from l{rounds}"


@_query(_GRAPH + _propagated(10))
def q_label_propagation(spark, sf):
    """Ten rounds, or fewer where nothing moves any more."""
    return g.label_propagation(table_graph(spark, sf), 10).select("id", "community")


_WORDS = r"""list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace({}, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '[^a-zA-Z0-9]+'), lambda x: lower(x)), lambda x: len(x) > 1)"""


@_query(_GRAPH + f", tok as (select id, unnest({_WORDS.format("label || ' ' || coalesce(description, '') || ' ' || type")}) as t from nodes), total as (select count(distinct id) as n from tok) select t, df, round(ln((n + 1) / (df + 1)) + 1, 9) as idf from (select t, count(distinct id) as df from tok group by t), total")
def q_inverse_document_frequency(spark, sf):
    tables = relevance.term_tables(nodes(spark, sf))
    return tables.terms.groupBy("t").agg(F.count(F.lit(1)).alias("df")).join(tables.idf, "t").select("t", "df", F.round("idf", 9).alias("idf"))


@_query(
    _GRAPH
    + f""", tok as (select id, unnest({_WORDS.format("label || ' ' || coalesce(description, '') || ' ' || type")}) as t from nodes),
tf as (select id, t, count(*) as tf from tok group by id, t), total as (select count(distinct id) as n from tok),
idf as (select t, ln((n + 1) / (count(*) + 1)) + 1 as idf from tf, total group by t, n),
norm as (select id, sqrt(sum((tf * idf) ** 2)) as norm from tf join idf using (t) group by id),
q as (select unnest(['buys', 'building', 'delivers']) as t), qi as (select q.t, coalesce(idf, 0.5) as idf from q left join idf on q.t = idf.t),
qn as (select sqrt(sum(idf * idf)) as qnorm from qi),
dot as (select id, sum(tf * qi.idf * qi.idf) as dot from tf join qi using (t) group by id),
doc as (select id, array_to_string({_WORDS.format("label || ' ' || coalesce(description, '') || ' ' || type")}, ' ') as text from nodes)
select doc.id, round(least(1.0, coalesce(dot / (qnorm * norm), 0) + 0.3 * (contains(text, 'buys')::int + contains(text, 'building')::int + contains(text, 'delivers')::int)), 9) as score
from doc left join dot using (id) left join norm using (id), qn"""
)
def q_relevance(spark, sf):
    return relevance.relevance(relevance.term_tables(nodes(spark, sf)), "buys building delivers").select("id", F.round("score", 9).alias("score"))


@_query()
def q_select_nodes(spark, sf):
    graph = table_graph(spark, sf)
    scored = relevance.relevance(relevance.term_tables(graph.nodes), "buys building delivers")
    return relevance.select_nodes(graph, scored, 4000, 0.15, "# buys\n")


@_query(_GRAPH + ", c as (select id from nodes where type in ('file', 'building', 'class')) select least(source, target) as a, greatest(source, target) as b, min(ord) as ord from edges where source in (from c) and target in (from c) group by all")
def q_induced_edges(spark, sf):
    chosen = nodes(spark, sf).where("type in ('file', 'building', 'class')")
    return relevance.induced_edges(edges(spark, sf), chosen).select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), "ord")


@_query(_GRAPH + "select target as start_id, source as node_id, target as parent_id, 1 as depth, row_number() over (partition by target order by ord) as pos from edges where relation = 'calls' and target in ('s0', 's1', 's2') qualify pos <= 50")
def q_impact(spark, sf):
    starts = nodes(spark, sf).where("id in ('s0', 's1', 's2')").select(F.col("id").alias("start_id"))
    return impact.reverse_impact(edges(spark, sf), starts, 2, 50)


@_query(_GRAPH + "select id, relation, count(*) as n, list(arrow || ' ' || label order by ord, arrow)[:15] as shown from (select source as id, relation, ord, '→' as arrow, target as other from edges union all select target, relation, ord, '←', source from edges where source <> target) e join (select id as other, label from nodes) using (other) where id in ('n1', 's1', 'r1') group by id, relation")
def q_explain(spark, sf):
    graph = table_graph(spark, sf)
    return impact.neighbourhood(graph, graph.nodes.where("id in ('n1', 's1', 'r1')").select("id"))


@_query(_GRAPH + "select community, count(*) as size, max_by(label, (centrality, -ord)) as name, array_to_string(list(label order by ord)[:3], ', ') as labels from (select *, ord % 7 as community, cast(ord % 11 as double) as centrality from nodes) group by community")
def q_community_sizes(spark, sf):
    return report.community_sizes(nodes(spark, sf).withColumn("community", F.col("ord") % 7).withColumn("centrality", (F.col("ord") % 11).cast("double")))


@_query(_GRAPH + ", n as (select *, ord % 7 as community, cast(ord % 11 as double) as centrality from nodes), names as (select community, max_by(label, (centrality, -ord)) as name from n group by community) select a.label as source_label, relation, b.label as target_label, x.name as source_name, y.name as target_name from edges e join n a on a.id = source join n b on b.id = target join names x on x.community = a.community join names y on y.community = b.community where confidence = 'EXTRACTED' and a.community <> b.community order by e.ord limit 40")
def q_surprises(spark, sf):
    n = nodes(spark, sf).withColumn("community", F.col("ord") % 7).withColumn("centrality", (F.col("ord") % 11).cast("double"))
    return report.surprises(g.Graph(n, edges(spark, sf)), 40).drop("ord")


@_query(_GRAPH + "select id, degree, round(greatest(5.0, least(25.0, log2(degree + 2) * 8)), 9) as size, ord % 7 % 25 as colour from degrees where type <> 'file' order by degree desc, ord limit 1500")
def q_view_nodes(spark, sf):
    n = nodes(spark, sf).withColumn("community", F.col("ord") % 7)
    return report.view_nodes(g.Graph(n, edges(spark, sf))).select("id", "degree", F.round("size", 9).alias("size"), "colour")


@_query(_GRAPH + "select community, count(*) as size, min_by(label, ord) as label from (select *, ord % 97 as community from nodes) group by community order by size desc, community limit 50")
def q_legend(spark, sf):
    return report.legend(nodes(spark, sf).withColumn("community", F.col("ord") % 97))


@_query("select regexp_replace(regexp_replace(url, '[\\\\/]', '_', 'g'), '\\.[^.]+\\z', '') || '_' || regexp_replace('page ' || page_id, '[^a-zA-Z0-9_$]', '_', 'g') as id, page_id from pages")
def q_node_id(spark, sf):
    return _t(spark, sf, "pages").select(fn.node_id("url", F.concat(F.lit("page "), F.col("page_id").cast("string"))).alias("id"), "page_id")


@_query("select doc_id, left(sha256(coalesce(text, '')), 16) as hash, cast(ceil(len(text) / 4.0) as bigint) as tokens from documents")
def q_content_hash(spark, sf):
    d = _t(spark, sf, "documents")
    return d.select("doc_id", fn.content_hash(F.coalesce("text", F.lit("")).cast("binary")).alias("hash"), fn.token_estimate("text").alias("tokens"))


_ROUTES = r"""
with r as (
    select ((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 1000 + cast(round(100 * l_extendedprice) as bigint) % 1000 as ord, case l_linenumber % 2 when 0 then 'GET' else 'HEAD' end as method,
        case l_returnflag when 'R' then '_' else '' end || 'orders/' || l_orderkey || '/' || l_linenumber as uri,
        case l_linestatus when 'O' then 'orders.' || l_orderkey end as name, case cast(l_quantity as int) % 7 when 0 then ['auth', 'web'] else [] end as middleware,
        case cast(l_quantity as int) % 5 when 0 then 'Closure' when 1 then 'App\C' || l_suppkey else 'App\C' || l_suppkey || '@show' end as action, 'C' || l_suppkey as cls, l_suppkey
    from lineitem),
k as (select *, row_number() over (order by ord) as n, method || ' /' || uri as label from r where method <> 'HEAD' and not starts_with(uri, '_') and action <> 'Closure'),
i as (select *, 'route_' || n || '_' || regexp_replace(label, '[^a-zA-Z0-9_]', '_', 'g') as id from k)
select id, label, case when name is not null then 'name: ' || name end as source_location,
    case when len(middleware) > 0 then 'middleware: ' || array_to_string(middleware, ', ') end as description,
    case when contains(action, '@') then 'route_controller_' || cls end as controller, case when contains(action, '@') and s_acctbal > 0 then 'm' || l_suppkey end as method
from i join supplier on s_suppkey = l_suppkey"""


@_query(_ROUTES)
def q_routes(spark, sf):
    """Routes made of all line items; suppliers in credit have the method that routes may name."""
    key, maker = F.col("l_orderkey").cast("string"), F.concat(F.lit("App\\C"), F.col("l_suppkey").cast("string"))
    uri = F.concat(F.when(F.col("l_returnflag") == "R", "_").otherwise(""), F.concat_ws("/", F.lit("orders"), key, "l_linenumber"))
    action = F.when(F.col("l_quantity").cast("int") % 5 == 0, "Closure").when(F.col("l_quantity").cast("int") % 5 == 1, maker).otherwise(F.concat(maker, F.lit("@show")))
    layers = F.when(F.col("l_quantity").cast("int") % 7 == 0, F.array(F.lit("auth"), F.lit("web"))).otherwise(F.array().cast("array<string>"))
    routes = _t(spark, sf, "lineitem").select(F.when(F.col("l_linenumber") % 2 == 0, "GET").otherwise("HEAD").alias("method"), uri.alias("uri"), F.when(F.col("l_linestatus") == "O", F.concat(F.lit("orders."), key)).alias("name"), action.alias("action"), layers.alias("middleware"), (((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")) * 1000 + F.round(100 * F.col("l_extendedprice")).cast("long") % 1000).alias("ord"))
    methods = _t(spark, sf, "supplier").where("s_acctbal > 0").select(F.concat(F.lit("m"), F.col("s_suppkey").cast("string")).alias("id"), F.concat(F.lit("C"), F.col("s_suppkey").cast("string"), F.lit(".show")).alias("label"), F.lit("method").alias("type"), F.col("s_suppkey").alias("ord"))
    made, linked = resolve.link_routes(routes, methods)
    ends = linked.groupBy(F.col("source").alias("id")).agg(F.max(F.when(F.startswith("target", F.lit("route_controller_")), F.col("target"))).alias("controller"), F.max(F.when(~F.startswith("target", F.lit("route_controller_")), F.col("target"))).alias("method"))
    return made.where("type = 'route'").join(ends, "id", "left").select("id", "label", "source_location", "description", "controller", "method")


@_query("select cast(doc_id as varchar) as file, 'p' as prop, substr('TVUWX', doc_id % 5 + 1, 1) || doc_id as prop_type from documents")
def q_property_types(spark, sf):
    """Typed declarations beat comments, which beat constructor parameters, created and resolved objects."""
    i = F.col("doc_id").cast("string")
    resolved = F.concat(F.lit("$this->p = app(\\App\\X"), i, F.lit("::class);"))
    created = F.concat(F.lit("$this->p = new \\App\\W"), i, F.lit("();\n"), resolved)
    params = F.concat(F.lit("function __construct(U"), i, F.lit(" $p) {}\n"), created)
    commented = F.concat(F.lit("/** @var V"), i, F.lit(" $p */\n"), params)
    # A comment of this form reads as a declaration too, so it stands before those that are to win.
    typed = F.concat(F.lit("/** @var V"), i, F.lit(" $p */\nvar S"), i, F.lit(" $p;\nprivate T"), i, F.lit(" $p;\n"), params)
    kinds = F.array(typed, commented, params, created, resolved)
    return resolve.property_types(_t(spark, sf, "documents").select(i.alias("file"), F.get(kinds, (F.col("doc_id") % 5).cast("int")).alias("content")))


@_query("select user_id, count(*) as n_events, min(ts) as first_ts, max(ts) as last_ts from (select *, sum(new) over (partition by user_id order by ts, event_id) as s from (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 1 hour then 0 else 1 end as new from events)) group by user_id, s")
def q_debounce(spark, sf):
    bursts = watch.debounced(_t(spark, sf, "events"), "user_id", "1 hour")
    return bursts.select("user_id", "n_events", F.col("first_ts").cast("timestamp_ntz").alias("first_ts"), F.col("last_ts").cast("timestamp_ntz").alias("last_ts"))


@_query("select case when lang = 'en' then '.ts' else '.py' end as ext, count(*) as n_files from documents group by all")
def q_files_by_extension(spark, sf):
    return report.files_by_extension(_t(spark, sf, "documents").select(F.when(F.col("lang") == "en", ".ts").otherwise(".py").alias("ext")))


@_query("select case when source = 'src0' then 'root' else source end as name, case when source = 'src0' then '' else source end as path from documents group by source")
def q_projects(spark, sf):
    d = _t(spark, sf, "documents").select("source").distinct()
    rows = d.select(F.explode(F.array(F.concat(F.when(F.col("source") == "src0", "").otherwise(F.concat("source", F.lit("/"))), F.lit("package.json")), F.concat(F.when(F.col("source") == "src0", "").otherwise(F.concat("source", F.lit("/"))), F.lit("vite.config.ts")))).alias("path"))
    return fs.projects(rows)


@_query(_GRAPH + "select printf('%.1f', 2.0 * (select count(*) from edges) / (select count(*) from nodes)) as average_degree")
def q_average_degree(spark, sf):
    return report.average_degree(table_graph(spark, sf))


@_query(_GRAPH + ", shown as (select id from degrees where type <> 'file' order by degree desc, ord limit 1500) select source, target, relation, confidence <> 'EXTRACTED' as dashed from edges where source in (from shown) and target in (from shown) order by ord limit 4000")
def q_view_edges(spark, sf):
    graph = table_graph(spark, sf)
    return report.view_edges(graph, report.view_nodes(g.Graph(graph.nodes.withColumn("community", F.lit(1)), graph.edges))).select("source", "target", "relation", "dashed")


@_query(_GRAPH + ", e as (select source as id, relation, ord, '→' as arrow, target as other, confidence from edges union all select target, relation, ord, '←', source, confidence from edges where source <> target), l as (select e.*, arrow || ' **' || label || '** (' || type || ') _' || confidence || '_' as line from e join (select id as other, label, type from nodes) using (other)) select id, relation, count(*) as n, list(line order by ord, arrow)[:15] as shown from l where id in (select id from nodes where type = 'file') group by id, relation")
def q_explain_details(spark, sf):
    graph = table_graph(spark, sf)
    return impact.details(graph, graph.nodes.where("type = 'file'").select("id")).drop("first")


@_query("select cast(doc_id as varchar) as path, lang = 'en' and sha256(text) is not null as cached from documents where text is not null")
def q_split_by_cache(spark, sf):
    """Documents as files: English ones are in the cache as they are, others as they once were."""
    d = _t(spark, sf, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("path"), "lang", F.col("text").cast("binary").alias("content"))
    found = fs.with_hash(d)
    cache = found.select(F.col("path").alias("file"), F.when(F.col("lang") == "en", F.col("hash")).otherwise(F.lit("old")).alias("hash"))
    cached, fresh = fs.split_by_cache(found, cache)
    return cached.select(F.col("file").alias("path"), F.lit(True).alias("cached")).unionByName(fresh.select("path", F.lit(False).alias("cached")))


@_query(
    """
with f as (select 'src/c' || c_nationkey || '/m' || c_custkey || case c_custkey % 4 when 0 then '.ts' when 1 then '.py' when 2 then '/index.js' else '.vue' end as path from customer),
i as (select o_orderkey as ord, 'src/c' || c_nationkey || '/index.ts' as importer, '../c' || c_nationkey || '/m' || o_custkey || case when o_orderkey % 5 = 0 then '.ts' else '' end as specifier, c_nationkey, o_custkey from orders join customer on c_custkey = o_custkey)
select ord, specifier, case when o_custkey % 4 = 3 or (o_orderkey_5 and o_custkey % 4 <> 0) then null
    else 'src/c' || c_nationkey || '/m' || o_custkey || case o_custkey % 4 when 0 then '.ts' when 1 then '.py' else '/index.js' end end as resolved
from (select *, ord % 5 = 0 as o_orderkey_5 from i)"""
)
def q_modules(spark, sf):
    """Orders import the modules of their customers: by suffix, by index file, as they are, or not at all."""
    c = _t(spark, sf, "customer").select("c_custkey", F.concat(F.lit("src/c"), F.col("c_nationkey").cast("string"), F.lit("/m"), F.col("c_custkey").cast("string")).alias("stem"), F.col("c_nationkey").cast("string").alias("n"))
    kinds = F.array(*map(F.lit, (".ts", ".py", "/index.js", ".vue")))
    listing = c.select(F.concat("stem", F.get(kinds, (F.col("c_custkey") % 4).cast("int"))).alias("path"))
    o = _t(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    name = F.concat(F.lit("../c"), "n", F.lit("/m"), F.col("o_custkey").cast("string"), F.when(F.col("o_orderkey") % 5 == 0, ".ts").otherwise(""))
    imports = o.select(F.col("o_orderkey").alias("ord"), F.concat(F.lit("src/c"), "n", F.lit("/index.ts")).alias("importer"), name.alias("specifier"))
    return fs.resolve_modules(imports, listing).select("ord", "specifier", "resolved")


@_query(
    """
select o_orderkey as ord, case when o_orderkey % 3 = 0 then 'run' || c_custkey when s_acctbal > 0 then 'm' || s_suppkey else 'C' || s_suppkey || '.run' end as target
from orders join customer on c_custkey = o_custkey join (select *, count(*) over () as many from supplier) on s_suppkey = o_custkey % many"""
)
def q_resolve_calls(spark, sf):
    """Customers are classes that call, through a typed property or by name, the suppliers' classes; those in credit
    have the method. Every third call is of an unknown variable and stays as it is."""
    s, c, o = (_t(spark, sf, n) for n in ("supplier", "customer", "orders"))
    many = s.count()
    text, key = lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v.cast("string") for v in x)), F.col
    shape = lambda df, id, label, kind, file, ord: df.select(id.alias("id"), label.alias("label"), F.lit(kind).alias("type"), file.alias("source_file"), F.lit(None).cast("string").alias("source_location"), F.lit(None).cast("string").alias("description"), ord.cast("long").alias("ord"))
    n = shape(s, text("k", key("s_suppkey")), text("C", key("s_suppkey")), "class", text("s", key("s_suppkey"), ".php"), key("s_suppkey"))
    n = n.unionByName(shape(s.where("s_acctbal > 0"), text("m", key("s_suppkey")), text("C", key("s_suppkey"), ".run"), "method", text("s", key("s_suppkey"), ".php"), key("s_suppkey") + 10**6))
    for i, (id, label, kind) in enumerate((("q", ("K", ""), "class"), ("go", ("K", ".go"), "method"), ("run", ("run", None), "call"))):
        name = F.lit("run") if kind == "call" else text(label[0], key("c_custkey"), label[1])
        n = n.unionByName(shape(c, text(id, key("c_custkey")), name, kind, text("c", key("c_custkey"), ".php"), key("c_custkey") + (i + 2) * 10**8))
    context = F.when(key("o_orderkey") % 3 == 0, "$x").when(key("o_orderkey") % 3 == 1, "$this->s").otherwise(text("C", key("o_custkey") % many))
    e = o.join(c, key("c_custkey") == key("o_custkey")).select(text("go", key("o_custkey")).alias("source"), text("run", key("o_custkey")).alias("target"), F.lit("calls").alias("relation"), F.lit("INFERRED").alias("confidence"), F.lit(0.85).alias("confidence_score"), context.alias("call_context"), key("o_orderkey").cast("long").alias("ord"))
    sources = c.select(text("c", key("c_custkey"), ".php").alias("file"), text("private C", key("c_custkey") % many, " $s;").alias("content"))
    graph = g.Graph(n, e)
    return resolve.resolve_calls(graph, resolve.class_index(graph, sources)).edges.select("ord", "target")
