"""A class index from graph and source text, and call edges retargeted through it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.text import before_last_dot, last_segment, resolve_short_name
from skein.operators.graph import Graph, first_by
from skein.operators.iterate import dense_rank

#: PHP source patterns of typed properties, @var comments, the constructor and its parameters, and assignments.
TYPED = r"(?:public|protected|private|var)\s+([\w\\]+)\s+\$(\w+)"
COMMENTED = r"@var\s+([\w\\]+)\s+\$(\w+)"
CONSTRUCTOR = r"function\s+__construct\s*\(([^)]*)\)"
PARAMETER = r"([\w\\]+)\s+\$(\w+)"
CREATED = r"\$this->(\w+)\s*=\s*new\s+([\w\\]+)\s*\("
RESOLVED = r"\$this->(\w+)\s*=\s*(?:resolve|app)\s*\(\s*([\w\\]+)::class\s*\)"


@dataclass
class ClassIndex:
    """classes: label, file, namespace, imports (map short -> full); props: label, prop, prop_type; methods: label, method."""

    classes: DataFrame
    props: DataFrame
    methods: DataFrame

    def save(self, path: str) -> None:
        for name in ("classes", "props", "methods"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ClassIndex:
        return cls(*(spark.read.parquet(f"{path}/{name}") for name in ("classes", "props", "methods")))


def property_types(files: DataFrame) -> DataFrame:
    """file, prop, prop_type by precedence: the last typed declaration, then the first @var, constructor
    parameter, ``new`` and ``resolve`` or ``app`` assignment. files: file, content."""

    def found(text: F.Column, pattern: str, type_group: int, name_group: int, priority: int, last: bool = False) -> F.Column:
        pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(type_group)).alias("t"), F.regexp_extract_all(text, F.lit(pattern), F.lit(name_group)).alias("n"))
        return F.transform(pairs, lambda x, i: F.struct(x["n"].alias("prop"), x["t"].alias("prop_type"), F.lit(priority).alias("priority"), (-i if last else i).alias("pos")))

    c = F.col("content")
    short = lambda types: F.transform(types, lambda x: x.withField("prop_type", last_segment(x["prop_type"])))
    every = F.concat(found(c, TYPED, 1, 2, 1, True), found(c, COMMENTED, 1, 2, 2), found(F.regexp_extract(c, CONSTRUCTOR, 1), PARAMETER, 1, 2, 3), short(found(c, CREATED, 2, 1, 4)), short(found(c, RESOLVED, 2, 1, 5)))
    rows = files.where("content is not null").select("file", F.explode(every).alias("p")).select("file", "p.*")
    return rows.groupBy("file", "prop").agg(F.min_by("prop_type", F.struct("priority", "pos")).alias("prop_type"))


def class_index(graph: Graph, files: DataFrame) -> ClassIndex:
    """Of several classes of a label the last counts; a file's methods and properties go to its first class."""
    nodes, edges = graph.nodes, graph.edges
    owners = nodes.where("type = 'class' and source_file <> ''")
    classes = first_by(owners, [F.col("label")], [F.desc("ord")]).select("label", F.col("source_file").alias("file"))
    # A file node stands for its path; what it imports, and the namespaces that it contains, hold for its classes.
    roots = nodes.where("type = 'file'").select(F.col("id").alias("source"), F.col("source_file").alias("file"))
    targets = nodes.select(F.col("id").alias("target"), F.col("label").alias("full"), F.col("type").alias("kind"))
    held = edges.where("relation in ('imports', 'contains')").join(roots, "source").join(targets, "target")
    imports = held.where("relation = 'imports'").withColumn("short", last_segment("full")).groupBy("file", "short").agg(F.max_by("full", "ord").alias("full"))
    maps = imports.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("short", "full"))).alias("imports"))
    spaces = held.where("relation = 'contains' and kind = 'namespace'").groupBy("file").agg(F.min_by("full", "ord").alias("namespace"))
    indexed = classes.join(maps, "file", "left").join(spaces, "file", "left").withColumn("imports", F.coalesce("imports", F.create_map().cast("map<string,string>"))).withColumn("namespace", F.coalesce("namespace", F.lit("")))
    first = owners.groupBy(F.col("source_file").alias("file")).agg(F.min_by("label", "ord").alias("label"))
    methods = nodes.where("type = 'method'").select(F.col("source_file").alias("file"), F.element_at(F.split("label", r"\."), -1).alias("method")).join(first, "file").select("label", "method").distinct()
    props = property_types(files).join(first, "file").select("label", "prop", "prop_type")
    # Of files whose first classes share a label, the one that the index names counts.
    return ClassIndex(indexed, props.groupBy("label", "prop").agg(F.min("prop_type").alias("prop_type")), methods)


def resolve_calls(graph: Graph, index: ClassIndex) -> Graph:
    """Call edges of methods, retargeted where their receiver names a known class.

    Contexts: ``$this->p`` goes through p's type, a bare name is a class, ``$this`` and other variables stay
    as they are. Methods that no node has become placeholder nodes Class.method in the class's file."""
    callers = graph.nodes.where("type = 'method'").select(F.col("id").alias("source"), before_last_dot("label").alias("own"))
    calls = graph.edges.where("relation = 'calls' and call_context is not null").join(callers, "source").join(index.classes.select(F.col("label").alias("own"), "imports", "namespace"), "own")
    ctx = F.col("call_context")
    prop = F.regexp_extract(ctx, r"^\$this->(\w+)$", 1)
    typed = calls.withColumn("prop", prop).join(index.props.withColumnRenamed("label", "own"), ["own", "prop"], "left")
    name = F.when(F.col("prop") != "", F.col("prop_type")).when(~ctx.startswith("$"), ctx)
    full = resolve_short_name(name, F.col("imports"), F.col("namespace"))
    named = typed.withColumn("name", name).where("name is not null").withColumn("short", last_segment(full))
    known = index.classes.select(F.col("label").alias("hit"))
    direct = named.join(known, F.col("name") == F.col("hit"), "left").withColumnRenamed("hit", "direct").join(known, F.col("short") == F.col("hit"), "left")
    method = F.element_at(F.split(F.coalesce(F.col("callee"), F.lit("")), r"\."), -1)
    callee = graph.nodes.select(F.col("id").alias("target"), F.col("label").alias("callee"))
    aimed = direct.withColumn("cls", F.coalesce("direct", "hit")).where("cls is not null").join(callee, "target", "left").withColumn("wanted", F.concat("cls", F.lit("."), method)).where(method != "")
    methods = first_by(graph.nodes.where("type = 'method'"), [F.col("label")], [F.desc("ord")]).select(F.col("label").alias("wanted"), F.col("id").alias("found"))
    # Fixed format of a placeholder's id.
    made_id = F.regexp_replace("wanted", r"[^a-zA-Z0-9_$.]", "_")
    moved = aimed.join(methods, "wanted", "left").select("ord", "wanted", "cls", F.coalesce("found", made_id).alias("new_target"), "found")
    top = graph.nodes.agg(F.coalesce(F.max("ord"), F.lit(-1))).first()[0]
    made = moved.where("found is null").groupBy(F.col("new_target").alias("id")).agg(F.min("ord").alias("o"), F.min_by("wanted", "ord").alias("label"), F.min_by("cls", "ord").alias("cls")).join(graph.nodes.select("id"), "id", "left_anti")
    fresh = made.join(index.classes.select(F.col("label").alias("cls"), "file"), "cls").select("id", "label", F.lit("method").alias("type"), F.col("file").alias("source_file"), F.lit(None).cast("string").alias("source_location"), F.lit(None).cast("string").alias("description"), "o")
    # After all nodes, in the order of the edges that made them.
    fresh = fresh.withColumn("ord", (F.lit(top + 1) + F.col("o")).cast("long")).drop("o")
    edges = graph.edges.join(moved.select("ord", "new_target"), "ord", "left").withColumn("target", F.coalesce("new_target", "target")).drop("new_target")
    return Graph(graph.nodes.unionByName(fresh, allowMissingColumns=True), edges.select(graph.edges.columns), graph.directed)


def link_routes(routes: DataFrame, nodes: DataFrame, prefix: str = "") -> tuple[DataFrame, DataFrame]:
    """Route and controller nodes and their edges. routes: method, uri, name, action, middleware, ord.

    HEAD routes, closures and uris that begin with an underscore are left out; ids count the others from 1.
    Labels, ids, locations and descriptions are of a fixed format. An action of other than two parts around
    an @ links nothing."""
    kept = routes.where(~F.coalesce(F.col("method") == "HEAD", F.lit(False)) & ~F.coalesce(F.startswith("uri", F.lit("_")), F.lit(False)) & ~F.coalesce(F.col("action") == "Closure", F.lit(False)))
    rows = dense_rank(kept, "ord", "n").withColumn("label", F.concat(F.coalesce("method", F.lit("")), F.lit(" /"), F.coalesce("uri", F.lit(""))))
    rows = rows.withColumn("id", F.concat(F.lit(f"{prefix}route_"), F.col("n").cast("string"), F.lit("_"), F.regexp_replace("label", "[^a-zA-Z0-9_]", "_")))
    text, none = lambda c: F.lit(c).cast("string"), lambda t: F.lit(None).cast(t)
    where = F.when(F.coalesce("name", F.lit("")) != "", F.concat(F.lit("name: "), "name"))
    about = F.when(F.coalesce(F.size("middleware"), F.lit(0)) > 0, F.concat(F.lit("middleware: "), F.array_join("middleware", ", ")))
    made = rows.select("id", "label", text("route").alias("type"), text(f"{prefix}routes").alias("source_file"), where.alias("source_location"), about.alias("description"), (2 * F.col("n")).cast("long").alias("ord"))
    parts = rows.withColumn("parts", F.split("action", "@", -1)).where("size(parts) = 2").withColumn("cls", last_segment(F.col("parts")[0])).withColumn("m", F.col("parts")[1])
    controller = F.concat(F.lit(f"{prefix}route_controller_"), F.col("cls"))
    owners = parts.groupBy(controller.alias("id"), F.col("cls").alias("label")).agg((2 * F.min("n") + 1).cast("long").alias("ord")).select("id", "label", text("controller").alias("type"), text(f"{prefix}routes").alias("source_file"), none("string").alias("source_location"), none("string").alias("description"), "ord")
    methods = first_by(nodes.where("type = 'method'"), [F.col("label")], [F.desc("ord")]).select(F.col("label").alias("wanted"), F.col("id").alias("target"))
    link = lambda target, ord: (F.col("id").alias("source"), target, text("references").alias("relation"), text("EXTRACTED").alias("confidence"), none("double").alias("confidence_score"), none("string").alias("call_context"), ord.cast("long").alias("ord"))
    hit = parts.withColumn("wanted", F.concat("cls", F.lit("."), "m")).join(methods, "wanted").select(*link(F.col("target"), 2 * F.col("n")))
    always = parts.select(*link(controller.alias("target"), 2 * F.col("n") + 1))
    return made.unionByName(owners), hit.unionByName(always)
