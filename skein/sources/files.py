"""Source trees as tables: listing, languages, projects, hashes, caches, freshness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.text import content_hash, extension

#: Folders that a scan leaves out, and the language of each extension.
IGNORED = ("node_modules", "vendor", ".git", ".pi", "dist", "build", ".next", ".cache", "__pycache__", "coverage", ".nyc_output", "graph-out", ".graphify", "storage", "test-results")
LANGUAGES = {
    ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".jsx": "javascript",
    ".ts": "typescript", ".mts": "typescript", ".cts": "typescript", ".tsx": "typescript",
    ".py": "python", ".pyi": "python",
    ".go": "go",
    ".sh": "bash", ".bash": "bash", ".zsh": "bash",
    ".json": "json",
    ".java": "java",
    ".rs": "rust",
    ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".hh": "cpp", ".hxx": "cpp",
    ".rb": "ruby",
    ".kt": "kotlin", ".kts": "kotlin",
    ".scala": "scala", ".sc": "scala",
    ".php": "php", ".phtml": "php",
    ".vue": "vue",
}
DOCUMENTS = (".md", ".mdx", ".txt", ".rst", ".yaml", ".yml", ".toml", ".xml", ".html", ".css", ".scss", ".less")
MOST_BYTES = 1_000_000
#: Suffixes tried on a module's path, then on its index file; a path that has one is tried as it is first.
MODULE_SUFFIXES = (".ts", ".js", ".tsx", ".jsx", ".mts", ".mjs", ".py", ".go")

ROUTE_SCHEMA = "method string, uri string, name string, action string, middleware array<string>"


def scan(spark: SparkSession, root: str, content: bool = True) -> DataFrame:
    """path (relative to root), ext, lang, size, mtime, content; dot files, ignored folders and unknown
    extensions left out. A missing root raises Spark's error for paths."""
    base = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    stem = base.split(":", 1)[-1].lstrip("/") if ":" in base else base.lstrip("/")
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", ""), "^" + _quoted(stem) + "/", "")
    rows = raw.withColumn("path", path).withColumn("parts", F.split("path", "/"))
    hidden = F.exists("parts", lambda p: p.startswith(".") | p.isin(list(IGNORED)))
    lang = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    named = rows.where(~hidden).withColumn("ext", extension("path")).withColumn("lang", F.try_element_at(lang, F.col("ext"))).where("lang is not null")
    columns = ["path", "ext", "lang", F.col("length").alias("size"), F.col("modificationTime").alias("mtime")]
    return named.select(*columns, *(["content"] if content else []))


def _quoted(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c not in "/_-" else c for c in text)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def project_marks(spark: SparkSession, root: str) -> DataFrame:
    """path of files that mark projects (of the root or of its folders) though a scan leaves them out."""
    place, base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, root.rstrip("/")
    store = place(base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = ["artisan"] if store.exists(place(f"{base}/artisan")) else []
    names += [f"{f.getPath().getParent().getName()}/artisan" for f in store.globStatus(place(f"{base}/*/artisan")) or []]
    return spark.createDataFrame([(n,) for n in names], "path string")


def with_hash(files: DataFrame) -> DataFrame:
    return files.withColumn("hash", content_hash("content"))


def projects(listing: DataFrame) -> DataFrame:
    """name, path of the root (empty) and of immediate folders that are projects of their own.
    listing: path of every file, relative."""
    parts = F.split("path", "/")
    rows = listing.select(F.when(F.size(parts) == 1, F.lit("")).otherwise(F.element_at(parts, 1)).alias("dir"), F.element_at(parts, -1).alias("file"), F.size(parts).alias("depth")).where("depth <= 2")
    has = lambda *names: F.max(F.col("file").isin(*names))
    seen = rows.groupBy("dir").agg(has("composer.json").alias("composer"), has("package.json").alias("package"), has("artisan").alias("artisan"), has("vite.config.js", "vite.config.ts").alias("vite"))
    fine = F.when(F.col("dir") == "", F.col("composer") | F.col("package")).otherwise((F.col("composer") & F.col("artisan")) | (F.col("package") & F.col("vite")))
    return seen.where(fine).select(F.when(F.col("dir") == "", F.lit("root")).otherwise(F.col("dir")).alias("name"), F.col("dir").alias("path"))


def read_routes(spark: SparkSession, path: str) -> DataFrame:
    """Route lists exported as JSON arrays; commands are never run."""
    rows = spark.read.schema(ROUTE_SCHEMA).option("multiLine", True).json(path)
    return rows.withColumn("ord", F.monotonically_increasing_id())


def split_by_cache(files: DataFrame, cache: DataFrame | None, force: bool = False) -> tuple[DataFrame | None, DataFrame]:
    """(cached rows whose hash still holds, files to extract)."""
    if cache is None or force:
        return None, files
    keys = [files["path"] == cache["file"], files["hash"] == cache["hash"]]
    return cache.join(files, keys, "left_semi"), files.join(cache, keys, "left_anti")


def is_stale(files: DataFrame, built_at) -> bool:
    """Whether any file changed after the graph was built; deletions don't show."""
    return not files.where(F.col("mtime") > F.lit(built_at)).isEmpty()


def module_candidates(specifier: F.Column, importer: F.Column) -> F.Column:
    """Paths that a relative import may mean, in the order they are tried."""
    folder = F.regexp_replace(importer, "[^/]*$", "")
    joined = F.concat(folder, F.regexp_replace(specifier, r"^\./", ""))
    up = F.aggregate(F.split(joined, "/"), F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.lit(0), F.size(acc) - 1))).when((p == ".") | (p == ""), acc).otherwise(F.concat(acc, F.array(p))))
    base = F.array_join(up, "/")
    whole = F.when(base.rlike("(" + "|".join("\\" + s for s in MODULE_SUFFIXES) + ")$"), base)
    return F.array(whole, *[F.concat(base, F.lit(s)) for s in MODULE_SUFFIXES], *[F.concat(base, F.lit(f"/index{s}")) for s in MODULE_SUFFIXES])


def resolve_modules(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports (ord, importer, specifier, ...) with ``resolved``: the first candidate that is a file. ord tells
    imports apart; a specifier that isn't relative means no file."""
    relative = imports.where(F.startswith("specifier", F.lit(".")))
    tried = relative.select("ord", F.posexplode(module_candidates(F.col("specifier"), F.col("importer"))).alias("_p", "path"))
    hits = tried.join(files.select("path").distinct(), "path").groupBy("ord").agg(F.min_by("path", "_p").alias("resolved"))
    return imports.join(hits, "ord", "left")
