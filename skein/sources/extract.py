"""Entities and relations of source files: a table function from files to nodes and edges.

Python is read with its own parser; other languages with a scanner that blanks comments and strings,
pairs brackets and matches declarations per language. Bash functions and JSON keys need no scanner and
are plain Column expressions (``bash_functions``, ``json_keys``).
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.text import node_id
from skein.operators.graph import EDGE_SCHEMA, NODE_SCHEMA, first_by
from skein.operators.iterate import dense_rank
from skein.sources.files import MOST_BYTES

_ITEM = "array<struct<id:string,label:string,type:string,source_file:string,source_location:string,description:string>>"
_LINK = "array<struct<source:string,target:string,relation:string,confidence:string,confidence_score:double,call_context:string>>"
EXTRACTED_SCHEMA = f"file string, nodes {_ITEM}, edges {_LINK}"


def make_id(file: str, name: str) -> str:
    return re.sub(r"\.[^.]+\Z", "", re.sub(r"[\\/]", "_", file)) + "_" + re.sub(r"[^a-zA-Z0-9_$]", "_", name)


@dataclass
class Found:
    """What one file holds; ids are added once, and each hangs off the file node."""

    file: str
    nodes: dict[str, tuple] = field(default_factory=dict)
    edges: list[tuple] = field(default_factory=list)

    def __post_init__(self):
        self.root = make_id(self.file, "file")
        self.nodes[self.root] = (self.root, self.file, "file", self.file, None, None)

    def add(self, name: str, kind: str, line: int, about: str | None = None, label: str | None = None) -> str:
        i = make_id(self.file, name)
        if i not in self.nodes:
            self.nodes[i] = (i, label or name, kind, self.file, f"L{line}", about[:200] if about else None)
        self.link(self.root, i, "contains")
        return i

    def stand_in(self, name: str, kind: str) -> str:
        """The id of a name that is used but may be declared elsewhere; without a place or a link of its own."""
        i = make_id(self.file, name)
        self.nodes.setdefault(i, (i, name, kind, self.file, None, None))
        return i

    def link(self, source: str, target: str, relation: str, inferred: float | None = None, context: str | None = None) -> None:
        self.edges.append((source, target, relation, "INFERRED" if inferred else "EXTRACTED", inferred, context))

    def calls(self, source: str, names: list[tuple[str, str | None]]) -> None:
        for name, context in names:
            self.link(source, make_id(self.file, name), "calls", 0.85, context)


def blanked(text: str, hashes: bool) -> str:
    """text with comments and string contents as spaces; positions and line breaks stay."""
    marks = r"/\*.*?\*/|//[^\n]*" + (r"|\#[^\n]*" if hashes else "") + r"|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`"
    return re.sub(marks, lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)


def block_after(code: str, at: int) -> tuple[int, int]:
    """The braces that open first after ``at``, before any semicolon; (at, at) without."""
    m = re.compile(r"[{;]").search(code, at)
    if not m or m[0] == ";":
        return at, at
    depth = 0
    for b in re.compile(r"[{}]").finditer(code, m.start()):
        depth += 1 if b[0] == "{" else -1
        if not depth:
            return m.start(), b.end()
    return m.start(), len(code)


_CALL = re.compile(r"(?<![\w$.>:])([A-Za-z_$][\w$]*)\s*\(")
#: Words before a bracket that are no calls.
NO_CALLS = frozenset("if for while switch catch return function fn match elseif sizeof typeof new super await yield throw do else case def class func print echo isset empty array list unset exit die include require use and or not in is instanceof".split())


def names_called(code: str, start: int, end: int) -> list[tuple[str, str | None]]:
    seen = dict.fromkeys(m[1] for m in _CALL.finditer(code, start, end) if m[1] not in NO_CALLS)
    return [(n, None) for n in seen]


@dataclass(frozen=True)
class Dialect:
    functions: str
    types: str
    imports: str = ""
    hashes: bool = False
    methods: str = ""


_JS = Dialect(
    functions=r"(?:^|[\s;{}])(?:async\s+)?function\s*\*?\s*(?P<n>[\w$]+)\s*\(|(?:^|[\s;{}])(?:const|let|var)\s+(?P<a>[\w$]+)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\([^()]*\)|[\w$]+)\s*(?::\s*[\w<>\[\]., |]+)?\s*=>",
    types=r"(?:^|[\s;{}])(?P<k>class|interface|type|enum)\s+(?P<n>[A-Za-z_$][\w$]*)(?P<h>[^{;=\n]*)",
    methods=r"(?:^|\n)[ \t]+(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*(?P<n>[\w$]+)\s*(?:<[^>\n]*>)?\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::\s*[^{;\n]+)?\{",
)
DIALECTS = {
    "javascript": _JS,
    "typescript": _JS,
    "tsx": _JS,
    "go": Dialect(functions=r"(?:^|\n)func\s+(?P<n>\w+)\s*(?:\[[^\]]*\])?\(", types=r"(?:^|\n)type\s+(?P<n>\w+)\s+(?P<k>struct|interface|\w+)(?P<h>)", methods=r"(?:^|\n)func\s+\(\s*\w*\s*\*?(?P<r>\w+)(?:\[[^\]]*\])?\s*\)\s*(?P<n>\w+)\s*\("),
    "java": Dialect(functions=r"\n[ \t]*(?:(?:public|private|protected|static|final|abstract|synchronized|default)\s+)+(?:<[^>]+>\s*)?[\w<>\[\], .?]+\s+(?P<n>\w+)\s*\(", types=r"(?:^|[\s;{}])(?P<k>class|interface|enum|record)\s+(?P<n>\w+)(?P<h>[^{;]*)", imports=r"(?:^|\n)\s*import\s+(?:static\s+)?([\w.]+)"),
    "kotlin": Dialect(functions=r"(?:^|[\s;{}])fun\s+(?:<[^>]+>\s*)?(?:[\w.]+\.)?(?P<n>\w+)\s*\(", types=r"(?:^|[\s;{}])(?P<k>class|interface|object)\s+(?P<n>\w+)(?P<h>[^{;\n]*)", imports=r"(?:^|\n)\s*import\s+([\w.]+)"),
    "scala": Dialect(functions=r"(?:^|[\s;{}])def\s+(?P<n>\w+)", types=r"(?:^|[\s;{}])(?P<k>class|trait|object|enum)\s+(?P<n>\w+)(?P<h>[^{;\n]*)", imports=r"(?:^|\n)\s*import\s+([\w.]+)"),
    "rust": Dialect(functions=r"(?:^|[\s;{}])fn\s+(?P<n>\w+)", types=r"(?:^|[\s;{}])(?P<k>struct|enum|trait)\s+(?P<n>\w+)(?P<h>)", imports=r"(?:^|\n)\s*(?:pub\s+)?use\s+([\w:]+)"),
    "cpp": Dialect(functions=r"(?:^|\n)[ \t]*(?:[\w:<>,*&~]+[ \t]+)+[*&]*(?P<n>[\w:~]+)\s*\([^;{}]*\)\s*(?:const\s*)?(?:noexcept\s*)?(?=\{)", types=r"(?:^|[\s;{}])(?P<k>class|struct|enum)\s+(?P<n>\w+)(?P<h>[^{;()]*)(?=\{)", imports=r"(?:^|\n)\s*#\s*include\s*[<\"]([^>\"\n]+)"),
    "ruby": Dialect(functions=r"(?:^|\n)[ \t]*def\s+(?:self\.)?(?P<n>\w+[?!]?)", types=r"(?:^|\n)[ \t]*(?P<k>class|module)\s+(?P<n>\w+)(?P<h>[^\n]*)", imports=r"(?:^|\n)\s*require(?:_relative)?\s+['\"]([^'\"]+)", hashes=True),
    "php": Dialect(functions=r"(?:^|[\s;{}])function\s+&?(?P<n>\w+)\s*\(", types=r"(?:^|[\s;{}])(?P<k>class|interface|trait|enum)\s+(?P<n>[A-Z_a-z]\w*)(?P<h>[^{;]*)", hashes=True),
}


def _line(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


def _about(text: str, at: int) -> str | None:
    m = re.search(r"/\*\*((?:(?!\*/).)*)\*/\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?\Z", text[:at].rstrip() + "\n", re.S)
    return " ".join(re.sub(r"(?m)^\s*\*?", "", m[1]).split()) or None if m else None


def _heritage(found: Found, i: str, text: str) -> None:
    extends = re.search(r"(?:\bextends|:|<)\s*([\w$\\.]+)", text)
    if extends:
        found.link(i, make_id(found.file, extends[1].rsplit("\\", 1)[-1]), "inherits")
    implements = re.search(r"\bimplements\s+([\w$\\., ]+)", text)
    for name in re.findall(r"[\w$\\]+", implements[1]) if implements else []:
        found.link(i, make_id(found.file, name.rsplit("\\", 1)[-1]), "implements")


def scanned(file: str, text: str, lang: str) -> Found:
    found, d = Found(file), DIALECTS[lang]
    code = blanked(text, d.hashes)
    inside: list[tuple[int, int, str, str]] = []
    parents: list[tuple[str, str]] = []
    for m in re.finditer(d.types, code):
        at = m.start("n")
        kind = {"module": "class", "record": "class", "type": "type"}.get(m["k"], m["k"] if m["k"] in ("class", "interface", "struct", "enum", "trait", "object") else "type")
        i = found.add(m["n"], kind, _line(code, at), _about(text, m.start("k")))
        if lang != "php":
            _heritage(found, i, m["h"])
        else:
            parents.append((i, m["h"]))
        a, b = block_after(code, m.end())
        if b > a and kind != "type":
            inside.append((a, b, i, m["n"]))
    own = lambda at: next(((i, n) for a, b, i, n in reversed(inside) if a < at < b), None)
    if lang in ("javascript", "typescript", "tsx"):
        for a, b, i, cls in inside:
            for m in re.finditer(d.methods, code[a:b]):
                if m["n"] not in NO_CALLS:
                    j = found.add(f"{cls}.{m['n']}", "method", _line(code, a + m.start("n")))
                    found.link(i, j, "contains")
        for m in re.finditer(r"import\s+[^'\";]*?from\s*['\"](\.[^'\"]+)['\"]|import\s*['\"](\.[^'\"]+)['\"]|require\(\s*['\"](\.[^'\"]+)['\"]", text):
            found.link(found.root, f"module:{m[1] or m[2] or m[3]}", "imports")
    if lang == "go":
        for m in re.finditer(d.methods, code):
            found.add(f"{m['r']}.{m['n']}", "method", _line(code, m.start("n")))
        for m in re.finditer(r"import\s*\(([^)]*)\)|import\s+(?:\w+\s+)?(\"[^\"]+\")", text):
            for name in re.findall(r"\"([^\"]+)\"", m[1] or m[2]):
                found.link(found.root, name, "imports")
    if lang == "php":
        m = re.search(r"(?:^|\n)\s*(?:<\?php\s+)?namespace\s+([\w\\]+)", code)
        space = m[1] if m else ""
        if m:
            found.add(space, "namespace", _line(code, m.start(1)))
        imports = php_imports(code, [(a, b) for a, b, *_ in inside])
        for full in imports.values():
            found.link(found.root, found.stand_in(full, "namespace"), "imports")
        full_name = lambda short: imports.get(short) or (f"{space}\\{short}" if space else short)
        for i, heads in parents:
            for word, kind, relation in (("extends", "class", "inherits"), ("implements", "interface", "implements")):
                m = re.search(rf"\b{word}\s+([\w\\, \t\r\n]+?)(?=\bimplements\b|\Z)", heads)
                for name in re.findall(r"[\w\\]+", m[1]) if m else []:
                    found.link(i, found.stand_in(full_name(name.rsplit("\\", 1)[-1]), kind), relation)
        for a, b, i, cls in inside:
            for p in re.finditer(r"(?:public|protected|private)\s+(?:readonly\s+)?(?:static\s+)?(?:\??[\w\\|]+\s+)?\$(\w+)", code[a:b]):
                found.add(f"{cls}.{p[1]}", "property", _line(code, a + p.start(1)))
    called: list[tuple[str, list[tuple[str, str | None]]]] = []
    for m in re.finditer(d.functions, code):
        name = m["n"] or m.groupdict().get("a")
        at = m.start("n") if m["n"] else m.start("a")
        holder = own(at)
        if lang in ("javascript", "typescript", "tsx") and holder:
            continue
        if lang == "php" and holder:
            i = found.add(f"{holder[1]}.{name}", "method", _line(code, at))
            found.link(holder[0], i, "contains")
        else:
            i = found.add(name, "function", _line(code, at), _about(text, m.start()))
        a, b = block_after(code, m.end())
        calls = names_called(code, a, b)
        if lang == "php":
            # A receiver is a variable, a chain of its properties, or a class, which counts by its short name.
            used = ((r[1] or r[2].rsplit("\\", 1)[-1], r[3]) for r in re.finditer(r"(?:(\$\w+(?:->\w+)*)->|(?<![\w$\\>])([\w\\]+)::)(\w+)\s*\(", code[a:b]))
            calls += [(n, c) for c, n in dict.fromkeys(used) if c not in ("parent", "self", "static")]
            called.append((i, calls))
        else:
            found.calls(i, calls)
    for i, calls in called:
        # What is called may be declared elsewhere; without a node of its own the edge would have no end.
        for name, _ in calls:
            found.stand_in(name, "call")
        found.calls(i, calls)
    for m in re.finditer(d.imports, text) if d.imports else ():
        found.link(found.root, m[1], "imports")
    return found


def php_imports(code: str, inside: list[tuple[int, int]]) -> dict[str, str]:
    """alias -> full name of a file's use statements; those within braces of types name traits."""
    out: dict[str, str] = {}
    for m in re.finditer(r"(?:^|[;{}\n])\s*use\s+(?:function\s+|const\s+)?([\w\\][^;]*);", code):
        if any(a < m.start(1) < b for a, b in inside):
            continue
        head, _, group = m[1].partition("{")
        for part in group.rstrip("} \t\r\n").split(",") if group else head.split(","):
            name, _, alias = (x.strip() for x in f"{head if group else ''}{part.strip()}".partition(" as "))
            if re.fullmatch(r"[\w\\]+", name):
                out[alias or name.rsplit("\\", 1)[-1]] = name.lstrip("\\")
    return out


def python_file(file: str, text: str) -> Found:
    found = Found(file)
    for node in ast.parse(text).body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            i = found.add(node.name, "function", node.lineno, ast.get_docstring(node))
            found.calls(i, [(n, None) for n in dict.fromkeys(c.func.id for c in ast.walk(node) if isinstance(c, ast.Call) and isinstance(c.func, ast.Name))])
        elif isinstance(node, ast.ClassDef):
            i = found.add(node.name, "class", node.lineno, ast.get_docstring(node))
            for base in node.bases:
                if isinstance(base, (ast.Name, ast.Attribute)):
                    found.link(i, make_id(file, ast.unparse(base)), "inherits")
            for f in node.body:
                if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    found.link(i, found.add(f"{node.name}.{f.name}", "method", f.lineno, ast.get_docstring(f)), "contains")
        elif isinstance(node, ast.Import):
            for a in node.names:
                found.link(found.root, a.name, "imports")
        elif isinstance(node, ast.ImportFrom):
            found.link(found.root, "." * node.level + (node.module or ""), "imports")
    return found


def extract_file(file: str, text: str, lang: str) -> Found | None:
    """None for files beyond the size limit and those that don't parse."""
    if len(text.encode()) > MOST_BYTES:
        return None
    if lang == "python":
        try:
            return python_file(file, text)
        except (SyntaxError, ValueError):
            return None
    if lang == "vue":
        m = re.search(r"<script([^>]*)>(.*?)</script>", text, re.S)
        return scanned(file, m[2].strip() if m else "", "typescript" if m and 'lang="ts"' in m[1] else "javascript")
    if lang == "bash":
        found = Found(file)
        for m in re.finditer(r"(?m)^(?:function\s+)?(\w+)\s*\(\s*\)", text):
            found.add(m[1], "function", _line(text, m.start()))
        return found
    if lang == "json":
        import json

        found = Found(file)
        try:
            top = json.loads(text)
        except ValueError:
            return None
        keys = list(top) if isinstance(top, dict) else []
        whole = sorted((k for k in keys if re.fullmatch(r"0|[1-9]\d{0,9}", k)), key=int)
        for k in [*whole, *(k for k in keys if k not in set(whole))][:20]:
            found.add(k, "field", 1)
        return found
    return scanned(file, text, lang)


def extract_files(files: DataFrame) -> DataFrame:
    """files (path, lang, content) -> file, nodes, edges; one row a file, files apart from each other."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, lang, content in zip(part["path"], part["lang"], part["content"]):
                text = bytes(content).decode("utf-8", "replace") if not isinstance(content, str) else content
                got = extract_file(path, text, lang)
                names = ("id", "label", "type", "source_file", "source_location", "description")
                links = ("source", "target", "relation", "confidence", "confidence_score", "call_context")
                rows.append((path, [dict(zip(names, n)) for n in got.nodes.values()] if got else [], [dict(zip(links, e)) for e in got.edges] if got else []))
            yield pd.DataFrame(rows, columns=["file", "nodes", "edges"])

    return files.select("path", "lang", "content").mapInPandas(run, EXTRACTED_SCHEMA)


def as_tables(extracted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes and edges with their order (file, then place in it); the first node of an id counts. Relative
    module imports become edges to the file nodes they mean, or go."""
    # A dense order by file and place, counted by ranges.
    placed = lambda df: dense_rank(df, ["file", "p"], "ord").withColumn("ord", F.col("ord") - 1)
    numbered = placed(extracted.select("file", F.posexplode("nodes").alias("p", "n")).select("file", "p", "n.*"))
    first = first_by(numbered, [F.col("id")], [F.col("ord")]).select(*[c.split()[0] for c in NODE_SCHEMA.split(", ")])
    edges = placed(extracted.select("file", F.posexplode("edges").alias("p", "e")).select("file", "p", "e.*"))
    modules = edges.where("target like 'module:%'").select("ord", F.col("file").alias("importer"), F.expr("substring(target, 8)").alias("specifier"))
    from skein.sources.files import resolve_modules

    resolved = resolve_modules(modules, extracted.select(F.col("file").alias("path"))).where("resolved is not null").select("ord", node_id("resolved", F.lit("file")).alias("file_target"))
    fixed = edges.join(resolved, "ord", "left").withColumn("target", F.coalesce("file_target", "target")).where("target not like 'module:%'")
    return first, fixed.select(*[c.split()[0] for c in EDGE_SCHEMA.split(", ")])


def bash_functions(files: DataFrame) -> DataFrame:
    """file, name, line of shell functions, without Python."""
    lines = files.select(F.col("path").alias("file"), F.posexplode(F.split(F.col("content").cast("string"), "\n")).alias("p", "text"))
    return lines.withColumn("name", F.regexp_extract("text", r"^(?:function\s+)?(\w+)\s*\(\s*\)", 1)).where("name <> ''").select("file", "name", (F.col("p") + 1).alias("line"))


def json_keys(files: DataFrame, most: int = 20) -> DataFrame:
    """file, pos, key: the first top-level keys, integer-like ones first and ascending, without Python."""
    keys = F.json_object_keys(F.col("content").cast("string"))
    whole = lambda k: k.rlike(r"^(0|[1-9]\d{0,9})$")
    order = F.concat(F.transform(F.array_sort(F.transform(F.filter("keys", whole), lambda k: k.cast("long"))), lambda n: n.cast("string")), F.filter("keys", lambda k: ~whole(k)))
    return files.select(F.col("path").alias("file"), keys.alias("keys")).where("keys is not null").select("file", F.posexplode(F.slice(order, 1, most)).alias("pos", "key"))
