"""Full-text search with BM25 over an inverted index of node fields.

The index is a table of postings (doc, field, pos, term). Stemming runs once for each distinct raw
token, in Arrow batches, and comes back by a join.
Queries: implicit AND, OR, NOT, "phrases", prefix*, field:, ^ for a field's start, NEAR(a b, n), parentheses.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.porter import stem

FIELDS = ("id", "label", "type", "file", "description")


@dataclass
class TextIndex:
    docs: DataFrame
    postings: DataFrame

    @classmethod
    def build(cls, nodes: DataFrame) -> TextIndex:
        columns = {"file": "source_file"}
        values = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(columns.get(f, f)).cast("string"), F.lit("")).alias("text")) for f in FIELDS]))
        rows = nodes.select(F.col("id").alias("doc"), "ord", values.alias("v")).select("doc", "v.field", F.filter(F.split(F.lower("v.text"), r"[^\p{L}\p{N}\p{M}\p{Co}]+"), lambda t: t != "").alias("tokens"))
        raw = rows.select("doc", "field", F.posexplode("tokens").alias("pos", "raw"))
        terms = stems(raw.select("raw").distinct())
        postings = raw.join(terms, "raw").select("doc", "field", "pos", "raw", "term")
        sizes = postings.groupBy("doc").agg(F.count(F.lit(1)).alias("size"))
        docs = nodes.select(F.col("id").alias("doc"), "label", "type", F.col("source_file").alias("file"), "description", "ord").join(sizes, "doc", "left").withColumn("size", F.coalesce("size", F.lit(0)))
        return cls(docs, postings)

    def save(self, path: str) -> None:
        self.docs.write.mode("overwrite").parquet(f"{path}/docs")
        self.postings.write.mode("overwrite").parquet(f"{path}/postings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TextIndex:
        return cls(spark.read.parquet(f"{path}/docs"), spark.read.parquet(f"{path}/postings"))

    def search(self, query: str, limit: int = 20) -> DataFrame:
        """doc, label, type, file, description, rank; the smallest rank (minus BM25) first."""
        tree = parse(query)
        phrases: list[Phrase] = []
        wanted = self._docs_of(tree, phrases)
        n, avg = self.docs.agg(F.count(F.lit(1)), F.avg("size")).first()
        total = F.lit(0.0)
        scored = self.docs.join(wanted, "doc", "left_semi")
        for i, p in enumerate(phrases):
            hits = self._hits(p)
            # One number a phrase.
            df = hits.select("doc").distinct().count()
            idf = max(1e-6, float(_ln((n - df + 0.5) / (df + 0.5))))
            tf = hits.groupBy("doc").agg(F.count(F.lit(1)).alias(f"f{i}"))
            scored = scored.join(tf, "doc", "left").withColumn(f"f{i}", F.coalesce(f"f{i}", F.lit(0)))
            f = F.col(f"f{i}")
            total = total + F.lit(idf) * (f * 2.2) / (f + 1.2 * (0.25 + 0.75 * F.col("size") / F.lit(avg)))
        return scored.withColumn("rank", -total).orderBy("rank", "ord").limit(limit).drop("size", "ord", *[f"f{i}" for i in range(len(phrases))])

    def _hits(self, p: Phrase) -> DataFrame:
        """doc, field, pos where a phrase begins."""
        at = self.postings if p.field is None else self.postings.where(F.col("field") == p.field)
        out = None
        for k, (word, prefix) in enumerate(p.words):
            match = F.col("term").startswith(word) if prefix else F.col("term") == stem(word)
            one = at.where(match).select("doc", "field", (F.col("pos") - k).alias("pos")).distinct()
            out = one if out is None else out.join(one, ["doc", "field", "pos"], "left_semi")
        return out.where("pos = 0") if p.start else out

    def _docs_of(self, node: tuple, phrases: list[Phrase]) -> DataFrame:
        kind = node[0]
        if kind == "phrase":
            phrases.append(node[1])
            return self._hits(node[1]).select("doc").distinct()
        if kind == "near":
            _, parts, gap = node
            phrases.extend(parts)
            out = self._hits(parts[0]).select("doc", "field", F.col("pos").alias("lo"), (F.col("pos") + len(parts[0].words)).alias("hi"))
            for p in parts[1:]:
                other = self._hits(p).select("doc", "field", "pos")
                out = out.join(other, ["doc", "field"]).select("doc", "field", F.least("lo", "pos").alias("lo"), F.greatest("hi", F.col("pos") + len(p.words)).alias("hi")).where(F.col("hi") - F.col("lo") <= gap + sum(len(x.words) for x in parts)).distinct()
            return out.select("doc").distinct()
        if kind == "not":
            left = self._docs_of(node[1], phrases)
            return left.join(self._docs_of(node[2], []), "doc", "left_anti")
        left, right = self._docs_of(node[1], phrases), self._docs_of(node[2], phrases)
        return left.join(right, "doc", "left_semi") if kind == "and" else left.unionByName(right).distinct()


def _ln(x: float) -> float:
    import math

    return math.log(x) if x > 0 else float("-inf")


def stems(raw: DataFrame) -> DataFrame:
    """raw (distinct tokens) with term: without diacritics, stemmed."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"raw": part["raw"], "term": [stem(plain(t)) for t in part["raw"]]})

    return raw.mapInPandas(run, "raw string, term string")


def plain(token: str) -> str:
    import unicodedata

    return "".join(c for c in unicodedata.normalize("NFD", token) if not unicodedata.combining(c))


@dataclass(frozen=True)
class Phrase:
    words: tuple[tuple[str, bool], ...]
    field: str | None = None
    start: bool = False


_TOKEN = re.compile(r'\s*("(?:[^"]|"")*"\s*\*?|[()^:,+]|[^\s()^:,"+*]+\*?|\*)')


def parse(query: str) -> tuple:
    """A query's tree; raises ValueError where it is malformed."""
    tokens, at = [], 0
    text = query.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"malformed search: {text[at:]!r}")
        tokens.append(m[1])
        at = m.end()
    pos = 0

    def peek() -> str | None:
        return tokens[pos] if pos < len(tokens) else None

    def take(want: str | None = None) -> str:
        nonlocal pos
        t = peek()
        if t is None or (want and t != want):
            raise ValueError(f"malformed search near {t!r}")
        pos += 1
        return t

    def either() -> tuple:
        left = both()
        while peek() == "OR":
            take()
            left = ("or", left, both())
        return left

    def both() -> tuple:
        left = minus()
        while peek() not in (None, ")", "OR"):
            if peek() == "AND":
                take()
            left = ("and", left, minus())
        return left

    def minus() -> tuple:
        left = atom(None)
        while peek() == "NOT":
            take()
            left = ("not", left, atom(None))
        return left

    def words(t: str) -> tuple[tuple[str, bool], ...]:
        prefix = t.rstrip().endswith("*")
        body = t.rstrip().rstrip("*").strip()
        body = body[1:-1].replace('""', '"') if body.startswith('"') else body
        found = [plain(w) for w in re.findall(r"[^\W_]+", body.lower())]
        if not found:
            raise ValueError(f"nothing to search in {t!r}")
        return tuple((w, prefix and i == len(found) - 1) for i, w in enumerate(found))

    def phrase(field: str | None, start: bool) -> tuple:
        got = words(take())
        while peek() == "+":
            take()
            got += words(take())
        return ("phrase", Phrase(got, field, start))

    def atom(field: str | None) -> tuple:
        t = peek()
        if t == "(":
            take()
            inner = either()
            take(")")
            return inner
        if t == "^":
            take()
            return phrase(field, True)
        if t == "NEAR" and pos + 1 < len(tokens) and tokens[pos + 1] == "(":
            take(), take()
            parts, gap = [], 10
            while peek() not in (")", ",", None):
                parts.append(phrase(field, False)[1])
            if peek() == ",":
                take()
                gap = int(take())
            take(")")
            return ("near", parts, gap)
        if t in FIELDS and pos + 1 < len(tokens) and tokens[pos + 1] == ":":
            take(), take()
            return atom(t)
        if t in (None, ")", ":", ",", "+", "*", "AND", "OR", "NOT"):
            raise ValueError(f"malformed search near {t!r}")
        return phrase(field, False)

    tree = either()
    if pos != len(tokens):
        raise ValueError(f"malformed search near {peek()!r}")
    return tree
