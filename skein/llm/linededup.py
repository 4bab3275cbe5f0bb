"""Removes lines that repeat or nearly repeat an earlier line, by an exact set-similarity join.

All steps are DataFrame functions. A line's tokens are the distinct lower-cased words of the line.
Lines are ordered by (doc_id, text hash, line number), nulls first; a line goes if any earlier line has
a token set with Jaccard similarity of at least ``percent`` / 100. Lines without tokens stay.

1.  Lines that are equal up to case and kind of white space become one entry, known by two 64-bit
    hashes, with its earliest place and its words.
2.  Rarity: counts over 65,536 hash buckets of the words of all distinct lines, rounded to a byte each. Ordering tokens by
    (bucket's count, hash) is a total order that is the same for all lines, which is all the prefix
    filter needs to be exact; rarer tokens first makes it selective.
3.  Shortcut for crowds: every set is held against the earliest sets (of four parts) with the same rarest token,
    and with the same least or largest hash among its rarest tokens (two min-hashes). It settles most of a large
    group of near copies with a few candidates a set, so that the join below doesn't meet all pairs of such a group.
4.  Prefix join: |x| - ceil(t |x|) + 1 rarest tokens of each set; pairs must pass length and
    positional filters, and a parity sketch of 64 bits (256 for long lines) whose differing bits can't
    outnumber the tokens in which two sets differ.
5.  Candidates are read again as words, and the words' 64-bit hashes are intersected in full. Only two
    different words of one pair of lines with equal hashes could make a difference.
"""

from __future__ import annotations

import uuid
from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace

_BUCKETS = 1 << 16
#: Sets of so many tokens have a sketch of 256 bits too: all bits but those of the first word, which follows from b.
_LONG, _WIDE = 80, ("w1", "w2", "w3")
_FIRST = -(1 << 63)
_SPACES = ("\t", "\x0b", "\f", "\r")


def _longs(numbers: list[int]) -> F.Column:
    """One literal array, folded once. Numbers below 128 become shared objects, so that lookups stay in the cache."""
    return F.split(F.lit(" ".join(map(str, numbers))), " ").cast("array<bigint>")


def _plain(text: F.Column) -> F.Column:
    """With a space for every white-space character but line feeds."""
    spaced = text
    for c in _SPACES:
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    # To look for a character costs far less than to replace it.
    return F.when(reduce(or_, (F.contains(text, F.lit(c)) for c in _SPACES)), spaced).otherwise(text)


def _words(words: F.Column) -> F.Column:
    return F.array_remove(F.split(words, " ", -1), "")


def plain_lines(docs: DataFrame) -> DataFrame:
    """doc_id (null: the least long), th (hash of the text), line, words of every line with tokens."""
    text = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST)).alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    lines = text.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split(F.lower(_plain(F.col("text"))), "\n", -1)).alias("line", "words"))
    return lines.where(F.trim("words") != "")


def rarity(lines: DataFrame) -> list[int]:
    """A byte below 128 for each hash bucket, about 4 log2 of the words in it, over all distinct lines."""
    words = lines.select(F.explode(F.split("words", " ", -1)).alias("w")).where("w <> ''")
    counted = words.groupBy(F.xxhash64("w").bitwiseAND(F.lit(_BUCKETS - 1)).alias("k")).count().collect()
    counts = np.zeros(_BUCKETS)
    for k, n in counted:
        counts[k] = n
    return np.minimum(127, np.round(4 * np.log2(1 + counts))).astype(int).tolist()


def _pair_filter(percent: int, nx: str = "x.n", ny: str = "y.n") -> str:
    """Length filter and parity sketches for x and y; the wide one where both sets have it."""
    fewer, bits = f"{100 - percent} * ({nx} + {ny})", " + ".join(f"bit_count(x.{c} ^ y.{c})" for c in _WIDE)
    return f"""100 * least({nx}, {ny}) >= {percent} * greatest({nx}, {ny})
        and {100 + percent} * bit_count(x.b ^ y.b) <= {fewer}
        and (least({nx}, {ny}) < {_LONG} or {100 + percent} * (bit_count(x.b ^ x.w1 ^ x.w2 ^ x.w3 ^ y.b ^ y.w1 ^ y.w2 ^ y.w3) + {bits}) <= {fewer})"""


_KEY = ["h", "g"]
_PAIR = [f"{side}.{c} as {side}{c}" for side in "xy" for c in _KEY]


class SimilarLines:
    def __init__(self, docs: DataFrame, percent: int = 80, work: Workspace | None = None):
        self.spark, self.percent = docs.sparkSession, percent
        self.work = work or Workspace(self.spark, "lines")
        self.docs = docs
        self._tables: list[tuple[str, str]] = []

    def kept(self) -> DataFrame:
        """(doc_id, th, line) of all lines with tokens that stay."""
        w = self.work
        try:
            lines = self._bucketed(self._distinct(plain_lines(self.docs)))
            w.release()
            sets = self._bucketed(self._features(lines))
            w.release()
            settled = self._verified(self._crowd_pairs(sets), lines, "settled")
            # Tokens in two halves: only one half's rows are on disk at a time.
            halves = []
            for half in (0, 1):
                halves.append(w.table(self._prefix_pairs(sets, settled, half), "half"))
                w.release()
            found = self._verified(halves[0].unionByName(halves[1]).distinct(), lines, "found")
            for half in halves:
                w.drop(half)
            gone = settled.unionByName(found).distinct()
            kept = w.table(sets.select(*_KEY, "doc_id", "th", "line").join(gone.hint("shuffle_hash"), _KEY, "left_anti").select("doc_id", "th", "line"), "kept")
        finally:
            for name, folder in self._tables:
                self.spark.sql(f"drop table if exists {name}")
                w.clear(folder)
        w.drop(settled)
        w.drop(found)
        w.release()
        return kept

    def _bucketed(self, df: DataFrame) -> DataFrame:
        """df as a table bucketed by h and g, so that joins on them don't shuffle it again."""
        name, folder = f"skein_lines_{uuid.uuid4().hex}", self.work.folder("bucketed")
        self._tables.append((name, folder))
        buckets = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        # Hashes and whole lines hardly repeat: to look for their repeats costs more than it saves.
        df.write.bucketBy(buckets, *_KEY).option("path", folder).option("compression", "zstd").option("parquet.enable.dictionary", "false").format("parquet").saveAsTable(name)
        return self.spark.table(name)

    def _distinct(self, lines: DataFrame) -> DataFrame:
        """A row for each distinct line: h, g (two hashes), its words and its earliest place."""
        keyed = lines.select(F.xxhash64("words").alias("h"), F.xxhash64(F.lit(1), "words").alias("g"), F.struct("doc_id", "th", "line").alias("at"), "words")
        return keyed.groupBy(*_KEY).agg(F.min("at").alias("at"), F.first("words").alias("words")).select(*_KEY, "words", "at.doc_id", "at.th", "at.line")

    def _features(self, lines: DataFrame) -> DataFrame:
        """Number of tokens n, sketch b, prefix, and three crowd keys: its rarest token, and its tokens of least and largest hash."""
        levels = _longs(rarity(lines))
        # Each bucket's byte in place above a hash's 56 bits; the bucket is told by the hash's last bits.
        code = lambda h: F.shiftleft(F.get(levels, h.bitwiseAND(F.lit(_BUCKETS - 1))), 56).bitwiseOR(F.shiftrightunsigned(h, 8))
        place = ("doc_id", "th", "line")
        # A word is hashed once. What an empty word between two spaces gives is taken out of the hashes, not of the words.
        hashes = F.array_distinct(F.array_remove(F.transform(F.split("words", " ", -1), lambda w: F.xxhash64(w)), F.xxhash64(F.lit(""))))
        # Arrays that can't hold a null are sorted and compared as plain longs.
        coded = lines.select(*_KEY, *place, F.sort_array(F.transform(hashes, lambda h: F.coalesce(code(h), F.lit(0)))).alias("s"))
        bits = [1 << i if i < 63 else _FIRST for i in range(64)]
        parity = lambda table: F.aggregate("s", F.lit(0).cast("long"), lambda a, t: a.bitwiseXOR(F.get(_longs(table), t.bitwiseAND(F.lit(len(table) - 1)))))
        wide = [F.when(F.size("s") >= _LONG, parity([0] * 64 * k + bits + [0] * 64 * (3 - k))).otherwise(F.lit(0).cast("long")).alias(c) for k, c in enumerate(_WIDE, 1)]
        sets = coded.select(*_KEY, *place, F.size("s").alias("n"), parity(bits).alias("b"), *wide, F.slice("s", 1, F.size("s") - F.floor((self.percent * F.size("s") + 99) / 100).cast("int") + 1).alias("prefix"))
        hashed = sets.withColumn("m", F.transform("prefix", lambda t: t.bitwiseAND(F.lit((1 << 56) - 1))))
        return hashed.withColumns({"k0": F.get("m", F.lit(0)), "k1": F.array_min("m"), "k2": F.array_max("m")}).drop("m")

    def _crowd_pairs(self, sets: DataFrame) -> DataFrame:
        own = (*_KEY, "n", "b", *_WIDE)
        keyed = sets.select(F.explode(F.array_distinct(F.array("k0", "k1", "k2"))).alias("k"), *own, "doc_id", "th", "line")
        # Not one set for each key but the earliest of each of four parts of its sets.
        firsts = keyed.groupBy("k", F.col("h").bitwiseAND(F.lit(3)).alias("part")).agg(F.min(F.struct("doc_id", "th", "line", *own)).alias("y"), F.count(F.lit(1)).alias("m")).select("k", *(f"y.{c}" for c in own))
        # Written, so that both sides of the join come straight from a shuffle and a crowded key can be split.
        firsts = self.work.table(firsts, "firsts")
        pairs = keyed.select("k", *own).alias("x").join(firsts.alias("y"), F.expr(f"x.k = y.k and (x.h <> y.h or x.g <> y.g) and {_pair_filter(self.percent)}"))
        return pairs.selectExpr(*_PAIR).distinct()

    def _prefix_pairs(self, sets: DataFrame, settled: DataFrame, half: int) -> DataFrame:
        """Pairs, in no order, of sets that share a prefix token of a half; not of two that are settled."""
        flagged = sets.select(*_KEY, "n", "b", *_WIDE, "prefix").join(settled.withColumn("f", F.lit(1)).hint("shuffle_hash"), _KEY, "left")
        rows = flagged.select(F.posexplode("prefix").alias("p", "t"), *_KEY, (F.col("n") * 2 + F.coalesce("f", F.lit(0))).alias("nf"), "b", *_WIDE).where(F.col("t").bitwiseAND(F.lit(1)) == half)
        rows = rows.select("t", *_KEY, "b", *_WIDE, (F.col("nf").cast("long") * (1 << 24) + F.col("p")).alias("pack"))
        # No column is null, which tables don't tell: the join, which reads them for each pair, is spared its tests.
        rows = rows.select(*(F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in rows.columns))
        # Both sides read the same columns, so that the shuffle by token is made once; a test on one side
        # alone would give that side a shuffle of its own.
        nx, ny = "shiftright(x.pack, 25)", "shiftright(y.pack, 25)"
        cond = f"""x.t = y.t and (x.h > y.h or x.h = y.h and x.g > y.g) and (x.pack & y.pack & 16777216) = 0 and {_pair_filter(self.percent, nx, ny)}
            and {100 + self.percent} * least({nx} - (x.pack & 16777215), {ny} - (y.pack & 16777215)) >= {self.percent} * ({nx} + {ny})"""
        return rows.alias("x").join(rows.alias("y"), F.expr(cond)).selectExpr(*_PAIR).distinct()

    def _verified(self, pairs: DataFrame, lines: DataFrame, name: str) -> DataFrame:
        """h, g of the later one of each similar pair, by all their words (64-bit hashes of them)."""
        w = self.work
        pairs = w.table(pairs, f"{name}-pairs")
        w.release()
        ids = pairs.select(F.col("xh").alias("h"), F.col("xg").alias("g")).unionByName(pairs.select(F.col("yh").alias("h"), F.col("yg").alias("g"))).distinct()
        # Each line of any pair is cut into words once.
        tokens = F.array_distinct(F.transform(_words(F.col("words")), lambda x: F.xxhash64(x)))
        told = w.table(lines.join(ids.hint("shuffle_hash"), _KEY).select(*_KEY, F.struct("doc_id", "th", "line").alias("at"), tokens.alias("toks")), f"{name}-tokens")
        w.release()
        side = lambda c: told.select(F.col("h").alias(f"{c}h"), F.col("g").alias(f"{c}g"), F.col("toks").alias(f"{c}_toks"), F.col("at").alias(f"{c}_at"))
        both = pairs.join(side("x"), ["xh", "xg"]).join(side("y"), ["yh", "yg"])
        later = lambda c: F.when(F.col("y_at") < F.col("x_at"), F.col(f"x{c}")).otherwise(F.col(f"y{c}")).alias(c)
        sizes = both.select(later("h"), later("g"), F.size("x_toks").alias("nx"), F.size("y_toks").alias("ny"), F.size(F.array_intersect("x_toks", "y_toks")).alias("i"))
        # Grouped before the test, so that it isn't pushed down and the tokens compared twice.
        near = sizes.groupBy(*_KEY).agg(F.max(F.expr(f"100 * i >= {self.percent} * (nx + ny - i)")).alias("near")).where("near").select(*_KEY)
        near = w.table(near, name)
        w.drop(pairs)
        w.drop(told)
        w.release()
        return near


def _stay(docs: DataFrame, percent: int, work: Workspace | None) -> DataFrame:
    """k_id, k_th and ``stay``: the numbers of a text's lines with tokens that stay."""
    return SimilarLines(docs, percent, work).kept().groupBy(F.col("doc_id").alias("k_id"), F.col("th").alias("k_th")).agg(F.sort_array(F.collect_list("line")).alias("stay"))


def _keys() -> list[F.Column]:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST)).alias("k_id"), F.xxhash64(F.col("text").cast("string")).alias("k_th")]


def _told() -> F.Column:
    """Numbers of the lines with tokens in ``lines``."""
    return F.array_compact(F.transform("lines", lambda x, i: F.when(F.ltrim(x, F.lit(" " + "".join(_SPACES))) != "", i)))


def _or_none(stay: str) -> F.Column:
    return F.coalesce(F.col(stay), F.array().cast("array<int>"))


def line_report(docs: DataFrame, percent: int = 80, work: Workspace | None = None) -> DataFrame:
    """Per row: doc_id, n_lines, n_removed, removed_lines (their numbers from 0, comma-joined).

    A null text has no lines, an empty one has one; texts are read whole, however long. A null doc_id
    comes before all others. Of lines with equal words the first by (doc_id, text hash, number) stays.
    Rows that repeat both id and text get the same lines. An empty table gives no rows; other columns
    are not read."""
    lines = docs.select("doc_id", *_keys(), F.split(F.col("text").cast("string"), "\n", -1).alias("lines"))
    told = lines.select("doc_id", "k_id", "k_th", F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(_told(), F.array().cast("array<int>")).alias("told"))
    rows = told.join(_stay(docs, percent, work), ["k_id", "k_th"], "left")
    rows = rows.select("doc_id", "n_lines", F.array_except("told", _or_none("stay")).alias("gone"))
    return rows.select("doc_id", "n_lines", F.size("gone").cast("long").alias("n_removed"), F.array_join(F.col("gone").cast("array<string>"), ",").alias("removed_lines"))


def without_similar_lines(docs: DataFrame, percent: int = 80, work: Workspace | None = None) -> DataFrame:
    """docs with the lines that stay, in order; rows that lose all their lines with tokens go.

    Rows without tokens (null, empty or blank texts) stay as they are, and so do all other columns,
    whatever their names. What is said of line_report() holds here."""
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("own"), F.col("text").cast("string").alias("text"), *_keys())
    rows = whole.join(_stay(docs, percent, work), ["k_id", "k_th"], "left").select("own", _or_none("stay").alias("stay"), "text")
    rows = rows.select("own", "stay", "text", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("lines"))
    rows = rows.select("own", "stay", "text", _told().alias("told")).where((F.size("told") == 0) | (F.size("stay") > 0))
    lines = rows.select("own", "stay", "text", "told", F.split("text", "\n", -1).alias("lines"))
    left = F.sort_array(F.array_union("stay", F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "told")))
    text = F.when(F.size("told") == F.size("stay"), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n"))
    return lines.select("own", text.alias("text")).select(*(F.col("text") if c == "text" else F.col(f"own.`{c}`").alias(c) for c in docs.columns))
