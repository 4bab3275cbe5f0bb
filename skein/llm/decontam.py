"""Finds benchmark passages in training documents with an FM-index per shard of documents.

A task reads its documents and cuts them into shards of bounded size. A shard's text is the
sequence of its word numbers in the benchmark's vocabulary; a word outside of it ends a run, and
runs shorter than the shortest phrase can't hold one and are left out. Runs are joined by
separators, each smaller than all words and than every later separator. Over this text stand

    suffix array   prefix doubling in numpy; separators differ, so it ends within the longest run
    BWT            in a wavelet matrix, whose ranks answer backward search for all phrases at once
    samples        suffix positions at every 8th place and at every start of a run; the others walk
                   back to one of them by LF steps, which so never cross a separator

Occurrences become word spans of documents, and overlapping or touching spans are merged.
The benchmark reaches tasks by broadcast; a large one in slices of bounded size, a pass over the documents each.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .words import alnum_words, as_bytes, small_batches
from .workspace import Workspace

#: Bytes of benchmark texts in a slice, which one broadcast holds, and symbols of a shard.
SLICE_BYTES = 4 << 20
SHARD_WORDS = 2 << 20
_SAMPLE = 8


class WaveletMatrix:
    """Rank and access over a sequence of small integers, vectorised over queries."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bits = ((seq >> level) & 1).astype(np.uint8)
            packed = np.packbits(np.concatenate([bits, np.zeros(-len(bits) % 64 + 64, np.uint8)]), bitorder="little").view("<u8")
            self.words.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]))
            seq = np.concatenate([seq[bits == 0], seq[bits == 1]])
            self.zeros.append(int(len(bits) - bits.sum()))
        symbols = np.arange(sigma)
        self.start = self._walk(symbols, np.zeros(sigma, np.int64))

    def _ones(self, k: int, i: np.ndarray) -> np.ndarray:
        block, shift = i >> 6, (i & 63).astype(np.uint64)
        return self.counts[k][block] + np.bitwise_count(self.words[k][block] & ((np.uint64(1) << shift) - np.uint64(1)))

    def _walk(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            ones = self._ones(k, i)
            i = np.where((c >> (self.levels - 1 - k)) & 1, self.zeros[k] + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c stands before place i."""
        return self._walk(c, i) - self.start[c]

    def access_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at place i, and how often it stands before."""
        c = np.zeros(len(i), np.int64)
        for k in range(self.levels):
            block, shift = i >> 6, (i & 63).astype(np.uint64)
            bit = ((self.words[k][block] >> shift) & np.uint64(1)).astype(np.int64)
            ones = self._ones(k, i)
            i = np.where(bit, self.zeros[k] + ones, i - ones)
            c = 2 * c + bit
        return c, i - self.start[c]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """text: 0 separates runs and stands at the end."""
    n, sep = len(text), text == 0
    _, rank = np.unique(np.where(sep, np.cumsum(sep) - 1, int(sep.sum()) + text), return_inverse=True)
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        key = rank.astype(np.int64) * (n + 1) + after
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        step *= 2


class FMIndex:
    def __init__(self, text: np.ndarray, sigma: int):
        sa = suffix_array(text)
        self.n = len(text)
        bwt = text[sa - 1]
        self.tree = WaveletMatrix(bwt, sigma)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        before = text[sa - 1] == 0
        self.marked = before | (sa % _SAMPLE == 0) | (sa == 0)
        self.place = np.cumsum(self.marked) - 1
        self.samples = sa[self.marked]

    def search(self, phrases: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix-array ranges of phrases; the rows are right-aligned."""
        last = phrases[:, -1]
        lo, hi = self.first[last], self.first[last + 1]
        for k in range(2, phrases.shape[1] + 1):
            live = np.flatnonzero((sizes >= k) & (lo < hi))
            if not len(live):
                break
            c = phrases[live, -k]
            lo[live], hi[live] = self.first[c] + self.tree.rank(c, lo[live]), self.first[c] + self.tree.rank(c, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows."""
        out, todo, walked = np.zeros(len(rows), np.int64), np.arange(len(rows)), 0
        rows = rows.copy()
        while len(todo):
            done = self.marked[rows[todo]]
            at = todo[done]
            out[at] = self.samples[self.place[rows[at]]] + walked
            todo = todo[~done]
            c, rank = self.tree.access_rank(rows[todo])
            rows[todo] = self.first[c] + rank
            walked += 1
        return out


@dataclass
class Phrases:
    """A slice of the benchmark: its words, distinct phrases, and which items each phrase is of."""

    vocabulary: dict[bytes, int]
    rows: np.ndarray
    sizes: np.ndarray
    item_starts: np.ndarray
    items: np.ndarray
    names: list[str]

    @classmethod
    def of(cls, items: list[tuple[str, bytes]], window: int) -> Phrases:
        vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[int]] = {}
        names = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(names)}
        for name, text in items:
            ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in alnum_words(text)]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                owners.setdefault(tuple(ids[i : i + window]), set()).add(number[name])
        rows = np.zeros((len(owners), max(map(len, owners), default=1)), np.int64)
        for k, p in enumerate(owners):
            rows[k, rows.shape[1] - len(p) :] = p
        own = [sorted(x) for x in owners.values()]
        return cls(vocabulary, rows, np.array([len(p) for p in owners], np.int64), np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64), np.array([i for x in own for i in x], np.int64), names)


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, end to end."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def merge_spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unites overlapping and touching spans of each document; sorted."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    if not len(doc):
        return doc, start, end
    far = np.int64(1) << 40
    reach = np.maximum.accumulate(doc * far + end)
    new = np.concatenate([[True], doc[1:] * far + start[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(doc)]]) - 1
    return doc[first], start[first], reach[last] - doc[first] * far


def search_shard(words: list[list[bytes]], slices: list[Phrases]) -> list[tuple[list[tuple[int, int]], list[str]]]:
    """For each document of a shard: merged (start, end) word spans and the items found, as strings."""
    spans: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    found: list[set[str]] = [set() for _ in words]
    sizes = np.array([len(w) for w in words], np.int64)
    doc_of, place = np.repeat(np.arange(len(words)), sizes), _ragged(np.zeros(len(words), np.int64), sizes)
    for part in slices:
        if not len(part.sizes):
            continue
        get = part.vocabulary.get
        ids = np.fromiter((get(w, 0) for ws in words for w in ws), np.int64, len(doc_of))
        same = (ids[1:] > 0) & (ids[:-1] > 0) & (doc_of[1:] == doc_of[:-1])
        begins = np.flatnonzero((ids > 0) & np.concatenate([[True], ~same]) if len(ids) else np.zeros(0, bool))
        ends = np.flatnonzero((ids > 0) & np.concatenate([~same, [True]]) if len(ids) else np.zeros(0, bool)) + 1
        keep = ends - begins >= part.sizes.min()
        begins, ends = begins[keep], ends[keep]
        if not len(begins):
            continue
        # Each run's words and then one separator, written over the place after the run.
        source = _ragged(begins, ends - begins + 1)
        text = np.append(ids, 0)[source]
        text[np.cumsum(ends - begins + 1) - 1] = 0
        index = FMIndex(text, len(part.vocabulary) + 1)
        lo, hi = index.search(part.rows, part.sizes)
        hit = np.flatnonzero(lo < hi)
        if not len(hit):
            continue
        at = source[index.locate(_ragged(lo[hit], hi[hit] - lo[hit]))]
        phrase = np.repeat(hit, hi[hit] - lo[hit])
        spans.append((doc_of[at], place[at], place[at] + part.sizes[phrase]))
        pairs = np.unique(doc_of[at] * np.int64(len(part.sizes)) + phrase)
        docs, phrase = pairs // len(part.sizes), pairs % len(part.sizes)
        counts = part.item_starts[phrase + 1] - part.item_starts[phrase]
        for d, i in np.unique(np.stack([np.repeat(docs, counts), part.items[_ragged(part.item_starts[phrase], counts)]]), axis=1).T.tolist():
            found[d].add(part.names[i])
    out: list[tuple[list[tuple[int, int]], list[str]]] = [([], sorted(f)) for f in found]
    if spans:
        for d, a, b in zip(*(x.tolist() for x in merge_spans(*(np.concatenate(x) for x in zip(*spans))))):
            out[d][0].append((a, b))
    return out


def benchmark_slices(benchmark: DataFrame, window: int, id_col: str = "item_id", text_col: str = "text", slice_bytes: int = SLICE_BYTES) -> Iterator[tuple[Phrases, bool]]:
    """Phrases of one slice of the benchmark after another, and whether it's the last. Items are dealt to
    slices of about ``slice_bytes`` by a hash of their id, and the driver holds one slice at a time. Rows that
    share an id are one item; a null id is the item named by the empty string; items without words have no
    phrases."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"), F.col(text_col).cast("binary").alias("text")).where(F.length(text_col) > 0)
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + int(total) // slice_bytes
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("name"), F.lit(n)) == k)
        yield Phrases.of([(r.name, bytes(r.text)) for r in part.toLocalIterator()], window), k == n - 1


_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def cut_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """text without the words of each (start, end) span; a line break stands in for each."""
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return b"\n".join([*out, text[at:]])


_FOUND = "n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"


def find_passages(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, text_col: str = "text", item_col: str = "item_id", slice_bytes: int = SLICE_BYTES, cut: bool = False, work: Workspace | None = None) -> DataFrame:
    """Every row of docs with n_words, n_hit, items and spans; with ``cut``, spans are cut from the text.

    Works row by row: repeated rows and ids stay, a null text has no words, texts are read whole however
    long; an empty table gives none. Columns of docs named like a new one are replaced. A benchmark of more
    than ``slice_bytes`` takes a pass over the documents for each of its slices, so that a task never holds
    more than one.
    """
    new = ("n_words", "n_hit", "items", "spans")
    now = docs.select([c for c in docs.columns if c not in new])
    schema = StructType([*now.schema.fields, *StructType.fromDDL(_FOUND).fields])
    spark, before = docs.sparkSession, None
    for part, last in benchmark_slices(benchmark, window, item_col, "text", slice_bytes):
        shared = spark.sparkContext.broadcast(part)
        now = now.mapInArrow(_search(shared, text_col, cut and last, before is not None), schema)
        if not last:
            work = work or Workspace(spark, "passages")
            now = work.table(now, "slice")
            shared.unpersist()
            if before is not None:
                work.drop(before)
            before = now
    return now


def _search(shared, text_col: str, cut: bool, again: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A pass over documents with one slice; again: what passes before found stands in the last columns."""
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    new = ("n_words", "n_hit", "items", "spans")

    def shard(group: list[tuple[pa.RecordBatch, list[list[bytes]]]]) -> Iterator[pa.RecordBatch]:
        found = search_shard([w for _, ws in group for w in ws], [shared.value])
        for batch, words in group:
            mine, found = found[: len(words)], found[len(words) :]
            columns = list(batch.columns)
            if again:
                *columns, _, _, items, spans = columns
                mine = [(_united(s, [(x["start"], x["end"]) for x in t]), sorted({*i, *j})) for (s, i), j, t in zip(mine, items.to_pylist(), spans.to_pylist())]
            names = batch.schema.names[: len(columns)]
            if cut and any(spans for spans, _ in mine):
                k = batch.schema.get_field_index(text_col)
                texts = as_bytes(columns[k])
                columns[k] = pa.array([cut_spans(t, s) if s else t for t, (s, _) in zip(texts, mine)], pa.binary()).cast(columns[k].type)
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array([len(w) for w in words], pa.int64()), pa.array([sum(b - a for a, b in s) for s, _ in mine], pa.int64()), pa.array([i for _, i in mine], pa.list_(pa.string())), pa.array([[{"start": a, "end": b} for a, b in s] for s, _ in mine], span_type)],
                names=[*names, *new],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, size = [], 0
        for batch in small_batches(batches, text_col, 4 << 20):
            words = [alnum_words(x or b"") for x in as_bytes(batch.column(batch.schema.get_field_index(text_col)))]
            group.append((batch, words))
            size += sum(map(len, words))
            if size >= SHARD_WORDS:
                yield from shard(group)
                group, size = [], 0
        if group:
            yield from shard(group)

    return run


def _united(x: list[tuple[int, int]], y: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(x + y):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_passages(docs.select("doc_id", "text"), benchmark, window=window)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
