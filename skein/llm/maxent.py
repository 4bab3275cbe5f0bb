"""A hashed maximum-entropy language model with a class-factored softmax.

    p(w | history) = p(class | history) * p(member | class, history) * p(w | member)

Every word is in one of ``WIDTH`` classes and is, or shares, one of its ``WIDTH`` members. The most frequent
words are members by themselves, so that the last factor is 1; other words share a member by their ending,
and follow their smoothed training counts within it. Both softmaxes read sums of weight rows that hashed
features of the history pick: for the class the word before, the two words before (n-grams) and the word
two before alone (skip); for the member the class, and the word before and the word two before together
with the class. Words that are rare for the size of the table enter features by their ending. Words unseen
in training are one word of the member their ending picks, so the model is a distribution over the training
vocabulary and one such word a member.

Corpus side: a task turns its documents into chunks: local word numbers and the 64-bit hashes of the chunk's
distinct words. Hashes with their counts are dealt out by hash, summed in numpy, and the sums go back to the
chunks that asked: a row for each (chunk, group of hashes), never one for each word. The table of weights grows
with the tokens, up to ``max_rows`` (what is broadcast has that bound). Each learner goes through its chunks in
minibatches (AdaGrad); its changes are averaged row by row, weighted by how often it saw the row, a block of
rows at a time. How many learners there are follows from the number of tokens; which chunks each has follows
the splits of the input.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import as_bytes, mix64, small_batches, space_words
from .workspace import Workspace

END = b"\n"  # no word holds white space, so the end is none of them
WIDTH = 32
CELLS = WIDTH * WIDTH
#: Cells of words that are members by themselves; the others are shared by ending.
OWN = CELLS // 2


@dataclass(frozen=True)
class Settings:
    #: Rows of weights for each factor: a power of two near tokens / ``a_row``, in these bounds.
    min_rows: int = 1 << 12
    max_rows: int = 1 << 17
    a_row: int = 4096
    #: Words rarer than one in ``named`` * rows tokens enter features by their ending.
    named: int = 16
    batch: int = 8192
    rate: float = 0.3
    chunk_words: int = 1 << 20
    #: Training tokens of a learner.
    learner: int = 8 << 20
    blocks: int = 16

    def rows(self, tokens: int) -> int:
        return min(self.max_rows, max(self.min_rows, 1 << round(np.log2(max(1, tokens / self.a_row)))))


@dataclass
class Tables:
    """What scoring needs besides chunks: totals, own words, cell counts and weights, all of bounded size."""

    tokens: int
    types: int
    own: np.ndarray  # hashes of the words that are members by themselves, most frequent first
    cell_tokens: np.ndarray  # of shared cells: training tokens
    cell_types: np.ndarray
    own_tokens: np.ndarray
    weights: np.ndarray | None = None

    def cells(self, hashes: np.ndarray, shared: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The cell of every word: class * WIDTH + member."""
        out = (OWN + shared).astype(np.int64)
        if len(self.own):
            order = np.argsort(self.own)
            at = np.minimum(np.searchsorted(self.own[order], hashes), len(order) - 1)
            known = (self.own[order][at] == hashes) & (c > 0)
            out[known] = order[at[known]]
        return out

    def inner(self, cells: np.ndarray, c: np.ndarray) -> np.ndarray:
        """log10 of a word's share of its cell."""
        shared = cells >= OWN
        k = np.where(shared, cells - OWN, 0)
        return np.where(shared, np.log10((c + 1.0) / (self.cell_tokens[k] + self.cell_types[k] + 1.0)), 0.0)

    def start(self, s: Settings) -> tuple[int, np.ndarray, np.ndarray]:
        """Rows of a factor; the class bias; a member bias for each class: a model without history."""
        mass = np.concatenate([self.own_tokens, np.zeros(OWN - len(self.own_tokens)), self.cell_tokens]) + np.concatenate([np.full(OWN, 1e-3), self.cell_types + 1.0])
        mass = mass.reshape(WIDTH, WIDTH)
        return s.rows(self.tokens), np.log(mass.sum(axis=1) / mass.sum()).astype(np.float32), np.log(mass / mass.sum(axis=1, keepdims=True)).astype(np.float32)


def ending_cell(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % (CELLS - OWN)


class _Numbers(dict):
    """word -> its number, by first appearance."""

    def __init__(self):
        self.fresh = count()

    def __missing__(self, word: bytes) -> int:
        self[word] = n = next(self.fresh)
        return n


_DOC = [("doc", "<i8"), ("null", "u1"), ("held", "u1"), ("n", "<i8")]


def _pack_docs(rows: list) -> np.ndarray:
    table = np.zeros(len(rows), _DOC)
    table["doc"] = [r[0] or 0 for r in rows]
    table["null"] = [r[0] is None for r in rows]
    table["held"], table["n"] = [r[1] for r in rows], [r[2] for r in rows]
    return table


def _learn_counts(docs: np.ndarray, words: np.ndarray, n_words: int) -> np.ndarray:
    """Training tokens of each word of a chunk."""
    return np.bincount(words[np.repeat(docs["held"] == 0, docs["n"])], minlength=n_words)


_CHUNK = "chunk long, docs binary, words binary, hashes binary, shared binary"


def cut_chunks(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    """Chunks of (doc_id, text) rows: documents, local word numbers (frequent words have small ones), and for
    each word its hash and the shared cell that its ending picks."""
    import xxhash
    from pyspark import TaskContext

    part, n_chunk = TaskContext.get().partitionId(), 0
    rows, ids, size, words = [], [], 0, _Numbers()

    def flush() -> pa.RecordBatch:
        nonlocal n_chunk, rows, ids, size, words
        docs, flat, names = _pack_docs(rows), np.concatenate(ids), list(words)
        order = np.argsort(-np.bincount(flat, minlength=len(names)), kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))[order]
        shared = np.fromiter(map(ending_cell, names), np.uint16, len(names))[order]
        out = {"chunk": pa.array([(part << 32) + n_chunk], pa.int64())} | {k: pa.array([v.tobytes()], pa.binary()) for k, v in (("docs", docs), ("words", _planes(rank[flat])), ("hashes", hashes), ("shared", shared))}
        n_chunk, rows, ids, size, words = n_chunk + 1, [], [], 0, _Numbers()
        return pa.RecordBatch.from_pydict(out)

    for batch in small_batches(batches, "text"):
        for doc, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
            held = doc is not None and zlib.crc32(str(doc).encode()) % 7 == 2
            tokens = [*space_words(text or b""), END]
            ids.append(np.fromiter(map(words.__getitem__, tokens), np.int32, len(tokens)))
            rows.append((doc, held, len(tokens)))
            size += len(tokens)
            if size >= s.chunk_words:
                yield flush()
    if rows:
        yield flush()


def _planes(words: np.ndarray) -> np.ndarray:
    """All lowest bytes, then all second ones and so on: most of the higher are zeros, which compress well."""
    return np.ascontiguousarray(words.astype("<i4").view(np.uint8).reshape(-1, 4).T)


def _chunk_arrays(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, ...]:
    """(docs, words, hashes, shared) of a row that starts with _CHUNK's columns."""
    docs, words, hashes, shared = (batch.column(k)[i].as_py() for k in range(1, 5))
    whole = np.frombuffer(words, np.uint8).reshape(4, -1).T.copy().view("<i4").ravel()
    return np.frombuffer(docs, _DOC), whole, np.frombuffer(hashes, "<u8"), np.frombuffer(shared, "<u2")


def _grouped(hashes: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of words by group (low bits of the hash), and where groups begin."""
    g = hashes & np.uint64(groups - 1)
    order = np.argsort(g, kind="stable")
    return order, np.searchsorted(g[order], np.arange(groups + 1, dtype=np.uint64))


_ASK = "grp int, chunk long, hashes binary, n binary, shared binary"
_TOLD = "grp int, chunk long, c binary, tokens long, types long, cells binary, top binary"


def _ask(batches: Iterator[pa.RecordBatch], groups: int) -> Iterator[pa.RecordBatch]:
    """What chunks ask of each group of hashes, with their own counts."""
    for batch in batches:
        for i in range(batch.num_rows):
            docs, words, hashes, shared = _chunk_arrays(batch, i)
            n = _learn_counts(docs, words, len(hashes))
            order, cuts = _grouped(hashes, groups)
            hashes, n, shared = hashes[order], n[order].astype("<u4"), shared[order]
            some = [g for g in range(groups) if cuts[g] < cuts[g + 1]]
            cut = lambda x: pa.array([x[cuts[g] : cuts[g + 1]].tobytes() for g in some], pa.binary())  # noqa: E731, B023
            yield pa.RecordBatch.from_pydict({"grp": pa.array(some, pa.int32()), "chunk": pa.array([batch.column(0)[i].as_py()] * len(some), pa.int64()), "hashes": cut(hashes), "n": cut(n), "shared": cut(shared)})


def _merge_tops(tops: list[np.ndarray]) -> np.ndarray:
    """The OWN largest of (c, hash, shared cell) rows; ties go to the smaller hash."""
    pairs = np.concatenate(tops)
    return pairs[np.lexsort((pairs["h"], -pairs["c"].astype(np.int64)))[:OWN]]


_TOP = [("c", "<i8"), ("h", "<u8"), ("shared", "<u2")]


def _tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over all chunks, for each (group, chunk) row of a task sorted by group; and a row of the group's totals."""
    held: list[tuple] = []

    def flush() -> Iterator[pa.RecordBatch]:
        hashes, n, shared = (np.concatenate([np.frombuffer(r[k], t) for r in held]) for k, t in ((2, "<u8"), (3, "<u4"), (4, "<u2")))
        names, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        c = np.bincount(which, n, len(names)).astype(np.int64)
        ends = np.cumsum([len(r[2]) // 8 for r in held])
        told = c[which]
        for r, a, b in zip(held, [0, *ends[:-1].tolist()], ends.tolist()):
            yield _told(r[0], r[1], told[a:b].astype("<i8").tobytes())
        seen = c > 0
        top = np.zeros(int(seen.sum()), _TOP)
        top["c"], top["h"], top["shared"] = c[seen], names[seen], shared[first][seen]
        cells = np.stack([np.bincount(shared[first], w, CELLS - OWN) for w in (c, seen)]).astype("<f8")
        yield _told(held[0][0], None, None, int(c.sum()), int(seen.sum()), cells.tobytes(), _merge_tops([top]).tobytes())
        held.clear()

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and held[0][0] != row[0]:
                yield from flush()
            held.append(row)
    if held:
        yield from flush()


def _told(grp, chunk, c, tokens=None, types=None, cells=None, top=None) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((grp, chunk, c, tokens, types, cells, top), kinds)], names=[x.split()[0] for x in _TOLD.split(", ")])


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for all groups of a task."""
    tokens, types, cells, top = 0, 0, np.zeros((2, CELLS - OWN)), np.zeros(0, _TOP)
    for batch in batches:
        for n, t, k, x in zip(*(c.to_pylist() for c in batch.columns)):
            tokens, types, cells = tokens + n, types + t, cells + np.frombuffer(k, "<f8").reshape(2, -1)
            top = _merge_tops([top, np.frombuffer(x, _TOP)])
    yield pa.RecordBatch.from_pydict({"tokens": pa.array([tokens], pa.int64()), "types": pa.array([types], pa.int64()), "cells": pa.array([cells.tobytes()], pa.binary()), "top": pa.array([top.tobytes()], pa.binary())})


_READY = f"{_CHUNK}, c binary"


def _joined(batches: Iterator[pa.RecordBatch], groups: int) -> Iterator[pa.RecordBatch]:
    """Chunks with the counts of their words; a chunk's row (grp -1) comes before those of its groups."""
    chunk: list | None = None
    told: list[bytes] = []

    def done() -> pa.RecordBatch:
        hashes = np.frombuffer(chunk[3], "<u8")
        c = np.empty(len(hashes), "<i8")
        c[_grouped(hashes, groups)[0]] = np.frombuffer(b"".join(told), "<i8")
        return pa.RecordBatch.from_pydict({k.split()[0]: pa.array([v], pa.int64() if k.endswith("long") else pa.binary()) for k, v in zip(_READY.split(", "), (*chunk, c.tobytes()))})

    for batch in batches:
        for i in range(batch.num_rows):
            if batch.column(1)[i].as_py() == -1:
                if chunk is not None:
                    yield done()
                chunk, told = [batch.column(k)[i].as_py() for k in (0, 2, 3, 4, 5)], []
            else:
                told.append(batch.column(6)[i].as_py())
    if chunk is not None:
        yield done()


class Corpus:
    """Chunks of a corpus and, for each, what the whole corpus says of its words."""

    def __init__(self, docs: DataFrame, work: Workspace, s: Settings):
        self.s, self.work, spark = s, work, docs.sparkSession
        plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        chunks = work.table(plain.mapInArrow(lambda b: cut_chunks(b, s), _CHUNK), "chunks", compression="zstd")
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
        groups = 1 << max(4, (parts - 1).bit_length())
        asked = chunks.mapInArrow(lambda b: _ask(b, groups), _ASK).repartition(parts, "grp").sortWithinPartitions("grp")
        told = work.table(asked.mapInArrow(_tell, _TOLD), "told", compression="zstd")
        work.release()
        kind = "tokens long, types long, cells binary, top binary"
        sums = told.where("chunk is null").select("tokens", "types", "cells", "top")
        # In two steps, as each group has its own candidates for the words that are members by themselves.
        total = sums.repartition(16).mapInArrow(_total, kind).repartition(1).mapInArrow(_total, kind).first()
        top = np.frombuffer(bytes(total.top), _TOP) if total else np.zeros(0, _TOP)
        cells = np.frombuffer(bytes(total.cells), "<f8").reshape(2, -1).copy() if total else np.zeros((2, CELLS - OWN))
        # The own words were counted in the cells of their endings too.
        np.subtract.at(cells[0], top["shared"], top["c"])
        np.subtract.at(cells[1], top["shared"], 1)
        self.tables = Tables(total.tokens if total else 0, total.types if total else 0, top["h"].copy(), cells[0], cells[1], top["c"].astype(np.float64))
        whole = chunks.select("chunk", F.lit(-1).alias("grp"), "docs", "words", "hashes", "shared", F.lit(None).cast("binary").alias("c"))
        none = [F.lit(None).cast("binary").alias(n) for n in ("docs", "words", "hashes", "shared")]
        joint = whole.unionByName(told.where("chunk is not null").select("chunk", "grp", *none, "c"))
        self.ready = work.table(joint.repartition(parts, "chunk").sortWithinPartitions("chunk", "grp").mapInArrow(lambda b: _joined(b, groups), _READY), "ready", compression="zstd")
        work.drop(chunks)
        work.drop(told)
        work.release()

    def map(self, kernel: Callable, schema: str, tasks: int | None = None) -> DataFrame:
        """kernel over (docs, words, hashes, shared, counts) of every chunk."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from kernel((*_chunk_arrays(b, i), np.frombuffer(b.column(5)[i].as_py(), "<i8")) for b in batches for i in range(b.num_rows))

        return (self.ready.coalesce(tasks) if tasks else self.ready).mapInArrow(run, schema)


def feature_keys(words: np.ndarray, ends: np.ndarray, key: np.ndarray) -> np.ndarray:
    """(3, tokens) hashes: the word before, the two before, the one two before. A document starts after two empty words."""
    k = mix64(key)[words]
    n = len(words)
    starts = np.concatenate([[0], ends[:-1]])
    one, two = np.empty(n, np.uint64), np.empty(n, np.uint64)
    one[1:], two[2:] = k[:-1], k[:-2]
    one[starts] = 1
    two[starts] = 2
    two[np.minimum(starts + 1, n - 1)[starts + 1 < ends]] = 2
    with np.errstate(over="ignore"):
        return np.stack([one, mix64(one * np.uint64(3) + two), two * np.uint64(5) + np.uint64(7)])


def weight_rows(keys: np.ndarray, cls: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of weights for the class (0 is its bias) and for the member of class ``cls`` (a bias for each class first)."""
    mask = np.uint64(rows - 1)
    first = (keys & mask).astype(np.int32)
    first[first == 0] = 1
    with np.errstate(over="ignore"):
        c = (cls.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        crossed = ((keys[[0, 2]] + c) * np.uint64(0xD1342543DE82EF95) >> np.uint64(40)) & mask
    second = np.concatenate([cls[None].astype(np.int32), np.maximum(crossed.astype(np.int32), WIDTH)]) + rows
    return first, second


def _softmax(w: np.ndarray, rows: np.ndarray, bias: bool) -> np.ndarray:
    z = w[rows[0]]
    z += w[rows[1]]
    z += w[rows[2]]
    if bias:
        z += w[0]
    z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    return z


def sgd(w: np.ndarray, speed: np.ndarray, seen: np.ndarray, rows: np.ndarray, y: np.ndarray, s: Settings, bias: bool) -> None:
    """AdaGrad over minibatches, in place. seen: how often each row was used."""
    for a in range(0, len(y), s.batch):
        r, t = rows[:, a : a + s.batch], y[a : a + s.batch]
        n = len(t)
        g = _softmax(w, r, bias)
        g[np.arange(n), t] -= 1
        # Row and place packed into one number: sorting those is fast, and brings each row's gradients together.
        packed = np.sort((r.ravel().astype(np.int64) << 24) | np.tile(np.arange(n), 3))
        at = packed >> 24
        first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
        total = np.add.reduceat(g[packed & 0xFFFFFF], first)
        touched, times = at[first], np.diff(first, append=len(at))
        if bias:
            total, touched, times = np.concatenate([total, g.sum(axis=0, keepdims=True)]), np.append(touched, 0), np.append(times, n)
        total /= np.maximum(1, np.sqrt(times))[:, None]
        speed[touched] += np.einsum("ij,ij->i", total, total) / WIDTH
        w[touched] -= (s.rate / (np.sqrt(speed[touched]) + 1e-4))[:, None] * total
        seen[touched] += times


def _empty(start: tuple[int, np.ndarray, np.ndarray]) -> np.ndarray:
    """Weights of the model without history: class rows, then member rows."""
    rows, first, second = start
    w = np.zeros((2 * rows, WIDTH), np.float32)
    w[0], w[rows : rows + WIDTH] = first, second
    return w


def _prepared(chunk: tuple, t: Tables, s: Settings, rows: int) -> tuple[np.ndarray, ...]:
    """(ends, cells of the words, keys of the tokens)."""
    docs, words, hashes, shared, c = chunk
    ends = np.cumsum(docs["n"])
    key = np.where(c * (s.named * rows) >= max(t.tokens, 1), hashes, shared.astype(np.uint64) + np.uint64(11))
    return ends, t.cells(hashes, shared, c), feature_keys(words, ends, key)


_UPDATE = "block int, n binary, w binary"


def train(corpus: Corpus) -> Tables:
    s, t = corpus.s, corpus.tables
    if not t.tokens:
        t.weights = _empty(t.start(s))
        return t
    spark: SparkSession = corpus.ready.sparkSession
    shared = spark.sparkContext.broadcast((t, start := t.start(s)))
    rows = start[0]
    step = 2 * rows // s.blocks

    def kernel(chunks) -> Iterator[pa.RecordBatch]:
        t, start = shared.value
        w = _empty(start)
        speed, seen = np.full(len(w), 1e-6, np.float32), np.zeros(len(w), np.float32)
        for chunk in chunks:
            docs, words = chunk[:2]
            ends, cells, keys = _prepared(chunk, t, s, rows)
            learn = np.flatnonzero(np.repeat(docs["held"] == 0, docs["n"]))
            for a in range(0, len(learn), 1 << 17):
                some = learn[a : a + (1 << 17)]
                cls, member = np.divmod(cells[words[some]], WIDTH)
                first, second = weight_rows(keys[:, some], cls, rows)
                sgd(w, speed, seen, first, cls, s, True)
                sgd(w, speed, seen, second, member, s, False)
        if seen.any():
            w -= _empty(start)
            for b in range(s.blocks):
                at = slice(b * step, (b + 1) * step)
                yield pa.RecordBatch.from_pydict({"block": pa.array([b], pa.int32()), "n": [seen[at].astype("<f4").tobytes()], "w": [w[at].astype("<f2").tobytes()]})

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block's mean, each row weighted by its use; at most ``blocks`` of them are held."""
        sums: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for b, n, w in zip(*(batch.column(c).to_pylist() for c in range(3))):
                n, w = np.frombuffer(n, "<f4"), np.frombuffer(w, "<f2").astype(np.float32).reshape(step, WIDTH)
                have = sums.setdefault(b, [np.zeros(step, np.float32), np.zeros((step, WIDTH), np.float32)])
                have[0] += n
                have[1] += n[:, None] * w
        for b, (n, w) in sums.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([b], pa.int32()), "n": [n.tobytes()], "w": [(w / np.maximum(n, 1)[:, None]).astype("<f2").tobytes()]})

    updates = corpus.map(kernel, _UPDATE, -(-t.tokens // s.learner)).repartition(s.blocks, "block").mapInArrow(mean, _UPDATE)
    w = _empty(start)
    for r in updates.toLocalIterator():
        w[r.block * step : (r.block + 1) * step] += np.frombuffer(r.w, "<f2").astype(np.float32).reshape(step, WIDTH)
    t.weights = w
    return t


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def token_scores(chunk: tuple, t: Tables, s: Settings) -> np.ndarray:
    """log10 probability of every token of a chunk."""
    _, words, _, _, c = chunk
    rows = len(t.weights) // 2
    _, cells, keys = _prepared(chunk, t, s, rows)
    inner = t.inner(cells, c)
    out = np.empty(len(words))
    for a in range(0, len(words), 1 << 14):
        at = words[a : a + (1 << 14)]
        cls, member = np.divmod(cells[at], WIDTH)
        first, second = weight_rows(keys[:, a : a + len(at)], cls, rows)
        p = _softmax(t.weights, first, True)[np.arange(len(at)), cls]
        q = _softmax(t.weights, second, False)[np.arange(len(at)), member]
        out[a : a + len(at)] = np.log10(np.maximum(p, 1e-30)) + np.log10(np.maximum(q, 1e-30)) + inner[at]
    return out


def score(corpus: Corpus, tables: Tables) -> DataFrame:
    s = corpus.s
    shared = corpus.ready.sparkSession.sparkContext.broadcast(tables)

    def kernel(chunks) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for chunk in chunks:
            docs, words, _, _, c = chunk
            base = np.log10((c + 1.0) / (t.tokens + 1.0 * (t.types + 1)))
            starts = np.cumsum(docs["n"]) - docs["n"]
            add = lambda x: np.add.reduceat(x, starts)  # noqa: E731, B023
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(np.where(docs["null"], 0, docs["doc"]), pa.int64(), mask=docs["null"] > 0), "held_out": docs["held"] > 0, "n_tokens": docs["n"], "n_known": add((c > 0)[words].astype(np.int64)), "train_tokens": np.full(len(docs), t.tokens), "base_score": add(base[words]), "score": add(token_scores(chunk, t, s))})

    return corpus.map(kernel, _SCORES)


def lm_scores(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A null text is empty: its one token is the end. A null doc_id isn't held out. Repeated rows count, and
    are scored, as often as they stand there; texts are read whole, however long (a text is never cut into two
    chunks). An empty table gives no rows; without training rows all counts are 0. Other columns aren't read."""
    corpus = Corpus(docs, Workspace(docs.sparkSession, "maxent"), s)
    return score(corpus, train(corpus))
