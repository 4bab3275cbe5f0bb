"""Unigram tokenisation: Viterbi over a double-array trie of pieces with log scores.

Pieces are kept as UTF-8 with a space for the white-space marker, so a marker character that a text
itself holds is no marker: it falls back to its bytes and comes back as it was. Characters that no
piece covers become byte pieces. A text is cut before every space that follows another character,
and around line breaks; where no piece spans such a cut (checked when the vocabulary is loaded),
the best segmentation of a text is that of its parts, and each distinct part is solved once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from .words import as_bytes, small_batches

MARKER = "▁"
#: Below the lowest score by so much: a character that goes to bytes.
UNKNOWN_PENALTY = 10.0


class DoubleArray:
    """A trie in two arrays: from state s byte b leads to base[s] + b + 1 if check there is s.

    ``value`` is the piece that ends at a state, -1 for none."""

    def __init__(self, keys: list[tuple[bytes, int]]):
        keys = sorted(keys)
        self._base, self._check, self._value = {}, {}, {}
        taken = bytearray(1 << 16)
        taken[0] = 1
        low = top = 257
        todo = [(0, 0, len(keys), 0)]
        while todo:
            state, a, b, depth = todo.pop()
            if a < b and len(keys[a][0]) == depth:
                self._value[state] = keys[a][1]
                a += 1
            if a == b:
                continue
            groups, at = [], a
            for i in range(a + 1, b + 1):
                if i == b or keys[i][0][depth] != keys[at][0][depth]:
                    groups.append((keys[at][0][depth] + 1, at, i))
                    at = i
            steps = [g[0] for g in groups]
            if len(steps) == 1:
                # One child fills the first gap that its byte can reach; wide nodes leave such gaps.
                while taken[low]:
                    low += 1
                at = low
                while at < steps[0] or taken[at]:
                    at += 1
                base = at - steps[0]
            else:
                base = max(0, top - steps[0])
            last = base + steps[-1]
            if last + 300 > len(taken):
                taken.extend(bytes(len(taken)))
            top = max(top, last + 1)
            self._base[state] = base
            for c, x, y in groups:
                taken[base + c] = 1
                self._check[base + c] = state
                todo.append((base + c, x, y, depth + 1))
        size = top + 258
        self.base, self.check, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        for to, made in ((self.base, self._base), (self.check, self._check), (self.value, self._value)):
            to[list(made)] = list(made.values())
        del self._base, self._check, self._value

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Next states, -1 where there is none."""
        to = self.base[state] + byte + 1
        return np.where(self.check[to] == state, to, -1)


@dataclass
class Vocabulary:
    """Pieces as bytes (None: control), their log scores, and the id of byte piece b at bytes_at + b."""

    pieces: list[bytes | None]
    scores: np.ndarray
    bytes_at: int

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """From a model file with byte fallback.

        The file ranks its pieces without giving probabilities; by Zipf's law the piece of rank r gets the
        log probability -ln(r + 1) - ln(H), H the harmonic number. Runs of the marker beyond one have no
        rank in the file and stand last."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        rank = [-model.get_score(i) for i in range(n)]
        normal = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        order = sorted(normal, key=lambda i: (rank[i], i))
        total = np.log(np.sum(1 / np.arange(1, len(order) + 1)))
        scores = np.full(n, -np.inf)
        scores[order] = -np.log(np.arange(1, len(order) + 1)) - total
        own = set(normal)
        pieces = [model.id_to_piece(i).replace(MARKER, " ").encode() if i in own else None for i in range(n)]
        return cls(pieces, scores, model.piece_to_id("<0x00>"))


class Unigram:
    LIMIT = 300_000
    LONG = 96

    def __init__(self, vocabulary: Vocabulary):
        v = self.vocabulary = vocabulary
        real = [(p, i) for i, p in enumerate(v.pieces) if p]
        self.trie = DoubleArray(real)
        self.unknown = float(v.scores[np.isfinite(v.scores)].min()) - UNKNOWN_PENALTY
        self.apart = not any(b" " in p.lstrip(b" ") for p, _ in real)
        self.lines = not any(b"\n" in p for p, _ in real)
        self._lists: list[list] | None = None
        self.output = [bytes([i - v.bytes_at]) if v.bytes_at <= i < v.bytes_at + 256 else (p or b"") for i, p in enumerate(v.pieces)]
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, np.ndarray] = {}

    def parts(self, text: bytes) -> list[bytes]:
        """The text, a space in front, in parts that no piece spans."""
        if not text:
            return []
        if not self.apart:
            return [b" " + text]
        out: list[bytes] = []
        for k, line in enumerate(text.split(b"\n") if self.lines else [text]):
            if k:
                out.append(b"\n")
            words = line.split(b" ")
            spaces = b"" if k else b" "
            for w in words:
                if w:
                    out.append(spaces + w)
                    spaces = b" "
                else:
                    spaces += b" " if w is not words[0] or not k else b" "
            # Spaces that end the line: one was counted before its word came.
            if not words[-1]:
                if spaces := spaces[:-1]:
                    out.append(spaces)
        return out

    def solve(self, parts: list[bytes]) -> list[np.ndarray]:
        """Ids of each part."""
        out: list[np.ndarray | None] = [None] * len(parts)
        order = sorted(range(len(parts)), key=lambda i: len(parts[i]))
        at = 0
        while at < len(order) and len(parts[order[at]]) <= self.LONG:
            size = len(parts[order[at]])
            end = at
            while end < len(order) and end < at + 50_000 and len(parts[order[end]]) <= min(self.LONG, size + size // 4 + 1):
                end += 1
            self._solve_block([parts[i] for i in order[at:end]], order[at:end], out)
            at = end
        for i in order[at:]:
            out[i] = self._solve_long(parts[i])
        return out

    def _solve_block(self, parts: list[bytes], where: list[int], out: list) -> None:
        v, trie, n, width = self.vocabulary, self.trie, len(parts), max(map(len, parts))
        text = np.zeros((width + 4, n), np.int32)
        sizes = np.array([len(p) for p in parts])
        text[:width] = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), np.uint8).reshape(n, width).T
        best = np.full((width + 5, n), -np.inf)
        start, piece = np.zeros((width + 5, n), np.int32), np.full((width + 5, n), -1, np.int32)
        best[0] = 0
        for i in range(width):
            rows = np.flatnonzero((sizes > i) & (best[i] > -np.inf) & (text[i] & 0xC0 != 0x80))
            if not len(rows):
                continue
            lead = text[i, rows]
            char = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
            single = np.zeros(len(rows), bool)
            live, state, j = np.arange(len(rows)), np.zeros(len(rows), np.int64), i
            while len(live):
                live = live[j < sizes[rows[live]]]
                state = trie.step(state[live], text[j, rows[live]]) if len(live) else state[:0]
                going = state >= 0
                live, state = live[going], state[going]
                j += 1
                ends = trie.value[state]
                hit = np.flatnonzero(ends >= 0)
                if len(hit):
                    at, r = live[hit], rows[live[hit]]
                    single[at] |= char[at] == j - i
                    score = best[i, r] + v.scores[ends[hit]]
                    better = score > best[j, r]
                    r, ends = r[better], ends[hit][better]
                    best[j, r], start[j, r], piece[j, r] = score[better], i, ends
                full = np.zeros(len(rows), np.int64)
                full[live] = state
                state = full
            none = np.flatnonzero(~single)
            if len(none):
                r, e = rows[none], np.minimum(i + char[none], sizes[rows[none]])
                score = best[i, r] + self.unknown
                better = score > best[e, r]
                r, e = r[better], e[better]
                best[e, r], start[e, r], piece[e, r] = score[better], i, -1
        starts, pieces = start.T.tolist(), piece.T.tolist()
        for k in range(n):
            out[where[k]] = self._trace(parts[k], starts[k], pieces[k])

    def _trace(self, part: bytes, start: list[int], piece: list[int]) -> np.ndarray:
        ids, at, low = [], len(part), self.vocabulary.bytes_at
        while at:
            a = start[at]
            if piece[at] >= 0:
                ids.append(piece[at])
            else:
                ids.extend(low + b for b in part[a:at][::-1])
            at = a
        return np.array(ids[::-1], np.int32)

    def _solve_long(self, part: bytes) -> np.ndarray:
        """The same in plain Python, for parts whose length makes vectors short."""
        if self._lists is None:
            self._lists = [x.tolist() for x in (self.trie.base, self.trie.check, self.trie.value, self.vocabulary.scores)]
        (base, check, value, scores), n = self._lists, len(part)
        best, start, piece = [-np.inf] * (n + 5), [0] * (n + 5), [-1] * (n + 5)
        best[0] = 0.0
        for i in range(n):
            lead = part[i]
            if best[i] == -np.inf or lead & 0xC0 == 0x80:
                continue
            char = min(n, i + 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0))
            single, state, j = False, 0, i
            while j < n:
                to = base[state] + part[j] + 1
                if check[to] != state:
                    break
                state, j = to, j + 1
                k = value[state]
                if k >= 0:
                    single |= j == char
                    if best[i] + scores[k] > best[j]:
                        best[j], start[j], piece[j] = best[i] + scores[k], i, k
            if not single and best[i] + self.unknown > best[char]:
                best[char], start[char], piece[char] = best[i] + self.unknown, i, -1
        return self._trace(part, start, piece)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        if len(self.known) > self.LIMIT:
            self.clear()
        parts = [self.parts(t) for t in texts]
        new = list({p for ps in parts for p in ps if p not in self.known})
        for a in range(0, len(new), 50_000):
            self.known.update(zip(new[a : a + 50_000], self.solve(new[a : a + 50_000])))
        none = np.zeros(0, np.int32)
        return [np.concatenate([self.known[p] for p in ps]) if ps else none for ps in parts]

    def decode(self, ids: np.ndarray) -> bytes:
        """Pieces end to end, markers as spaces, without the space that encoding put in front."""
        return b"".join(map(self.output.__getitem__, ids.tolist()))[1:]


_loaded: dict[str, Unigram] = {}


def unigram_of(path: str) -> Unigram:
    """The worker's tokenizer, kept from task to task."""
    if path not in _loaded:
        _loaded[path] = Unigram(Vocabulary.load(path))
    return _loaded[path]


def with_pieces(docs: DataFrame, path: str, *, text_col: str = "text", full: bool = True) -> DataFrame:
    """docs with n_pieces, n_byte_pieces, ids_crc32 (of the ids as little-endian unsigned 32-bit
    integers) and decoded_equal for every row's whole text (null: empty, no pieces); with ``full`` also
    ids (array of int) and decoded (string). Columns of docs with these names are replaced. Texts are
    encoded whole, however long; repeated rows stay, an empty table gives none."""
    new = ["n_pieces", "n_byte_pieces", "ids_crc32", "decoded_equal", *(["ids", "decoded"] if full else [])]
    kept = docs.select([c for c in docs.columns if c not in new])
    kinds = {"n_pieces": "long", "n_byte_pieces": "long", "ids_crc32": "long", "decoded_equal": "boolean", "ids": "array<int>", "decoded": "string"}
    schema = StructType([*kept.schema.fields, *StructType.fromDDL(", ".join(f"{c} {kinds[c]}" for c in new)).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = unigram_of(path)
        low = model.vocabulary.bytes_at
        for batch in small_batches(batches, text_col, 4 << 20):
            texts = [x or b"" for x in as_bytes(batch.column(batch.schema.get_field_index(text_col)))]
            ids = model.encode(texts)
            back = [model.decode(i) for i in ids]
            columns = [pa.array([len(i) for i in ids], pa.int64()), pa.array([int(((i >= low) & (i < low + 256)).sum()) for i in ids], pa.int64()), pa.array([zlib.crc32(i.astype("<u4")) for i in ids], pa.int64()), pa.array([a == b for a, b in zip(texts, back)])]
            if full:
                offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                columns += [pa.ListArray.from_arrays(offsets, np.concatenate(ids)), pa.array(back, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *new])

    return kept.mapInArrow(run, schema)


def piece_report(docs: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id, n_pieces, n_byte_pieces, ids_crc32, decoded_equal."""
    return with_pieces(docs.select("doc_id", "text"), path, full=False).drop("text")
