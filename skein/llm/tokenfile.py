"""Token ids as flat binary shards with Elias-Fano document boundaries.

A shard holds, in ascending document order,

    ids            unsigned little-endian integers of 2 or 4 bytes, all documents end to end
    boundaries     Elias-Fano code of the n + 1 offsets into the ids
    document ids   Elias-Fano code of doc_id - base, for the documents whose id isn't null
    trailer        fixed size: counts, lengths, base, width, magic

so offsets take about ``2 + log2(ids / documents)`` bits a document instead of 64, and ``select``
returns any one of them without decoding the rest. Ids are streamed to the file while a task reads
its documents; a task holds only offsets.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .words import as_bytes, small_batches
from .workspace import Workspace, attempt_name, open_fs

_TRAILER = "<QQQQQqI8s"
_MAGIC = b"SKNTOK01"


class EliasFano:
    """A non-decreasing sequence of integers >= 0: low bits packed, high bits in unary.

    ``values(i, j)`` jumps to the sampled position of the last of every ``SAMPLE`` set bits before i and counts
    set bits of bytes on from there. Samples are all there is besides the code: 64 / ``SAMPLE`` bits a value.
    """

    SAMPLE = 256

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        self._samples: np.ndarray | None = None

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        if not n:
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8))
        width = max(0, (int(v[-1]) // n).bit_length() - 1)
        shifts = np.arange(width, dtype=np.uint64)
        low = np.packbits(((v[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        top = (v >> np.uint64(width)).astype(np.int64)
        bits = np.zeros(n + int(top[-1]) + 1, np.uint8)
        bits[top + np.arange(n)] = 1
        return cls(n, width, low, np.packbits(bits, bitorder="little"))

    def to_bytes(self) -> bytes:
        return struct.pack("<QQQQ", self.n, self.low_bits, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, width, a, b = struct.unpack_from("<QQQQ", data)
        buf = np.frombuffer(data, np.uint8, a + b, 32)
        return cls(n, width, buf[:a], buf[a:])

    def _low_of(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.uint64)
        for k in range(self.low_bits):
            at = i * self.low_bits + k
            out |= ((self.low[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(np.uint64) << np.uint64(k)
        return out

    def _sampled(self) -> np.ndarray:
        """Byte of every ``SAMPLE``-th set bit, and the set bits before that byte; made a stretch of bytes at a time."""
        if self._samples is None:
            found, seen = [], 0
            for a in range(0, len(self.high), 1 << 16):
                upto = np.cumsum(np.bitwise_count(self.high[a : a + (1 << 16)]), dtype=np.int64)
                want = np.arange(-(-seen // self.SAMPLE) * self.SAMPLE, min(self.n, seen + int(upto[-1])), self.SAMPLE) - seen
                at = np.searchsorted(upto, want, side="right")
                found.append(np.stack([at + a, seen + np.where(at, upto[at - 1], 0)], axis=1))
                seen += int(upto[-1])
            self._samples = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
        return self._samples

    def values(self, i: int, j: int) -> np.ndarray:
        """Values i to j - 1; only their part of the code is decoded."""
        if not 0 <= i <= j <= self.n:
            raise IndexError((i, j))
        if i == j:
            return np.zeros(0, np.uint64)
        byte, before = self._sampled()[i // self.SAMPLE].tolist()
        ones, a = [], byte
        while before < j:
            bits = np.flatnonzero(np.unpackbits(self.high[a : a + 4096], bitorder="little"))
            ones.append(bits[max(0, i - before) : j - before] + 8 * a)
            before, a = before + len(bits), a + 4096
        index = np.arange(i, j)
        return ((np.concatenate(ones) - index).astype(np.uint64) << np.uint64(self.low_bits)) | self._low_of(index)

    def all(self) -> np.ndarray:
        return self.values(0, self.n)

    def select(self, i: int) -> int:
        """The i-th value."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        return int(self.values(i, i + 1)[0])


class _Numbers(dict):
    """chunk -> its number in order of first use; ``new`` has those not learnt yet."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, chunk: bytes) -> int:
        self[chunk] = k = len(self)
        self.new.append(chunk)
        return k


class ChunkEncoder:
    """Encodes texts with the tokenizers library, each white-space-delimited chunk once.

    Valid for tokenizers whose pre-tokenizer drops white space and never lets a token span it, as
    the word tokenizer's does: ids of a text are those of its chunks end to end. Splitting is on
    ASCII white space only; any other stays within its chunk for the library to judge. With any other
    tokenizer file (see drops_space), whole texts are given to the library.
    """

    LIMIT = 600_000
    GROUP = 100

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_chunk = drops_space(path)
        self.clear()

    def clear(self) -> None:
        self.known = _Numbers()
        self.flat, self.starts, self.sizes = np.zeros(1 << 16, np.uint32), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.used = self.learned = 0

    def _learn(self, chunks: list[bytes]) -> None:
        """Encodes chunks in groups joined by spaces; where a token starts tells the chunk it is of."""
        words = [c.decode("utf-8", "replace") for c in chunks]
        groups = [words[a : a + self.GROUP] for a in range(0, len(words), self.GROUP)]
        made = self.tokenizer.encode_batch([" ".join(g) for g in groups], add_special_tokens=False)
        sizes = []
        for group, e in zip(groups, made):
            first = np.cumsum([0] + [len(w) + 1 for w in group[:-1]])
            spans = e.offsets
            at = np.fromiter(chain.from_iterable(spans), np.int64, 2 * len(spans))[::2]
            sizes.append(np.bincount(np.searchsorted(first, at, side="right") - 1, minlength=len(group)))
        ids, size = np.fromiter(chain.from_iterable(e.ids for e in made), np.uint32), np.concatenate(sizes)
        k, m = self.learned, len(chunks)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while k + m > len(self.starts):
            self.starts, self.sizes = np.concatenate([self.starts, np.zeros_like(self.starts)]), np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[k : k + m], self.sizes[k : k + m] = self.used + np.cumsum(size) - size, size
        self.used, self.learned = self.used + len(ids), k + m

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids end to end, number of ids of each text)."""
        if not self.by_chunk:
            made = self.tokenizer.encode_batch([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
            sizes = np.fromiter((len(e) for e in made), np.int64, len(made))
            return np.fromiter(chain.from_iterable(e.ids for e in made), np.uint32, int(sizes.sum())), sizes
        if len(self.known) > self.LIMIT:
            self.clear()
        parts = [t.split() for t in texts]
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        known = self.known
        which = np.fromiter(map(known.__getitem__, chain.from_iterable(parts)), np.int64, int(counts.sum()))
        for a in range(0, len(known.new), 4000):
            self._learn(known.new[a : a + 4000])
        known.new.clear()
        sizes = self.sizes[which]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.starts[which] - (ends - sizes), sizes) + np.arange(total)] if total else np.zeros(0, np.uint32)
        upto = np.concatenate([[0], ends])[np.cumsum(counts)]
        per = np.diff(upto, prepend=0)
        return ids, per


def drops_space(path: str) -> bool:
    """Whether a tokenizer file splits texts by matches of a pattern that can't match white space, drops
    what is between them, and normalises characters alone."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    parts = lambda x, many: [] if x is None else x[many] if x["type"] == "Sequence" else [x]
    first = next(iter(parts(made.get("pre_tokenizer"), "pretokenizers")), {"type": ""})
    if first["type"] == "Split" and first["behavior"] == "Removed" and first["invert"] and "Regex" in first["pattern"]:
        # Only negated classes that name white space may hold a sign of it; no dot, no space, no other negation.
        rest = re.sub(r"\[\^[^\]]*\\s[^\]]*\]", "", first["pattern"]["Regex"])
        splits = not re.search(r"\s|\.|\[\^|\\[sSWDPvhHRXn]", rest)
    else:
        splits = first["type"] in ("Whitespace", "WhitespaceSplit", "BertPreTokenizer")
    fine = {"NFC", "NFD", "NFKC", "NFKD", "Lowercase"}
    spaces = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
    tokens = all(not t["lstrip"] and not t["rstrip"] and not re.search(r"\s", t["content"]) for t in made.get("added_tokens", []))
    return bool(splits and tokens and all(n["type"] in fine or n == spaces for n in parts(made.get("normalizer"), "normalizers")))


_encoders: dict[str, ChunkEncoder] = {}


def encoder_of(path: str) -> ChunkEncoder:
    """The worker's encoder, kept from task to task."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks fill the cores; the library's threads would only wait on each other
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


_MANIFEST = "shard int, path string, n_docs long, n_tokens long"


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int, work: Workspace, *, id_col: str = "doc_id", text_col: str = "text", width: int = 2) -> DataFrame:
    """Encode every text (null: empty), append ``end_id`` and write shards; returns the manifest.

    Documents are range-partitioned on (id, text hash), so a repeated id doesn't pile up in one
    task; nulls come first. ``width`` is the bytes of an id: 2 where the vocabulary fits, which is checked.
    Texts are encoded whole, however long; an empty table gives no shards. Input columns other than the
    two are ignored.
    """
    from tokenizers import Tokenizer

    largest = max(end_id, Tokenizer.from_file(tokenizer_path).get_vocab_size(with_added_tokens=True) - 1)
    if largest >= 1 << 8 * width:
        raise ValueError(f"ids up to {largest} don't fit into {width} bytes")
    folder = work.folder("tokens")
    dtype = {2: "<u2", 4: "<u4"}[width]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out, fs, path, n_null, n, total = None, None, "", 0, 0, 0
        ids, sizes = [], []
        encoder = encoder_of(tokenizer_path)
        for batch in small_batches(batches, "text"):
            if out is None:
                fs, top = open_fs(folder)
                fs.create_dir(top, recursive=True)
                path = attempt_name("shard", ".tok")
                out = fs.open_output_stream(f"{top}/{path}")
            flat, per = encoder.encode([x or b"" for x in as_bytes(batch.column(1))])
            flat = np.insert(flat, np.cumsum(per), end_id)
            out.write(flat.astype(dtype).tobytes())
            keys = batch.column(0)
            n_null += keys.null_count
            ids.append(keys.drop_null().to_numpy(zero_copy_only=False))
            sizes.append(per + 1)
            n += batch.num_rows
            total += len(flat)
        if out is None:
            return
        keys = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        base = int(keys[0]) if len(keys) else 0
        bounds = EliasFano.encode(np.concatenate([[0], np.cumsum(np.concatenate(sizes))])).to_bytes()
        names = EliasFano.encode((keys.astype(np.uint64) - np.array(base, np.int64).astype(np.uint64))).to_bytes()
        out.write(bounds)
        out.write(names)
        out.write(struct.pack(_TRAILER, n, n_null, total, len(bounds), len(names), base, width, _MAGIC))
        out.close()
        yield pa.RecordBatch.from_pydict({"shard": pa.array([TaskContext.get().partitionId()], pa.int32()), "path": [f"{folder}/{path}"], "n_docs": pa.array([n], pa.int64()), "n_tokens": pa.array([total], pa.int64())})

    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    spread = F.xxhash64("text")
    ranged = keyed.repartitionByRange(F.col("doc_id").asc_nulls_first(), spread).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), spread)
    return work.table(ranged.mapInArrow(write, _MANIFEST), "manifest")


class TokenShard:
    """Reads one shard: ``ids(i)`` of the i-th document through its boundaries, or everything in blocks."""

    def __init__(self, uri: str):
        fs, path = open_fs(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        n, n_null, total, a, b, base, width, magic = struct.unpack(_TRAILER, self.file.read_at(end := struct.calcsize(_TRAILER), size - end))
        if magic != _MAGIC:
            raise ValueError(f"{uri} is no token shard")
        self.n_docs, self.n_null, self.n_tokens, self.base, self.width = n, n_null, total, base, width
        self.bounds = EliasFano.from_bytes(self.file.read_at(a, total * width))
        self._names = EliasFano.from_bytes(self.file.read_at(b, total * width + a))

    def doc_ids(self, i: int, j: int) -> list[int | None]:
        """Of documents i to j - 1; those without an id come first."""
        null = max(0, min(j, self.n_null) - i)
        return [None] * null + [int(x) + self.base for x in self._names.values(max(0, i - self.n_null), max(0, j - self.n_null))]

    def span(self, start: int, end: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at((end - start) * self.width, start * self.width), f"<u{self.width}")

    def ids(self, i: int) -> np.ndarray:
        return self.span(self.bounds.select(i), self.bounds.select(i + 1))

    def close(self) -> None:
        self.file.close()


def read_tokens(manifest: DataFrame) -> DataFrame:
    """A row for each document, from the shards: doc_id, start, n_tokens, ids_crc32."""
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = TokenShard(row["path"])
                i = 0
                while i < shard.n_docs:
                    # Selected offsets of a few documents at a time, cut where their ids take too much.
                    bounds = shard.bounds.values(i, min(i + 4096, shard.n_docs) + 1).astype(np.int64)
                    n = max(1, int(np.searchsorted(bounds, bounds[0] + (4 << 20), side="right")) - 1)
                    bounds = bounds[: n + 1]
                    ids = shard.span(bounds[0], bounds[-1]).astype("<u4")
                    sums = [zlib.crc32(ids[a - bounds[0] : b - bounds[0]]) for a, b in zip(bounds, bounds[1:])]
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(shard.doc_ids(i, i + len(sums)), pa.int64()), "start": pa.array(bounds[:-1] + row["base"], pa.int64()), "n_tokens": pa.array(np.diff(bounds), pa.int64()), "ids_crc32": pa.array(sums, pa.int64())})
                    i += len(sums)
                shard.close()

    # One row a shard: this window is over file names, not documents. An explicit count keeps shards in tasks of their own.
    spark = manifest.sparkSession
    shards = manifest.withColumn("base", before).repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), F.col("shard"))
    return shards.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
