"""A toxicity classifier: subword-bag embeddings averaged into a linear softmax.

A word's vector is the mean of hashed embeddings of the word and of its character n-grams, so an
unseen misspelling shares most of its vector with the word it comes from. A window of words is the
weighted mean of its word vectors (common words weigh less), and a linear softmax over two labels
reads it; embeddings and softmax are trained together by Adam in numpy. Toxic words are few among
many, so windows, not whole documents, are averaged: first windows drawn from all carry their
document's label, then only the one that the model finds worst, for toxic and for clean documents. A
document's logit is that of its worst window, placed on the probability scale by a logistic fit on
training documents that were held back from the embeddings. (An average over a whole document drowns
one toxic sentence in a long text; the README has figures for both.)

The fit reads at most ``toxic_rows`` and ``clean_rows`` labelled rows. Their texts are cut into words where
they lie, whole texts up to ``words_a_row`` words and runs of words drawn over all of a longer one, and one
task trains on them; the driver sees nothing but the weights. Its memory is bound by these parameters.

As softmax and averages are linear, scoring needs one number a word: each task computes it once for
every distinct word, and a document costs a lookup a word and a running sum.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .words import as_bytes, small_batches


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 16
    dims: int = 8
    grams: tuple[int, ...] = (3, 4, 5)
    window: int = 4
    #: Words of this share of all words count half.
    common: float = 5e-4
    #: Steps over windows drawn from all, then over each document's worst window.
    warm: int = 8
    warm_windows: int = 60_000
    epochs: int = 90
    rate: float = 0.02
    decay: float = 1e-5
    #: The sample that the model is fitted on: rows of either label, and words of a row, in drawn runs of ``run`` words.
    toxic_rows: int = 2500
    clean_rows: int = 6000
    words_a_row: int = 3000
    run: int = 40


# Letters and digits of any script; apostrophes and the like end a word.
_TABLE = bytes(32 if c < 48 or 58 <= c < 65 or 91 <= c < 97 or 123 <= c < 128 else c for c in range(256))


#: Bytes of the longest word; longer runs give pieces that overlap by half.
_LONG = 64


def tox_words(text: bytes) -> list[bytes]:
    words = text.translate(_TABLE).decode("utf-8", "replace").lower().encode().split()
    if max(map(len, words), default=0) <= _LONG:
        return words
    return [p for w in words for p in ([w] if len(w) <= _LONG else _pieces(w))]


def _pieces(word: bytes) -> list[bytes]:
    """Overlapping pieces of a long run, as of scripts without spaces; no character is split."""
    edge = lambda i: next(j for j in range(i, -1, -1) if j >= len(word) or word[j] & 0xC0 != 0x80)
    out, a, b = [], 0, 0
    while b < len(word):
        b = edge(min(len(word), a + _LONG))
        out.append(word[a:b])
        a = edge(a + _LONG // 2)
    return out


def subwords(word: bytes, s: Settings) -> list[int]:
    """Buckets of a word and its n-grams; grams are of bytes of <word>."""
    w = b"<" + word + b">"
    out = [zlib.crc32(w) % s.buckets]
    for n in s.grams:
        out += [zlib.crc32(w[i : i + n]) % s.buckets for i in range(len(w) - n + 1)]
    return out


#: Windows whose words are looked up at a time.
_AT_ONCE = 1 << 18


def _segments(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)


class Model:
    def __init__(self, s: Settings, embeddings: np.ndarray, softmax: np.ndarray, bias: np.ndarray, damp: dict[bytes, float] | None = None, scale: float = 1.0, shift: float = 0.0):
        self.s, self.damp, self.scale, self.shift = s, damp or {}, scale, shift
        # The logit between the two labels is all that scoring needs.
        self.weight = (embeddings @ (softmax[:, 1] - softmax[:, 0])).astype(np.float32)
        self.bias = float(bias[1] - bias[0])
        self.known: dict[bytes, float] = {}

    def word(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > 500_000:
            known.clear()
        new = list({w for w in words if w not in known})
        if new:
            bags = [subwords(w, self.s) for w in new]
            sizes = np.array([len(b) for b in bags])
            values = np.add.reduceat(self.weight[np.array([i for b in bags for i in b])], _segments(sizes)) / sizes
            values *= np.array([self.damp.get(w, 1.0) for w in new])
            known.update(zip(new, values.tolist()))
        return np.fromiter(map(known.__getitem__, words), np.float64, len(words))

    def logit(self, text: bytes) -> float:
        """Of the worst window of a whole text; windows overlap by all but one word."""
        return self.worst([self.word(tox_words(text))])

    def worst(self, runs: list[np.ndarray]) -> float:
        """The largest logit of all windows within runs of words' numbers; the bias if there are no words."""
        most = []
        for values in runs:
            if len(values):
                sums = np.concatenate([[0.0], np.cumsum(values)])
                w = min(self.s.window, len(values))
                most.append(float((sums[w:] - sums[:-w]).max()) / self.s.window + self.bias)
        return max(most, default=self.bias)

    def score(self, text: bytes) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.scale * self.logit(text) + self.shift, -60, 60))))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}


def _fit(s: Settings, vocabulary: list[bytes], words: list[np.ndarray], owner: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[bytes, float]]:
    """words: numbers of the words of each run; owner: the row that a run is of, ascending; label: of each row."""
    half = max(1, s.window // 2)
    counts = [max(1, -(-(len(w) - half) // half)) for w in words]
    run = np.repeat(np.arange(len(words)), counts)
    doc = owner[run]
    begin = np.concatenate([np.arange(n) * half for n in counts])
    size = np.minimum(s.window, np.array([len(w) for w in words])[run] - begin)
    place = np.concatenate([[0], np.cumsum([len(w) for w in words])])[run] + begin
    token = np.concatenate(words)[_spread(place, size)].astype(np.int32)
    start = _segments(size)
    share = np.bincount(token, minlength=len(vocabulary)) / len(token)
    damp = (s.common / (s.common + share)).astype(np.float32)
    flat, sizes = array("i"), []
    for w in vocabulary:
        flat.extend(own := subwords(w, s))
        sizes.append(len(own))
    bag, bag_size = np.array(flat, np.int32), np.array(sizes, np.float32)
    bag_start = _segments(bag_size)
    first = np.searchsorted(doc, np.arange(len(label)))
    rng = np.random.default_rng(7)
    params = [rng.normal(0, 0.1, (s.buckets, s.dims)).astype(np.float32), rng.normal(0, 0.5, (s.dims, 2)).astype(np.float32), np.zeros(2, np.float32)]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, s.warm + s.epochs + 1):
        e, u, b = params
        if step <= s.warm:
            use = np.sort(rng.permutation(len(doc))[: s.warm_windows])
        else:
            # Linear, so a window's logit needs one number a word; vectors are made for chosen windows alone.
            flat = np.add.reduceat((e @ (u[:, 1] - u[:, 0]))[bag], bag_start) * (damp / bag_size)
            logits = np.concatenate([np.add.reduceat(flat[token[start[a] : start[a + _AT_ONCE] if a + _AT_ONCE < len(start) else None]], start[a : a + _AT_ONCE] - start[a]) for a in range(0, len(start), _AT_ONCE)])
            worst = np.flatnonzero(logits == np.maximum.reduceat(logits, first)[doc])
            use = np.empty(len(first), np.int64)
            use[doc[worst]] = worst
        y = label[doc[use]]
        t, row = token[_spread(start[use], size[use])], np.repeat(np.arange(len(use)), size[use])
        seen, t = np.unique(t, return_inverse=True)
        at = bag[_spread(bag_start[seen], bag_size[seen].astype(int))]
        vec = np.add.reduceat(e[at], _segments(bag_size[seen])) * (damp / bag_size)[seen, None]
        mean = np.add.reduceat(vec[t], _segments(size[use])) / s.window
        z = mean @ u + b
        p = 1 / (1 + np.exp(-np.clip(z[:, 1] - z[:, 0], -30, 30)))
        balance = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
        g = ((p - y) * balance).astype(np.float32)
        dz = np.stack([-g, g], axis=1)
        dm = dz @ u.T / s.window
        dvec = np.stack([np.bincount(t, dm[row, k], len(seen)) for k in range(s.dims)], axis=1) * (damp / bag_size)[seen, None]
        back = np.repeat(np.arange(len(seen)), bag_size[seen].astype(int))
        de = np.stack([np.bincount(at, dvec[back, k], s.buckets) for k in range(s.dims)], axis=1)
        for k, d in enumerate((de + s.decay * e, mean.T @ dz + s.decay * u, dz.sum(axis=0))):
            m[k] = 0.9 * m[k] + 0.1 * d
            v[k] = 0.99 * v[k] + 0.01 * d * d
            params[k] = (params[k] - s.rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    common = np.flatnonzero(damp < 0.98)
    return params[0], params[1], params[2], {vocabulary[i]: float(damp[i]) for i in common}


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def _place(logit: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift of a logistic fit by Newton steps, lightly held."""
    x = np.stack([logit, np.ones_like(logit)], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        w -= np.clip(np.linalg.solve(h, x.T @ (p - y) + 1e-2 * w), -5, 5)
    return float(max(w[0], 1e-3)), float(w[1])


def drawn_runs(text: bytes, s: Settings) -> list[list[bytes]]:
    """All words of a text as one run, or runs drawn over all of it if it has more than ``words_a_row``."""
    words = tox_words(text)
    if len(words) <= s.words_a_row:
        return [words]
    starts = np.random.default_rng(zlib.crc32(text)).choice(len(words) // s.run, max(1, s.words_a_row // s.run), replace=False)
    return [words[a * s.run : (a + 1) * s.run] for a in sorted(starts.tolist())]


class Numbers(dict):
    """word -> its number, by first appearance."""

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter((self.setdefault(w, len(self)) for w in words), np.int32, len(words))


def train(texts: list[bytes], labels: list[int], s: Settings = Settings()) -> Model:
    """Fit on (text, 0/1) rows; with a label missing, the model scores every text by the share of ones."""
    numbers = Numbers()
    return train_runs([[numbers.of(r) for r in drawn_runs(t, s)] for t in texts], list(numbers), labels, s)


def train_runs(rows: list[list[np.ndarray]], vocabulary: list[bytes], labels: list[int], s: Settings) -> Model:
    """As train(), of rows that are cut into runs of numbers of words already."""
    y = np.array(labels, np.float64)
    has = np.array([any(len(r) for r in runs) for runs in rows], bool)
    if len(y) == 0 or not has.any() or len(set(y[has])) < 2:
        share = float(np.clip(y.mean() if len(y) else 0.0, 0.01, 0.99))
        return Model(s, np.zeros((s.buckets, 1)), np.zeros((1, 2)), np.zeros(2), None, 0.0, float(np.log(share / (1 - share))))
    # Every fourth row of each label places the logits; the others train the embeddings.
    turn = np.zeros(len(y), np.int64)
    for value in (0, 1):
        turn[y == value] = np.arange(int((y == value).sum())) % 4
    fit = np.flatnonzero(has & ((turn != 3) | (min((y == 0).sum(), (y == 1).sum()) < 8)))
    if len(set(y[fit])) < 2:
        fit = np.flatnonzero(has)
    runs = [(k, run) for k, i in enumerate(fit.tolist()) for run in rows[i] if len(run)]
    made = Model(s, *_fit(s, vocabulary, [run for _, run in runs], np.array([k for k, _ in runs]), y[fit]))
    held = np.flatnonzero(turn == 3) if (turn == 3).any() and len(set(y[turn == 3])) == 2 else np.arange(len(y))
    value = made.word(vocabulary)
    made.scale, made.shift = _place(np.array([made.worst([value[run] for run in rows[i]]) for i in held]), y[held])
    made.known = {}
    return made


def training_rows(docs: DataFrame, labels: DataFrame, s: Settings) -> DataFrame:
    """At most ``toxic_rows`` and ``clean_rows`` rows, the first by a hash of the id; held-out ids left out.

    A document labelled twice counts once, by its largest label; null labels, ids and texts give no row."""
    marked = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    learn = marked.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) != 1)
    order = (F.xxhash64("doc_id", F.lit("toxic")), F.col("doc_id"))
    parts = [learn.where(F.col("toxic") == value).orderBy(*order).limit(n) for value, n in ((0, s.clean_rows), (1, s.toxic_rows))]
    chosen = parts[0].unionByName(parts[1])
    # Repeated ids give one text, so the sample's size is bound by its parameters.
    texts = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def held_out() -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fit_model(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    """Trained by one task on the rows of training_rows(), in the order of their ids."""
    import pickle

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            runs = [b"\n".join(b" ".join(run) for run in drawn_runs(x, s)) for x in as_bytes(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(runs, pa.binary())], names=["doc_id", "toxic", "runs"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((x for b in batches for x in zip(*(c.to_pylist() for c in b.columns))), key=lambda x: x[:2])
        numbers = Numbers()
        runs = [[numbers.of(run.split()) for run in x[2].split(b"\n")] for x in rows]
        model = train_runs(runs, list(numbers), [x[1] for x in rows], s)
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(model)], pa.binary())})

    rows = training_rows(docs, labels, s).select(F.col("doc_id").cast("string").alias("doc_id"), "toxic", "text")
    made = rows.mapInArrow(cut, "doc_id string, toxic int, runs binary").repartition(1).mapInArrow(fit, "model binary").collect()
    return pickle.loads(made[0].model) if made else train([], [], s)


def with_score(docs: DataFrame, model: Model, column: str = "toxicity", text_col: str = "text") -> DataFrame:
    """docs with a score for every row's whole text, however long (null: empty). A column of that name is replaced;
    repeated rows score alike, an empty table gives none."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select([c for c in docs.columns if c != column])
    schema = StructType([*kept.schema.fields, StructField(column, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in small_batches(batches, text_col):
            scores = [m.score(x or b"") for x in as_bytes(batch.column(batch.schema.get_field_index(text_col)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, column])

    return kept.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted. A null doc_id isn't held out; it has no label.

    Words of over 64 bytes are read as pieces that overlap by half, so nothing of a long text or word is left
    out. Empty texts score by the model's bias. Other columns, of any name, aren't read."""
    scored = with_score(docs.select("doc_id", "text"), fit_model(docs, labels), "score")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
