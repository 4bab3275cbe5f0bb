"""Operators of the llm subpackage against brute force, round trips and edge cases."""

import collections
import hashlib
import json
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import decontam, linededup, lshforest, maxent, tokenfile, toolcalls, topk, toxicity, unigram, warc
from skein.llm.components import components
from skein.llm.queries import tokenizer_file
from skein.llm.words import alnum_words, emptied, few_rows, shingles, small_batches, space_words
from skein.llm.workspace import Workspace

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, text2 string"
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (4, "a"), (None, "x y z"), (5, "x y z"), (6, "Ünïcode 字 ▁ 😀\r\nz  z"), (7, "one two three four " * 400), (8, "w" * 3000)]


def odd(spark):
    return spark.createDataFrame([(i, t, "extra") for i, t in ODD], DOCS)


def none(spark):
    return spark.createDataFrame([], DOCS)


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def test_words():
    assert space_words("Ab \tÉc\n".encode()) == [b"ab", "Éc".encode()]
    assert alnum_words("a-B2 É!".encode()) == [b"a", b"b2", "É".encode()]
    assert len(shingles(np.array([], np.uint64), 2)) == 0 and len(shingles(np.array([5], np.uint64), 2)) == 1
    assert len(shingles(np.array([1, 2, 1, 2], np.uint64), 2)) == 2


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(1000, i) for i in range(1001, 1200)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "t")).collect()
    assert {r.node: r.root for r in got} == {x: find(x) for x in list(up)} and len(got) == len(up)


def test_topk_odd_rows(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.5]), (0, [1.0, 0.5]), (50, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [1.0, nan]), (3, None), (4, [1.0, None]), (5, [-2.0, 1.0]), (100, [1.0, 2.0, 3.0]), (6, [0.0, 0.0, 1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_products(df).collect()]
    assert sorted(got) == [(0, 1, 1, 81920), (0, 2, 50, 81920), (0, 3, 5, -98304), (50, 1, 0, 81920), (50, 2, 1, 81920), (50, 3, 5, -98304), (100, 1, 6, 196608)]
    assert topk.top_products(df.limit(0)).count() == 0


def test_topk_exact(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(900, 8)), np.repeat(rng.normal(size=(1, 8)), 300, axis=0)]).astype(np.float32)
    q = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_products(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")).collect()}
    for i in range(0, len(x), 50):
        s = q @ q[i]
        best = [j for j in np.lexsort((np.arange(len(x)), -s)) if j != i][:5]
        assert [got[i, r + 1] for r in range(5)] == [(j, s[j]) for j in best]


def test_topk_of_huge_values(spark):
    rows = [(0, [1e300, 1.0]), (1, [1e300, -1.0]), (2, [-1e300, 0.0]), (3, [2.0, 1.0])]
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()]
    assert sorted(got) == [(0, 1, 1, 2**63 - 1), (0, 2, 3, 2**63 - 1), (0, 3, 2, -(2**63))]


def test_workers_keep_no_cache_after_a_task():
    import pyarrow as pa

    cache = lshforest._words
    lshforest.text_shingles(b"one two three", 2)
    assert cache
    batch = pa.RecordBatch.from_pydict({"text": ["ab" * 40, None, "é" * 30, ""] * 50})
    rows = [b.column(0).to_pylist() for b in lshforest._clean(lambda x: few_rows(x, 64))(iter([batch]))]
    assert not cache and [len(r) for r in rows] == [64, 64, 64, 8] and sum(rows, []) == batch.column(0).to_pylist()
    cut = list(small_batches(iter([batch]), "text", 1000))
    assert len(cut) > 5 and [x for b in cut for x in b.column(0).to_pylist()] == batch.column(0).to_pylist()
    seen = {1: 2}
    left = emptied(lambda x: x, seen)(iter([batch]))
    next(left)
    left.close()
    assert not seen


def test_topk_sample_sends_few_rows(spark):
    """However many tasks there are, the driver gets about twice the sample, and range keys without vectors."""
    x = spark.range(0, 20000, 1, 40).select(F.array(F.col("id"), F.col("id") * 7).alias("vec"))
    want = x.orderBy(F.xxhash64("vec"), "vec").limit(300).collect()
    assert topk.least_hashes(x, 20000, 300).collect() == want
    assert topk.few_hashes(x, 20000, 300).count() < 900 and topk.few_hashes(x, 600, 300).count() == 20000


def test_topk_best_of():
    rng = np.random.default_rng(1)
    s, names, ids = rng.integers(0, 9, (20, 60)), rng.permutation(60), np.arange(20)
    for best in (np.full(20, -np.inf), np.full(20, 7.0)):
        got = list(zip(*(x.tolist() for x in topk.best_of(s, names, ids, best, 5))))
        for i in range(20):
            rows = sorted((-s[i, j], names[j]) for j in range(60) if names[j] != i and s[i, j] >= best[i])[:5]
            assert [(i, n, -v) for v, n in rows] == [g for g in got if g[0] == i]


def test_warc(spark):
    long = "é" * 600
    rows = [(1, "http://a/\r\nx y", long), (2, None, long), (9, "http://c", long), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (None, "u", long), (6, "u", "\r\n\r\n" * 300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for limit in (10**6, 0):
        work = Workspace(spark, "warc")
        records = warc.read_archives(warc.write_archives(warc.resolve_revisits(pages, broadcast_rows=limit), work))
        got = {r.page_id: r for r in warc.resolved_records(records).collect()}
        assert len(got) == 8 and {i for i, r in got.items() if r.record_type == "revisit"} == {1, 2, None}
        assert all(got[i].refers_to == 9 and got[i].payload_bytes == 1200 for i in (1, 2, None))
        assert got[5].payload_bytes == 0 and got[6].payload_digest == hashlib.sha1(b"\r\n\r\n" * 300).hexdigest()
    assert warc.revisit_report(pages.limit(0)).count() == 0


def test_canonical_json():
    assert toolcalls.canonical({"b": [1.0, 1e21, 1e-7, 0.000001, -0.5], "a": None, "é": "\n\u2028"}) == '{"a":null,"b":[1,1e+21,1e-7,0.000001,-0.5],"é":"\\n\u2028"}'
    schema = {"type": "object", "required": ["x"], "additionalProperties": False, "properties": {"x": {"type": "integer", "minimum": 1}, "y": {"type": "array", "items": {"enum": ["a"]}}}}
    assert toolcalls.schema_errors({"x": 2, "y": ["a"]}, schema) == []
    assert toolcalls.schema_errors({"x": 0, "y": ["b"], "z": 1}, schema) == ["$.z: additional", "$.x: minimum", "$.y[0]: enum"]
    assert toolcalls.schema_errors({"x": True}, schema) == ["$.x: type"] and toolcalls.schema_errors({}, schema) == ["$.x: required"]


def test_tool_calls(spark):
    args = json.dumps({"n": 1})
    calls = [(1, "a", 0, "t", args, ["b"]), (1, "b", 5, "t", args, []), (1, "c", 2, "t", "{", None), (1, "d", 9, "t", args, ["e"]), (1, "e", 9, "t", args, ["d"]), (1, "f", 10, "u", args, ["e", "gone"]), (1, "a", 7, "t", args, []), (1, None, 1, "t", args, []), (2, "a", 0, "t", None, ["a"])]
    results = [(1, "a", 3, "late"), (1, "a", 1, "first"), (1, "z", 1, None), (None, "a", 1, "x")]
    got = {(r.conv_id, r.call_id): r for r in toolcalls.link_calls(spark.createDataFrame(calls, "conv_id long, call_id string, seq long, name string, arguments string, after array<string>"), spark.createDataFrame(results, "conv_id long, call_id string, seq long, content string"), {"t": {"type": "object"}}, Workspace(spark, "c")).collect()}
    assert {k: (r.status, r.position, r.valid) for k, r in got.items()} == {(1, "a"): ("linked", 2, True), (1, "b"): ("unanswered", 1, True), (1, "c"): ("unanswered", 0, False), (1, "d"): ("unanswered", None, True), (1, "e"): ("unanswered", None, True), (1, "f"): ("unanswered", None, False), (1, "z"): ("orphan", None, None), (2, "a"): ("unanswered", 0, False)}
    # Each call depends on the next; two calls at the chain's other end are a cycle that a last one waits for.
    chain = [(7, f"c{i}", i, "t", args, [f"c{i + 1}"]) for i in range(25)] + [(7, "c25", 25, "t", args, [])] + [(7, "x", 1, "t", args, ["y"]), (7, "y", 2, "t", args, ["x"]), (7, "z", 3, "t", args, ["x", "c3"])]
    work = Workspace(spark, "c")
    linked = toolcalls.link_calls(spark.createDataFrame(chain, "conv_id long, call_id string, seq long, name string, arguments string, after array<string>"), spark.createDataFrame([], "conv_id long, call_id string, seq long, content string"), {"t": {}}, work)
    assert {r.call_id: r.position for r in linked.collect()} == {f"c{i}": 25 - i for i in range(26)} | {"x": None, "y": None, "z": None}
    assert got[1, "a"].json == '{"after":["b"],"arguments":{"n":1},"id":"a","name":"t","result":"first"}' and got[1, "a"].n_calls == 2


def test_fm_index():
    rng = np.random.default_rng(3)
    text = rng.integers(0, 4, 600)
    text[-1] = 0
    index = decontam.FMIndex(text, 4)
    for size in (1, 2, 5):
        phrases = rng.integers(1, 4, (40, size))
        lo, hi = index.search(phrases, np.full(40, size))
        for p, a, b in zip(phrases, lo, hi):
            want = [i for i in range(len(text) - size + 1) if (text[i : i + size] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_decontamination(spark):
    passage = " ".join(f"w{i}" for i in range(14))
    bench = spark.createDataFrame([(1, passage), (2, "Tiny-Item"), (3, None), (4, ""), (2, "tiny item"), (10, passage)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x {passage.upper()} y", ""), (2, "a tiny, ITEM b tiny c", ""), (3, None, ""), (4, " ".join(f"w{i}" for i in range(9)), ""), (None, passage, "")], DOCS)
    for size in (1 << 20, 30):
        got = {r.doc_id: r for r in decontam.find_passages(docs, bench, slice_bytes=size, cut=True).collect()}
        assert {k: (r.n_words, r.n_hit, r["items"]) for k, r in got.items()} == {1: (16, 14, ["1", "10"]), 2: (6, 2, ["2"]), 3: (0, 0, []), 4: (9, 0, []), None: (14, 14, ["1", "10"])}
        assert got[1].text == "x \n y" and got[2].text == "a \n b tiny c" and got[3].text is None
    assert decontam.contamination(none(spark), bench).count() == 0
    assert decontam.contamination(odd(spark), bench.limit(0)).where("contaminated").count() == 0


def test_elias_fano():
    rng = np.random.default_rng(1)
    for values in ([], [0], [0, 0, 0], [7], np.sort(rng.integers(0, 10**9, 3000)), np.arange(5000)):
        ef = tokenfile.EliasFano.from_bytes(tokenfile.EliasFano.encode(np.array(values, np.int64)).to_bytes())
        assert ef.all().tolist() == list(values) and all(ef.select(i) == values[i] for i in range(0, len(values), 37))
        assert all(ef.values(i, j).tolist() == list(values[i:j]) for i in range(0, len(values), 211) for j in (i, i + 1, min(len(values), i + 700), len(values)) if i <= j <= len(values))
        # What is kept beside the code: a pair of numbers for each 256 values.
        assert ef._sampled().size <= 2 * (len(values) // 256 + 1)


def test_token_files(spark):
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    rows = [(i, t) for i, t in ODD] + [(-5, "<|endoftext|>a b'll \u00a0 c"), (99, "don't e\u0301 \u0301x")]
    manifest = tokenfile.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path, 2, Workspace(spark, "tok"))
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in tokenfile.read_tokens(manifest).collect()))
    assert [g[1] is None for g in got] == [True] + [False] * (len(rows) - 1) and [g[1] for g in got[1:]] == sorted(i for i, _ in rows if i is not None)
    want = collections.Counter((i, zlib.crc32(np.array([*own.encode(t or "", add_special_tokens=False).ids, 2], "<u4"))) for i, t in rows)
    assert collections.Counter((g[1], g[3]) for g in got) == want
    assert all(a[0] + a[2] == b[0] for a, b in zip(got, got[1:])) and got[0][0] == 0
    with pytest.raises(ValueError):
        tokenfile.write_tokens(odd(spark), path, 1 << 16, Workspace(spark, "tok"))
    shard = tokenfile.TokenShard(manifest.first().path)
    assert shard.ids(shard.n_docs - 1)[-1] == 2
    assert tokenfile.read_tokens(tokenfile.write_tokens(none(spark), path, 2, Workspace(spark, "tok"))).count() == 0


def test_whole_texts_for_other_tokenizers(tmp_path):
    assert tokenfile.drops_space(tokenizer_file("word_bpe_49k.json")) and not tokenfile.drops_space(tokenizer_file("byte_bpe_50k.json"))
    encoder = tokenfile.ChunkEncoder(tokenizer_file("byte_bpe_50k.json"))
    texts = ["a  b\n\nc", "", " x"]
    ids, sizes = encoder.encode([t.encode() for t in texts])
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def small_model(spark, texts, **settings):
    s = maxent.Settings(min_rows=256, **settings)
    corpus = maxent.Corpus(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), Workspace(spark, "lm"), s)
    return s, corpus, maxent.train(corpus)


def plain_mix(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) % 2**64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) % 2**64
    return x ^ (x >> 31)


def plain_probability(word, before, t, s, counts):
    """Of a word after the words before it, one feature at a time; t: the trained tables, counts: of training."""
    import xxhash

    rows = len(t.weights) // 2
    digest, shared = lambda w: xxhash.xxh3_64_intdigest(w), lambda w: zlib.crc32(w[-3:]) % 512
    own = {int(h): k for k, h in enumerate(t.own)}

    def cell(w):
        return own[digest(w)] if counts[w] and digest(w) in own else 512 + shared(w)

    key = lambda w: digest(w) if counts[w] * s.named * rows >= t.tokens else shared(w) + 11
    one = plain_mix(key(before[-1])) if before else 1
    two = plain_mix(key(before[-2])) if len(before) > 1 else 2
    keys = [one, plain_mix((one * 3 + two) % 2**64), (two * 5 + 7) % 2**64]
    softmax = lambda z: np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    p = softmax(t.weights[0].astype(float) + sum(t.weights[k % rows or 1].astype(float) for k in keys))
    cls, member = divmod(cell(word), 32)
    cross = [max(32, (((k + (cls + 1) * 0x9E3779B97F4A7C15) * 0xD1342543DE82EF95) % 2**64 >> 40) % rows) for k in (keys[0], keys[2])]
    q = softmax(t.weights[rows + cls].astype(float) + sum(t.weights[rows + k].astype(float) for k in cross))
    if cell(word) < 512:
        return p[cls] * q[member]
    within = [w for w in counts if counts[w] and cell(w) == cell(word)]
    return p[cls] * q[member] * (counts[word] + 1) / (sum(counts[w] for w in within) + len(within) + 1)


def test_language_model_by_hand(spark):
    rng = random.Random(5)
    names = [f"{a}{b}" for a in "ka lo mi ne ru so ti va wu xe".split() for b in (f"{i}{c}" for i in range(9) for c in "abcdefgh")]
    texts = [" ".join(w for _ in range(rng.randrange(60)) for w in (rng.choice(names[:40]), rng.choice(names)) ) for _ in range(60)]
    s, corpus, t = small_model(spark, texts)
    split = lambda x: [*x.encode().split(), b"\n"]
    counts = collections.Counter(w for i, x in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2 for w in split(x))
    got = {r.doc_id: r.score for r in maxent.score(corpus, t).collect()}
    for i in (0, 7, 23, 44):
        words = split(texts[i])
        assert got[i] == pytest.approx(sum(math.log10(plain_probability(w, words[:k], t, s, counts)) for k, w in enumerate(words)), abs=1e-3)
    # All words of training, and one unseen word of each shared member, have a probability of one together.
    ends = [next(w for w in (f"{k}".encode() for k in range(10**6)) if zlib.crc32(w[-3:]) % 512 == c) for c in range(512)]
    for before in ([], [b"ka0a"], [b"lo1b", b"never seen"]):
        total = sum(plain_probability(w, before, t, s, counts) for w in [*(w for w in counts if counts[w]), *ends])
        # Members that no word has are given next to nothing by the start.
        assert 0.99 < total <= 1 + 1e-6


def test_language_model_learns_history(spark):
    rng = random.Random(6)
    after = {f"w{i}": f"v{(7 * i) % 90}" for i in range(90)}
    texts = [" ".join(x for _ in range(150) for w in [rng.choice(list(after))] for x in (w, after[w])) for _ in range(80)]
    rows = [r for r in maxent.lm_scores(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect() if r.held_out]
    gain = sum(r.score - r.base_score for r in rows) / sum(r.n_tokens for r in rows)
    assert rows and gain > 0.3


def test_language_model(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").unionByName(odd(spark).selectExpr("doc_id + 10000 as doc_id", "text"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    split = lambda t: [*space_words((t or "").encode()), b"\n"]
    c = collections.Counter(w for i, t in rows if not held(i) for w in split(t))
    n, v = sum(c.values()), len(c)
    got = maxent.lm_scores(docs).collect()
    want = collections.Counter((i, held(i), len(split(t)), sum(c[w] > 0 for w in split(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in split(t)), 6)) for i, t in rows)
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert maxent.lm_scores(none(spark)).count() == 0


def test_unigram(spark):
    path = tokenizer_file("piece_bpe_32k.model")
    model = unigram.unigram_of(path)
    pieces = {p: i for i, p in enumerate(model.vocabulary.pieces) if p}

    def best(text):
        s = b" " + text
        top = [0.0] + [-math.inf] * len(s)
        for i in range(len(s)):
            if top[i] > -math.inf and s[i] & 0xC0 != 0x80:
                end = i + 1 + (s[i] >= 0xC0) + (s[i] >= 0xE0) + (s[i] >= 0xF0)
                for j in range(i + 1, min(len(s), i + 60) + 1):
                    if s[i:j] in pieces:
                        top[j] = max(top[j], top[i] + model.vocabulary.scores[pieces[s[i:j]]])
                if s[i:end] not in pieces:
                    top[end] = max(top[end], top[i] + model.unknown)
        return top[-1]

    rng = random.Random(2)
    samples = ["".join(rng.choices(["a", "the", " ", "\n", "▁", "é", "😀", "ing", "字", "  "], k=rng.randrange(1, 25))).encode() for _ in range(150)] + [b"word" * 60, b" ", b"\n \n"]
    for text, ids in zip(samples, model.encode(samples)):
        assert model.decode(ids) == text
        low_id = model.vocabulary.bytes_at
        plain, at, n_unknown = 0.0, 0, 0
        raw = b"".join(model.output[i] for i in ids.tolist())
        for i in ids.tolist():
            if low_id <= i < low_id + 256:
                n_unknown += raw[at] & 0xC0 != 0x80
                at += 1
            else:
                plain += model.vocabulary.scores[i]
                at += len(model.output[i])
        assert plain + n_unknown * model.unknown == pytest.approx(best(text))
    got = unigram.piece_report(odd(spark), path).collect()
    assert len(got) == len(ODD) and all(r.decoded_equal for r in got)
    assert unigram.with_pieces(none(spark), path).count() == 0


def line_brute(rows):
    seen, out = [], []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        gone = []
        for n, line in enumerate((text or "").split("\n")):
            s = frozenset(w for w in line.lower().replace("\t", " ").replace("\r", " ").split(" ") if w)
            if s and any(100 * len(s & t) >= 80 * len(s | t) for t in seen):
                gone.append(n)
            if s:
                seen.append(s)
        out.append((i, ",".join(map(str, gone))))
    return sorted(out, key=repr)


def test_line_dedup(spark):
    rng = random.Random(5)
    base = [f"t{i}" for i in range(30)]
    rows = [(i, "\n".join(" ".join(w if rng.random() < 0.93 else f"n{rng.randrange(99)}" for w in base[: rng.choice([4, 5, 10, 30])]) for _ in range(3))) for i in range(60)] + [(70, None), (71, ""), (72, "\n\n"), (73, "a b\n\nb a\n" + "long " * 5000)]
    got = linededup.line_report(spark.createDataFrame([(*r, "") for r in rows], "doc_id long, text string, stay string")).collect()
    assert sorted(((r.doc_id, r.removed_lines) for r in got), key=repr) == line_brute(rows)
    assert linededup.line_report(none(spark)).count() == 0
    kept = {r.doc_id: r for r in linededup.without_similar_lines(spark.createDataFrame([(1, "a b\n\nc", "k"), (2, "c\nd", "k"), (3, "b a", "k"), (4, "", "k"), (5, None, "k")], "doc_id long, text string, lines string")).collect()}
    assert {k: r.text for k, r in kept.items()} == {1: "a b\n\nc", 2: "d", 4: "", 5: None} and kept[2].lines == "k"


def test_similar_lines_of_all_lengths(spark):
    rng = random.Random(11)
    rows, n = [], 0
    for size in (8, 70, 85, 140, 400):
        base = [f"s{size}w{i}" for i in range(size)]
        for copy in range(24):
            # Up to two in nine words differ, around the limit; order and case don't count.
            words = [w if rng.random() > rng.choice([0, 0.05, 0.1, 0.12]) else f"x{rng.randrange(10**6)}" for w in base]
            rng.shuffle(words)
            rows.append((n := n + 1, " ".join(words).upper() if copy % 2 else " ".join(words)))
    got = linededup.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.removed_lines) for r in got), key=repr) == line_brute(rows)


def test_line_dedup_hashes_words_once_and_reports_without_rewriting(spark):
    docs = spark.createDataFrame([(1, "a\tb\n\t\r \x0b\f\nb  a"), (2, "\x0bB\rA\f\n\nc"), (3, "\t\n")], "doc_id long, text string")
    report = linededup.line_report(docs)
    assert sorted((r.doc_id, r.n_lines, r.removed_lines) for r in report.collect()) == [(1, 3, "2"), (2, 3, "0"), (3, 2, "")]
    plan = lambda df: df._jdf.queryExecution().analyzed().toString()
    assert "replace(" not in plan(report)
    sets = linededup.SimilarLines(docs)
    assert "hash(" not in plan(sets._features(sets._distinct(linededup.plain_lines(docs))))


def test_toxicity():
    rng = random.Random(4)
    bad, plain = ["idiot", "moron", "scumbag"], [f"{a}{b}" for a in "ka lo mi ne".split() for b in "ra to vu sel dor".split()]
    spelled = lambda w: w if rng.random() < 0.6 else w[:2] + rng.choice("xzq") + w[2:]

    def text(toxic):
        words = [rng.choice(plain) for _ in range(rng.randrange(20, 60))]
        if toxic:
            words[rng.randrange(len(words))] = spelled(rng.choice(bad))
        return " ".join(words).encode()

    rows = [(text(i % 3 == 0), int(i % 3 == 0)) for i in range(900)]
    model = toxicity.train([t for t, _ in rows[:600]], [y for _, y in rows[:600]], toxicity.Settings(epochs=60))
    right = sum((model.score(t) >= 0.7) == bool(y) for t, y in rows[600:])
    assert right >= 285
    assert 0 <= toxicity.train([], []).score(b"") <= 1 and 0 <= model.score(b"") <= 1 and toxicity.train([b"a"], [0]).score(b"a") < 0.7


def test_toxicity_reads_long_runs():
    for run in ("字" * 500, "aé😀" * 200, "x" * 65, "x" * 64):
        pieces = toxicity.tox_words(run.encode())
        assert all(len(p) <= 64 and p.decode() for p in pieces)
        # Every place is read: each run of eight characters stands whole in a piece.
        assert all(any(run[i : i + 8].encode() in p for p in pieces) for i in range(len(run) - 7))
    assert pieces == [b"x" * 64]
    rng = random.Random(7)
    plain = [f"{a}{b}" for a in "ka lo mi ne".split() for b in "ra to vu sel dor".split()]
    rows = [(" ".join([*rng.choices(plain, k=20), *["scumbag"] * (i % 2)]).encode(), i % 2) for i in range(300)]
    model = toxicity.train([t for t, _ in rows], [y for _, y in rows], toxicity.Settings(epochs=40))
    head = "".join(rng.choices(plain, k=60))
    assert model.logit((head + "scumbag" + head).encode()) > model.logit((head + head).encode()) + 1e-3
    assert model.logit((head + "scumbag").encode()) > model.logit(head.encode()) + 1e-3


def test_toxicity_rows(spark):
    labels = spark.createDataFrame([(4, 1, 1), (5, 0, 0), (5, 0, 0), (7, 0, 0), (None, 0, 1), (8, 0, None)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(odd(spark), labels).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.toxicity(none(spark), labels).count() == 0 and toxicity.toxicity(odd(spark), labels.limit(0)).count() == len(ODD)


def group_brute(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = [x for x in low(t or "").translate({9: " ", 10: " ", 11: " ", 12: " ", 13: " "}).split(" ") if x]
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in sets:
            if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_near_groups(spark):
    rng = random.Random(6)
    hub = [f"h{i}" for i in range(60)]
    # The copies are each close to the hub, mostly not to each other; the hub's id isn't the least.
    rows = [(50, " ".join(hub))] + [(i, " ".join(w if rng.random() > 0.045 else f"x{rng.randrange(10**6)}" for w in hub)) for i in range(150) if i != 50]
    rows += [(200, "one"), (201, "ONE"), (202, ""), (203, None), (204, "one two"), (205, " ".join(hub)), (206, "w " * 20000)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in lshforest.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == group_brute(rows, 2, 80)
    assert lshforest.near_groups(none(spark)).count() == 0
    assert lshforest.near_groups(odd(spark)).count() == len(ODD)


def test_near_copies_without_ids(spark):
    rng = random.Random(8)
    texts = []
    for g in range(12):
        base = [f"g{g}w{i}" for i in range(120)]
        texts += [" ".join(base[:j] + [f"x{g}y{j}"] + base[j + 1 :]) for j in rng.sample(range(120), 5)]
    key = [lshforest.set_key(lshforest.text_shingles(t.encode(), 2)) for t in texts]
    # In every group the least node has no id; in half of them only one row has one, in two none has.
    rows = []
    for g in range(12):
        order = sorted(range(5 * g, 5 * g + 5), key=key.__getitem__)
        rows += [(None if n == 0 or g >= 10 or (g % 2 and n < 4) else 100 * g + n, texts[i], g) for n, i in enumerate(order)]
    rows += [(None, rows[0][1], 0), (None, "alone without id", 99)]
    got = lshforest.near_groups(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()
    least = {g: min((i for i, _, h in rows if h == g and i is not None), default=None) for _, _, g in rows}
    count = lambda x: collections.Counter(x)
    assert count((r.doc_id, r.component_id, r.kept) for r in got) == count((i, least[g], i == least[g]) for i, _, g in rows)


def test_deep_runs():
    rng = np.random.default_rng(1)
    n = 3 * lshforest.DENSE
    path = np.zeros((n, lshforest.DEPTH), np.uint16)
    path[:, lshforest.BASE :] = np.sort(rng.integers(0, 9, (n, 3)), axis=0)
    links = lshforest.Links()
    lshforest.run_links(path, np.arange(n), np.zeros((n, 3), np.uint64), 10, links)
    assert {links.find(i) for i in range(n)} == {0}


def crowd(n, seed=3):
    """n unlike rows that share their first eight steps, with pairs (i, i + n // 2) of 30 of 160 bits apart for i < 40."""
    rng = np.random.default_rng(seed)
    bits = rng.integers(0, 2, (n, 192), np.uint8)
    bits[:, 160:] = 0
    for i in range(40):
        bits[n // 2 + i] = bits[i]
        bits[n // 2 + i, rng.permutation(160)[:30]] ^= 1
    return np.packbits(bits, axis=1).view(np.uint64)


def test_dense_run_is_compared_whole():
    n = 6000
    links = lshforest.Links()
    lshforest.run_links(np.zeros((n, lshforest.DEPTH), ">u2"), np.arange(n), crowd(n), lshforest.sketch_limit(0.8), links)
    assert all(links.find(i) == links.find(n // 2 + i) for i in range(40))
    assert len({links.find(i) for i in range(n)}) > n - 100


def test_dense_run_across_tasks(spark, monkeypatch):
    # All rows share every min-hash's path, so each tree is one run, which tasks' ends cut; blocks are small.
    monkeypatch.setattr(lshforest, "_BLOCK", 300, raising=False)
    monkeypatch.setattr(lshforest, "paths_of", lambda least: np.zeros((1, 8), ">u2"))
    monkeypatch.setattr(lshforest, "TREES", 1)
    rng = random.Random(9)
    texts = [" ".join(f"w{i}_{j}" for j in range(60)) for i in range(900)]
    for i in range(30):
        words = texts[i].split()
        for j in rng.sample(range(60), 2):
            words[j] = f"other{i}_{j}"
        texts[450 + i] = " ".join(words)
    # As many tasks as shuffle partitions, whatever the size of the table.
    with_aqe = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = {r.doc_id: r.component_id for r in lshforest.near_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", with_aqe)
    assert got == {i: i - 450 if 450 <= i < 480 else i for i in range(900)}
