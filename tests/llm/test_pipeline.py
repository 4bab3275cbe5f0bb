"""The pipeline's stages, each on its own input, against brute force."""

import collections

import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F

from skein.llm import toxicity
from test_operators import group_brute, line_brute

DATA = "/root/testdata/sf0.001"
#: Names that operators use for columns of their own.
CLASH = "doc_id long, text string, score double, n_words long, n_hit long, items string, spans string, lines string, stay string, own string, n_chars long, `a b` int, kept boolean, grp long"
LONG = "a much longer text of many words " * 3000


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, 7.0, 77, 78, "x", "y", "z", "s", "o", -1, 3, False, k) for k, (i, t) in enumerate(rows)], CLASH)


ROWS = [(1, None), (2, ""), (3, " \n\t "), (4, "one two three four five six"), (4, "one two three four five six"), (None, "nobody has this one but me alone"), (6, "one two three four five six"), (7, LONG), (8, "字" * 400), (9, "tie a b c d e\ntie a b c d e")]


def words(text):
    return [w for w in "".join(c if c.isalnum() or ord(c) > 127 else " " for c in (text or "")).lower().split() if w]


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (name, stage) in enumerate(cp.STAGES):
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        if k < len(cp.STAGES) - 1:
            assert docs.columns == columns
        if name == "toxicity":
            model = toxicity.fit_model(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet"))
            assert after == {i: t for i, t in rows if model.score((t or "").encode()) < 0.7}
        if name == "line_dedup":
            gone = {i: set(map(int, filter(None, x.split(",")))) for i, x in line_brute(rows)}
            left = {i: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i]) for i, t in rows}
            assert after == {i: t for i, t in left.items() if t.strip() or not dict(rows)[i].strip()}
        if name == "near_dedup":
            groups = group_brute(rows, 5, 80)
            assert after == {i: t for i, t in rows if groups[i][1] == i}
        if name == "decontamination":
            bench = [words(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
            phrases = {tuple(w[i : i + 10]) for w in bench if w for i in range(max(1, len(w) - 9))}
            sizes = {len(p) for p in phrases}
            want = {}
            for i, t in rows:
                w = words(t)
                hit = {j for n in sizes for a in range(len(w) - n + 1) if tuple(w[a : a + n]) in phrases for j in range(a, a + n)}
                if len(hit) < len(w) or not w:
                    want[i] = [x for j, x in enumerate(w) if j not in hit]
            assert {i: words(t) for i, t in after.items()} == want
        assert 0 < docs.count() <= before
        before = docs.count()
    assert docs.where("not decoded_equal").count() == 0 and after == dict(rows) and docs.select("doc_id").distinct().count() == docs.count()


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_odd_rows_and_clashing_columns(spark, name):
    stage, docs = dict(cp.STAGES)[name], clashing(spark, ROWS)
    out = stage(spark, docs, DATA)
    assert stage(spark, docs.limit(0), DATA).count() == 0
    got = out.collect()
    texts = collections.Counter((r.doc_id, r.text) for r in got)
    if name == "pieces":
        assert texts == collections.Counter((i, t or "") for i, t in ROWS) and all(r.decoded_equal for r in got)
        return
    assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    assert all((r.score, r.n_words, r.n_hit, r["items"], r.spans, r.lines, r.stay, r.own, r["a b"], r.kept) == (7.0, 77, 78, "x", "y", "z", "s", "o", 3, False) and ROWS[r.grp][0] == r.doc_id for r in got)
    if name in ("toxicity", "decontamination"):
        assert texts == collections.Counter(ROWS)
    if name == "line_dedup":
        # The id's two rows are one place and keep the line, later ones lose it; blank texts stay.
        kept = dict(ROWS) | {9: "tie a b c d e"}
        assert texts == collections.Counter({(i, t): 2 if i == 4 else 1 for i, t in kept.items() if i != 6})
    if name == "near_dedup":
        assert texts == collections.Counter({(i, t): 1 for i, t in ROWS if i != 6})
    if name in ("line_dedup", "decontamination"):
        assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)


def test_near_copies_that_share_an_id(spark):
    base = [f"w{i}" for i in range(60)]
    near = " ".join([*base[:59], "other"])
    rows = [(5, " ".join(base)), (5, near), (5, near), (6, near), (7, " ".join(base)), (8, "apart from all the others here")]
    got = cp.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), DATA).collect()
    assert sorted(r.doc_id for r in got) == [5, 8]
