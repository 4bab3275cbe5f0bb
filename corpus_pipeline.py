"""A corpus pipeline of five stages over ``documents``; each works on all that the one before kept.

Every stage but the last returns the columns of documents, whatever other columns there are and whatever
their names. ORACLE_SQL is None: the toxicity model and the LSH forest are no SQL; tests hold the stages
after the first against brute force, and the first against its own model.

In every stage an empty table gives an empty one, texts are read whole however long, and repeated rows
are rows of their own unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import decontam, linededup, lshforest, toxicity, unigram
from skein.llm.queries import tokenizer_file
from skein.llm.workspace import Workspace

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go. The model learns from labels outside of the held-out third.

    Null and empty texts score by the model's bias; null ids have no label but a score. Without labels all
    documents score alike, below 0.7."""
    model = toxicity.fit_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.with_score(boxed(docs), model, "score")
    return unboxed(scored.where("score < 0.7"), docs)


def drop_similar_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines with a similarity of 0.8 or more to an earlier line go, and documents that lose all their lines.

    Null, empty and blank texts stay as they are. Null ids come first. Repeated rows (id and text) are one
    place: they keep the same lines."""
    return with_sizes(linededup.without_similar_lines(docs, 80))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, the one with the least (id, text hash). Shingles are of five words.

    Of rows that repeat id and text one stays. Null, empty and blank texts are in no group; they stay, one
    row for each id and text. Rows with a null id stay only where no row of their group has an id."""
    groups = Workspace(spark, "near").table(lshforest.near_groups(docs, k=5, percent=80).where("kept"), "kept")
    first = groups.where("n_shingles > 0").groupBy("grp").agg(F.min(F.struct("doc_id", "text_hash", F.lit(1).alias("one"))).alias("k")).select("k.doc_id", "k.text_hash")
    keys = first.unionByName(groups.where("n_shingles = 0").select("doc_id", "text_hash")).distinct().withColumnsRenamed({"doc_id": "k_id", "text_hash": "k_th"})
    rows = boxed(docs).select("own", "text", F.col("own.doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("th"))
    kept = rows.join(keys, rows["id"].eqNullSafe(keys["k_id"]) & (rows["th"] == keys["k_th"]), "left_semi")
    # Texts are sorted by id only where some row is repeated.
    if not groups.groupBy("doc_id", "text_hash").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["id", "th"])
    return unboxed(kept, docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents without a word left go, those without any before stay."""
    found = decontam.find_passages(boxed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10, cut=True)
    return with_sizes(unboxed(found.where("n_words = 0 or n_hit < n_words"), docs))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, n_byte_pieces, ids_crc32, decoded_equal, ids and the text decoded from them.

    A null text is encoded as an empty one, to no pieces, and decoded as that."""
    coded = unigram.with_pieces(docs.select("doc_id", "text"), tokenizer_file("piece_bpe_32k.model"))
    return coded.select("doc_id", "n_pieces", "n_byte_pieces", "ids_crc32", "decoded_equal", "ids", F.col("decoded").alias("text"))


def boxed(docs: DataFrame) -> DataFrame:
    """A row's other columns in one, beside its text, so that no name meets one of an operator's."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("own"), "text")


def unboxed(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs again, with the text beside the box."""
    return rows.select(*(F.col("text") if c == "text" else F.col(f"own.`{c}`").alias(c) for c in docs.columns))


def with_sizes(docs: DataFrame) -> DataFrame:
    """n_chars, where the table has it, follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_similar_lines), ("near_dedup", drop_near_copies), ("decontamination", cut_benchmark), ("pieces", encode_pieces)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = work.table(stage(spark, docs, sf_dir), name)
    return docs
