"""A corpus pipeline: quality, line dedup, near dedup, decontamination, tokens.

Each stage takes the documents that the one before kept, as a table written
and read again, and returns them with its decisions taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patternweave.llm import bpe, decontamination, line_dedup, near_copies, quality, queries, runtime


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns as ``rest``, so that their names can't clash with an operator's."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("none"), *(F.col(c).alias(f"_{k}") for k, c in enumerate(others))).alias("rest"))


def unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` again."""
    others = iter([c for c in docs.columns if c not in ("doc_id", "text")])
    place = {c: k for k, c in enumerate(others)}
    return rows.select(*(F.col(c) if c in ("doc_id", "text") else F.col(f"rest._{place[c]}").alias(c) for c in docs.columns))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go: those with a calibrated score under ``quality.GOOD``.  Learns from labels of the documents given."""
    labels = runtime.load(spark, sf_dir, "labels")
    vectors, net = quality.fit(docs, labels.where(runtime.held("doc_id", 5) != 0))
    return unpacked(quality.score(packed(docs), vectors, net).where(F.col("score") >= quality.GOOD), docs)


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines are cut out; a document that this empties goes."""
    cut = unpacked(line_dedup.dedup_lines(packed(docs)).where(~F.col("emptied")), docs)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))
    return cut


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, five-word shingles at a similarity of 0.8 or more, the document of least id stays."""
    return near_copies.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of any benchmark item go."""
    rows = packed(docs).select(F.struct("doc_id", "rest").alias("doc_id"), "text")
    found = decontamination.decontaminate(rows, runtime.load(spark, sf_dir, "benchmark")).where(F.size("spans") == 0)
    return unpacked(found.select("doc_id.doc_id", "text", "doc_id.rest"), docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with digests of ids and decoded texts."""
    made = bpe.encode_decode(docs, queries.tokenizer_path())
    return made.select("doc_id", F.expr("cast(length(ids) div 4 as long)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", drop_low_quality),
    ("line dedup", cut_repeated_lines),
    ("SimHash near-dedup", keep_one_of_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("BPE encoding and decoding", tokenize),
]

#: The first stage is a trained network, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply ``STAGES`` to the documents of ``sf_dir``."""
    docs, since = runtime.load(spark, sf_dir, "documents"), runtime.mark()
    for k, (_, stage) in enumerate(STAGES):
        path = runtime.new_path(spark, f"stage-{k}")
        kept = stage(spark, docs, sf_dir)
        kept.write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
        # what the stage has read, and what it has written on its way
        runtime.drop_tables(since, keep=path)
    return docs
