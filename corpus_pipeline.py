"""The training-corpus pipeline: five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run``
writes as Parquet and rereads as the next stage's input.  All but the last
return the columns they got.  The operators live in ``symsift.llm``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symsift.llm import language, near_dups, packing, repeats, secrets
from symsift.llm.common import tidy
from symsift.storage import discard, scratch


def _with_text(docs: DataFrame, text) -> DataFrame:
    """docs with another text, and its length where the column is there."""
    out = docs.withColumn("text", text)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the rows outside the held-out fold.

    Rejected are null and empty texts, texts without a letter, ties, and texts of
    256 bytes or more with a narrow margin.  Equal texts share one fate; other
    columns, the language's own included, decide nothing.
    """
    model = language.learn(language.train_rows(docs))
    named = language.identify(docs, model, {f"c{i}": F.col(c) for i, c in enumerate(docs.columns)})
    return named.where(~F.col("rejected")).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays: the one with the least id, null last.

    Among rows of one id the least by text, then by all columns in their order
    stays, so the choice doesn't depend on how rows are dealt.  Null and empty
    texts are one class.
    """
    labels, _ = near_dups.classes(docs)
    own = labels.select(F.col("tid").alias("_tid"), F.col("label").alias("_label"))
    row = F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)))  # no name of the table's can clash
    rows = docs.select(row.alias("_row"), F.col("doc_id").alias("_id"), near_dups.text_id("text").alias("_tid")).join(own, "_tid", "left")
    rest = [F.struct(F.col(f"_row.c{i}").isNull(), F.col(f"_row.c{i}")).alias(f"c{i}") for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")]
    key = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_tid").alias("tid"), *rest)
    rows = rows.select("_row", F.coalesce("_label", "_tid").alias("_label"), key.alias("_key"))
    least = rows.groupBy("_label").agg(F.min("_key").alias("_k")).withColumnRenamed("_label", "_l")
    kept = rows.join(least, (F.col("_label") == F.col("_l")) & (F.col("_key") == F.col("_k")), "left_semi")
    kept = kept.dropDuplicates(["_label"])  # of rows that are equal in all columns
    return kept.select(*(F.col(f"_row.c{i}").alias(c) for i, c in enumerate(docs.columns)))


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings of 200 or more that occur again go; what a cut leaves of a character goes with it.

    Every row stays, with what is left of its text: '' where all of it occurs
    again, null where it was null.  Rows that are equal lose their texts alike.
    """
    rest = [c for c in docs.columns if c != "text"]
    row = F.struct(F.col("text").isNull().alias("none"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(rest)))
    cut = repeats.remove_repeats(docs.select(row.alias("row"), "text"), id_col="row", as_text=True)
    out = cut.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(rest)), F.when(~F.col("row.none"), F.col("kept")).alias("text"))
    return _with_text(out.select(*docs.columns), F.col("text"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The secrets found are replaced by a mark; every row stays, null texts are null, overlapping secrets have one mark."""
    body = F.coalesce(F.col("text"), F.lit(""))
    _, ledger = secrets.scan(docs.select("doc_id", "text"))
    hits = ledger.where(F.size("spans") > 0).select(F.col("blob").alias("_blob"), F.col("spans").alias("_spans"))
    rows = docs.withColumn("_key", F.sha2(body, 256))
    rows = rows.join(hits, rows["_key"] == hits["_blob"], "left")
    return _with_text(rows, F.when(F.col("_spans").isNull(), F.col("text")).otherwise(secrets.redacted(F.col("text"), F.col("_spans")))).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their sequence and offset."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("minhash_dedup", minhash_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: Suffix sorting, similarity classes and packing have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        path = scratch(spark, name)
        with tidy(spark):  # what a stage saved on the way goes when its result is written
            stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
        if before:
            discard(spark, before)
        before = path
    return docs
