"""The corpus pipeline: documents in, token digests of the cleaned corpus out.

Each stage takes (spark, docs, sf_dir) and returns the rows that stay, with the
columns of ``documents``; the last one returns the encoded result. Stages are
written and read again between each other, so lost executors cost one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from whorl.llm import decontaminate, jaccard, pii, quality, tokens
from whorl.llm.common import BLANKS, OWN, Scratch, table
from whorl.llm.queries import ranks


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or a certified cutoff go.

    Null and empty texts have no words, fail the base rules and go; repeated
    rows share their verdict; extra columns of any name stay; an empty table stays empty; texts are measured whole.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: that with the smallest id.

    Five-word shingles and a similarity of 0.8. Rows are told apart by id and
    text: rows that share an id but are no copies all stay, rows without an id
    come last in their group, of rows equal in id and text one stays, and rows
    without words are in no group and stay. Extra columns of any type and name
    are carried; an empty table stays empty.
    """
    row, key, own = f"{OWN}row", f"{OWN}key", f"{OWN}id"
    found = jaccard.jaccard_join(docs.select("doc_id", "text"), words=5, percent=80).where("component is not null")
    copies = found.groupBy("component", F.col("doc_id").alias(own), F.col("digest").alias(key)).agg(F.count("*").alias("n"))
    first = copies.groupBy("component").agg(F.min(F.struct(F.col(own).isNull(), own, key, "n")).alias("x")).select(f"x.{own}", f"x.{key}", "x.n")
    # The rows themselves are one struct, so their names cannot clash.
    rows = docs.select(F.struct("*").alias(row), F.col("doc_id").alias("id"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"), F.coalesce("text", F.lit("")).rlike(f"[^{BLANKS}]").alias("wordy"))
    kept = rows.where("wordy").join(first, F.col("id").eqNullSafe(F.col(own)) & (F.col("digest") == F.col(key)))
    order = Window.partitionBy(own, key).orderBy(F.to_json(row))
    repeated = kept.where("n > 1").withColumn("turn", F.row_number().over(order)).where("turn = 1")
    return kept.where("n = 1").select(f"{row}.*").union(repeated.select(f"{row}.*")).union(rows.where("not wordy").select(f"{row}.*"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark item in them go.

    Each row is tested for itself, also where ids are null or repeated; null
    and empty texts hold no item and stay; extra columns of any name stay; an empty table stays empty.
    """
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by their kind; ``n_chars`` follows the text.

    Null texts stay null, with a null ``n_chars``; spans that overlap are
    replaced once, by the first kind; no row goes; extra columns of any name stay.
    """
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, their number and digest, and the digest of the decoded bytes.

    One row per row of ``docs``: null and empty texts have no ids and the
    digests of nothing; null and repeated ids are kept as they are; other columns end here.
    """
    encoded = tokens.encode(docs, **ranks())
    return tokens.digests(tokens.decode(encoded, **ranks()))


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("PII", pii_stage),
    ("byte-level BPE", token_stage),
]

#: The Jaccard components and the field's messages are iterative: no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the whole documents table."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.save(docs, str(i))
            if i > 1:
                scratch.drop(str(i - 2))
    return docs
