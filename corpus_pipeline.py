"""The corpus pipeline: five stages over documents, each an operator of millrace.llm on all that its predecessor kept.

1. quality: attention-based classifier; documents that it rejects go.
2. line_dedup: lines repeated across documents go, but for the first document that holds them.
3. near_dup: of each group of near duplicates (five-word shingles, similarity 0.8 or more) the smallest id stays.
4. mixing: documents are drawn to the target weights of domains, languages and sources.
5. packing: what is left is packed into sequences of 2,048 tokens.

All stages but the last return the columns of documents; n_chars follows the text. The last returns a row for each packed piece. Each
stage is written as Parquet and read again as the next one's docs. Rows with nulls, empty texts, repeated rows and extra columns are
treated as the operators state; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import line_dedup, mil_quality, mixing, near_dup, packing
from millrace.llm.common import materialize, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _rest(docs: DataFrame) -> DataFrame:
    """(doc_id, text, rest): what an operator reads, and the other columns, whatever they are called."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *others).alias("rest"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the classifier of op10 predicts to be good."""
    model = mil_quality.train(docs, table(spark, sf_dir, "labels"))
    scored = mil_quality.score_documents(_rest(docs), model, keep=("rest",)).where("predicted = 1")
    return scored.select(*[F.col(c if c in ("doc_id", "text") else f"rest.`{c}`") for c in docs.columns])


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated lines from the texts; null texts become empty. A text of which nothing but blanks is left goes, if it lost lines."""
    out = line_dedup.dedup_lines(_rest(docs), keep=("rest",)).where("n_dropped = 0 or text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")

    def column(name: str) -> Column:
        if name == "n_chars":
            return F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("rest.n_chars")).alias(name)
        return F.col(name) if name in ("doc_id", "text") else F.col(f"rest.`{name}`").alias(name)

    return out.select(*map(column, docs.columns))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates. Rows that repeat a kept id stay, and so do rows without an id: nothing tells
    them from one another."""
    dropped = near_dup.near_duplicates(docs, k=5, percent=80).where("not kept and doc_id is not null").select("doc_id").distinct()
    return docs.join(dropped.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws documents to the target weights, each at most once."""
    return mixing.mix_sources(docs, share=0.8, epochs=1).select("mix_row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences; a row for each piece."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("line_dedup", line_dedup_stage),
    ("near_dup", near_dup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Learned weights and hashes of shingles have no SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
