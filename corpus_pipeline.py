"""Corpus pipeline: five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps with the columns of documents; the last returns
what its files hold. Between stages the rows are written as Parquet in the shared folder and read again.

A document is a row; rows are told apart by id and text. Defined results: null and empty texts fail the quality rules; documents with a
null id, or with one id and different texts, are documents of their own in every stage; rows equal in id and text are copies, of which one stays; texts of
any length are judged whole; an empty table passes through as one; columns beyond those of documents stay, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.decontaminate import clean_documents
from gridloom.llm.jaccard_join import jaccard_join
from gridloom.llm.mixing import mix, taken
from gridloom.llm.quality_rules import quality_rules
from gridloom.llm.queries import tokenizer_path
from gridloom.llm.schema import fresh
from gridloom.llm.shared import shared_dir, stage
from gridloom.llm.token_files import read_token_files, write_token_files


def by_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that every quality rule holds for."""
    out = fresh(docs, "quality_rules")
    return quality_rules(docs, out=out).filter(F.col(f"`{out}`.kept")).select(*(F.col(f"`{c}`") for c in docs.columns))


def _row_key(docs: DataFrame, id_col: str, text_key) -> dict:
    """Columns that tell rows apart, none of them null: whether a row has an id, the id, a hash of its text."""
    names = (fresh(docs, f"_row_{x}") for x in ("no_id", "id", "text"))
    return dict(zip(names, (F.col(id_col).isNull(), F.coalesce(F.col(id_col).cast("long"), F.lit(0)), text_key), strict=True))


def by_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of copies and near copies the document with the smallest id, and of rows equal in id and text one."""
    own = _row_key(docs, "doc_id", F.xxhash64("text"))
    first = jaccard_join(docs).filter("first")
    first = first.select(*(x.alias(k) for k, x in zip(own, _row_key(first, "doc_id", F.col("text_key")).values(), strict=True)))
    return docs.withColumns(own).join(first, list(own), "left_semi").dropDuplicates(list(own)).drop(*own)


def by_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any phrase of the benchmark."""
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def by_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document; one that the end of its source's stream cuts counts if at least half of it is taken."""
    own, times, again = _row_key(docs, "doc_id", F.xxhash64("text")), fresh(docs, "_times"), fresh(docs, "_pass")
    mixed = taken(mix(docs)).withColumn(times, F.floor(F.col("_taken") / F.greatest("_size", F.lit(1)) + 0.5).cast("int")).filter(F.col(times) > 0)
    mixed = mixed.select(*(x.alias(k) for k, x in zip(own, _row_key(mixed, "_id", F.col("_text_key")).values(), strict=True)), times)
    mixed = mixed.groupBy(*own).agg(F.sum(times).cast("int").alias(times))
    taken_docs = docs.withColumns(own).dropDuplicates(list(own)).join(mixed, list(own))
    return taken_docs.withColumn(again, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*(F.col(f"`{c}`") for c in docs.columns))


def to_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-ID files of all rows; what they hold per document, read back."""
    folder = f"{shared_dir(spark)}/corpus"
    write_token_files(docs, folder, tokenizer_path())
    return read_token_files(spark, folder)


STAGES = [
    ("quality rules", by_quality_rules),
    ("n-gram Jaccard join", by_jaccard_join),
    ("benchmark decontamination", by_decontamination),
    ("mixing sources", by_mixing),
    ("token files", to_token_files),
]

#: SQL has no byte-level BPE, so the rows are held against a brute-force version in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, apply) in enumerate(STAGES):
        docs = apply(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, f"stage{k}")
    return docs
