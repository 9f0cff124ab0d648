"""A pipeline over documents: language, near copies, repeated strings, benchmark passages, packing.

Each stage takes what the one before it kept, as a table with the columns of documents, and the next one reads it back
from Parquet. STAGES has the stages; run(spark, sf_dir) applies them to the documents of a folder.

1. language_id drops documents without a letter or without a likely language. The network is trained on the stage's own
   labelled rows.
2. near_duplicates keeps the smallest doc_id of each group that five-word shingle links of 0.75 or more form.
3. repeated_strings cuts out each 50-byte string that a document with a smaller doc_id has; a character that is cut
   through goes as well, n_chars is counted anew, and documents of which nothing is left are dropped.
4. decontamination drops documents with a passage of the benchmark.
5. packing cuts and packs what is left into sequences of 2048 tokens and returns the pieces with their places.

Null and empty texts do not pass the first stage; empty tables pass through all of them; extra columns are carried
through the first four. Repeated rows stay together in the first two stages, since they share a doc_id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoplane.llm import decontaminate, language, packing, shingle_join, suffix_dedup
from cytoplane.llm._shared import staged


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_known(docs, language.learn(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    others = shingle_join.groups(docs).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(others.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.deduplicate(docs, keep="text", carry=tuple(c for c in docs.columns if c != "text"))
    left = cut.where("n_bytes = 0 or n_removed < n_bytes")
    new = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    return left.select(*(new.get(c, F.col(f"row.{c}")).alias(c) for c in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, name)
    return docs
