"""The corpus pipeline: from raw documents to token ids.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame; run() writes it as
Parquet in the shared folder and reads it again for the next stage. All but the last return documents' columns.
Every stage works on an empty table, on repeated rows, null keys and further columns, which pass through; nulls and
ties are settled as the operators' docstrings say.

1. language: documents whose language cannot be told (no letter, or a score below MIN_SCORE) go; a missing lang
   is filled in. Everything else stays.
2. near_duplicates: of each component of near-duplicates (five-word shingles, similarity about 0.8 or more) the
   document with the smallest doc_id stays.
3. repeated_strings: bytes within 200-byte strings that occur twice or more are cut out of text, n_chars follows;
   documents that lose their last word go.
4. mixing: each source is taken to its target, documents up to twice.
5. tokens: token ids of each text, and digests of the ids and of what they decode to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, language, mixing, simhash, substring_dedup
from plumbline.llm.shared import Scratch, sweep

#: A text's mean word marginal for its best language; chance is one over the number of languages.
MIN_SCORE = 0.3


def tell_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    told = language.label_languages(docs, language.train(docs), names=("__told", "__score"))
    kept = told.where((F.col("__told") != "und") & (F.col("__score") >= MIN_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "__told")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_texts(docs, chars="n_chars")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = f.read()
    return bpe.bpe_tokens(docs, ranks, public_tokenizers.PATTERN, keep=("doc_id", "lang", "source", "n_chars"))


STAGES = [
    ("language", tell_language),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("mixing", mix),
    ("tokens", tokens),
]

#: SQL has none of these methods; tests hold the pipeline against a plain one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        sweep(spark, but=(scratch.root,))
        if before:
            scratch.drop(before)
        before = name
    return docs
