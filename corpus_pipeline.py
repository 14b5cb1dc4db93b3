"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs. All but the last return the
columns of documents.

1. quality: documents that the rule ensemble scores under QUALITY_LEAST go.
2. near_duplicates: one document, the one with the smallest id, of each group
   linked by five-word n-grams and a similarity of 0.8 or more stays.
3. secrets: spans of secrets are replaced by a mark.
4. mixture: sources are brought to weights that grow with the root of their
   size; a document may appear several times, or not at all.
5. tokens: token ids of each document.

Rows without id pass stage 2; null texts count as empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.llm import bpe, common, mixing, ngram_join, rule_ensemble, secrets
from driftline.session import prepare

QUALITY_LEAST = 0.3
NEAR_WORDS, NEAR_PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with a quality score of QUALITY_LEAST and more."""
    prepare(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = rule_ensemble.fit(common.labelled_sample(docs.select("doc_id", "text"), labels, rule_ensemble.SAMPLE))
    return rule_ensemble.score(docs, model, score_col="__score").where(F.col("__score") >= QUALITY_LEAST).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id.

    A row goes when its own text belongs to a group with a smaller id; of rows
    with one id and one text one stays, other rows that share an id are judged
    each by its text. Only rows that go, and ids with several rows, meet in a
    join; the others pass a filter of those ids without a shuffle of their texts.
    """
    prepare(spark)
    classes = common.stored(ngram_join.similarity_classes(docs, n=NEAR_WORDS, percent=NEAR_PERCENT).where("doc_id is not null"), "classes")
    goes = classes.where("doc_id <> component_id").select(F.col("doc_id").alias("__id"), F.col("fp1").alias("__a"), F.col("fp2").alias("__b")).distinct()
    again = classes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    touched = common.Bloom.of(common.stored(goes.select(F.col("__id").alias("doc_id")).unionByName(again), "touched"), "doc_id")
    rest = ngram_join.with_digests(common.filtered(docs, touched, "doc_id", inside=True))
    rest = rest.join(goes, (F.col("doc_id") == F.col("__id")) & (F.col("__fp1") == F.col("__a")) & (F.col("__fp2") == F.col("__b")), "left_anti")
    one = rest.withColumn("__r", F.row_number().over(Window.partitionBy("doc_id", "text").orderBy("__fp1"))).where("__r = 1").select(docs.columns)
    return common.filtered(docs, touched, "doc_id", inside=False).unionByName(one)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with secrets replaced by a mark; n_chars follows the text."""
    prepare(spark)
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else out


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of the documents in the target mix, in a random order."""
    prepare(spark)
    return mixing.replicate(docs).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids of each document."""
    prepare(spark)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), path, public_tokenizers.PATTERN)
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("secrets", redacted),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: Fitting a rule ensemble and merging byte pairs have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages' result on the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.stored(docs, name)
    return docs
