"""A corpus from documents to packed sequences: five stages, each over all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lontar.llm.mixing import mixed
from lontar.llm.packing import pack
from lontar.llm.pii import with_pseudonyms
from lontar.llm.quality import keep_good
from lontar.llm.shared import Scratch
from lontar.llm.simhash import keep_one
from lontar.session import ship

#: Target token shares: toxic text is brought down to this, other text stays whole.
WEIGHTS = {"clean": 0.98, "toxic": 0.02}
PSEUDONYM_KEY = "lontar-demonstration-key"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of at least 0.3 stay."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies (SimHash of word 5-shingles, at the distance of a similarity of 0.8) the document of
    smallest id stays."""
    return keep_one(docs)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to pseudonyms of the same format; n_chars is that of the text, as before."""
    return with_pseudonyms(docs, PSEUDONYM_KEY)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document once or not at all, at the rate that brings the domains' tokens to their shares."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("toxic") == 0, "clean")
    return mixed(docs, labels.select("doc_id", domain.alias("domain")), WEIGHTS, most=1.0)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens, a row for each piece of a document."""
    return pack(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("pseudonyms", pseudonyms), ("mixing", mixing), ("packing", packing)]

#: SQL can't express the stages; tests hold the pipeline against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over documents, each stage's result written and read again as the next one's input."""
    ship(spark)
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = scratch.write(docs)
    return docs
