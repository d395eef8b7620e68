"""Indexes on disk, as Parquet: written once, searched by any number of query sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lontar.errors import BadInput
from lontar.functions.text import tokens, unit_vector
from lontar.operators.retrieval import Analyzer, analyzed, collection, document_frequencies, nearest, postings, query_terms, top_k


def write_bm25(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", analyzer: Analyzer = tokens) -> None:
    """postings (sorted by term, so that a query's terms skip row groups), document frequencies and the collection's
    numbers. The corpus is tokenised once: the last two come from what is written first."""
    spark = docs.sparkSession
    analyzed(docs, doc_id, text, analyzer).write.mode("overwrite").parquet(f"{path}/documents")
    index = spark.read.parquet(f"{path}/documents")
    postings(index).repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
    document_frequencies(spark.read.parquet(f"{path}/postings")).write.mode("overwrite").parquet(f"{path}/frequencies")
    collection(index).write.mode("overwrite").parquet(f"{path}/collection")


def search_bm25(spark: SparkSession, path: str, queries: DataFrame, k: int = 1000, k1: float = 0.9, b: float = 0.4, analyzer: Analyzer = tokens, digits: int = 6) -> DataFrame:
    """query_id, doc_id, score, rank; equals ``bm25`` over the documents of the index."""
    wanted = query_terms(queries, analyzer)
    df, posted, stats = (spark.read.parquet(f"{path}/{n}") for n in ("frequencies", "postings", "collection"))
    weighted = wanted.join(df, "term").crossJoin(F.broadcast(stats))  # stats: one row
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))
    scored = posted.join(weighted, "term").groupBy("query_id", "doc_id").agg(F.sum(idf * F.col("tf") / norm * F.col("qtf")).alias("score"))
    return top_k(scored, k).withColumn("score", F.round("score", digits))


def write_dense(vectors: DataFrame, path: str, doc_id: str = "doc_id", vector: str = "embedding", model: str = "") -> None:
    """Vectors of unit length. All must have one number of dimensions, and there must be some."""
    sizes = [r["n"] for r in vectors.select(F.size(vector).alias("n")).distinct().limit(2).collect()]
    if len(sizes) != 1 or sizes[0] < 1:
        raise BadInput("vectors need one number of dimensions" if sizes else "no vector to index")
    rows = vectors.select(F.col(doc_id).alias("doc_id"), unit_vector(F.col(vector)).alias("embedding"))
    rows.write.mode("overwrite").parquet(f"{path}/vectors")
    about = rows.agg(F.count("*").alias("num_docs")).select("num_docs", F.lit(sizes[0]).alias("dimension"), F.lit(model).alias("model"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("created"))
    about.coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def search_dense(spark: SparkSession, path: str, queries: DataFrame, k: int = 1000, vector: str = "embedding") -> DataFrame:
    """query_id, doc_id, score, rank of queries (query_id and a vector), by inner product of unit vectors."""
    return nearest(queries.select("query_id", unit_vector(F.col(vector)).alias("embedding")), spark.read.parquet(f"{path}/vectors"), k)


def search_text(spark: SparkSession, path: str, queries: DataFrame, encoder, k: int = 1000) -> DataFrame:
    """As ``search_dense`` for queries (query_id, text), through ``encoder``: a function from Column to Column."""
    encoded: Column = encoder(F.col("text"))
    return search_dense(spark, path, queries.select("query_id", encoded.alias("embedding")), k)
