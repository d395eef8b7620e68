"""The experiment: strategies x retrievers, prepared corpora, sensitivity strata, subsets and sweep checks."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lontar.errors import BadInput
from lontar.functions import text as X
from lontar.operators.evaluation import metrics
from lontar.operators.retrieval import Analyzer, bm25, hashed_encoder, nearest
from lontar.operators.statistics import tertile_cuts
from lontar.session import removed, shared_dir, stored


class Strategy(str, Enum):
    KEEP = "keep"
    NAIVE_STRIP = "naive_strip"
    SASTRAWI_CLITIC = "sastrawi_clitic"
    SENTINEL = "sentinel"
    RULE_RESOLVED = "rule_resolved"


@dataclass(frozen=True)
class Condition:
    strategy: Strategy
    retriever: str

    @property
    def run_id(self) -> str:
        return f"{self.retriever}__{self.strategy.value}"


def matrix(retrievers: tuple[str, ...] = ("bm25", "bge_m3")) -> list[Condition]:
    return [Condition(s, r) for r in retrievers for s in Strategy]


def apply_strategy(df: DataFrame, strategy: str, roots: DataFrame | None = None, key: str = "id", column: str = "contents", suffix: str = "nya", normalise: bool = True, remover: Callable[[Column], Column] | None = None, tagger: Callable[[Column], Column] | None = None) -> DataFrame:
    """``df`` with ``column`` rewritten; strategies with a dictionary need ``roots`` (root) and a unique ``key``.

    ``remover`` takes a token's clitic away (default: ``suffix``); ``tagger`` gives the resolver a root's part of speech.
    """
    try:
        kind = Strategy(strategy)
    except ValueError as e:
        raise BadInput(f"unknown strategy {strategy!r}") from e
    text = X.nfc(F.col(column)) if normalise else F.col(column)
    df = df.withColumn(column, text)
    c = F.col(column)
    if kind is Strategy.KEEP:
        return df
    if kind is Strategy.NAIVE_STRIP:
        return df.withColumn(column, X.naive_strip(c, suffix))
    if kind is Strategy.SENTINEL:
        return df.withColumn(column, X.sentinel(c, suffix, f"<{suffix.upper()}>"))
    if roots is None:
        raise BadInput(f"strategy {strategy} needs a root dictionary")
    if kind is Strategy.SASTRAWI_CLITIC:
        remover = remover or (lambda t: X.suffix_remover(t, suffix))
        known = X.with_known(df, roots, X.clitic_candidates(c, remover), key, "_known")
        return known.withColumn(column, X.guarded_clitic(c, F.col("_known"), remover)).drop("_known")
    known = X.with_known(df, roots, X.host_candidates(c, suffix), key, "_known")
    return known.withColumn(column, X.resolved(c, F.col("_known"), suffix, tagger=tagger)).drop("_known")


def prepared(rows: DataFrame, roots: DataFrame, strategies: list[str] | None = None, suffix: str = "nya", limit: int | None = None, remover: Callable[[Column], Column] | None = None) -> DataFrame:
    """strategy, id, contents of (id, contents) under each strategy; ``limit`` takes the first rows by ``place``, where
    there is such a column, else by id."""
    base = rows.orderBy("place" if "place" in rows.columns else "id").limit(limit) if limit is not None else rows
    out = None
    for name in strategies or [s.value for s in Strategy]:
        one = apply_strategy(base, name, roots, suffix=suffix, remover=remover).select(F.lit(name).alias("strategy"), "id", "contents")
        out = one if out is None else out.unionByName(one)
    return out


def write_prepared(rows: DataFrame, path: str) -> None:
    """Partitioned by strategy, so that a condition reads its own only."""
    rows.write.mode("overwrite").partitionBy("strategy").parquet(path)


#: From queries (query_id, text), documents (doc_id, text) and a number of hits to query_id, doc_id, score, rank.
Retriever = Callable[[DataFrame, DataFrame, int], DataFrame]


def _stored(rows: DataFrame, path: str) -> DataFrame:
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def retrievers(folder: str, encoder: Callable[[Column], Column] = hashed_encoder, analyzer: Analyzer | None = None) -> dict[str, Retriever]:
    """bm25 with ``analyzer``, and dense with ``encoder``, whose vectors are written to ``folder`` before they are compared."""

    def by_words(queries: DataFrame, docs: DataFrame, hits: int) -> DataFrame:
        return bm25(queries, docs, hits, **({"analyzer": analyzer} if analyzer else {}))

    def by_vectors(queries: DataFrame, docs: DataFrame, hits: int) -> DataFrame:
        at = f"{folder}/vectors-{uuid.uuid4().hex}"
        q, d = (_stored(rows.select(key, encoder(F.col("text")).alias("embedding")), f"{at}/{key}") for rows, key in ((queries, "query_id"), (docs, "doc_id")))
        return nearest(q, d, hits)

    return {"bm25": by_words, "dense": by_vectors}


def prepared_pair(queries: DataFrame, docs: DataFrame, strategy: str, roots: DataFrame | None, folder: str, suffix: str = "nya") -> tuple[DataFrame, DataFrame]:
    """``queries`` (query_id, text) and ``docs`` (doc_id, text) under a strategy, written to ``folder`` once."""
    out = []
    for rows, key in ((queries, "query_id"), (docs, "doc_id")):
        made = apply_strategy(rows.select(F.col(key).alias("id"), F.col("text").alias("contents")), strategy, roots, suffix=suffix)
        out.append(_stored(made.select(F.col("id").alias(key), F.col("contents").alias("text")), f"{folder}/{strategy}/{key}"))
    return out[0], out[1]


def evaluate_matrix(queries: DataFrame, docs: DataFrame, judgments: DataFrame, roots: DataFrame | None, names: tuple[str, ...] = ("bm25", "dense"), strategies: tuple[str, ...] | None = None, suffix: str = "nya", hits: int = 1000, cutoffs: tuple[int, ...] = (1, 10, 100), given: dict[str, Retriever] | None = None, folder: str | None = None) -> DataFrame:
    """query_id, condition and metrics of each strategy x retriever.

    Each strategy's corpus is written once and read by all retrievers; nothing is cached. Judgments are made once, and a
    strategy's metrics are written before the next corpus, so that one corpus is there at a time; in a ``folder`` that
    is given they all stay. ``given`` adds retrievers to ``retrievers``' own or replaces them; the dense one's encoder is
    a stand-in otherwise.
    """
    kept = folder is not None
    folder = folder or f"{shared_dir(docs.sparkSession)}/lontar-matrix-{uuid.uuid4().hex}"
    known = retrievers(folder) | (given or {})
    if missing := set(names) - set(known):
        raise BadInput(f"unknown retrievers {', '.join(sorted(missing))}")
    judgments = stored(judgments)
    roots = stored(roots) if roots is not None else None
    out = None
    for strategy in strategies or [s.value for s in Strategy]:
        q, d = prepared_pair(queries, docs, strategy, roots, folder, suffix)
        for name in names:
            one = stored(metrics(judgments, known[name](q, d, hits), cutoffs, f"{name}__{strategy}"))
            out = one if out is None else out.unionByName(one)
        if not kept:
            removed(docs.sparkSession, folder)
    return out


def scored_sensitivity(judged: DataFrame, suffix: str = "nya") -> DataFrame:
    """query_id, nya_total, nya_anaphoric, entity_referenced, sensitivity_score, tertile of judged rows with a positive
    passage. The cut points are exact thirds over all rows."""
    named = judged.withColumn("_query", X.first_filled(F.col("query_id"), F.col("id"))).withColumn("_text", X.first_filled(F.col("query"), F.col("text")))
    some = named.where("_query is not null and size(filter(positive_passages, p -> p is not null)) > 0")
    gold = some.select(F.col("_query").alias("query_id"), X.query_entity(F.col("_text")).alias("entity"), X.gold_text(F.filter("positive_passages", lambda p: p.isNotNull())).alias("gold"))
    counted = gold.select("query_id", X.count_suffix(F.col("gold"), suffix).alias("nya_total"), X.count_anaphoric(F.col("gold"), suffix).alias("nya_anaphoric"), X.entity_referenced(F.col("gold"), F.col("entity"), suffix).cast("int").alias("entity_referenced"))
    scored = counted.withColumn("sensitivity_score", X.sensitivity(F.col("nya_total"), F.col("nya_anaphoric"), F.col("entity_referenced") == 1))
    return labelled_tertiles(scored, "sensitivity_score")


def labelled_tertiles(scores: DataFrame, column: str) -> DataFrame:
    cuts = F.broadcast(tertile_cuts(scores, column))  # one row
    return scores.crossJoin(cuts).withColumn("tertile", X.tertile(F.col(column), F.col("low"), F.col("high"))).drop("low", "high")


def smoke_subset(queries: DataFrame, docs: DataFrame, judgments: DataFrame, n_queries: int = 20, extra: int = 1000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The first queries by id, their relevant documents with the first ``extra`` others, and the judgments between them."""
    head = queries.orderBy("query_id").limit(n_queries)
    wanted = judgments.where("relevance > 0").join(head, "query_id", "left_semi").select("doc_id").distinct()
    filler = docs.join(wanted, "doc_id", "left_anti").orderBy("doc_id").limit(extra).select("doc_id")
    ids = wanted.union(filler).distinct()
    return head, docs.join(ids, "doc_id", "left_semi"), judgments.join(head, "query_id", "left_semi").join(ids, "doc_id", "left_semi")


def row_counts(rows: DataFrame) -> DataFrame:
    """strategy, rows, agree: whether all strategies have as many."""
    counts = rows.groupBy("strategy").agg(F.count("*").alias("rows"))
    every = Window.partitionBy(F.lit(0))
    return counts.withColumn("agree", F.max("rows").over(every) == F.min("rows").over(every))


def first_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: the first id at which (id, contents) differ, with both contents; none if they don't."""
    both = a.select("id", F.col("contents").alias("left_contents")).join(b.select("id", F.col("contents").alias("right_contents")), "id")
    return both.where("left_contents <> right_contents").orderBy("id").limit(1)


def report(spark: SparkSession, samples: list[tuple[str, str]], roots: DataFrame, suffix: str = "nya", remover: Callable[[Column], Column] | None = None) -> DataFrame:
    """label, text and each strategy's result, a row for each sample."""
    base = spark.createDataFrame([(i, *s) for i, s in enumerate(samples)], "id int, label string, contents string")
    out = base.withColumnRenamed("contents", "text")
    for s in Strategy:
        out = out.join(apply_strategy(base.select("id", "contents"), s.value, roots, suffix=suffix, remover=remover).withColumnRenamed("contents", s.value), "id")
    return out.orderBy("id").drop("id")


def pending(conditions: list[Condition], done: set[str], force: bool = False) -> list[Condition]:
    """Conditions whose result isn't there yet."""
    return [c for c in conditions if force or c.run_id not in done]


def with_run_id(df: DataFrame, retriever: Column, strategy: Column) -> DataFrame:
    return df.withColumn("run_id", F.concat_ws("__", retriever, strategy))
