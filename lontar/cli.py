"""Commands: ``python -m lontar.cli COMMAND ...``; each returns an exit code."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lontar.errors import BadInput, LontarError
from lontar.functions import text as X
from lontar.operators import evaluation as E
from lontar.operators import indexes as N
from lontar.operators import statistics as S
from lontar.operators.retrieval import hashed_encoder, run_rows
from lontar.plans import experiment as P
from lontar.plans.figure import forest_svg
from lontar.sources import files as IO

RAW_QUERY = "query_id string, id string, query string, text string"
RAW_PASSAGE = "docid string, doc_id string, id string, title string, text string"
PREPARED = "id string, contents string"
#: Words that merely end in -nya and must survive stripping.
FALSE_POSITIVES = ["punya", "tanya", "hanya", "Kenya", "Sonya", "Tanya"]


def _prepared(spark: SparkSession, path: str, key: str) -> DataFrame:
    return IO.read_jsonl(spark, path, PREPARED).select(F.col("id").alias(key), F.col("contents").alias("text"))


REMOVERS = {"suffix": None, "pronoun": X.pronoun_remover}
METRICS = ["ndcg_1", "ndcg_10", "recall_10", "mrr_100", "recall_100"]


def _there(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to ``path`` as a whole."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def prepare(spark: SparkSession, a: argparse.Namespace) -> int:
    """One strategy into the folder itself, several into a folder each."""
    strategies = [s.value for s in P.Strategy] if a.strategy == ["all"] else a.strategy
    roots = IO.read_roots(spark, a.root_dict) if {"sastrawi_clitic", "rule_resolved"} & set(strategies) else None
    queries = IO.alias_queries(IO.read_jsonl(spark, a.queries_jsonl, RAW_QUERY, "place")).select(F.col("query_id").alias("id"), F.col("text").alias("contents"), "place")
    corpus = IO.contents(IO.alias_passages(IO.read_jsonl(spark, a.corpus_jsonl, RAW_PASSAGE, "place")))
    for name, rows in (("queries", queries), ("corpus", corpus)):
        for strategy in strategies:
            path = f"{a.output_dir}/{name}" if len(strategies) == 1 else f"{a.output_dir}/{strategy}/{name}"
            out = P.prepared(rows, roots, [strategy], limit=a.limit, remover=REMOVERS[a.remover]).drop("strategy")
            if a.dry_run:
                print(path, out.count())
            else:
                IO.write_jsonl(out, path)
    return 0


def qrels(spark: SparkSession, a: argparse.Namespace) -> int:
    rows = IO.read_jsonl(spark, a.queries_jsonl, IO.JUDGED)
    IO.write_judgments(E.nested_judgments(rows, a.include_negatives), a.output)
    for name, value in E.judgment_counts(rows, a.include_negatives).first().asDict().items():
        print(f"{name}: {value}")
    return 0


def sensitivity(spark: SparkSession, a: argparse.Namespace) -> int:
    out = P.scored_sensitivity(IO.read_jsonl(spark, a.queries_jsonl, IO.JUDGED))
    IO.write_csv(out, a.output)
    spark.read.option("header", True).csv(a.output).groupBy("tertile").count().show()
    return 0


def index(spark: SparkSession, a: argparse.Namespace) -> int:
    docs = _prepared(spark, a.collection_dir, "doc_id")
    if a.dry_run:
        print(a.index_dir, a.retriever, docs.count())
        return 0
    if a.retriever == "bm25":
        N.write_bm25(docs, a.index_dir)
    else:
        N.write_dense(docs.select("doc_id", hashed_encoder(F.col("text"), a.dimensions).alias("embedding")), a.index_dir, model="hashed tokens")
    return 0


def search(spark: SparkSession, a: argparse.Namespace) -> int:
    queries = _prepared(spark, a.queries, "query_id")
    if a.retriever == "bm25":
        hits = N.search_bm25(spark, a.index_dir, queries, a.hits, a.k1, a.b)
    else:
        hits = N.search_text(spark, a.index_dir, queries, lambda c: hashed_encoder(c, a.dimensions), a.hits)
    IO.write_run(run_rows(hits, a.run_id), a.output)
    return 0


def evaluate(spark: SparkSession, a: argparse.Namespace) -> int:
    rows = E.metrics(IO.read_judgments(spark, a.qrels), IO.read_run(spark, a.run), condition=a.condition).select("query_id", "condition", *METRICS)
    IO.write_csv(IO.published(rows), a.output)
    if a.summary_output:
        IO.write_csv(IO.published(E.condition_summary(rows, METRICS)), a.summary_output)
    return 0


def sweep(spark: SparkSession, a: argparse.Namespace) -> int:
    """Index-free runs and metrics of every strategy x retriever whose metrics aren't there yet; the gate, if asked for,
    stops the sweep after the first condition. Prepared strategies are folders of ``prepare``."""
    judgments = IO.read_judgments(spark, a.qrels)
    conditions = [P.Condition(P.Strategy(s), r) for r in a.retrievers for s in ([x.value for x in P.Strategy] if a.strategies == ["all"] else a.strategies)]
    done = {c.run_id for c in conditions if _there(spark, f"{a.output_dir}/metrics/{c.run_id}")}
    search_by = P.retrievers(f"{a.output_dir}/vectors")
    for c in P.pending(conditions, done, a.force):
        folder = f"{a.processed_dir}/{c.strategy.value}"
        hits = search_by[c.retriever](_prepared(spark, f"{folder}/queries", "query_id"), _prepared(spark, f"{folder}/corpus", "doc_id"), a.hits)
        IO.write_run(run_rows(hits, c.run_id), f"{a.output_dir}/runs/{c.run_id}")
        rows = E.metrics(judgments, IO.read_run(spark, f"{a.output_dir}/runs/{c.run_id}"), condition=c.run_id).select("query_id", "condition", *METRICS)
        IO.write_csv(IO.published(rows), f"{a.output_dir}/metrics/{c.run_id}")
        print(c.run_id)
        if a.reference is not None and c is conditions[0]:
            row = E.baseline_gate(IO.read_baseline(spark, f"{a.output_dir}/metrics/{c.run_id}", "ndcg_10"), a.reference, a.tolerance).first()
            print(row["line"])
            if not row["passed"]:
                return 1
    every = None
    for m in METRICS:
        values = IO.read_metrics(spark, [f"{a.output_dir}/metrics/{c.run_id}" for c in conditions], m).select("query_id", "condition", F.col("value").alias(m))
        every = values if every is None else every.join(values, ["query_id", "condition"])
    IO.write_csv(IO.published(E.condition_summary(every, METRICS)), f"{a.output_dir}/summary")
    return 0


def subset(spark: SparkSession, a: argparse.Namespace) -> int:
    """The first queries, their relevant documents and some others, of every prepared strategy, with their judgments."""
    keep = f"{a.processed_dir}/keep"
    judgments = IO.read_judgments(spark, a.qrels)
    q, d, j = P.smoke_subset(_prepared(spark, f"{keep}/queries", "query_id"), _prepared(spark, f"{keep}/corpus", "doc_id"), judgments, a.queries, a.extra_docs)
    if not j.where("relevance > 0").head(1):
        raise BadInput("the chosen queries have no relevant document")
    ids = {"queries": q.select(F.col("query_id").alias("id")), "corpus": d.select(F.col("doc_id").alias("id"))}
    for strategy in [s.value for s in P.Strategy] if a.strategies == ["all"] else a.strategies:
        for name, wanted in ids.items():
            rows = IO.read_jsonl(spark, f"{a.processed_dir}/{strategy}/{name}", PREPARED)
            IO.write_jsonl(rows.join(wanted, "id", "left_semi"), f"{a.output_dir}/{strategy}/{name}")
    IO.write_judgments(j, f"{a.output_dir}/qrels")
    print(IO.count_rows(spark, f"{a.output_dir}/qrels"), "judgments")
    return 0


def analyze(spark: SparkSession, a: argparse.Namespace) -> int:
    values = IO.read_metrics(spark, a.metrics, a.metric)
    for path, make in (
        (a.output, lambda: E.value_summary(values)),
        (a.pairwise_output, lambda: S.pairwise(values, resamples=a.bootstrap_resamples)),
        (a.friedman_output, lambda: S.friedman(values)),
        (a.stratified_output, lambda: S.stratified_pairwise(values, IO.read_sensitivity(spark, a.sensitivity), resamples=a.bootstrap_resamples)),
    ):
        if path:
            IO.write_csv(make(), path)
    return 0


def forest(spark: SparkSession, a: argparse.Namespace) -> int:
    """Each condition's mean difference from the baseline with its interval, as an SVG drawing."""
    rows = S.effect_rows(IO.read_metrics(spark, a.metrics, a.metric), a.baseline, a.bootstrap_resamples).orderBy("condition")
    with open(a.output, "w", encoding="utf8") as f:
        f.write(forest_svg([r.asDict() for r in rows.collect()], f"{IO.metric_name(a.metric)} against {a.baseline}"))  # a row for each condition
    return 0


def gate(spark: SparkSession, a: argparse.Namespace) -> int:
    row = E.baseline_gate(IO.read_baseline(spark, a.csv, a.metric), a.reference, a.tolerance).first()
    print(row["line"])
    return 0 if row["passed"] else 1


def archive(spark: SparkSession, a: argparse.Namespace) -> int:
    print(IO.archive(spark, a.input, a.output), "files")
    return 0


def verify(spark: SparkSession, a: argparse.Namespace) -> int:
    roots = IO.roots_or_default(spark, a.root_dict)
    out = P.report(spark, [("word", w) for w in FALSE_POSITIVES], roots, remover=REMOVERS[a.remover])
    out.show(truncate=False)
    return int(out.where("text <> sastrawi_clitic").count() > 0)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lontar")
    commands = top.add_subparsers(required=True)

    def command(f, required: list[str], **optional) -> argparse.ArgumentParser:
        c = commands.add_parser(f.__name__)
        c.set_defaults(run_command=f)
        for name in required:
            c.add_argument(f"--{name}", required=True)
        for name, default in optional.items():
            flag = f"--{name.replace('_', '-')}"
            if default is False:
                c.add_argument(flag, action="store_true")
            else:
                c.add_argument(flag, default=default, type=type(default) if default is not None else None)
        return c

    every = ["all", *[s.value for s in P.Strategy]]
    c = command(prepare, ["output-dir", "queries-jsonl", "corpus-jsonl"], root_dict=None, dry_run=False)
    c.add_argument("--strategy", nargs="+", choices=every, required=True)
    c.add_argument("--remover", choices=list(REMOVERS), default="suffix")
    c.add_argument("--limit", type=int)
    command(qrels, ["output", "queries-jsonl"], include_negatives=False)
    command(sensitivity, ["output", "queries-jsonl"])
    command(index, ["retriever", "collection-dir", "index-dir"], dimensions=64, dry_run=False)
    c = command(sweep, ["processed-dir", "qrels", "output-dir"], hits=1000, force=False, tolerance=0.02)
    c.add_argument("--strategies", nargs="+", choices=every, default=["all"])
    c.add_argument("--retrievers", nargs="+", choices=["bm25", "dense"], default=["bm25"])
    c.add_argument("--reference", type=float)
    c = command(subset, ["processed-dir", "qrels", "output-dir"], queries=20, extra_docs=1000)
    c.add_argument("--strategies", nargs="+", choices=every, default=["all"])
    command(search, ["retriever", "index-dir", "queries", "output", "run-id"], hits=1000, k1=0.9, b=0.4, dimensions=64)
    command(evaluate, ["qrels", "run", "condition", "output"], summary_output=None)
    c = command(analyze, [], metric="ndcg_10", output=None, pairwise_output=None, friedman_output=None, stratified_output=None, sensitivity=None, bootstrap_resamples=10_000)
    c.add_argument("--metrics", nargs="+", required=True)
    c = command(forest, ["baseline", "output"], metric="ndcg_10", bootstrap_resamples=10_000)
    c.add_argument("--metrics", nargs="+", required=True)
    c = command(gate, ["csv"], metric="ndcg_10", tolerance=0.02)
    c.add_argument("--reference", type=float, required=True)
    command(archive, ["input", "output"])
    command(verify, [], root_dict=None).add_argument("--remover", choices=list(REMOVERS), default="suffix")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    try:
        return args.run_command(spark, args)
    except LontarError as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
