import json
import zipfile

from pyspark.sql import functions as F

from lontar.cli import main
from lontar.operators.indexes import search_bm25, search_dense, write_bm25, write_dense
from lontar.operators.retrieval import bm25, nearest


def test_index_equals_direct_search(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    queries = spark.read.parquet(f"{data}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    write_bm25(docs, str(tmp_path / "i"))
    a, b = search_bm25(spark, str(tmp_path / "i"), queries, 10), bm25(queries, docs, 10)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(*a.columns).collect()))


def test_dense_index(spark, data, tmp_path):
    v = spark.read.parquet(f"{data}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), "embedding")
    write_dense(v, str(tmp_path / "d"), model="m")
    q = v.withColumnRenamed("doc_id", "query_id")
    a, b = search_dense(spark, str(tmp_path / "d"), q, 3), nearest(q, v, 3)
    assert {(r.query_id, r.rank): r.score for r in a.collect()}.keys() == {(r.query_id, r.rank): r.score for r in b.collect()}.keys()
    assert spark.read.json(str(tmp_path / "d/metadata")).first().dimension == 64


def test_commands_end_to_end(spark, tmp_path):
    def p(name):
        return str(tmp_path / name)

    docs = [{"docid": "d1", "title": "Rumah", "text": "rumahnya di kota"}, {"doc_id": "d2", "text": "biasanya hujan turun"}, {"id": "d3", "title": "", "text": "mobilnya merah"}]
    asked = [{"query_id": "q1", "query": "rumahnya besar", "positive_passages": [{"docid": "d1", "text": "Sukarno datang. Rumahnya besar."}]}, {"id": "q2", "text": "kenapa hujan turun", "positive_passages": [{"id": "d2", "text": "x"}], "negative_passages": [{"id": "d3"}]}]
    (tmp_path / "c.jsonl").write_text("\n".join(map(json.dumps, docs)))
    (tmp_path / "q.jsonl").write_text("\n".join(map(json.dumps, asked)))
    assert main(["prepare", "--strategy", "keep", "--output-dir", p("out"), "--queries-jsonl", p("q.jsonl"), "--corpus-jsonl", p("c.jsonl")]) == 0
    assert main(["prepare", "--strategy", "rule_resolved", "--output-dir", p("x"), "--queries-jsonl", p("q.jsonl"), "--corpus-jsonl", p("c.jsonl")]) == 2
    assert {r.contents for r in spark.read.json(p("out/corpus")).collect()} == {"Rumah\nrumahnya di kota", "biasanya hujan turun", "mobilnya merah"}
    assert main(["qrels", "--output", p("qrels"), "--queries-jsonl", p("q.jsonl"), "--include-negatives"]) == 0
    for retriever in ("bm25", "dense"):
        assert main(["index", "--retriever", retriever, "--collection-dir", p("out/corpus"), "--index-dir", p(f"i_{retriever}")]) == 0
        assert main(["search", "--retriever", retriever, "--index-dir", p(f"i_{retriever}"), "--queries", p("out/queries"), "--output", p(f"run_{retriever}"), "--run-id", f"{retriever}__keep"]) == 0
        assert main(["evaluate", "--qrels", p("qrels"), "--run", p(f"run_{retriever}"), "--condition", f"{retriever}__keep", "--output", p(f"m_{retriever}"), "--summary-output", p(f"s_{retriever}")]) == 0
    assert main(["analyze", "--metrics", p("m_bm25"), p("m_dense"), "--output", p("summary"), "--pairwise-output", p("pairs"), "--friedman-output", p("friedman")]) == 0
    assert main(["gate", "--csv", p("m_bm25"), "--reference", "1.0", "--tolerance", "0.01"]) == 0
    assert main(["gate", "--csv", p("m_bm25"), "--reference", "0.2"]) == 1
    assert main(["sensitivity", "--output", p("sens"), "--queries-jsonl", p("q.jsonl")]) == 0
    assert main(["verify"]) == 0


def test_sweep_and_subset(spark, tmp_path, capsys):
    def p(name):
        return str(tmp_path / name)

    docs = [{"docid": f"d{i}", "text": f"rumahnya kata{i} kota{i % 3}"} for i in range(12)]
    asked = [{"query_id": f"q{i}", "query": f"kata{i}", "positive_passages": [{"docid": f"d{i}"}, {"title": "no id"}]} for i in range(4)]
    (tmp_path / "c.jsonl").write_text("\n".join(map(json.dumps, docs)))
    (tmp_path / "q.jsonl").write_text("\n".join(map(json.dumps, asked)))
    both = ["keep", "naive_strip"]
    assert main(["prepare", "--strategy", *both, "--output-dir", p("out"), "--queries-jsonl", p("q.jsonl"), "--corpus-jsonl", p("c.jsonl")]) == 0
    assert main(["qrels", "--output", p("qrels"), "--queries-jsonl", p("q.jsonl")]) == 0
    assert "judgments: 4" in capsys.readouterr().out
    sweep = ["sweep", "--processed-dir", p("out"), "--qrels", p("qrels"), "--output-dir", p("done"), "--strategies", *both, "--retrievers", "bm25", "dense"]
    assert main([*sweep, "--reference", "1.0"]) == 0
    assert capsys.readouterr().out.count("__") == 4
    assert main(sweep) == 0 and "__" not in capsys.readouterr().out
    rows = spark.read.option("header", True).csv(p("done/summary")).collect()
    assert {r.condition: float(r["ndcg@10_mean"]) for r in rows if r.condition.startswith("bm25")} == {"bm25__keep": 1.0, "bm25__naive_strip": 1.0} and len(rows) == 4
    assert main([*sweep, "--force", "--reference", "0.2"]) == 1
    metrics = [p(f"done/metrics/bm25__{s}") for s in both]
    assert main(["forest", "--metrics", *metrics, "--baseline", "bm25__keep", "--output", p("f.svg"), "--bootstrap-resamples", "50"]) == 0
    assert "bm25__naive_strip" in (tmp_path / "f.svg").read_text()
    assert main(["archive", "--input", p("done/runs"), "--output", p("runs.zip")]) == 0
    with zipfile.ZipFile(p("runs.zip")) as z:
        assert any(n.startswith("bm25__keep/") for n in z.namelist()) and "manifest.json" in z.namelist()
    assert main(["subset", "--processed-dir", p("out"), "--qrels", p("qrels"), "--output-dir", p("small"), "--strategies", *both, "--queries", "2", "--extra-docs", "3"]) == 0
    assert [spark.read.json(p(f"small/{s}/{n}")).count() for s in both for n in ("queries", "corpus")] == [2, 5, 2, 5]
    assert main(["index", "--retriever", "bm25", "--collection-dir", p("out/keep/corpus"), "--index-dir", p("i"), "--dry-run"]) == 0
