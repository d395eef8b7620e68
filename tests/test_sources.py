import pytest
from pyspark.errors import PySparkException

from lontar.errors import BadInput
from lontar.sources import files as IO


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text, encoding="utf8")
    return str(path)


def test_jsonl(spark, tmp_path):
    path = write(tmp_path, "a.jsonl", '{"id": "1", "text": "é"}\n\n{"id": "2"}\n')
    assert [(r.id, r.text) for r in IO.read_jsonl(spark, path, "id string, text string").collect()] == [("1", "é"), ("2", None)]
    bad = write(tmp_path, "b.jsonl", '{"id": "1"}\n\n[1]\n')
    with pytest.raises(PySparkException, match=r"b.jsonl: JSONL row must be an object: \[1\]"):
        IO.read_jsonl(spark, bad, "id string").collect()
    assert [tuple(r) for r in IO.located(spark, bad, "jsonl").collect()] == [("b.jsonl", 3, "JSONL row must be an object")]


def test_reading_does_not_shuffle(spark, tmp_path):
    path = write(tmp_path, "a.jsonl", '{"id": "1"}\n')
    for df in (IO.read_jsonl(spark, path, "id string"), IO.read_judgments(spark, write(tmp_path, "q", "q 0 d 1\n"), last_wins=False)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_judgments(spark, tmp_path):
    path = write(tmp_path, "q.txt", "q1 0 d1 1\nq1 0 d2 0\n\nq2 0 d3 2\nq1 0 d1 3\n")
    assert sorted(tuple(r) for r in IO.read_judgments(spark, path).collect()) == [("q1", "0", "d1", 3), ("q1", "0", "d2", 0), ("q2", "0", "d3", 2)]
    assert IO.read_judgments(spark, path, last_wins=False).count() == 4
    for text, why in (("q1 0 d1\n", "qrels row must have 4 columns"), ("q1 0 d1 relevant\n", "relevance must be an integer")):
        path = write(tmp_path, "bad.txt", text)
        with pytest.raises(PySparkException, match=f"bad.txt: {why}"):
            IO.read_judgments(spark, path).collect()
        assert [tuple(r) for r in IO.located(spark, path, "qrels").collect()] == [("bad.txt", 1, why)]


def test_run_round_trip(spark, tmp_path):
    run = spark.createDataFrame([("q1", "d2", 2, 0.5, "r"), ("q1", "d1", 1, 1 / 3, "r")], "query_id string, doc_id string, rank int, score double, run_id string")
    IO.write_run(run, str(tmp_path / "run"))
    assert [(r.doc_id, r.rank, r.score) for r in IO.read_run(spark, str(tmp_path / "run")).collect()] == [("d1", 1, 0.333333), ("d2", 2, 0.5)]
    with pytest.raises(PySparkException, match="score must be a number"):
        IO.read_run(spark, write(tmp_path, "bad.run", "q1 Q0 d1 1 high r\n")).collect()


def test_aliases(spark):
    rows = spark.createDataFrame([("d1", None, None, "T", "x"), (None, "d2", None, "", "y"), ("", None, "d3", None, "z")], "docid string, doc_id string, id string, title string, text string")
    assert [tuple(r) for r in IO.contents(IO.alias_passages(rows)).collect()] == [("d1", "T\nx"), ("d2", "y"), ("d3", "z")]
    with pytest.raises(PySparkException, match="query needs one of"):
        IO.alias_queries(spark.createDataFrame([("", "a")], "id string, text string")).collect()


def test_roots_and_counts(spark, tmp_path):
    path = write(tmp_path, "roots.txt", " rumah \n\nbuku\n")
    assert {r.root for r in IO.read_roots(spark, path).collect()} == {"rumah", "buku"}
    assert IO.count_rows(spark, path) == 2
    assert IO.roots_or_default(spark).count() == 4
    with pytest.raises(BadInput):
        IO.read_roots(spark, None)
    with pytest.warns(UserWarning, match="isn't there"):
        assert IO.roots_or_default(spark, bundled=str(tmp_path / "none.txt")).count() == 4


def test_csv_and_config(spark, tmp_path):
    path = write(tmp_path, "m.csv", "query_id,condition,ndcg@10\n1,a,0.5\n2,a,n/a\n")
    assert [r.value for r in IO.read_metrics(spark, [path], "ndcg@10").orderBy("query_id").collect()] == [0.5, None]
    with pytest.raises(BadInput, match="missing columns"):
        IO.read_sensitivity(spark, path)
    assert IO.load_config(write(tmp_path, "c.toml", "a = 1\n")) == {"a": 1}
    with pytest.raises(BadInput):
        IO.load_config(write(tmp_path, "c.json", "[1]"))
    assert IO.stable_hash({"a": 1, "b": 2}) == IO.stable_hash({"b": 2, "a": 1})
    assert IO.manifest(spark, path).first().bytes > 0


def test_first_of_repeated_rows(spark, tmp_path):
    from lontar.operators import statistics as S

    path = write(tmp_path, "r.csv", "query_id,condition,ndcg@10\n1,a,0.9\n1,a,0.1\n1,b,0.5\n")
    pair = S.condition_pairs(IO.read_metrics(spark, [path], "ndcg_10")).first()
    assert (pair.a, pair.b) == (0.9, 0.5)
    assert [tuple(r) for r in IO.read_per_query(spark, path, "ndcg@10").collect()] == [("1", 0.5)]
    assert IO.read_per_query(spark, path, "mrr@100").count() == 0
    base = write(tmp_path, "b.csv", "q,ndcg@10\n1,0.5\n2,\n3,n/a\n4,0.4\n")
    assert [r.value for r in IO.read_baseline(spark, base, "ndcg_10").collect()] == [0.5, 0.4]
    with pytest.raises(BadInput, match="missing column"):
        IO.read_baseline(spark, base, "mrr_10")


def test_no_query_in_common(spark):
    from lontar.operators import statistics as S

    rows = spark.createDataFrame([("1", "a", 0.5), ("2", "b", 0.5)], "query_id string, condition string, value double")
    with pytest.raises(PySparkException, match="no query in common"):
        S.effect_rows(rows, "a").collect()
