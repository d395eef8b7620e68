import itertools
import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lontar.functions.tails import _chi_square, signed_rank_exact
from lontar.operators import evaluation as E
from lontar.operators import statistics as S
from lontar.operators.retrieval import batched, hashed_encoder, nearest
from lontar.streaming import incremental


def test_metrics(spark):
    judged = spark.createDataFrame([("q1", "d1", 1), ("q1", "d3", 1), ("q2", "d4", 1)], "query_id string, doc_id string, relevance int")
    run = spark.createDataFrame([("q1", "d2", 1), ("q1", "d1", 2), ("q1", "d3", 5), ("q9", "d1", 1)], "query_id string, doc_id string, rank int")
    out = {r.query_id: r for r in E.metrics(judged, run, (2, 100)).collect()}
    assert set(out) == {"q1", "q2"}
    assert out["q1"].mrr_100 == 0.5 and out["q1"].recall_2 == 0.5 and out["q2"].ndcg_100 == 0.0
    ideal = 1 + 1 / math.log2(3)
    assert out["q1"].ndcg_100 == pytest.approx((1 / math.log2(3) + 1 / math.log2(4)) / ideal)


def test_gate(spark):
    for mean, passed in ((0.449, True), (0.468999, True), (0.474, False), (0.42, False)):
        assert E.baseline_gate(spark.createDataFrame([(mean,)], "value double"), 0.449).first().passed is passed
    with pytest.raises(PySparkException):
        E.baseline_gate(spark.createDataFrame([], "value double"), 0.449).collect()


def values(spark):
    rows = [(f"q{i}", c, v) for i in range(8) for c, v in (("bm25__keep", 0.75 + 0.01 * i), ("bm25__naive", 0.15 + 0.02 * i), ("bm25__mark", 0.4))]
    return spark.createDataFrame(rows, "query_id string, condition string, value double")


def test_pairwise(spark):
    out = {(r.condition_a, r.condition_b): r for r in S.pairwise(values(spark), directions={("bm25__keep", "bm25__naive"): "greater"}, resamples=200).collect()}
    r = out["bm25__keep", "bm25__naive"]
    assert len(out) == 3 and r.paired_queries == 8 and r.bonferroni_family_size == 3
    assert r.wilcoxon_p_value == pytest.approx(1 / 256) and r.wilcoxon_bonferroni_p_value == pytest.approx(3 / 256)
    assert r.cliffs_delta == -1.0 and r.bootstrap_ci_low <= r.mean_delta_b_minus_a <= r.bootstrap_ci_high


def test_direction(spark):
    pairs = spark.createDataFrame([(1, 1.0 + i, 0.1 * i) for i in range(8)], "g int, a double, b double")
    p = {s: S.wilcoxon(pairs, ["g"], s).first().p_value for s in ("less", "greater", "two-sided")}
    assert p["greater"] < 0.01 and p["less"] > 0.99 and p["two-sided"] == pytest.approx(2 * p["greater"])


def test_few_and_flat(spark):
    few = spark.createDataFrame([(1, 1.0, 2.0)] * 3, "g int, a double, b double")
    flat = spark.createDataFrame([(1, 1.0, 1.0)] * 7, "g int, a double, b double")
    assert S.wilcoxon(few, ["g"]).first().p_value is None
    assert tuple(S.wilcoxon(flat, ["g"]).first())[3:] == (0.0, None, 1.0)


def test_exact_tail_against_enumeration():
    for n in (3, 6):
        sums = [sum(r for r, s in zip(range(1, n + 1), signs, strict=True) if s) for signs in itertools.product((0, 1), repeat=n)]
        for t in range(n * (n + 1) // 2 + 1):
            assert signed_rank_exact(t, n) == pytest.approx(np.mean([s >= t for s in sums]))


def test_chi_square_tail():
    assert _chi_square(3.841458820694124, 1) == pytest.approx(0.05)
    assert _chi_square(7.814727903251179, 3) == pytest.approx(0.05)
    assert _chi_square(9.487729036781154, 4) == pytest.approx(0.05)
    assert _chi_square(40.1296, 4) == pytest.approx(4.069e-08, rel=1e-3)


def test_friedman_and_strata(spark):
    f = S.friedman(values(spark)).first()
    assert f.paired_queries == 8 and f.friedman_statistic == pytest.approx(16.0)
    strata = spark.createDataFrame([(f"q{i}", ("low", "mid", "high")[i % 3]) for i in range(8)], "query_id string, tertile string")
    out = S.stratified_pairwise(values(spark), strata, resamples=None).collect()
    assert [r.tertile for r in out[::3]] == ["low", "mid", "high"]


def test_nearest(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((60, 8))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, embedding array<double>")
    got = nearest(rows.withColumnRenamed("doc_id", "query_id"), rows, 5, block=16).collect()
    truth = {(i, int(j)) for i in range(60) for j in np.argsort(-np.round(x @ x[i], 6), kind="stable")[:5]}
    assert {(r.query_id, r.doc_id) for r in got} == truth


def test_nearest_moves_no_pairs(spark):
    """Blocks of vectors are sent; neither side is multiplied by the other's blocks. Ties, and no vector at all."""
    rng = np.random.default_rng(1)
    x = np.round(rng.standard_normal((700, 4)))  # many equal products
    rows = spark.createDataFrame([(f"d{i}", v.tolist()) for i, v in enumerate(x)], "doc_id string, embedding array<double>")
    out = nearest(rows.withColumnRenamed("doc_id", "query_id"), rows, 7, block=50)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan
    names = sorted((f"d{i}" for i in range(700)))
    y = x[[int(n[1:]) for n in names]]
    truth = {(f"d{i}", names[j], r + 1) for i in range(700) for r, j in enumerate(np.argsort(-(y @ x[i]), kind="stable")[:7])}
    assert {(r.query_id, r.doc_id, r["rank"]) for r in out.collect()} == truth
    assert nearest(rows.withColumnRenamed("doc_id", "query_id"), rows.limit(0), 7).count() == 0


def test_class_metrics(spark):
    """As from all judgments within classes, which aren't made; null labels, a class of one, a query without a run."""
    classes = spark.createDataFrame([(i, None if i % 7 == 0 else i % 3 if i < 29 else 9) for i in range(30)], "doc_id long, label int")
    rng = np.random.default_rng(2)
    run = [(q, int(d), r + 1) for q in range(25) for r, d in enumerate(rng.permutation(30)[:12])]
    run = spark.createDataFrame(run, "query_id long, doc_id long, rank int")
    judged = classes.withColumnRenamed("doc_id", "query_id").join(classes, "label").select("query_id", "doc_id", F.lit(1).alias("relevance"))
    a, b = (sorted([round(x, 9) for x in r] for r in rows.collect()) for rows in (E.class_metrics(classes, run, (1, 10)), E.metrics(judged, run, (1, 10))))
    assert a == b and len(a) == 25


def test_encoder_and_batches(spark):
    v = spark.createDataFrame([("rumah besar",), ("",)], "t string").select(hashed_encoder(F.col("t"), 16)).collect()
    assert sum(x * x for x in v[0][0]) == pytest.approx(1.0) and sum(v[1][0]) == 0.0
    assert list(batched(iter(range(5)), 2)) == [[0, 1], [2, 3], [4]]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"docid": "1", "title": "T", "text": "rumahnya"}\n{"text": "x"}\n')
    stream = incremental.prepared_stream(incremental.raw_passages(spark, str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("prepared_rows").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("prepared_rows").collect()] == [("1", "T\nrumah")]


def test_containment(spark):
    queries = spark.createDataFrame([(1, "aa bb cc dd ee ff"), (2, "cc dd"), (3, "no such text in here"), (4, "b cc d")], "query_id long, text string")
    docs = spark.createDataFrame([(1, "xaa bb cc dd ee ffy"), (2, "aa bb cc"), (3, "cc dd")], "doc_id long, text string")
    assert sorted(tuple(r) for r in E.containment_judgments(queries, docs).collect()) == [(1, 1, 1), (2, 1, 1), (2, 3, 1), (4, 1, 1)]


def test_matrix_moves_words_once_and_keeps_one_corpus(spark):
    """Scores are summed where a document's words lie, and a strategy's corpus goes when its metrics are there."""
    import glob

    from lontar.operators.retrieval import bm25
    from lontar.plans.experiment import evaluate_matrix
    from lontar.session import shared_dir

    docs = spark.createDataFrame([(i, f"rumahnya besar {'Sukarno' if i % 2 else 'Hatta'} datang kemari {i}") for i in range(20)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "Sukarno datang kemari"), (2, "besar Hatta datang kemari")], "query_id long, text string")
    plan = bm25(queries, docs)._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning(query_id" in line and "doc_id" in line]
    top = shared_dir(spark).removeprefix("file://")
    before = set(glob.glob(f"{top}/lontar-matrix-*"))
    out = evaluate_matrix(queries, docs, E.containment_judgments(queries, docs), None, strategies=("keep", "sentinel"), hits=5)
    assert sorted((r.condition, r.query_id, r.recall_100) for r in out.collect()) == [(f"{n}__{s}", q, 0.5) for n in ("bm25", "dense") for s in ("keep", "sentinel") for q in (1, 2)]
    assert set(glob.glob(f"{top}/lontar-matrix-*")) == before
