"""The pipeline's rows against its stages' properties, stage by stage."""

import re

import corpus_pipeline
import pandas as pd
from lontar.llm.shared import Scratch


def test_stages(spark, data):
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    seen = {"": docs.toPandas().set_index("doc_id")}
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.write(stage(spark, docs, data))
        if name != "packing":
            assert docs.columns == columns
            seen[name] = docs.toPandas().set_index("doc_id")
            assert seen[name].index.is_unique
    labels = pd.read_parquet(f"{data}/labels.parquet").set_index("doc_id")
    good = labels.index[(labels.quality == 1)]
    assert len(good.intersection(seen["quality"].index)) >= 0.97 * len(good.intersection(seen[""].index))
    texts = seen["quality"].text
    first = texts.reset_index().groupby("text").doc_id.min()
    assert set(seen["near_dedup"].index) <= set(first)
    for i, t in seen["pseudonyms"].text.items():
        was = seen["near_dedup"].text[i]
        assert t == was or re.search(r"[0-9@]", was)
    packed = docs.toPandas()
    assert set(packed.doc_id) == set(seen["mixing"].index)
    assert packed.groupby("doc_id").length.sum().eq(packed.groupby("doc_id").doc_tokens.max()).all()


def test_stages_against_plain_versions(spark, data):
    """Each stage's rows by loops over its input: scores, all pairs of fingerprints, replaced values, rates and hashes."""
    import zlib

    import numpy as np
    from lontar.llm import mixing, pii, quality, simhash
    from test_edges import _python_pseudonym
    from test_queries import roots

    stages, scratch = dict(corpus_pipeline.STAGES), Scratch(spark)
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = pd.read_parquet(f"{data}/labels.parquet").set_index("doc_id")

    def frame(df):
        return df.toPandas().set_index("doc_id")

    before, after = docs, scratch.write(stages["quality"](spark, docs, data))
    table = frame(before)
    known = [i for i in table.index if i in labels.index and zlib.crc32(str(i).encode()) % 5]
    model = quality.Model(np.stack([quality.counts(table.text[i].encode()) for i in known]), labels.quality.loc[known].to_numpy() > 0, quality.RANK, quality.NEIGHBOURS)
    scores = dict(zip(table.index, model.scores([t.encode() for t in table.text]), strict=True))
    kept = set(frame(after).index)
    assert all((scores[i] >= 0.3) == (i in kept) for i in table.index if abs(scores[i] - 0.3) > 0.01)

    before, after = after, scratch.write(stages["near_dedup"](spark, after, data))
    table = frame(before)
    prints = {i: simhash.wide(simhash.shingles(t.encode())).view(np.uint64) for i, t in table.text.items() if t.split()}
    ids = sorted(prints)
    near = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if np.bitwise_count(prints[a] ^ prints[b]).sum() <= simhash.APART]
    truth = roots(near, ids)
    kept = set(frame(after).index)
    assert sum((truth[i] == i) == (i in kept) for i in ids) >= 0.97 * len(ids)  # masks miss some pairs at the distance itself

    before, after = after, scratch.write(stages["pseudonyms"](spark, after, data))
    table, out = frame(before), frame(after)
    pattern = re.compile(pii.ANY)
    for i, t in table.text.items():
        made = [_python_pseudonym(m[0], corpus_pipeline.PSEUDONYM_KEY) for m in pattern.finditer(t)]
        if None not in made:
            it = iter(made)
            assert out.text[i] == pattern.sub(lambda m: next(it), t)  # noqa: B023

    before, after = after, scratch.write(stages["mixing"](spark, after, data))
    domain = mixing.F.when(mixing.F.col("toxic") == 1, "toxic").when(mixing.F.col("toxic") == 0, "clean")
    rated = frame(mixing.mix(before, spark.read.parquet(f"{data}/labels.parquet").select("doc_id", domain.alias("domain")), corpus_pipeline.WEIGHTS, most=1.0))
    p, n = rated[["p_clean", "p_toxic"]].to_numpy(), rated.n_tokens.to_numpy()
    weights, rate, mass = np.array([0.98, 0.02]), np.ones(len(n)), n @ p
    for _ in range(5000):
        rate = np.clip(rate - p @ (((rate * n) @ p - weights * mass[0] / 0.98) / np.maximum(mass, 1e-9)), 0, 1)
    assert np.abs(rate - rated.rate.to_numpy()).max() < 0.02
    kept = set(frame(after).index)
    assert kept == set(rated.index[rated.copies >= 1]) and all(i in kept for i in rated.index if rated.rate[i] >= 1)


def test_run(spark, data):
    out = corpus_pipeline.run(spark, data)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 0


def test_near_copies_beyond_simhash(spark):
    """Similarity 0.8 and more is found whatever the fingerprints' distance, less isn't, and columns stay."""
    words = [f"w{i}" for i in range(200)]

    def changed(n):
        return " ".join("other" + w if i % (200 // n) == 7 and i // (200 // n) < n else w for i, w in enumerate(words))

    sets = [{tuple(t.split()[i : i + 5]) for i in range(196)} for t in (" ".join(words), changed(4), changed(20))]
    similarity = [len(sets[0] & s) / len(sets[0] | s) for s in sets[1:]]
    assert similarity[0] >= 0.8 > similarity[1]
    rows = [(3, " ".join(words), 1), (4, changed(4), 2), (5, changed(20), 3), (6, " ".join(words).upper(), 4), (7, None, 5), (8, "", 6), (None, " ".join(words), 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rep int")
    out = corpus_pipeline.near_dedup(spark, docs, "")
    assert out.columns == docs.columns and sorted(r.rep for r in out.collect()) == [1, 3, 5, 7]
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == 0


def test_mixed_makes_posteriors_in_steps(spark):
    """No filter holds the whole formula of a posterior, in which each step stands several times."""
    from lontar.llm.mixing import mixed

    docs = spark.createDataFrame([(i, "good words here" if i % 2 else "bad words here") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, "a" if i % 2 else "b") for i in range(40)], "doc_id long, domain string")
    out = mixed(docs, labels, {"a": 0.5, "b": 0.5})
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "isnotnull(transform" not in plan
    assert out.count() == 40
