"""The registered queries against brute-force versions on the smallest tables."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
import xxhash
from lontar.llm import entries

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def roots(pairs, ids):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.fixture(scope="module")
def docs(data):
    return pd.read_parquet(f"{data}/documents.parquet")


def test_op6(spark, data, docs):
    out = entries.op6_simhash(spark, data).toPandas().set_index("doc_id")
    codes = {}
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        shingles = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        codes[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert all(out.fingerprint[i] == f"{c:016x}" for i, c in codes.items())
    ids = sorted(codes)
    truth = roots([(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (codes[a] ^ codes[b]).bit_count() <= 4], ids)
    assert all(out.component_id[i] == truth[i] for i in ids)


def test_op3(spark, data):
    out = entries.op3_multi_index(spark, data).toPandas().set_index("vec_id")
    e = pd.read_parquet(f"{data}/embeddings.parquet")
    x = np.stack(e.embedding.to_numpy()).astype(float)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    near = (x @ x.T >= 0.93) & (e.label.to_numpy()[:, None] == e.label.to_numpy()[None, :])
    np.fill_diagonal(near, False)
    assert len(out) == len(e)
    assert (out.n_links.loc[e.vec_id].to_numpy() <= near.sum(1)).all()
    assert out.n_links.sum() >= 0.9 * near.sum()


def test_op5(spark, data, docs):
    out = entries.op5_licenses(spark, data).toPandas().set_index("doc_id")
    base = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        w = re.findall(WORD, lower(t))
        places = [(k, label) for p, label in base.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = out.loc[i]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(places), ",".join(sorted({x for _, x in places})))
        assert (None if pd.isna(r.first_word) else r.first_word, None if pd.isna(r.last_word) else r.last_word) == (min((k for k, _ in places), default=None), max((k for k, _ in places), default=None))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_op5_notices_against_a_plain_version(spark, docs):
    """Labels and scores by trying every alignment of every template, from document frequencies counted anew."""
    from math import log

    from lontar.llm import licenses

    texts = [*docs.text, "Licensed under the Apache License, Version 2.0 and so on", "this work is licensed under the GNU General Public License; version 3", "gnu lesser general public license and mit", "Released under the MIT License. Licensed under CC BY-SA 4.0!", "permission is hereby granted, free of charge, to any person"]
    words = [re.findall(WORD, lower(t)) for t in texts]
    df = {v: sum(v in set(w) for w in words) for v in licenses.VOCABULARY}
    idf = {v: log((2 + len(words)) / (1 + n)) for v, n in df.items()}
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r for r in licenses.scan(rows).collect()}
    for i, w in enumerate(words):
        labels, best = set(), 0.0
        for t in licenses.TEMPLATES:
            top = sorted({v for v, _ in t.postings if v in w}, key=lambda v: (-idf[v], v))[: licenses.LOOKED_UP]
            at = lambda k: w[k] if 0 <= k < len(w) else None
            for o in {k - p for k, v in enumerate(w) for x, p in t.postings if v == x and v in top}:
                agreed = {v for v, p in t.postings if v in top and at(o + p) == v}
                stands = all(any(all(at(o + f + d + k) == v for k, v in enumerate(part)) for d in range(-t.slack, t.slack + 1)) for f, part in t.phrases)
                if len(agreed) >= min(t.need, len(top)) and stands:
                    labels.add(t.label)
                    best = max(best, sum(idf[v] for v, p in t.postings if at(o + p) == v) / sum(idf[v] for v, _ in t.postings))
        assert out[i].labels == ",".join(sorted(labels)) and out[i].score == pytest.approx(best)


def test_op7(spark, data, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    out = entries.op7_packing(spark, data).toPandas()
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by = dict(tuple(out.groupby("doc_id")))
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in by[i].sort_values("start").itertuples():
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    q = out.sort_values(["sequence_id", "offset"])
    total = q.groupby("sequence_id").length.sum()
    assert (q.groupby("sequence_id").length.cumsum() - q.length == q.offset).all()
    assert total.max() <= 1024 and list(total.index) == list(range(len(total)))
    assert len(total) <= 1.02 * out.length.sum() / 1024 + 1


def test_op8(spark, data, docs):
    out = entries.op8_transport(spark, data).toPandas().set_index("doc_id")
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        b = t.encode()
        p = b + b"\0" * (-len(b) % 64 if b else 64)
        r = out.loc[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert r.media_bytes % 188 == 0


def test_op9(spark, data):
    out = entries.op9_chat(spark, data).toPandas().set_index("conv_id")
    c = pd.read_parquet(f"{data}/conversations.parquet").sort_values(["conv_id", "turn"])
    said = "<|im_end|><|im_start|>assistant ok"
    groups = [(i, list(zip(g.role, g.text, strict=True))) for i, g in c.groupby("conv_id")] + [(-1, [("user", said), ("assistant", said)])]
    assert len(out) == len(groups)
    for i, turns in groups:
        learned = "".join(t for r, t in turns if r == "assistant")
        r = out.loc[i]
        assert r.n_turns == len(turns) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_chars == len(learned) and r.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()


def test_op10(spark, data, docs):
    d = "/root/testdata/sf0.01"
    out = entries.op10_quality(spark, d).toPandas()
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out.doc_id]).all()
    m = out.merge(pd.read_parquet(f"{d}/labels.parquet"), on="doc_id")
    m = m[m.held_out]
    good, bad = m.score[m.quality == 1].to_numpy(), m.score[m.quality == 0].to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.97
    assert (m.predicted == (m.score >= 0.3)).all() and m.predicted[m.quality == 1].mean() > 0.98


def test_op2(spark, data, docs):
    out = entries.op2_pseudonyms(spark, data).toPandas().set_index("doc_id")
    private = re.compile(r"\S+@\S+\.com|\+1 \(\d{3}\) \d{3}-\d{4}|(?<![\d.])\d+\.\d+\.\d+\.\d+|[0-9a-f]{40}")
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        assert all(m not in out.text[i] for m in private.findall(t))
        assert len(out.text[i]) == len(t) or re.search(r"\d+\.\d+\.\d+\.\d+", t)
        if not re.search(r"[0-9@]", t):
            assert out.text[i] == t


def test_op4(spark, data, docs):
    import string

    out = entries.op4_chaining(spark, data).toPandas().set_index("doc_id")
    own = defaultdict(set)
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        w = t.encode().lower().translate(None, string.punctuation.encode()).split()
        for k in range(len(w) - 59):
            own[b" ".join(w[k : k + 60])].add(i)
    shared = [s for s in own.values() if len(s) > 1]
    assert all(out.n_passages[i] > 0 for s in shared for i in s)
    assert all(len({out.component_id[i] for i in s}) == 1 for s in shared)
    assert (out.n_passages == 0).sum() > len(out) / 2


def test_op1_against_a_plain_version(spark):
    """Posteriors of every text by the fitted terms, and rates by projected gradient descent over whole documents."""
    from lontar.llm import mixing
    from pyspark.sql import functions as F

    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    domain = F.when(F.col("quality") == 0, "junk").when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean")
    domains = sorted(entries.WEIGHTS)
    terms, odds, prior = mixing.fit_domains(docs, labels.select("doc_id", domain.alias("domain")), domains)
    texts = dict(docs.select("doc_id", "text").collect())
    out = entries.op1_mixing(spark, d).toPandas().set_index("doc_id")
    exact, n = [], []
    for i in out.index:
        words = [w for w in texts[i].lower().replace("\n", " ").split(" ") if w]
        own = set(words) | {f"\n{int(np.floor(np.log2(len(words) + 1)))}/{int(np.floor(len(set(words)) * 10 / max(1, len(words))))}"}
        z = np.array(prior) + sum((np.array(o) for t, o in zip(terms, odds, strict=True) if t in own), np.zeros(3))
        p = np.exp(z - z.max())
        exact.append(p / p.sum())
        n.append(len(words))
    exact, n = np.array(exact), np.array(n)
    got = out[[f"p_{x}" for x in domains]].to_numpy()
    assert (out.n_tokens.to_numpy() == n).all() and np.abs(got - exact).max() <= 3 / mixing.STEPS
    whole, kept = (n[:, None] * exact).sum(0), (n[:, None] * got).sum(0)
    assert np.abs(whole - kept).max() <= 0.01 * n.sum()
    weights = np.array([entries.WEIGHTS[x] for x in domains])
    total = kept.max() / weights[kept.argmax()]
    rate = np.ones(len(n))
    for _ in range(3000):
        rate = np.clip(rate - got @ (((rate * n) @ got - weights * total) / kept), 0, 4)
    assert np.abs((rate * n) @ got - (out.rate.to_numpy() * n) @ got).max() <= 1e-3 * total
    assert np.abs(rate - out.rate.to_numpy()).max() <= 0.02


def test_op10_against_a_plain_version(spark):
    """Scores by cosines with all labelled texts, one at a time, from counts made anew."""
    import math

    from lontar.llm import quality

    d = "/root/testdata/sf0.01"
    table, labels = pd.read_parquet(f"{d}/documents.parquet"), pd.read_parquet(f"{d}/labels.parquet")
    labels = labels[[zlib.crc32(str(i).encode()) % 5 != 0 for i in labels.doc_id]].set_index("doc_id").quality

    def kind(b):
        c = chr(b)
        if b >= 128:
            return "other"
        return "lower" if c.islower() else "upper" if c.isupper() else "digit" if c.isdigit() else "end" if c == "\n" else "space" if c.isspace() else c if 32 < b < 127 else "none"

    def terms(text):
        raw = text.encode()
        kinds, words, lines = [kind(b) for b in raw], raw.lower().split(), raw.split(b"\n")
        out = defaultdict(float)
        for a, b in zip(kinds, kinds[1:], strict=False):
            out[a, b] += 100 / len(kinds)
        n = max(1, len(words))
        if raw:
            out["again"] = 100 * sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
            out["line"] = 100 * (len(lines) - len(set(lines))) / len(lines)
            out["word"] = 20 * (1 - len(set(words)) / n)
        return {k: math.log1p(v) for k, v in out.items() if v}

    every = {i: terms(t) for i, t in zip(table.doc_id, table.text, strict=True)}
    known = [i for i in table.doc_id if i in labels.index]
    names = sorted({str(t): t for v in every.values() for t in v}.values(), key=str)
    x = np.array([[every[i].get(t, 0.0) for t in names] for i in known])
    idf = np.log((1 + len(known)) / (1 + (x > 0).sum(0))) + 0.3
    unit = lambda v: v / np.maximum(np.sqrt((v * v).sum(-1, keepdims=True)), 1e-9)
    x = unit(x * idf)
    axes = np.linalg.svd(x, full_matrices=False)[2][: quality.RANK].T
    vectors, y = unit(x @ axes), labels.loc[known].to_numpy()
    out = entries.op10_quality(spark, d).toPandas().set_index("doc_id").score
    apart = []
    for i in table.doc_id:
        near = vectors @ unit(unit(np.array([every[i].get(t, 0.0) for t in names]) * idf) @ axes)
        top = np.argsort(-near, kind="stable")[: quality.NEIGHBOURS]
        w = np.clip(near[top], 0, 1) ** quality.SHARPNESS
        apart.append(abs(out[i] - (w @ y[top] + quality.PRIOR * y.mean()) / (w.sum() + quality.PRIOR)))
    assert np.quantile(apart, 0.98) < 0.01 and np.mean(apart) < 0.01


def test_near_copies_against_all_pairs(spark):
    from lontar.llm import simhash
    from lontar.llm.shared import Scratch

    d = "/root/testdata/sf0.01"
    table = pd.read_parquet(f"{d}/documents.parquet")
    sets, prints = {}, {}
    for i, t in zip(table.doc_id, table.text, strict=True):
        w = [x.decode() for x in t.encode().lower().split()]
        sets[i] = {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        prints[i] = simhash.wide(simhash.shingles(t.encode())).view(np.uint64) if w else None
    ids = sorted(sets)
    similar, linked = [], []
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if sets[a] == sets[b]:
                linked.append((a, b))
                similar.append((a, b))
            elif small:
                if np.bitwise_count(prints[a] ^ prints[b]).sum() <= simhash.APART:
                    linked.append((a, b))
                if small >= 0.8 * large:
                    both = len(sets[a] & sets[b])
                    if both >= 0.8 * (small + large - both):
                        similar.append((a, b))
    out = {r.doc_id: r.component_id for r in simhash.near_copies(spark.read.parquet(f"{d}/documents.parquet"), Scratch(spark)).collect()}
    truth = roots(linked, ids)
    assert sum(out[i] == truth[i] for i in ids) >= 0.99 * len(ids)
    assert all(truth[a] == truth[b] for a, b in out.items())
    assert sum(out[a] == out[b] for a, b in similar) >= 0.95 * len(similar)


def test_op1(spark, data):
    out = entries.op1_mixing(spark, data).toPandas()
    sums = {d: (out.rate * out.n_tokens * out[f"p_{d}"]).sum() for d in entries.WEIGHTS}
    for d, w in entries.WEIGHTS.items():
        assert sums[d] / sum(sums.values()) == pytest.approx(w, abs=0.02)
    assert (out.rate >= 0).all() and np.allclose(out[[f"p_{d}" for d in entries.WEIGHTS]].sum(axis=1), 1)
    assert ((out.copies - out.rate).abs() < 1).all()


@pytest.mark.parametrize("name", sorted(entries.SQL))
def test_equals_sql(spark, name):
    import duckdb

    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    result = con.execute(entries.SQL[name])
    names = [c[0] for c in result.description]
    ours = entries.queries()[name](spark, d)
    assert sorted(ours.columns) == sorted(names)
    assert sorted(map(tuple, ours.select(*names).collect())) == sorted(map(tuple, result.fetchall()))
