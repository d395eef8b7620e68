"""Mixing to target weights with soft membership, in DataFrame and SQL functions only.

A labelled table gives some documents a domain. A Bernoulli naive Bayes classifier over their most telling terms turns
every document into domain posteriors p, rounded to 1/``STEPS`` and kept summing to one; as all roundings go down but the
likeliest domain's, totals shift to large domains by less than 1/STEPS for each other one. Document rates r in [0, most]
are fitted by projected gradient descent on the least squares sum_k (S_k - T_k)^2 / N_k, where S_k = sum_d r_d n_d p_dk
are the expected token totals of the domains, T_k their targets and N_k what they are at rate 1. Under token weights
the gradient of a document is sum_k p_dk (S_k - T_k) / N_k and has Lipschitz constant 1, so a step of 1 descends.
Documents of equal posteriors keep equal rates; each round is therefore an aggregate over distinct posteriors, of which
there are few whatever the number of documents, computed by Spark; the driver sees one total for each domain.
"""

from __future__ import annotations

import warnings
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lontar.llm.shared import Scratch, free_name

#: Labelled documents that the classifier is fitted on at most, and terms of a domain at most.
SAMPLE = 8000
TERMS = 96
#: A domain's terms are this much likelier in its documents than in others, and stand in this share of them.
LIFT, SPREAD = 8.0, 0.02
#: Posteriors are multiples of 1/STEPS.
STEPS = 256
#: Rounds at most, share of the total by which targets may be missed, and by which totals may still move at the end.
ROUNDS = 100
TOLERANCE, STILL = 1e-4, 1e-6
#: Rounds after which rates are written, so that what is computed in a round doesn't grow.
WRITTEN = 25


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("\n"), F.lit(" ")), " "), "")


def _terms(words: Column, distinct: Column) -> Column:
    """Distinct words, and one term for how much a text repeats itself given its length."""
    size = F.floor(F.log2(F.size(words) + 1)).cast("string")
    ratio = F.floor(F.size(distinct) * 10 / F.greatest(F.size(words), F.lit(1))).cast("string")
    return F.array_append(distinct, F.concat(F.lit("\n"), size, F.lit("/"), ratio))


def _tokenised(docs: DataFrame, text: Column, words: str, terms: str) -> DataFrame:
    """``docs`` with columns ``words`` and ``terms`` of ``text``."""
    distinct = free_name(docs, "_distinct")
    both = docs.withColumn(words, _words(text)).withColumn(distinct, F.array_distinct(words))
    return both.withColumn(terms, _terms(F.col(words), F.col(distinct))).drop(distinct)


def fit_domains(docs: DataFrame, labelled: DataFrame, domains: list[str], id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> tuple[list[str], list[list[float]], list[float]]:
    """(terms, their log odds by domain, log weight of each domain where none of them occurs).

    ``labelled``: doc_id, domain. At most ``sample`` labelled documents, first by a hash of their id, are looked at;
    null ids and domains not in ``domains`` are left out, and of an id with several domains the first by name counts.
    """
    known = labelled.where(F.col("doc_id").isNotNull() & F.col("domain").isin(domains)).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min("domain").alias("domain"))
    chosen = F.broadcast(known.orderBy(F.xxhash64("_id"), "_id").limit(sample))
    ids = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).join(chosen, "_id")
    rows = _tokenised(ids, F.col("_text"), "words", "terms")
    scratch = Scratch(docs.sparkSession)
    rows = scratch.write(rows.select("domain", "terms"))
    size = {d: 0 for d in domains} | {r["domain"]: r["n"] for r in rows.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    total = sum(size.values())
    counts = rows.select("domain", F.explode("terms").alias("term")).groupBy("term").agg(*[F.count(F.when(F.col("domain") == d, 1)).alias(f"n{k}") for k, d in enumerate(domains)])
    every = sum((F.col(f"n{k}") for k in range(1, len(domains))), F.col("n0"))

    def telling(k: int, d: str) -> Column:
        inside = (F.col(f"n{k}") + 0.5) / (size[d] + 1)
        outside = (every - F.col(f"n{k}") + 0.5) / (total - size[d] + 1)
        fits = (inside >= LIFT * outside) & (inside >= SPREAD)
        return F.struct(F.when(fits, inside * F.log(inside / outside)).alias("s"), F.lit(k).alias("k"))

    scored = counts.where(every >= 5).select("*", F.explode(F.array(*[telling(k, d) for k, d in enumerate(domains)])).alias("t"))
    # Limits first, so that only a bounded number of rows is ranked.
    best = None
    for k in range(len(domains)):
        part = scored.where((F.col("t.k") == k) & (F.col("t.s") > 0)).orderBy(F.desc("t.s"), "term").limit(TERMS).select("term", *[f"n{i}" for i in range(len(domains))])
        best = part if best is None else best.unionByName(part)
    terms = sorted({tuple(r) for r in best.collect()})  # TERMS rows for each domain at most
    odds, prior = [], [log((size[d] + 1) / (total + len(domains))) for d in domains]
    for row in terms:
        share = [(n + 0.5) / (size[d] + 1) for n, d in zip(row[1:], domains, strict=True)]
        share = [min(x, 1 - 1e-6) for x in share]
        odds.append([log(x / (1 - x)) for x in share])
        prior = [v + log(1 - x) for v, x in zip(prior, share, strict=True)]
    return [r[0] for r in terms], odds, prior


def _doubles(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def with_posteriors(docs: DataFrame, model: tuple[list[str], list[list[float]], list[float]], text: Column, p: str, n_tokens: str) -> DataFrame:
    """``docs`` with ``p`` (array<double>, multiples of 1/STEPS that sum to 1) and ``n_tokens`` of ``text``."""
    known_terms, odds, prior = model
    k = len(prior)
    known = F.array(*[F.lit(t) for t in known_terms]) if known_terms else F.array().cast("array<string>")
    weights = F.array(*[_doubles(o) for o in odds]) if known_terms else F.array(_doubles([0.0] * k))
    words, terms, z = (free_name(docs, name) for name in ("_words", "_terms", "_z"))
    logits = F.aggregate(F.array_intersect(terms, known), _doubles(prior), lambda a, t: F.zip_with(a, F.element_at(weights, F.array_position(known, t).cast("int")), lambda x, y: x + y))
    rows = _tokenised(docs, text, words, terms).withColumn(n_tokens, F.size(words).cast("long")).withColumn(z, logits).drop(words, terms)
    rows = rows.withColumn(z, F.transform(z, lambda x: F.exp(x - F.array_max(z))))
    total = F.aggregate(z, F.lit(0.0), lambda a, x: a + x)
    rows = rows.withColumn(p, F.transform(z, lambda x: F.floor(x / total * STEPS).cast("double")))
    # What rounding down left over goes to the likeliest domain, the first of equals.
    first = F.array_position(z, F.array_max(z)) - 1
    rest = F.lit(float(STEPS)) - F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    return rows.withColumn(p, F.transform(p, lambda x, i: (x + F.when(i == first, rest).otherwise(0.0)) / STEPS)).drop(z)


def _stepped(state: Column, history: list[tuple[list[float], float]], most: float) -> Column:
    """``state`` (rate, point) of posterior ``p`` after steps along ``history``: scaled residuals by domain at the point,
    and how far the next point goes on beyond the rate."""
    if not history:
        return state
    steps = F.array(*[F.struct(_doubles(h).alias("h"), F.lit(beta).alias("beta")) for h, beta in history])

    def step(s: Column, x: Column) -> Column:
        inner = F.aggregate(F.zip_with("p", x["h"], lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        rate = F.greatest(F.lit(0.0), F.least(F.lit(most), s["point"] - inner))
        return F.struct(rate.alias("rate"), (rate + x["beta"] * (rate - s["rate"])).alias("point"))

    return F.aggregate(steps, state, step)


def fit_rates(cells: DataFrame, weights: list[float], scratch: Scratch, total: float | None = None, most: float = 4.0) -> DataFrame:
    """``cells`` (p, n_tokens) with their ``rate`` after projected gradient descent with momentum, which starts anew
    whenever the sum of squares grows.

    Targets are ``total`` times ``weights``; by default the total at which the largest domain keeps its tokens. Descent
    ends when targets are met or totals no longer move, as where ``most`` keeps them out of reach; a warning tells if
    neither came about within ``ROUNDS``. Totals are linear in the rates, so one aggregate a round gives both those of
    the rates and those of the next point.
    """
    k = len(weights)
    started = F.struct(F.lit(1.0).alias("rate"), F.lit(1.0).alias("point")).alias("state")
    rated = scratch.write(cells.select("p", "n_tokens", started))

    def sums(history: list[tuple[list[float], float]]) -> list[float]:
        now = rated.select("p", "n_tokens", _stepped(F.col("state"), history, most)["rate"].alias("r"))
        row = now.agg(*[F.sum(F.col("r") * F.col("n_tokens") * F.col("p")[i]).alias(f"s{i}") for i in range(k)]).first()
        return [x or 0.0 for x in row]

    now = mass = sums([])
    top = max(range(k), key=lambda i: mass[i])
    total = total if total is not None else mass[top] / (weights[top] or 1.0)
    target = [w * total for w in weights]

    def squares(s: list[float]) -> float:
        return sum((x - t) ** 2 / m for x, t, m in zip(s, target, mass, strict=True) if m > 0)

    def missed(s: list[float]) -> float:
        return max((abs(x - t) for x, t, m in zip(s, target, mass, strict=True) if m > 0), default=0.0)

    history: list[tuple[list[float], float]] = []
    point, age = now, 0
    for _ in range(ROUNDS):
        if missed(now) <= TOLERANCE * total:
            break
        scaled = [(s - t) / m if m > 0 else 0.0 for s, t, m in zip(point, target, mass, strict=True)]
        after = sums([*history, (scaled, 0.0)])
        age = 0 if squares(after) > squares(now) else age + 1
        beta = age / (age + 3)
        history.append((scaled, beta))
        moved = max((abs(a - b) for a, b in zip(after, now, strict=True)), default=0.0)
        point = [a + beta * (a - b) for a, b in zip(after, now, strict=True)]
        now = after
        if moved <= STILL * total:
            break
        if len(history) == WRITTEN:
            rated = scratch.write(rated.select("p", "n_tokens", _stepped(F.col("state"), history, most).alias("state")))
            history = []
    else:
        warnings.warn(f"rates still move after {ROUNDS} rounds: the largest residual is {missed(now):.0f} of {total:.0f} tokens", stacklevel=2)
    return scratch.write(rated.select("p", "n_tokens", _stepped(F.col("state"), history, most)["rate"].alias("rate")))


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], total: float | None = None, most: float = 4.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, p_<domain>..., rate, copies: one row per row of ``docs``.

    copies (long) is the rate rounded up or down by a hash of the id, so that its mean is the rate. A null or empty
    text has no tokens and the posterior of a text without a telling term; null and repeated ids pass through, a row each. A
    domain without a labelled document or without tokens is no target. Of equally likely domains the first by name is
    the likeliest. An empty table gives an empty one. Other columns are ignored.
    """
    _, _, rates, rows = _rated(docs, labelled, weights, total, most, id_col, text_col)
    rated = rows.join(rates, "p")  # a table, so Spark broadcasts it if it is small; else a popular posterior is split
    return rated.select("doc_id", "n_tokens", *[F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(sorted(weights))], "rate", _copies("rate", F.col("doc_id")).alias("copies"))


def _copies(rate: str, key: Column) -> Column:
    return F.floor(F.col(rate) + F.pmod(F.xxhash64(key), F.lit(1 << 20)) / float(1 << 20)).cast("long")


def _rated(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], total: float | None, most: float, id_col: str, text_col: str) -> tuple:
    """The model, cells of equal posteriors, their rates, and (doc_id, n_tokens, p) of each row."""
    domains = sorted(weights)
    share = sum(weights.values())
    scratch = Scratch(docs.sparkSession)
    model = fit_domains(docs, labelled, domains, id_col, text_col)
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = scratch.write(with_posteriors(named, model, F.col("text"), "p", "n_tokens").select("doc_id", "n_tokens", "p"))
    cells = scratch.write(rows.groupBy("p").agg(F.sum("n_tokens").alias("n_tokens")))
    rates = fit_rates(cells, [weights[d] / share for d in domains], scratch, total, most).select("p", "rate")
    return model, cells, rates, rows


def mixed(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], total: float | None = None, most: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, as often as their copies say (with ``most`` = 1 once or never), columns as they were.

    Rows with a null id stay once. Posteriors are computed again beside the text, so that texts aren't shuffled.
    """
    model, _, rates, _ = _rated(docs, labelled, weights, total, most, id_col, text_col)
    p, n, rate, copies = (free_name(docs, name) for name in ("_p", "_n", "_rate", "_copies"))
    rows = with_posteriors(docs, model, F.col(f"`{text_col}`"), p, n).drop(n)
    # Every posterior has a rate. An inner join would put "p is not null" beneath the steps that make p, all in one formula.
    rated = rows.join(rates.select(F.col("p").alias(p), F.col("rate").alias(rate)), p, "left")
    key = F.col(f"`{id_col}`").cast("long")
    rated = rated.withColumn(copies, F.when(key.isNull(), 1).otherwise(_copies(rate, key)))
    kept = rated.where(F.col(copies) >= 1)
    if most > 1:
        kept = kept.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
