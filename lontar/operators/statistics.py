"""Paired comparisons of conditions: rank tests, effect sizes, bootstrap intervals and strata.

Input is long: query_id, condition, value (and a stratum, if any). A condition's family is the text before ``__``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lontar.functions.tails import chi_square_tail, normal_tail, signed_rank_tail

#: Fewest pairs that the signed-rank test takes, and most for which its exact distribution is used.
LEAST, EXACT = 6, 50


def family(condition: Column) -> Column:
    return F.when(condition.contains("__"), F.substring_index(condition, "__", 1)).otherwise("_global_")


def run_id(retriever: Column, strategy: Column) -> Column:
    return F.concat_ws("__", retriever, strategy)


def _first(values: DataFrame, strata: list[str]) -> DataFrame:
    """One value for each (stratum, query, condition): of repeated ones the first by ``place`` where rows have one, as
    those read from files do, and else the smallest; nulls go."""
    pick = F.min_by("value", "place") if "place" in values.columns else F.min("value")
    return values.where("value is not null").groupBy(*strata, "query_id", "condition").agg(pick.alias("value"))


def condition_pairs(values: DataFrame, strata: list[str] | None = None) -> DataFrame:
    """retriever_family, condition_a < condition_b, query_id, a, b: queries that have both (and strata)."""
    strata = strata or []
    one = _first(values, strata).withColumn("retriever_family", family(F.col("condition")))
    left = one.select(*strata, "query_id", "retriever_family", F.col("condition").alias("condition_a"), F.col("value").alias("a"))
    right = one.select(*strata, "query_id", "retriever_family", F.col("condition").alias("condition_b"), F.col("value").alias("b"))
    return left.join(right, [*strata, "query_id", "retriever_family"]).where("condition_a < condition_b")


def average_rank(keys: list[str], order: Column) -> Column:
    """Rank within ``keys`` by ``order``, ties sharing the mean of theirs."""
    rank = F.rank().over(Window.partitionBy(*keys).orderBy(order))
    ties = F.count("*").over(Window.partitionBy(*keys, order))
    return rank + (ties - 1) / 2


def signed_ranks(pairs: DataFrame, keys: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """keys, n (non-zero differences a - b), t_plus, t_minus, ties (sum of t^3 - t)."""
    d = pairs.select(*keys, (F.col(a) - F.col(b)).alias("d")).where("d <> 0").withColumn("m", F.abs("d"))
    ranked = d.withColumn("r", average_rank(keys, F.col("m"))).withColumn("t", F.count("*").over(Window.partitionBy(*keys, "m")))
    return ranked.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0.0)).alias("t_plus"),
        F.sum(F.when(F.col("d") < 0, F.col("r")).otherwise(0.0)).alias("t_minus"),
        F.sum((F.col("t") * F.col("t") - 1).cast("double")).alias("ties"),
    )


def wilcoxon(pairs: DataFrame, keys: list[str], alternative: str | Column = "two-sided") -> DataFrame:
    """keys, paired, n, statistic, z, p_value of the signed-rank test of a against b.

    ``alternative``: two-sided, less (a below b) or greater. The statistic is the smaller rank sum if two-sided, else
    that of positive differences. Exact for up to ``EXACT`` pairs without ties and zeros, else by the normal law. Fewer
    than ``LEAST`` pairs give nulls; all differences zero give statistic 0 and p 1.
    """
    side = F.lit(alternative) if isinstance(alternative, str) else alternative
    paired = pairs.groupBy(*keys).agg(F.count("*").alias("paired"))
    sums = paired.join(signed_ranks(pairs, keys), keys, "left").withColumn("side", side)
    n = F.coalesce(F.col("n"), F.lit(0))
    sums = sums.withColumn("n", n)
    nn = F.col("n").cast("double")
    var = nn * (nn + 1) * (2 * nn + 1) / 24 - F.col("ties") / 48
    z = (F.col("t_plus") - nn * (nn + 1) / 4) / F.sqrt(var)
    exact = (F.col("n") <= EXACT) & (F.col("ties") == 0) & (F.col("n") == F.col("paired"))
    up, down = F.col("t_plus"), F.col("t_minus")
    sums = sums.withColumn("z", z)
    one = F.when(exact, signed_rank_tail(F.when(exact, F.when(F.col("side") == "less", down).when(F.col("side") == "greater", up).otherwise(F.greatest(up, down))), F.when(exact, F.col("n"))))
    one = one.otherwise(normal_tail(F.when(F.col("side") == "less", -F.col("z")).when(F.col("side") == "greater", F.col("z")).otherwise(F.abs("z"))))
    p = F.when(F.col("side") == "two-sided", F.least(F.lit(1.0), 2 * one)).otherwise(one)
    few, flat = F.col("paired") < LEAST, F.col("n") == 0
    statistic = F.when(F.col("side") == "two-sided", F.least(up, down)).otherwise(up)
    return sums.select(*keys, "paired", "n", F.when(few, None).when(flat, 0.0).otherwise(statistic).alias("statistic"), F.when(few | flat, None).otherwise(F.col("z")).alias("z"), F.when(few, None).when(flat, 1.0).otherwise(p).alias("p_value"))


def cliffs_delta(pairs: DataFrame, keys: list[str], x: str = "b", y: str = "a") -> DataFrame:
    """keys, cliffs_delta: (pairs with x above y - those below) / all pairs, from ranks in the union of both sides."""
    both = pairs.select(*keys, F.col(x).alias("v"), F.lit(1).alias("s")).unionAll(pairs.select(*keys, F.col(y).alias("v"), F.lit(0).alias("s")))
    ranked = both.withColumn("r", average_rank(keys, F.col("v")))
    n, m = F.sum("s").cast("double"), F.sum(1 - F.col("s")).cast("double")
    u = F.sum(F.when(F.col("s") == 1, F.col("r")).otherwise(0.0)) - n * (n + 1) / 2
    return ranked.groupBy(*keys).agg((2 * u / (n * m) - 1).alias("cliffs_delta"))


def bootstrap(pairs: DataFrame, keys: list[str], resamples: int = 10_000, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """keys, ci_low, ci_high: interval of the mean of b - a over resampled queries, in order of their id as a string."""
    types = dict(pairs.dtypes)
    fields = ", ".join(f"{k} {types[k]}" for k in keys)

    def interval(pdf: pd.DataFrame) -> pd.DataFrame:
        delta = pdf.assign(q=pdf.query_id.astype(str)).sort_values("q")
        delta = (delta.b - delta.a).to_numpy()
        rng = np.random.default_rng(seed)
        step = max(1, 4_000_000 // max(1, len(delta)))
        means = np.concatenate([rng.choice(delta, size=(min(step, resamples - k), len(delta)), replace=True).mean(axis=1) for k in range(0, resamples, step)])
        low, high = np.quantile(means, [(1 - confidence) / 2, (1 + confidence) / 2])
        return pd.DataFrame([[*pdf[keys].iloc[0], low, high]], columns=[*keys, "ci_low", "ci_high"])

    return pairs.select(*keys, F.col("query_id").cast("string").alias("query_id"), F.col("a").cast("double"), F.col("b").cast("double")).groupBy(*keys).applyInPandas(interval, f"{fields}, ci_low double, ci_high double")


def pairwise(values: DataFrame, strata: list[str] | None = None, directions: dict[tuple[str, str], str] | None = None, resamples: int | None = 10_000, bonferroni: bool = True) -> DataFrame:
    """The pairwise table: for each two conditions of a family (and stratum) their mean difference b - a, signed-rank
    test of a against b with Bonferroni's correction by the family's number of pairs, Cliff's delta, and bootstrap
    interval (unless ``resamples`` is None). ``directions`` gives one-sided alternatives by pair."""
    strata = strata or []
    keys = [*strata, "retriever_family", "condition_a", "condition_b"]
    pairs = condition_pairs(values, strata)
    means = pairs.groupBy(*keys).agg(F.avg(F.col("b") - F.col("a")).alias("mean_delta_b_minus_a"))
    side = F.lit("two-sided")
    for (a, b), direction in (directions or {}).items():
        side = F.when((F.col("condition_a") == a) & (F.col("condition_b") == b), direction).otherwise(side)
    test = wilcoxon(pairs, keys, side)
    out = means.join(test, keys).join(cliffs_delta(pairs, keys), keys)
    if resamples:
        out = out.join(bootstrap(pairs, keys, resamples), keys)
    size = F.count("*").over(Window.partitionBy(*strata, "retriever_family"))
    out = out.withColumn("alternative", side).withColumn("bonferroni_family_size", size)
    corrected = F.least(F.lit(1.0), F.col("p_value") * F.col("bonferroni_family_size")) if bonferroni else F.col("p_value")
    columns = [*keys, "alternative", F.col("paired").alias("paired_queries"), "mean_delta_b_minus_a", F.col("statistic").alias("wilcoxon_statistic"), F.col("z").alias("wilcoxon_z"), F.col("p_value").alias("wilcoxon_p_value"), corrected.alias("wilcoxon_bonferroni_p_value"), "bonferroni_family_size", "cliffs_delta"]
    if resamples:
        columns += [F.col("ci_low").alias("bootstrap_ci_low"), F.col("ci_high").alias("bootstrap_ci_high")]
    return out.select(*columns)


def stratified_pairwise(values: DataFrame, strata: DataFrame, **options: object) -> DataFrame:
    """``pairwise`` within the tertiles of ``strata`` (query_id, tertile), low, mid, high."""
    joined = values.withColumn("query_id", F.col("query_id").cast("string")).join(strata.select(F.col("query_id").cast("string").alias("query_id"), "tertile"), "query_id")
    order = F.when(F.col("tertile") == "low", 0).when(F.col("tertile") == "mid", 1).otherwise(2)
    return pairwise(joined, ["tertile"], **options).orderBy(order, "retriever_family", "condition_a", "condition_b")


def friedman(values: DataFrame) -> DataFrame:
    """retriever_family, conditions, paired_queries, friedman_statistic, friedman_p_value over queries that have all of a
    family's conditions; nulls with fewer than three conditions or no such query. Ties are corrected for."""
    one = _first(values, []).withColumn("retriever_family", family(F.col("condition")))
    size = one.groupBy("retriever_family").agg(F.countDistinct("condition").alias("k"), F.array_join(F.array_sort(F.collect_set("condition")), "|").alias("conditions"))
    sized = one.join(F.broadcast(size), "retriever_family")  # a row for each family
    block = Window.partitionBy("retriever_family", "query_id")
    full = sized.withColumn("have", F.count("*").over(block)).where("have = k")
    keys = ["retriever_family", "query_id"]
    ranked = full.withColumn("r", average_rank(keys, F.col("value"))).withColumn("t", F.count("*").over(Window.partitionBy(*keys, "value")))
    sums = ranked.groupBy("retriever_family", "k", "conditions", "condition").agg(F.sum("r").alias("s"), F.count("*").alias("n"), F.sum((F.col("t") * F.col("t") - 1).cast("double")).alias("ties"))
    total = sums.groupBy("retriever_family").agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.max("n").alias("n"), F.sum("ties").alias("ties"))
    out = size.join(total, "retriever_family", "left")
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    raw = 12 / (n * k * (k + 1)) * F.col("ss") - 3 * n * (k + 1)
    fix = 1 - F.col("ties") / (n * k * (k * k - 1))
    stat = F.when((F.col("k") >= 3) & (F.coalesce("n", F.lit(0)) > 0) & (fix > 0), raw / fix)
    out = out.withColumn("friedman_statistic", stat)
    return out.select("retriever_family", "conditions", F.coalesce("n", F.lit(0)).alias("paired_queries"), "friedman_statistic", chi_square_tail("friedman_statistic", (F.col("k") - 1).cast("long")).alias("friedman_p_value"))


def effect_rows(values: DataFrame, baseline: str, resamples: int | None = 10_000) -> DataFrame:
    """condition, mean_delta, ci_low, ci_high, cliffs_delta, n_pairs of each other condition against ``baseline``.

    A condition that has no query in common with it is an error. ``resamples`` of None leaves the interval out.
    """
    one = _first(values, [])
    base = one.where(F.col("condition") == baseline).select("query_id", F.col("value").alias("a"))
    pairs = one.where(F.col("condition") != baseline).select("query_id", "condition", F.col("value").alias("b")).join(base, "query_id")
    keys = ["condition"]
    means = pairs.groupBy("condition").agg(F.avg(F.col("b") - F.col("a")).alias("mean_delta"), F.count("*").alias("n_pairs"))
    every = one.where(F.col("condition") != baseline).select("condition").distinct().join(means, keys, "left")
    found = F.when(F.col("n_pairs").isNotNull(), F.col("n_pairs")).otherwise(F.raise_error(F.concat(F.lit("no query in common with the baseline: "), "condition")))
    out = every.withColumn("n_pairs", found).join(cliffs_delta(pairs, keys), keys, "left")
    if resamples is None:
        return out.select("condition", "mean_delta", "cliffs_delta", "n_pairs")
    return out.join(bootstrap(pairs, keys, resamples), keys, "left").select("condition", "mean_delta", "ci_low", "ci_high", "cliffs_delta", "n_pairs")


def tertile_cuts(scores: DataFrame, column: str) -> DataFrame:
    """One row: low and high, the thirds of ``column`` by linear interpolation."""
    return scores.agg(F.percentile(column, F.lit(1 / 3)).alias("low"), F.percentile(column, F.lit(2 / 3)).alias("high"))
