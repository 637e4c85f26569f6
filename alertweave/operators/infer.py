"""Paired effects, resampling inference and gates.

Resampling units (scenarios) are few; iterations are generated rows. Draws come
from `md5(seed | iteration | slot)`, so results repeat in any engine.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertweave.functions.hashing import seeded_key
from alertweave.functions.ratios import ratio_or_null
from alertweave.operators.points import safety_limit
from alertweave.session import cut_lineage

try:  # the interpreter's own function takes half the time of OpenSSL's on short texts
    from _md5 import md5
except ImportError:
    from hashlib import md5

_EXACT_UNITS = 20
_MONTE_CARLO = 100_000


def _unit_arrays(effects: DataFrame, keys: Sequence[str], unit: str, effect: str) -> DataFrame:
    """Per `keys`, the finite effects of the resampling units in unit order."""
    kept = effects.filter(F.col(effect).isNotNull() & ~F.isnan(effect))
    pairs = F.sort_array(F.collect_list(F.struct(F.col(unit).alias("u"), F.col(effect).cast("double").alias("e"))))
    return kept.groupBy(*keys).agg(F.transform(pairs, lambda p: p["e"]).alias("_e")).withColumn("_n", F.size("_e"))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def scenario_bootstrap_ci(
    effects: DataFrame, keys: Sequence[str] = (), unit: str = "scenario", effect: str = "effect",
    iterations: int = 20_000, seed: int = 20_260_903, low: float = 0.025, high: float = 0.975,
) -> DataFrame:
    """Percentile interval of the mean, resampling units with replacement (linear interpolation)."""
    units = _unit_arrays(effects, keys, unit, effect)
    drawn = units.withColumn("_it", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))
    drawn = drawn.withColumn("_slot", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    pick = seeded_key(F.lit(seed), F.col("_it"), F.col("_slot")) % F.col("_n")
    drawn = drawn.withColumn("_x", F.element_at("_e", (pick + 1).cast("int")))
    means = drawn.groupBy(*keys, "_it").agg(F.avg("_x").alias("_mean"))
    return means.groupBy(*keys).agg(
        F.percentile("_mean", F.lit(low)).alias("ci_low"), F.percentile("_mean", F.lit(high)).alias("ci_high")
    )


def _sign_rows(units: DataFrame, seed: int) -> DataFrame:
    """Each row of `units` under sign vectors: all of them up to 20 units, 100,000 random ones beyond."""
    exact = F.col("_n") <= _EXACT_UNITS
    last = F.when(exact, F.pow(F.lit(2.0), F.col("_n")).cast("long") - 1).otherwise(
        F.lit(_MONTE_CARLO - 1).cast("long")
    )
    rows = units.withColumn("_mask", F.explode(F.sequence(F.lit(0).cast("long"), last)))

    def sign(i: Column) -> Column:
        # bit i of the mask, or of a hash when the masks cannot enumerate all vectors
        bit = F.when(F.col("_n") <= _EXACT_UNITS, F.pmod(F.floor(F.col("_mask") / F.pow(F.lit(2.0), i)), F.lit(2))).otherwise(
            seeded_key(F.lit(seed), F.col("_mask"), i) % 2
        )
        return bit * 2 - 1

    return rows.withColumn("_signs", F.transform(F.sequence(F.lit(0), F.col("_n") - 1), sign))


def sign_flip_p(
    effects: DataFrame, keys: Sequence[str] = (), unit: str = "scenario", effect: str = "effect", seed: int = 20_260_903
) -> DataFrame:
    """One-sided sign-flip p-value of the mean effect: exact up to 20 units, else Monte Carlo with +1 correction."""
    signed = _sign_rows(_unit_arrays(effects, keys, unit, effect), seed)
    null_mean = _sum(F.zip_with("_signs", "_e", lambda s, e: s * e)) / F.col("_n")
    observed = _sum(F.col("_e")) / F.col("_n")
    exact = F.col("_n") <= _EXACT_UNITS
    hit = F.when(exact, null_mean >= observed - 1e-15).otherwise(null_mean >= observed)
    counted = signed.groupBy(*keys).agg(
        F.sum(hit.cast("long")).alias("_hits"), F.count("*").alias("_all"), F.max("_n").alias("_units")
    )
    p = F.when(F.col("_units") <= _EXACT_UNITS, F.col("_hits") / F.col("_all")).otherwise(
        (F.col("_hits") + 1) / (F.col("_all") + 1)
    )
    return counted.select(*keys, p.alias("p"))


def signed_rank_p(
    effects: DataFrame, keys: Sequence[str] = (), unit: str = "scenario", effect: str = "effect", seed: int = 20_260_903
) -> DataFrame:
    """One-sided signed-rank p-value: zeros are ranked, then dropped; null when all effects are 0."""
    clean = effects.filter(F.col(effect).isNotNull() & ~F.isnan(effect))
    size = F.abs(F.col(effect))
    by_key = Window.partitionBy(*keys)
    average_rank = F.rank().over(by_key.orderBy(size)) + (F.count("*").over(Window.partitionBy(*keys, size)) - 1) / 2.0
    ranked = clean.withColumn("_signed_rank", F.signum(effect) * average_rank)
    everything = ranked.select(*keys).distinct() if keys else None
    units = _unit_arrays(ranked.filter(F.col(effect) != 0), keys, unit, "_signed_rank")
    signed = _sign_rows(units, seed)
    null_plus = _sum(F.zip_with("_signs", "_e", lambda s, e: F.when(s > 0, F.abs(e)).otherwise(0.0)))
    observed = _sum(F.transform("_e", lambda e: F.greatest(e, F.lit(0.0))))
    counted = signed.groupBy(*keys).agg(
        F.sum((null_plus >= observed).cast("long")).alias("_hits"), F.count("*").alias("_all"), F.max("_n").alias("_units")
    )
    p = F.when(F.col("_units") <= _EXACT_UNITS, F.col("_hits") / F.col("_all")).otherwise(
        (F.col("_hits") + 1) / (F.col("_all") + 1)
    )
    result = counted.select(*keys, p.alias("signed_rank_p"))
    return everything.join(result, list(keys), "left") if keys else result


def paired_inference(
    selected: DataFrame,
    grouping: Sequence[str],
    proposed: str,
    baseline: str,
    confirmatory: Sequence[str] | None = None,
    recall: str = "test_triage_incident_recall",
    workload: str = "test_analyst_workload",
    iterations: int = 20_000,
    seed: int = 20_260_903,
) -> DataFrame:
    """Paired effect of `proposed` over `baseline` per grouping.

    Seeds are averaged inside a scenario. The interval and the p-values are given
    only when every scenario has every seed for both methods; otherwise the
    descriptive means stand alone.
    """
    keys = list(grouping)
    eligible = selected.filter(F.col("method").isin(proposed, baseline))
    if confirmatory is not None:
        eligible = eligible.filter(F.col("test_scenario").isin(*confirmatory))
    expected_seeds = eligible.groupBy(*keys).agg(F.countDistinct("seed").alias("_seeds"))

    def mean_of(method: str, column: str) -> Column:
        return F.avg(F.when(F.col("method") == method, F.col(column)))

    pivot = (
        eligible.filter("feasible")
        .groupBy(*keys, "test_scenario", "seed")
        .agg(
            (mean_of(proposed, recall) - mean_of(baseline, recall)).alias("delta_recall"),
            (mean_of(proposed, workload) - mean_of(baseline, workload)).alias("delta_workload"),
        )
        .filter("delta_recall IS NOT NULL AND delta_workload IS NOT NULL")
    )
    by_scenario = pivot.groupBy(*keys, "test_scenario").agg(
        F.avg("delta_recall").alias("delta_recall"), F.avg("delta_workload").alias("delta_workload"), F.count("*").alias("_pairs")
    )
    summary = by_scenario.groupBy(*keys).agg(
        F.count("*").alias("scenario_n"),
        F.sum("_pairs").alias("seed_scenario_pairs"),
        F.avg("delta_recall").alias("mean_delta_recall"),
        F.percentile("delta_recall", F.lit(0.5)).alias("median_delta_recall"),
        F.avg("delta_workload").alias("mean_delta_workload"),
    )
    expected_scenarios = F.lit(len(confirmatory)) if confirmatory is not None else F.col("scenario_n")
    summary = summary.join(expected_seeds, keys).withColumn("expected_scenario_n", expected_scenarios)
    summary = summary.withColumn("expected_pairs", F.col("expected_scenario_n") * F.col("_seeds")).withColumn(
        "complete_panel",
        (F.col("scenario_n") == F.col("expected_scenario_n")) & (F.col("seed_scenario_pairs") == F.col("expected_pairs")),
    )
    complete = by_scenario.join(summary.filter("complete_panel").select(*keys), keys, "left_semi")
    args = dict(keys=keys, unit="test_scenario", effect="delta_recall", seed=seed)
    return (
        summary.drop("_seeds")
        .join(scenario_bootstrap_ci(complete, iterations=iterations, **args), keys, "left")
        .join(sign_flip_p(complete, **args), keys, "left")
        .join(signed_rank_p(complete, **args), keys, "left")
    )


def holm(rows: DataFrame, family: Sequence[str], p: str = "p") -> DataFrame:
    """Step-down adjusted p-values within each family; rows without a p-value keep none."""
    tested = rows.filter(F.col(p).isNotNull())
    by_family = Window.partitionBy(*family)
    rank = F.row_number().over(by_family.orderBy(p))
    size = F.count("*").over(by_family)
    stepped = tested.withColumn("family_size", size).withColumn("_step", (size - rank + 1) * F.col(p)).withColumn("_rank", rank)
    running = F.max("_step").over(by_family.orderBy("_rank").rowsBetween(Window.unboundedPreceding, 0))
    adjusted = stepped.withColumn("p_holm", F.least(running, F.lit(1.0))).drop("_step", "_rank")
    untested = rows.filter(F.col(p).isNull()).select("*", F.lit(1).cast("long").alias("family_size"), F.lit(None).cast("double").alias("p_holm"))
    return adjusted.unionByName(untested)


#: Poisson means up to this are drawn by the distribution function, larger ones by a corrected normal.
LARGEST_EXACT_MEAN = 64
#: Values of a draw that are listed: at a mean of 64 the rest has a probability under 1e-20.
_DRAW_VALUES = 172
_PLAIN_VALUES = 16
#: Iterations that are drawn for a group at a time, and tasks for each such block.
_ITERATION_BLOCK = 1_000
_TASKS_PER_BLOCK = 4


def _poisson_functions(groups: DataFrame, mean: str) -> DataFrame:
    """`mean, _cdf`: the distribution function of a Poisson draw, rounded to 10 places, for the small means among the groups."""
    means = groups.filter(F.col(mean) <= LARGEST_EXACT_MEAN).select(mean).distinct()
    values = F.sequence(F.lit(0), F.lit(_DRAW_VALUES - 1))
    start = F.struct(F.exp(-F.col(mean).cast("double")).alias("p"), F.exp(-F.col(mean).cast("double")).alias("c"), F.array().cast("array<double>").alias("all"))

    def step(a: Column, k: Column) -> Column:
        p = F.when(k == 0, a["p"]).otherwise(a["p"] * F.col(mean) / k)
        c = F.when(k == 0, a["c"]).otherwise(a["c"] + p)
        return F.struct(p.alias("p"), c.alias("c"), F.concat(a["all"], F.array(F.round(c, 10))).alias("all"))

    # values at which the function is one are never passed over
    return means.select(mean, F.filter(F.aggregate(values, start, step)["all"], lambda c: c < 1).alias("_cdf"))


def poisson_weight(mean: Column, cdf: Column, first: Column, second: Column) -> Column:
    """A Poisson draw of `mean` from two 32-bit keys: inverse distribution function, or for a large mean a normal with skew correction."""
    u, v = ((key + 0.5) / F.lit(4_294_967_296.0) for key in (first, second))
    z = F.sqrt(-2.0 * F.ln(u)) * F.cos(2.0 * math.pi * v)
    large = F.greatest(F.floor(mean + F.sqrt(mean.cast("double")) * z + (z * z - 1.0) / 6.0 + 0.5), F.lit(0))
    # the first values one by one, as compiled code; the others by a function over what is left
    passed = sum((F.coalesce(F.get(cdf, F.lit(i)) < u, F.lit(False)).cast("int") for i in range(_PLAIN_VALUES)), F.lit(0))
    rest = F.when(F.size(cdf) > _PLAIN_VALUES, F.size(F.filter(F.slice(cdf, _PLAIN_VALUES + 1, _DRAW_VALUES), lambda c: c < u))).otherwise(0)
    return F.when(mean <= LARGEST_EXACT_MEAN, passed + rest).otherwise(large).cast("long")


def poisson_draws(mean: int, cdf: np.ndarray | None, keys: np.ndarray) -> np.ndarray:
    """`poisson_weight` of one mean for an array of key pairs."""
    u, v = ((keys[:, i] + 0.5) / 4_294_967_296.0 for i in (0, 1))
    if mean <= LARGEST_EXACT_MEAN:
        return np.searchsorted(cdf, u, side="left")
    z = np.sqrt(-2.0 * np.log(u)) * np.cos(2.0 * math.pi * v)
    return np.maximum(np.floor(mean + math.sqrt(mean) * z + (z * z - 1.0) / 6.0 + 0.5), 0).astype("int64")


def _sums_of_draws(seed: int, iterations: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Per iteration, the weighted counts of the groups that a task meets; it holds sums, never the draws of two groups."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heads, sums = {}, {}
        for batch in batches:
            for length, baseline, selector, copies, cdf, block in batch.itertuples(index=False, name=None):
                if block not in sums:
                    span = range(block * _ITERATION_BLOCK, min((block + 1) * _ITERATION_BLOCK, iterations))
                    heads[block], sums[block] = [f"{seed}|{i}|".encode() for i in span], np.zeros((len(span), 3), "int64")
                tail = f"{length}|{baseline}|{selector}".encode()
                digests = b"".join([md5(head + tail).digest() for head in heads[block]])
                keys = np.frombuffer(digests, ">u4").reshape(-1, 4)
                sums[block] += np.outer(poisson_draws(copies, cdf, keys), np.array([length, baseline, selector], "int64"))
        for block, total in sums.items():
            part = pd.DataFrame(total, columns=["_d", "_b", "_s"])
            part.insert(0, "iteration", np.arange(len(part), dtype="int32") + block * _ITERATION_BLOCK)
            yield part

    return run


def grouped_ratio_bootstrap(
    sequences: DataFrame, iterations: int = 20_000, seed: int = 20_260_903, seeds: int = 1, scale: float = 1.0
) -> DataFrame:
    """Cluster bootstrap of `selector - baseline` rates over sequences (`length, baseline, selector` counts).

    Sequences with equal counts are one group; the sum of their weights in an iteration is a
    Poisson draw whose mean is the size of the group, from keys of (seed, iteration, counts). So draws
    do not depend on partitioning, repeat in any engine, and are added up before the shuffle.
    """
    groups = sequences.groupBy("length", "baseline", "selector").agg(F.count("*").alias("copies"))
    drawn = groups.join(F.broadcast(_poisson_functions(groups, "copies")), "copies", "left")
    # groups may be few or many: pairs of a group and a block of iterations are dealt evenly
    blocks = -(-iterations // _ITERATION_BLOCK)
    drawn = drawn.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition(blocks * _TASKS_PER_BLOCK)
    summed = drawn.select("length", "baseline", "selector", "copies", "_cdf", "_block").mapInPandas(
        _sums_of_draws(seed, iterations), "iteration int, _d long, _b long, _s long"
    ).groupBy("iteration").agg(*[F.sum(c).alias(c) for c in ("_d", "_b", "_s")])
    # a draw may leave no sequence: it has no rate and no part in the interval
    rate = lambda c: F.try_divide(F.lit(scale) * F.col(c), F.lit(seeds) * F.col("_d"))
    rates = summed.select("iteration", rate("_b").alias("baseline_rate"), rate("_s").alias("selector_rate"))
    return rates.select(
        "*",
        (F.col("selector_rate") - F.col("baseline_rate")).alias("gain"),
        (F.col("selector_rate") - safety_limit(F.col("baseline_rate"))).alias("safety_violation"),
    )


def interval(draws: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    return draws.groupBy(*keys).agg(
        F.percentile(column, F.lit(0.025)).alias("ci_low"), F.percentile(column, F.lit(0.975)).alias("ci_high"),
        F.avg(column).alias("mean"),
    )


def subset_sensitivity(rows: DataFrame, trained: DataFrame, seed: int = 260_908) -> DataFrame:
    """One row on what stands on sequences whose content training has not seen.

    `rows` are tokens of the final sequences (`seq_id, label, pattern, baseline, selector`). Both bootstraps run on the
    unseen sequences; the flags name criteria that cannot bind: a limit above all events, nearly everything in review,
    nearly all normal events escalated, mostly seen content.
    """
    flagged = lambda c: F.sum((F.col(c) > 0).cast("long"))
    # tokens are added up before sequences meet the seen contents
    whole_lines = rows.groupBy("seq_id", "label", "pattern").agg(
        F.count("*").alias("length"), flagged("baseline").alias("baseline"), flagged("selector").alias("selector"),
        F.sum((F.col("baseline") != 0).cast("long")).alias("_review"),
    )
    marked = whole_lines.join(trained.select("pattern", F.lit(True).alias("_seen")), "pattern", "left").withColumn("_seen", F.coalesce("_seen", F.lit(False)))
    totals = marked.groupBy("seq_id", "label", "_seen").agg(*[F.sum(c).alias(c) for c in ("length", "baseline", "selector", "_review")])
    totals = cut_lineage(totals)
    fresh = totals.filter("NOT _seen")
    gain = interval(grouped_ratio_bootstrap(fresh.filter("label = 1"), seed=seed), "gain")
    safety = interval(grouped_ratio_bootstrap(fresh.filter("label = 0"), seed=seed + 1, scale=1000.0), "safety_violation")
    normal = F.col("label") == 0
    whole = totals.agg(
        F.countDistinct("seq_id").alias("sequences"), F.countDistinct(F.when(F.col("_seen"), F.col("seq_id"))).alias("overlap_sequences"),
        (F.sum("_review") / F.sum("length")).alias("baseline_workload"),
        (1000.0 * ratio_or_null(F.sum(F.when(normal, F.col("baseline"))), F.sum(F.when(normal, F.col("length"))))).alias("baseline_false_rate"),
    )
    incident = lambda c: F.sum(F.when(F.col("label") == 1, F.col(c)))
    sums = fresh.agg(
        F.count("*").alias("fresh_sequences"), F.coalesce(F.sum("label"), F.lit(0)).cast("long").alias("fresh_incident_sequences"),
        (ratio_or_null(incident("selector"), incident("length")) - ratio_or_null(incident("baseline"), incident("length"))).alias("fresh_recall_gain"),
    )
    one = F.lit(1).alias("_one")
    span = lambda d, p: d.select(one, F.col("ci_low").alias(f"{p}_ci_low"), F.col("ci_high").alias(f"{p}_ci_high"))
    joined = whole.select("*", one).join(sums.select("*", one), "_one").join(span(gain, "gain"), "_one").join(span(safety, "safety"), "_one").drop("_one")
    share = F.col("overlap_sequences") / F.col("sequences")
    return joined.select(
        "*", share.alias("overlap_share"), (F.col("baseline_false_rate") * 1.05 > 1000).alias("limit_nonbinding"),
        (F.col("baseline_workload") > 0.95).alias("workload_nonbinding"), (F.col("baseline_false_rate") > 900).alias("escalation_nonbinding"),
        (share > 0.5).alias("overlap_nonbinding"),
    )


def scenario_effects(pairs: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ("scenario",)) -> DataFrame:
    """Seed-averaged means per scenario, and the seed gains in seed order."""
    gains = F.transform(F.sort_array(F.collect_list(F.struct("seed", metrics[0]))), lambda x: x[metrics[0]])
    return pairs.groupBy(*keys).agg(*[F.avg(m).alias(f"mean_{m}") for m in metrics], gains.alias(f"seed_{metrics[0]}"))


def relative_increase(selector: Column, baseline: Column) -> Column:
    """x / 0 is infinite unless x is 0 too."""
    return F.when(baseline == 0, F.when(selector == 0, 0.0).otherwise(float("inf"))).otherwise(selector / baseline - 1)


def pooled_rates(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """False escalations per 1000 over all rows and as a mean of scenario means."""
    per_scenario = pairs.groupBy(*keys, "scenario").agg(
        F.sum("baseline_auto_false_incident").alias("_b"),
        F.sum("selector_auto_false_incident").alias("_s"),
        F.sum("nonincidents").alias("_n"),
        F.avg("baseline_false_escalations_per_1000_nonincidents").alias("_mb"),
        F.avg("selector_false_escalations_per_1000_nonincidents").alias("_ms"),
    )
    pooled = per_scenario.groupBy(*keys).agg(
        (1000.0 * ratio_or_null(F.sum("_b"), F.sum("_n"))).alias("pooled_baseline"),
        (1000.0 * ratio_or_null(F.sum("_s"), F.sum("_n"))).alias("pooled_selector"),
        F.avg("_mb").alias("macro_baseline"),
        F.avg("_ms").alias("macro_selector"),
    )
    return pooled.select(
        "*",
        relative_increase(F.col("pooled_selector"), F.col("pooled_baseline")).alias("pooled_relative_increase"),
        relative_increase(F.col("macro_selector"), F.col("macro_baseline")).alias("macro_relative_increase"),
    )


def upper_bound_gate(effects: DataFrame, each: float, best: float, gain: str = "mean_recall_gain", keys: Sequence[str] = ()) -> DataFrame:
    """Passes when every scenario gains at least `each`, or one gains `best` and none loses."""
    low, high = F.min(gain), F.max(gain)
    return effects.groupBy(*keys).agg(
        low.alias("least_gain"), high.alias("largest_gain"),
        ((low >= each) | ((high >= best) & (low >= 0))).alias("passed"),
    )


def confirmation_gate(
    effects: DataFrame, ci: DataFrame, pooled: DataFrame, evidence: DataFrame,
    gain: str = "mean_recall_gain", least_positive: int = 4, largest_increase: float = 0.05,
) -> DataFrame:
    """CI above 0, enough positive scenarios, bounded false-escalation increase, fixed width, no labels read.

    `evidence` has rows of `widths_and_labels`, one per selector; its other columns are kept.
    """
    counts = effects.agg(F.sum((F.col(gain) > 0).cast("int")).alias("positive_scenarios"), F.avg(gain).alias("mean_gain"))
    one = F.lit(1).alias("_one")
    joined = counts.select("*", one).join(ci.select("*", one), "_one").join(pooled.select("*", one), "_one")
    joined = joined.join(evidence.select("*", one), "_one").drop("_one")
    flags = {
        "ci_pass": F.col("ci_low") > 0,
        "count_pass": F.col("positive_scenarios") >= least_positive,
        "safety_pass": F.col("pooled_relative_increase") <= largest_increase,
        "width_pass": F.col("full_width"),
        "label_free_pass": F.col("label_free"),
    }
    every = None
    for flag in flags.values():
        every = flag if every is None else every & flag
    named = [c for c in evidence.columns if c not in ("full_width", "label_free")]
    return joined.select(
        *named, "positive_scenarios", "mean_gain", "ci_low", "ci_high", "pooled_relative_increase",
        *[v.alias(k) for k, v in flags.items()], every.alias("succeeds"),
    )


# Metrics compared between runs.
DELTA_METRICS = (
    "overall_reduction", "coverage", "cluster_purity", "auto_decided_rate", "reject_rate", "binary_f1", "macro_f1", "weighted_f1",
)


def compare_to_baseline(runs: DataFrame, baseline: str, key: str = "method") -> DataFrame:
    """Metric deltas of every other run and the role they suggest; missing metrics count as 0."""
    filled = runs.na.fill(0.0, list(DELTA_METRICS))
    base = filled.filter(F.col(key) == baseline).select(F.lit(1).alias("_one"), *[F.col(m).alias(f"_b_{m}") for m in DELTA_METRICS])
    others = filled.filter(F.col(key) != baseline).withColumn("_one", F.lit(1)).join(base, "_one")
    delta = {m: F.col(m) - F.col(f"_b_{m}") for m in DELTA_METRICS}
    role = (
        F.when((delta["binary_f1"] >= 0.02) & (delta["auto_decided_rate"] >= -0.05) & (delta["reject_rate"] <= 0.05), "primary_candidate")
        .when(delta["overall_reduction"] > 0, "workload_ablation")
        .otherwise("ablation_only")
    )
    return others.select(key, role.alias("recommended_role"), *[d.alias(f"delta_{m}") for m, d in delta.items()])


def widths_and_labels(contexts: DataFrame, width: int, chosen: str = "slots", again: str = "slots_without_labels") -> DataFrame:
    """`full_width, label_free` of a selector, from what it chose.

    `full_width`: every alert with `width` candidates or more got exactly that many, every other one all it has.
    `label_free`: the choice is the same when the label of the alert itself is turned around.
    """
    fits = F.size(chosen) == F.least(F.lit(width), F.col("candidates"))
    return contexts.agg(
        F.coalesce(F.min(fits.cast("int")) == 1, F.lit(False)).alias("full_width"),
        F.coalesce(F.min((F.col(chosen) == F.col(again)).cast("int")) == 1, F.lit(False)).alias("label_free"),
    )


def external_check(gain: DataFrame, safety: DataFrame) -> DataFrame:
    """`passed`: the recall gain is above zero and the safety violation not above zero over the whole interval."""
    one = lambda d, p: d.select(F.lit(1).alias("_one"), *[F.col(c).alias(f"{p}_{c}") for c in ("ci_low", "ci_high")])
    both = one(gain, "gain").join(one(safety, "safety"), "_one")
    passed = (F.col("gain_ci_low") > 0) & (F.col("safety_ci_high") <= 0)
    return both.select("gain_ci_low", "gain_ci_high", "safety_ci_low", "safety_ci_high", F.coalesce(passed, F.lit(False)).alias("passed"))


def study_decision(decisions: DataFrame, required: Sequence[str]) -> DataFrame:
    """Conjunction over `name, passed` decisions; a required decision that is missing or null fails."""
    wanted = decisions.select("name", "passed")
    flags = [
        F.coalesce(F.max(F.when(F.col("name") == name, F.col("passed").cast("int"))), F.lit(0)) == 1 for name in required
    ]
    every = flags[0]
    for flag in flags[1:]:
        every = every & flag
    return wanted.agg(*[f.alias(n) for n, f in zip(required, flags)], every.alias("study_succeeds"))
