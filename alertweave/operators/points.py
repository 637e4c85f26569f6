"""Choice of an operating point over a grid of settings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertweave.functions.ratios import finite_or_null


def operating_grid(
    rows: DataFrame,
    settings: Sequence[tuple[float, float]] | None = None,
    eps: Sequence[float] = (),
    thresholds: Sequence[float] = (),
    rule_thresholds: Sequence[float] | None = None,
) -> DataFrame:
    """Rows under every setting: given (eps, threshold) pairs, their cross product, or rule thresholds (eps null)."""
    if rule_thresholds is not None:
        points = [(None, t) for t in rule_thresholds]
    elif settings is not None:
        points = list(settings)
    else:
        points = [(e, t) for e in eps for t in thresholds]
    grid = F.array(
        *[
            F.struct(
                F.lit(e).cast("double").alias("eps"),
                F.lit(float(t)).alias("threshold"),
                F.lit(i).alias("grid_order"),
            )
            for i, (e, t) in enumerate(points)
        ]
    )
    return rows.withColumn("_point", F.explode(grid)).select("*", "_point.*").drop("_point")


def _worst_last(column: str) -> Column:
    """Undefined ranks as the worst value."""
    return F.coalesce(finite_or_null(F.col(column).cast("double")), F.lit(float("-inf")))


def _first(points: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    ranked = points.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter("_rank = 1").drop("_rank")


def _smaller_setting() -> list[Column]:
    return [F.coalesce("eps", F.lit(-1.0)).asc(), F.coalesce("threshold", F.lit(-1.0)).asc()]


def with_budgets(points: DataFrame, budgets: Sequence[float]) -> DataFrame:
    return points.withColumn("budget", F.explode(F.array(*[F.lit(float(b)) for b in budgets])))


def _keep_infeasible(points: DataFrame, chosen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every key group, with nulls and `feasible = false` where nothing qualified."""
    groups = points.select(*keys).distinct()
    return groups.join(chosen.withColumn("feasible", F.lit(True)), list(keys), "left").withColumn(
        "feasible", F.coalesce("feasible", F.lit(False))
    )


def select_validation(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Best validation recall, then precision, then workload among points within the validation budget."""
    feasible = points.filter(F.col("validation_analyst_workload") <= F.col("budget"))
    order = [
        _worst_last("validation_triage_incident_recall").desc(),
        _worst_last("validation_triage_precision").desc(),
        _worst_last("validation_analyst_workload").desc(),
        *_smaller_setting(),
    ]
    return _keep_infeasible(points, _first(feasible, keys, order), keys)


def select_calibrated(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Closest unlabelled test workload below the budget; ties by validation recall and precision."""
    feasible = points.filter(F.col("test_analyst_workload") <= F.col("budget"))
    order = [
        _worst_last("test_analyst_workload").desc(),
        _worst_last("validation_triage_incident_recall").desc(),
        _worst_last("validation_triage_precision").desc(),
        *_smaller_setting(),
    ]
    return _keep_infeasible(points, _first(feasible, keys, order), keys)


def default_point(points: DataFrame, eps: float, threshold: float, tolerance: float = 1e-9) -> DataFrame:
    """The points at one setting."""
    return points.filter(
        (F.abs(F.col("eps") - eps) <= tolerance) & (F.abs(F.col("threshold") - threshold) <= tolerance)
    )


def select_baseline_matched(
    points: DataFrame, group: Sequence[str], method: str, eps: float, threshold: float
) -> DataFrame:
    """Per group, the reference's default workload is the budget; each other method takes its largest workload within it.

    Groups without exactly one reference point are left out. Outcomes of the test
    stream are not read.
    """
    reference = default_point(points.filter(F.col("method") == method), eps, threshold)
    budgets = (
        reference.groupBy(*group)
        .agg(F.count("*").alias("_n"), F.max("test_analyst_workload").alias("budget"))
        .filter("_n = 1")
        .drop("_n")
    )
    budgeted = points.join(budgets, list(group))
    own = default_point(budgeted.filter(F.col("method") == method), eps, threshold)
    others = budgeted.filter(F.col("method") != method)
    feasible = others.filter(F.col("test_analyst_workload") <= F.col("budget") + 1e-12)
    keys = [*group, "method", "budget"]
    best = _first(feasible, keys, [F.col("test_analyst_workload").desc(), *_smaller_setting()])
    kept = _keep_infeasible(others, best, keys)
    return kept.unionByName(own.withColumn("feasible", F.lit(True)).select(kept.columns))


def _closest(points: DataFrame, keys: Sequence[str], target: str) -> DataFrame:
    gap = F.abs(F.col("test_review_workload") - F.col(target))
    return _first(points, keys, [gap.asc(), F.col("test_review_workload").asc(), F.col("grid_order").asc()])


def closest_workload(points: DataFrame, keys: Sequence[str], target: str = "target_workload") -> DataFrame:
    """Smallest workload gap, then lower workload, then grid order; outcomes are not read."""
    return _closest(points, keys, target)


def closest_safe_workload(
    points: DataFrame, keys: Sequence[str], target: str = "target_workload", limit: str = "safety_limit"
) -> DataFrame:
    """As `closest_workload` among points whose validation false-escalation rate is within the limit."""
    safe = points.filter(F.col("validation_false_escalations_per_1000_nonincidents") <= F.col(limit))
    return _keep_infeasible(points, _closest(safe, keys, target), keys)


def bracketed_mix(points: DataFrame, keys: Sequence[str], metrics: Sequence[str], target: str = "target_workload") -> DataFrame:
    """Linear mix of the two points that bracket the target workload; the nearest point when unbracketed."""
    load = F.col("test_review_workload")
    carried = F.struct(load.alias("load"), F.col("grid_order"), *[F.col(f"test_{m}").alias(m) for m in metrics])
    below, above = load <= F.col(target), load >= F.col(target)
    sides = points.groupBy(*keys, target).agg(
        F.max_by(F.when(below, carried), F.when(below, F.struct(load, -F.col("grid_order")))).alias("_low"),
        F.min_by(F.when(above, carried), F.when(above, F.struct(load, F.col("grid_order")))).alias("_high"),
        F.min_by(carried, F.struct(F.abs(load - F.col(target)), load, F.col("grid_order"))).alias("_near"),
    )
    both = F.col("_low").isNotNull() & F.col("_high").isNotNull()
    low, high = F.when(both, F.col("_low")).otherwise(F.col("_near")), F.when(both, F.col("_high")).otherwise(F.col("_near"))
    sides = sides.select(*keys, target, both.alias("bracketed"), low.alias("_low"), high.alias("_high"))
    width = F.col("_high.load") - F.col("_low.load")
    share = F.when(F.col("bracketed") & (F.abs(width) > 1e-15), (F.col(target) - F.col("_low.load")) / width).otherwise(0.0)
    mixed = sides.withColumn("upper_probability", share)
    p = F.col("upper_probability")

    def mix(name: str) -> Column:
        return (1 - p) * F.col(f"_low.{name}") + p * F.col(f"_high.{name}")

    return mixed.select(
        *keys, "bracketed",
        F.col("_low.grid_order").alias("lower_index"),
        F.col("_high.grid_order").alias("upper_index"),
        "upper_probability",
        mix("load").alias("workload"),
        *[mix(m).alias(m) for m in metrics],
    )


def lowest_workload_setting(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    order = [
        F.col("validation_analyst_workload").asc(),
        F.col("validation_triage_incident_recall").desc(),
        F.col("eps").asc(),
        F.col("threshold").asc(),
    ]
    return _first(points, keys, order)


def best_candidate(points: DataFrame, keys: Sequence[str], penalty: str) -> DataFrame:
    """Best (recall, group recall, precision, smallest penalty) on validation."""
    order = [
        F.col("validation_triage_incident_recall").desc_nulls_last(),
        F.col("validation_incident_group_recall").desc_nulls_last(),
        F.col("validation_triage_precision").desc_nulls_last(),
        F.col(penalty).asc(),
    ]
    return _first(points, keys, order)


def safety_limit(rate: Column, version: str = "hybrid", switch: float = 1.0, margin: float = 1.0, relative: float = 0.05) -> Column:
    """Largest tolerated false-escalation rate per 1000: one more below `switch`, 5 % more above it."""
    scaled = rate * (1.0 + relative)
    if version == "relative_only":
        limit = scaled
    elif version == "hybrid":
        limit = F.when(rate < switch, rate + margin).otherwise(scaled)
    else:
        raise ValueError(f"unknown safety limit {version!r}")
    return F.when(rate < 0, F.raise_error(F.lit("rate must not be negative")).cast("double")).otherwise(limit)


def flatten_selection(selected: DataFrame, policy: str, budget_design: str | None = None) -> DataFrame:
    """Wide selection rows; infeasible groups stay with null settings and metrics."""
    design = F.lit(budget_design) if budget_design else F.concat(F.lit("fixed_"), F.format_number("budget", "0.##"))
    return selected.withColumn("policy", F.lit(policy)).withColumn("budget_design", design)
