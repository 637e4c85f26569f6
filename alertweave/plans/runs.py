"""Run records: triage methods over every fold, seed and operating setting.

A record row is one operating point of one run on one split, with the operational
and strict metrics. Predictions depend on (target, newest context event) only, so
alerts are first counted per (scenario, target, newest event, truth, group); the
grid multiplies those counts, never the alerts.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertweave.functions import encode as E
from alertweave.operators.context import strict_past_context
from alertweave.operators.folds import fold_rows, reveal_labels
from alertweave.operators.metrics import triage_metrics
from alertweave.operators.points import operating_grid
from alertweave.operators.stats import rule_prior
from alertweave.session import cut_lineage

RUN_KEYS = ("method", "test_scenario", "seed")
POINT_KEYS = (*RUN_KEYS, "eps", "threshold", "grid_order")


@dataclass(frozen=True)
class Study:
    """Label budget, seeds and settings of a study.

    For the two context methods `eps` is the posterior from which an alert counts
    as an incident and `threshold` the least next-event confidence; the rule prior
    has a posterior threshold only.
    """

    budget: int = 550
    ratio: int = 10
    seeds: tuple[int, ...] = (11, 23)
    settings: tuple[tuple[float, float], ...] = field(
        default_factory=lambda: tuple((e, t) for e in (0.05, 0.10, 0.15, 0.30) for t in (0.01, 0.02, 0.03))
    )
    rule_thresholds: tuple[float, ...] = (0.05, 0.10, 0.20, 0.40)
    default_setting: tuple[float, float] = (0.30, 0.02)


def newest_event(alerts: DataFrame) -> DataFrame:
    """Alerts with `newest`: the latest strictly-past event of the machine, -1 if none."""
    context = strict_past_context(alerts, 1)
    return context.withColumn("newest", F.coalesce(F.try_element_at("context", F.lit(-1))["event_id"], F.lit(-1)))


def alert_cells(newest: DataFrame, label: str = "event_incident", group: str = "event_incident_group") -> DataFrame:
    return newest.groupBy(
        "scenario", "event_id", "newest", F.col(label).alias("truth"), F.col(group).alias("incident_group")
    ).agg(F.count("*").alias("n"))


def next_event_confidence(cells: DataFrame, folds: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """`(seen, pairs, previous)` per fold: training counts behind P(target | newest event)."""
    train = fold_rows(cells, folds, ["train"])
    pairs = train.groupBy("test_scenario", "event_id", "newest").agg(F.sum("n").alias("pair_n"))
    previous = pairs.groupBy("test_scenario", "newest").agg(F.sum("pair_n").alias("newest_n"))
    sizes = pairs.groupBy("test_scenario").agg((F.countDistinct("event_id") + 1).alias("vocabulary"))
    seen = pairs.select("test_scenario", "event_id").distinct().withColumn("seen", F.lit(True))
    return seen.join(sizes, "test_scenario"), pairs, previous


def scored_cells(alerts: DataFrame, folds: DataFrame, study: Study) -> DataFrame:
    """Validation and test cells of each fold and seed with posteriors and confidence.

    Three results are read more than once and are fixed when made: the alerts with
    their newest event (one context pass), and two aggregates.
    """
    newest = cut_lineage(
        newest_event(alerts).select("scenario", "row_id", "event_id", "newest", "event_incident", "event_incident_group")
    )
    cells = cut_lineage(alert_cells(newest))
    revealed = cut_lineage(reveal_labels(newest, folds, study.budget, study.ratio, study.seeds))
    by_rule = rule_prior(revealed, ["test_scenario", "seed", "event_id"]).select(
        "test_scenario", "seed", "event_id", F.col("posterior").alias("rule_posterior")
    )
    by_pattern = rule_prior(revealed, ["test_scenario", "seed", "event_id", "newest"]).select(
        "test_scenario", "seed", "event_id", "newest", F.col("posterior").alias("pattern_posterior")
    )
    seen, pairs, previous = next_event_confidence(cells, folds)
    held = fold_rows(cells, folds, ["validation", "test"]).withColumnRenamed("role", "split")
    held = held.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in study.seeds])))
    joined = (
        held.join(seen.drop("vocabulary"), ["test_scenario", "event_id"], "left")
        .join(seen.select("test_scenario", "vocabulary").distinct(), "test_scenario")
        .join(pairs, ["test_scenario", "event_id", "newest"], "left")
        .join(previous, ["test_scenario", "newest"], "left")
        .join(by_rule, ["test_scenario", "seed", "event_id"], "left")
        .join(by_pattern, ["test_scenario", "seed", "event_id", "newest"], "left")
    )
    confidence = (F.coalesce("pair_n", F.lit(0)) + 1.0) / (F.coalesce("newest_n", F.lit(0)) + F.col("vocabulary"))
    return joined.select(
        "test_scenario", "split", "seed", "event_id", "newest", "truth", "incident_group", "n",
        F.col("seen").isNotNull().alias("seen"),
        F.col("pair_n").isNotNull().alias("known_pattern"),
        confidence.alias("confidence"),
        F.coalesce("rule_posterior", F.lit(0.5)).alias("rule_posterior"),
        F.coalesce("pattern_posterior", "rule_posterior", F.lit(0.5)).alias("pattern_posterior"),
    )


def _context_code(posterior: Column) -> Column:
    return (
        F.when(F.col("confidence") < F.col("threshold"), E.NOT_CONFIDENT)
        .when(~F.col("seen"), E.UNSEEN_EVENT)
        .when(~F.col("known_pattern"), E.TOO_FAR)
        .when(posterior >= F.col("eps"), 1)
        .otherwise(0)
    )


def predictions(scored: DataFrame, study: Study) -> DataFrame:
    """Prediction code of every cell under every method and operating point."""
    rule = operating_grid(scored, rule_thresholds=study.rule_thresholds).select(
        F.lit("rule_prior").alias("method"), "*",
        F.when(~F.col("seen"), E.UNSEEN_EVENT)
        .when(F.col("rule_posterior") >= F.col("threshold"), 1)
        .otherwise(0)
        .alias("prediction"),
    )
    grid = operating_grid(scored, settings=study.settings)
    pattern = grid.select(
        F.lit("pattern_prior").alias("method"), "*", _context_code(F.col("pattern_posterior")).alias("prediction")
    )
    blend = grid.select(
        F.lit("blend_prior").alias("method"), "*",
        _context_code((F.col("rule_posterior") + F.col("pattern_posterior")) / 2.0).alias("prediction"),
    )
    return rule.unionByName(pattern).unionByName(blend)


def records_of(scored: DataFrame, study: Study) -> DataFrame:
    """The records of scored cells: one row per method, fold, seed, setting and split with both metric families."""
    keys = [*POINT_KEYS, "split"]
    # one row per (point, truth, group, code): all the metrics need
    cells = predictions(scored, study).groupBy(*keys, "truth", "incident_group", "prediction").agg(F.sum("n").alias("n"))
    return triage_metrics(cells, keys, weight="n")


def side_by_side(records: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """One row per operating point with `validation_*` and `test_*` metrics."""
    def of(split: str) -> DataFrame:
        return records.filter(F.col("split") == split).select(
            *POINT_KEYS, *[F.col(m).alias(f"{split}_{m}") for m in metrics]
        )
    keys = [k for k in POINT_KEYS if k != "eps"]
    return of("validation").join(of("test").drop("eps"), keys)
