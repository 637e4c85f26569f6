"""Interval labels, membership, pairing and lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alertweave.functions.encode import NO_ATTACK

_BUCKET = 3_600


def attack_dictionary(intervals: DataFrame) -> DataFrame:
    """Sorted distinct attacks with ids 0..n-1."""
    attacks = intervals.select("attack").distinct()
    return attacks.select("attack", (F.row_number().over(Window.orderBy("attack")) - 1).cast("int").alias("attack_id"))


def first_interval_segments(intervals: DataFrame, *carry: str) -> DataFrame:
    """Disjoint `scenario, after, start, end` segments, one per interval that ever wins.

    The first interval by (start, file position) labels an instant. An interval
    that ends no later than an earlier one never wins; the others win from where
    the earlier ones stop (`after`, exclusive; null when there is none).
    """
    earlier = Window.partitionBy("scenario").orderBy("start", "position").rowsBetween(Window.unboundedPreceding, -1)
    return (
        intervals.withColumn("after", F.max("end").over(earlier))
        .filter(F.col("after").isNull() | (F.col("end") > F.col("after")))
        .select("scenario", "after", "start", "end", *carry)
    )


def label_by_interval(alerts: DataFrame, intervals: DataFrame, name: str = "attack_id") -> DataFrame:
    """Attack id of the first interval of the scenario that covers each alert, else -1.

    Segments are disjoint, so an alert meets at most one; they are spread over
    hour buckets to make the range join an equi join (broadcast when small).
    """
    segments = first_interval_segments(intervals.join(attack_dictionary(intervals), "attack"), "attack_id")
    low = F.greatest(F.col("start"), F.coalesce("after", "start"))
    spread = segments.withColumn(
        "_bucket", F.explode(F.sequence(F.floor(low / _BUCKET), F.floor(F.col("end") / _BUCKET)))
    ).withColumnRenamed("scenario", "_scenario")
    keyed = alerts.withColumn("_at", F.floor(F.col("timestamp") / _BUCKET))
    covers = (
        (F.col("timestamp") >= F.col("start"))
        & (F.col("timestamp") <= F.col("end"))
        & (F.col("after").isNull() | (F.col("timestamp") > F.col("after")))
    )
    match = (F.col("scenario") == F.col("_scenario")) & (F.col("_at") == F.col("_bucket")) & covers
    return keyed.join(spread, match, "left").select(
        *alerts.columns, F.coalesce("attack_id", F.lit(NO_ATTACK)).alias(name)
    )


def gather(candidates: DataFrame, alerts: DataFrame, column: str = "candidates", keys: Sequence[str] = ("row_id",)) -> DataFrame:
    """Row-id lookup: one row per slot of the lists under `keys`, with the looked-up alert's event, label and group."""
    slots = candidates.select(*keys, F.posexplode(column).alias("slot", "candidate"))
    looked = alerts.select(
        F.col("row_id").alias("candidate"), "event_id", "event_incident", "event_incident_group"
    )
    return slots.join(looked, "candidate")


def rules_with_both_labels(rows: DataFrame, label: str, rule: str = "event_id", keys: Sequence[str] = ()) -> DataFrame:
    """Per rule: positives, negatives and the number of legal (positive, negative) pairs.

    Pairs are counted, never formed; sampling picks partners by position.
    """
    counts = rows.groupBy(*keys, rule).agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("positives"),
        F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).alias("negatives"),
    )
    return counts.filter("positives > 0 AND negatives > 0").withColumn("pairs", F.col("positives") * F.col("negatives"))


def pairable_positives(rows: DataFrame, label: str, rule: str = "event_id", keys: Sequence[str] = ()) -> DataFrame:
    """Positives whose rule also has a negative (semi join on the distinct negative rules)."""
    negative = rows.filter(F.col(label) == 0).select(*keys, rule).distinct()
    return rows.filter(F.col(label) == 1).join(negative, [*keys, rule], "left_semi")


def pair_runs(
    records: DataFrame, keys: Sequence[str], baseline: str, selector: str, metrics: Sequence[str]
) -> DataFrame:
    """Baseline and selector metrics side by side per `keys`, and their differences."""
    def side(method: str, prefix: str) -> DataFrame:
        return records.filter(F.col("method") == method).select(
            *keys, *[F.col(m).alias(f"{prefix}_{m}") for m in metrics]
        )
    paired = side(baseline, "baseline").join(side(selector, "selector"), list(keys))
    return paired.select("*", *[(F.col(f"selector_{m}") - F.col(f"baseline_{m}")).alias(f"{m}_gain") for m in metrics])


def expand_unique(rows: DataFrame, results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Results on distinct patterns back to every row."""
    return rows.join(results, list(keys), "left")
