"""Profiles, training-only rule statistics and label audits.

Statistics that vary by fold are aggregated once per scenario and then combined
over the fold table, so no alert is repeated per fold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertweave.functions.ratios import binary_entropy, ratio_or_null
from alertweave.operators.folds import fold_rows


def _count_if(test: Column) -> Column:
    return F.sum(F.when(test, 1).otherwise(0))


def ingest_counts(labelled: DataFrame, label: str = "attack_id") -> DataFrame:
    """Events and attack events per scenario and in total (scenario = `__all__`)."""
    return (
        labelled.rollup("scenario")
        .agg(F.count("*").alias("events"), _count_if(F.col(label) >= 0).alias("attack_events"))
        .withColumn("scenario", F.coalesce("scenario", F.lit("__all__")))
    )


def scenario_profile(alerts: DataFrame) -> DataFrame:
    """Counted once per (scenario, event type, machine), so that the distinct counts expand those cells and not the alerts."""
    cells = alerts.groupBy("scenario", "event_key", "machine").agg(
        F.count("*").alias("n"), F.sum("event_incident").alias("_e"), F.sum("window_incident").alias("_w")
    )
    return cells.groupBy("scenario").agg(
        F.sum("n").alias("alerts"),
        (F.sum("_e") / F.sum("n")).alias("event_prevalence"),
        (F.sum("_w") / F.sum("n")).alias("window_prevalence"),
        F.countDistinct("event_key").alias("event_types"),
        F.countDistinct("machine").alias("machines"),
    )


def rule_profile(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("detector", "event_key").agg(
        F.count("*").alias("alerts"), F.avg("event_incident").alias("incident_rate")
    )


def top_rules(profile: DataFrame, k: int = 20) -> DataFrame:
    return profile.orderBy(F.desc("alerts"), "event_key").limit(k)


def label_crosstab(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("window_incident").pivot("event_incident", [0, 1]).count().na.fill(0).toDF(
        "window_incident", "event_0", "event_1"
    )


def value_counts(rows: DataFrame, *columns: str) -> DataFrame:
    """`field, value, rows` for several columns in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns]))
    return rows.select(pairs.alias("p")).groupBy("p.field", "p.value").agg(F.count("*").alias("rows"))


def duplicate_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key groups that repeat, with their row counts."""
    return rows.groupBy(*keys).agg(F.count("*").alias("rows")).filter("rows > 1")


def empty_contexts(with_context: DataFrame, column: str = "context") -> DataFrame:
    return with_context.groupBy("scenario").agg(_count_if(F.size(column) == 0).alias("empty"), F.count("*").alias("alerts"))


def unseen_by_fold(alerts: DataFrame, folds: DataFrame) -> DataFrame:
    """Per test scenario: event types absent from its training scenarios and the alerts they cover."""
    counts = alerts.groupBy("scenario", "event_key").agg(F.count("*").alias("rows"))
    trained = fold_rows(counts, folds, ["train"]).select("test_scenario", "event_key").distinct()
    tested = fold_rows(counts, folds, ["test"]).select("test_scenario", "event_key", "rows")
    unseen = tested.join(trained, ["test_scenario", "event_key"], "left_anti")
    per_fold = unseen.groupBy("test_scenario").agg(
        F.count("*").alias("unseen_event_types"), F.sum("rows").alias("unseen_test_alerts")
    )
    validation = folds.filter("role = 'validation'").select("test_scenario", F.col("scenario").alias("validation"))
    return validation.join(per_fold, "test_scenario", "left").na.fill(0, ["unseen_event_types", "unseen_test_alerts"])


def training_rule_counts(alerts: DataFrame, folds: DataFrame, label: str, rule: str = "event_key") -> DataFrame:
    """Per (test_scenario, rule): positives, negatives and total over the training scenarios."""
    per_scenario = alerts.groupBy("scenario", rule).agg(
        F.sum(F.col(label).cast("long")).alias("positive"), F.count("*").alias("total")
    )
    return (
        fold_rows(per_scenario, folds, ["train"])
        .groupBy("test_scenario", rule)
        .agg(F.sum("positive").alias("positive"), F.sum("total").alias("total"))
        .withColumn("negative", F.col("total") - F.col("positive"))
        .withColumn("incident_rate", F.col("positive") / F.col("total"))
    )


def mixed(low: float, high: float, minimum: int, positive="positive", negative="negative", rate="incident_rate") -> Column:
    """Open-interval incident rate and at least `minimum` rows of each class."""
    if not 0 <= low < high <= 1 or minimum < 1:
        raise ValueError("invalid rate interval or minimum")
    return (
        (F.col(positive) >= minimum) & (F.col(negative) >= minimum) & (F.col(rate) > low) & (F.col(rate) < high)
    )


def ambiguous_rules(rule_counts: DataFrame, low: float = 0.05, high: float = 0.95, minimum: int = 50) -> DataFrame:
    return rule_counts.filter(mixed(low, high, minimum))


def rule_identifiability(
    rule_counts: DataFrame,
    revealed: DataFrame,
    label: str = "event_incident",
    group: str = "event_incident_group",
    rule: str = "event_key",
    low: float = 0.05,
    high: float = 0.95,
    minimum_full: int = 50,
    minimum_revealed: int = 1,
) -> DataFrame:
    """One row per (test_scenario, seed, training rule): full truth, revealed counts and flags."""
    keys = ["test_scenario", "seed"]
    seen = revealed.groupBy(*keys, rule).agg(
        F.sum(F.col(label).cast("long")).alias("revealed_positive"),
        F.count("*").alias("revealed_total"),
        F.countDistinct(F.when(F.col(label) == 1, F.col(group))).alias("revealed_positive_groups"),
    )
    runs = revealed.select(*keys).distinct()
    full = rule_counts.select(
        "test_scenario",
        rule,
        F.col("positive").alias("full_positive"),
        F.col("negative").alias("full_negative"),
        F.col("total").alias("full_total"),
        F.col("incident_rate").alias("full_incident_rate"),
        binary_entropy(F.col("incident_rate")).alias("full_binary_entropy"),
        mixed(low, high, minimum_full).alias("mixed_full_truth"),
    ).join(runs, "test_scenario")
    table = full.join(seen, [*keys, rule], "left").na.fill(
        0, ["revealed_positive", "revealed_total", "revealed_positive_groups"]
    )
    table = table.withColumn("revealed_negative", F.col("revealed_total") - F.col("revealed_positive"))
    pairable = (F.col("revealed_positive") >= minimum_revealed) & (F.col("revealed_negative") >= minimum_revealed)
    return table.withColumn("pairable_revealed", pairable).withColumn(
        "identifiable_revealed", F.col("mixed_full_truth") & F.col("pairable_revealed")
    )


def identifiability_gate(table: DataFrame, minimum_rules: int, minimum_groups: int) -> DataFrame:
    """One summary row per (test_scenario, seed) with the pass flag.

    The output names are fixed values: the study's tables use them.
    """
    def only(flag: str, value: str) -> Column:
        return F.sum(F.when(F.col(flag), F.col(value)).otherwise(0))

    summary = table.groupBy("test_scenario", "seed").agg(
        F.count("*").alias("rules_total"),
        _count_if(F.col("mixed_full_truth")).alias("rules_mixed_full_truth"),
        _count_if(F.col("identifiable_revealed")).alias("rules_pairable_revealed"),
        only("mixed_full_truth", "full_total").alias("full_truth_rows_in_mixed_rules"),
        only("mixed_full_truth", "full_positive").alias("full_truth_positive_in_mixed_rules"),
        only("identifiable_revealed", "revealed_positive").alias("revealed_positive_pairable"),
        only("identifiable_revealed", "revealed_negative").alias("revealed_negative_pairable"),
        only("identifiable_revealed", "revealed_positive_groups").alias("revealed_positive_groups_pairable"),
        F.sum("full_total").alias("_rows"),
        F.sum("full_positive").alias("_positive"),
        F.sum("revealed_positive").alias("_revealed"),
    )
    return summary.select(
        *[c for c in summary.columns if not c.startswith("_")],
        ratio_or_null(F.col("full_truth_rows_in_mixed_rules"), F.col("_rows")).alias("fraction_train_rows_in_mixed_rules"),
        ratio_or_null(F.col("full_truth_positive_in_mixed_rules"), F.col("_positive")).alias("fraction_train_positives_in_mixed_rules"),
        ratio_or_null(F.col("revealed_positive_pairable"), F.col("_revealed")).alias("fraction_revealed_positives_pairable"),
        (
            (F.col("rules_pairable_revealed") >= minimum_rules)
            & (F.col("revealed_positive_groups_pairable") >= minimum_groups)
        ).alias("pairability_pass"),
    )


def rule_prior(revealed: DataFrame, keys: Sequence[str], label: str = "event_incident", alpha: float = 1.0) -> DataFrame:
    """Smoothed incident posterior and log-odds per `keys`, from revealed labels only."""
    if alpha <= 0:
        raise ValueError("alpha must be positive")
    counts = revealed.groupBy(*keys).agg(
        F.sum(F.col(label).cast("long")).alias("positive"), F.count("*").alias("revealed")
    )
    posterior = (F.col("positive") + alpha) / (F.col("revealed") + 2.0 * alpha)
    return counts.withColumn("posterior", posterior).withColumn("logit", F.ln(F.col("posterior") / (1 - F.col("posterior"))))


def pairability(revealed: DataFrame, label: str = "event_incident", group: str = "event_incident_group", rule: str = "event_id") -> DataFrame:
    """Per (test_scenario, seed): positives, groups and rules for which a same-rule negative is revealed."""
    from alertweave.operators.joins import pairable_positives

    keys = ["test_scenario", "seed"]
    eligible = pairable_positives(revealed, label, rule, keys)
    return eligible.groupBy(*keys).agg(
        F.count("*").alias("eligible_positive_rows"),
        F.countDistinct(group).alias("eligible_positive_groups"),
        F.countDistinct(rule).alias("eligible_rules"),
    )


def sequence_patterns(lines: DataFrame) -> DataFrame:
    """One row per distinct line (by content hash): copies, labels seen and presence in training."""
    return lines.groupBy("pattern").agg(
        F.count("*").alias("copies"),
        F.min("label").alias("low"),
        F.max("label").alias("high"),
        F.max(F.col("source") == "train").alias("in_training"),
    )


def sequence_scan(lines: DataFrame) -> DataFrame:
    """Per (source, split): lines, duplicate and contradictory lines, lines whose pattern is in training.

    Lines are first counted per (pattern, source, split), so a line copied very
    often joins its pattern once.
    """
    cells = lines.groupBy("pattern", "source", "split").agg(F.count("*").alias("n"))
    patterns = sequence_patterns(lines).select(
        "pattern", "copies", (F.col("low") != F.col("high")).alias("contradictory"), "in_training"
    )

    def rows_where(test: Column) -> Column:
        return F.sum(F.when(test, F.col("n")).otherwise(0))

    return (
        cells.join(patterns, "pattern")
        .groupBy("source", "split")
        .agg(
            F.sum("n").alias("sequences"),
            rows_where(F.col("copies") > 1).alias("duplicate_sequences"),
            rows_where(F.col("contradictory")).alias("contradictory_sequences"),
            rows_where(F.col("in_training")).alias("train_pattern_sequences"),
        )
    )


def token_counts(lines: DataFrame, tokens: str = "tokens") -> DataFrame:
    return lines.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("rows"))


def distribution(rows: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """`keys, value, rows`: sorted by value when shown."""
    return rows.groupBy(*keys, F.col(column).alias("value")).agg(F.count("*").alias("rows"))


def distribution_map(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Counts per value folded into one map per `keys`; values are score codes, so the map stays small."""
    entries = F.sort_array(F.collect_list(F.struct("value", "rows")))
    return counts.groupBy(*keys).agg(F.map_from_entries(entries).alias("distribution"))


def coverage_against(rows: DataFrame, other: DataFrame, key: str = "event_key") -> DataFrame:
    """Row and type counts of another extract, and how many rows it lacks."""
    mine = rows.agg(F.count("*").alias("_rows")).withColumn("_one", F.lit(1))
    theirs = other.agg(F.count("*").alias("rows"), F.countDistinct(key).alias("event_types")).withColumn("_one", F.lit(1))
    return theirs.join(mine, "_one").select("rows", "event_types", (F.col("_rows") - F.col("rows")).alias("missing"))
