"""Workload, quality and decision metrics.

All take `keys` (one output row per key group) and an optional row `weight`, so a
metric can run over pre-aggregated counts as well as over alerts. Undefined
ratios: 0.0 in the workload/prediction family, null in the operational/strict
families (F1 stays 0.0).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertweave.functions import policy as P
from alertweave.functions.encode import NO_ATTACK
from alertweave.functions.ratios import f1_or_zero, ratio_or_null, ratio_or_zero


def _weight(weight: str | None) -> Column:
    return F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")


def _total(test: Column, weight: Column) -> Column:
    return F.coalesce(F.sum(F.when(test, weight).otherwise(0)), F.lit(0))


def workload_metrics(rows: DataFrame, keys: Sequence[str] = (), cluster: str = "cluster", samples: int = 10, weight: str | None = None) -> DataFrame:
    sizes = rows.groupBy(*keys, cluster).agg(F.sum(_weight(weight)).alias("_n"))
    inside = F.col(cluster) >= 0
    base = sizes.groupBy(*keys).agg(
        F.sum("_n").alias("total_sequences"),
        _total(inside, F.col("_n")).alias("clustered_sequences"),
        _total(~inside, F.col("_n")).alias("unclustered_sequences"),
        _total(inside, F.lit(1)).alias("n_clusters"),
        _total(inside, F.least(F.col("_n"), F.lit(samples))).alias("representative_alerts_capped"),
    )
    c = F.col
    base = base.withColumn("representative_alerts", c("n_clusters") * samples)
    return base.select(
        "*",
        ratio_or_zero(c("clustered_sequences"), c("total_sequences")).alias("coverage"),
        (1 - ratio_or_zero(c("representative_alerts"), c("clustered_sequences"))).alias("reduction_on_clustered"),
        (1 - ratio_or_zero(c("representative_alerts") + c("unclustered_sequences"), c("total_sequences"))).alias("overall_reduction"),
        (1 - ratio_or_zero(c("representative_alerts_capped") + c("unclustered_sequences"), c("total_sequences"))).alias("overall_reduction_capped"),
        ratio_or_zero(c("total_sequences"), c("n_clusters")).alias("events_per_cluster_all"),
        ratio_or_zero(c("clustered_sequences"), c("n_clusters")).alias("events_per_cluster_clustered"),
    )


def cluster_quality(rows: DataFrame, keys: Sequence[str] = (), cluster: str = "cluster", label: str = "label", weight: str | None = None) -> DataFrame:
    """Purity and number of clusters with more than one label; noise does not count."""
    cells = rows.filter(F.col(cluster) >= 0).groupBy(*keys, cluster, label).agg(F.sum(_weight(weight)).alias("_n"))
    per_cluster = cells.groupBy(*keys, cluster).agg(
        F.max("_n").alias("_major"), F.sum("_n").alias("_n"), F.count("*").alias("_labels")
    )
    return per_cluster.groupBy(*keys).agg(
        ratio_or_zero(F.sum("_major"), F.sum("_n")).alias("cluster_purity"),
        _total(F.col("_labels") > 1, F.lit(1)).alias("mixed_cluster_count"),
    )


def _decided(rows: DataFrame, keys, prediction, label, reading: dict, weight) -> DataFrame:
    """Rows collapsed to (keys, score, label) counts with the normalised decision."""
    cells = rows.groupBy(*keys, F.col(prediction).alias("_score"), F.col(label).alias("_label")).agg(
        F.sum(_weight(weight)).alias("_n")
    )
    return cells.withColumn("_decision", P.decided(reading, F.col("_score").cast("int"))).withColumn(
        "_truth", P.truth_for(reading, F.col("_label"))
    )


def prediction_metrics(
    rows: DataFrame,
    keys: Sequence[str] = (),
    prediction: str = "prediction",
    label: str = "label",
    reading: dict = P.ATTACK_ID,
    weight: str | None = None,
) -> DataFrame:
    """Decision rates, accuracies, binary detection on decided rows and rejects by truth."""
    cells = _decided(rows, keys, prediction, label, reading, weight)
    n = F.col("_n")
    auto = F.col("_decision").isNotNull()
    true_incident = F.col("_label") != NO_ATTACK
    said = P.is_alarm(reading, F.col("_decision"))
    base = cells.groupBy(*keys).agg(
        F.sum(n).alias("total_sequences"),
        _total(auto, n).alias("auto_decided_count"),
        _total(~auto, n).alias("reject_count"),
        _total(auto & (F.col("_decision") == F.col("_truth")), n).alias("_correct"),
        _total(auto & true_incident & said, n).alias("tp"),
        _total(auto & ~true_incident & said, n).alias("fp"),
        _total(auto & ~true_incident & ~said, n).alias("tn"),
        _total(auto & true_incident & ~said, n).alias("fn"),
        _total(~auto & true_incident, n).alias("rejected_incidents"),
        _total(~auto & ~true_incident, n).alias("rejected_benign"),
        _total(true_incident, n).alias("_incidents"),
        _total(~true_incident, n).alias("_benign"),
    )
    c = F.col
    precision = ratio_or_zero(c("tp"), c("tp") + c("fp"))
    recall = ratio_or_zero(c("tp"), c("tp") + c("fn"))
    return base.select(
        *keys,
        "total_sequences", "auto_decided_count", "reject_count",
        ratio_or_zero(c("auto_decided_count"), c("total_sequences")).alias("auto_decided_rate"),
        ratio_or_zero(c("reject_count"), c("total_sequences")).alias("reject_rate"),
        ratio_or_zero(c("_correct"), c("total_sequences")).alias("strict_accuracy_rejects_wrong"),
        ratio_or_null(c("_correct"), c("auto_decided_count")).alias("auto_decided_accuracy"),
        "tp", "fp", "tn", "fn",
        precision.alias("precision"),
        recall.alias("recall"),
        f1_or_zero(precision, recall).alias("f1"),
        ratio_or_zero(c("tp") + c("tn"), c("auto_decided_count")).alias("accuracy"),
        "rejected_incidents", "rejected_benign",
        ratio_or_zero(c("rejected_incidents"), c("_incidents")).alias("incident_reject_rate"),
        ratio_or_zero(c("rejected_benign"), c("_benign")).alias("benign_reject_rate"),
    )


def class_scores(
    rows: DataFrame,
    keys: Sequence[str] = (),
    prediction: str = "prediction",
    label: str = "label",
    reading: dict = P.ATTACK_ID,
    weight: str | None = None,
) -> DataFrame:
    """Per class: precision, recall, F1 and support on decided rows.

    The classes are all true labels (also those seen on rejected rows only, which
    lowers the macro average) and all decided labels.
    """
    cells = _decided(rows, keys, prediction, label, reading, weight)
    hit = F.col("_decision") == F.col("_label")
    auto = F.col("_decision").isNotNull()
    as_truth = cells.select(
        *keys, F.col("_label").alias("class"),
        F.when(auto & hit, F.col("_n")).otherwise(0).alias("_tp"),
        F.lit(0).cast("long").alias("_fp"),
        F.when(auto & ~hit, F.col("_n")).otherwise(0).alias("_fn"),
    )
    as_decision = cells.filter(auto).select(
        *keys, F.col("_decision").alias("class"),
        F.lit(0).cast("long").alias("_tp"),
        F.when(~hit, F.col("_n")).otherwise(0).alias("_fp"),
        F.lit(0).cast("long").alias("_fn"),
    )
    table = as_truth.unionByName(as_decision).groupBy(*keys, "class").agg(
        F.sum("_tp").alias("_tp"), F.sum("_fp").alias("_fp"), F.sum("_fn").alias("_fn")
    )
    precision = ratio_or_zero(F.col("_tp"), F.col("_tp") + F.col("_fp"))
    recall = ratio_or_zero(F.col("_tp"), F.col("_tp") + F.col("_fn"))
    return table.select(
        *keys, "class", precision.alias("precision"), recall.alias("recall"),
        f1_or_zero(precision, recall).alias("f1"), (F.col("_tp") + F.col("_fn")).alias("support"),
    )


def multiclass_f1(scores: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return scores.groupBy(*keys).agg(
        F.avg("f1").alias("macro_f1"),
        ratio_or_zero(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"),
        F.count("*").alias("classes"),
    )


_CODES = ("reject_low_confidence", -1), ("reject_unknown_event", -2), ("reject_distance", -3)


def _triage_counts(rows: DataFrame, keys, truth, prediction, group, weight) -> DataFrame:
    """Counts per `keys`, through counts per (keys, incident group) so that a hot key splits."""
    w = _weight(weight)
    t, p = F.col(truth), F.col(prediction)
    inc, auto1, auto0, rej = t == 1, p > 0, p == 0, p < 0
    cells = {
        "_tp1": inc & auto1, "_fp1": ~inc & auto1, "_tn0": ~inc & auto0, "_fn0": inc & auto0,
        "_rej1": inc & rej, "_rej0": ~inc & rej,
        **{f"_{name}": p == code for name, code in _CODES}, "_reject_other": p < -3,
    }
    in_group = F.when(inc, F.col(group)).alias("_g")
    first = rows.groupBy(*keys, in_group).agg(
        *[_total(test, w).alias(name) for name, test in cells.items()],
        F.max(F.when(auto1 | rej, 1).otherwise(0)).alias("_reviewed"),
        F.max(F.when(auto1, 1).otherwise(0)).alias("_detected"),
    )
    valid = F.col("_g").isNotNull()
    return first.groupBy(*keys).agg(
        *[F.sum(name).alias(name) for name in cells],
        _total(valid, F.lit(1)).alias("incident_groups"),
        _total(valid, F.col("_reviewed")).alias("_groups_reviewed"),
        _total(valid, F.col("_detected")).alias("_groups_detected"),
    ).withColumn("incidents", F.col("_tp1") + F.col("_fn0") + F.col("_rej1")).withColumn(
        "nonincidents", F.col("_fp1") + F.col("_tn0") + F.col("_rej0")
    ).withColumn("alerts", F.col("incidents") + F.col("nonincidents"))


def _operational_columns() -> list[Column]:
    c = F.col
    rejected = c("_rej1") + c("_rej0")
    reviewed_incident = c("_tp1") + c("_rej1")
    reviewed = reviewed_incident + c("_fp1") + c("_rej0")
    accepted = c("alerts") - rejected
    precision = ratio_or_null(reviewed_incident, reviewed)
    recall = ratio_or_null(reviewed_incident, c("incidents"))
    f1_incident = f1_or_zero(ratio_or_null(c("_tp1"), c("_tp1") + c("_fp1")), ratio_or_null(c("_tp1"), c("_tp1") + c("_fn0")))
    f1_benign = f1_or_zero(ratio_or_null(c("_tn0"), c("_tn0") + c("_fn0")), ratio_or_null(c("_tn0"), c("_tn0") + c("_fp1")))
    share = lambda x: ratio_or_null(x, c("alerts"))
    return [
        share(reviewed).alias("analyst_workload"),
        recall.alias("triage_incident_recall"),
        precision.alias("triage_precision"),
        f1_or_zero(precision, recall).alias("relaxed_f1"),
        share(rejected).alias("reject_rate"),
        share(accepted).alias("automation_coverage"),
        ratio_or_null(c("_fp1") + c("_fn0"), accepted).alias("accepted_error_rate"),
        F.when(accepted > 0, (f1_incident + f1_benign) / 2).alias("classified_macro_f1"),
        ratio_or_null(c("_groups_reviewed"), c("incident_groups")).alias("incident_group_recall"),
        share(c("_tp1") + c("_fp1")).alias("auto_incident_rate"),
        *[share(c(f"_{name}")).alias(f"{name}_rate") for name, _ in _CODES],
    ]


def _strict_columns() -> list[Column]:
    c = F.col
    rejected = c("_rej1") + c("_rej0")
    f1_incident = ratio_or_zero(2 * c("_tp1"), 2 * c("_tp1") + c("_fp1") + c("_fn0") + c("_rej1"))
    f1_benign = ratio_or_zero(2 * c("_tn0"), 2 * c("_tn0") + c("_fn0") + c("_fp1") + c("_rej0"))
    share = lambda x: ratio_or_null(x, c("alerts"))
    return [
        ratio_or_null(c("_tp1"), c("incidents")).alias("automatic_incident_recall"),
        ratio_or_null(c("_tp1"), c("_tp1") + c("_fp1")).alias("automatic_incident_precision"),
        ((f1_incident + f1_benign) / 2).alias("strict_macro_f1"),
        share(c("_tp1") + c("_fp1") + rejected).alias("review_workload"),
        share(c("_tp1") + c("_fp1")).alias("automatic_incident_rate"),
        share(c("_tn0") + c("_fn0")).alias("automatic_nonincident_rate"),
        ratio_or_null(c("_fp1") + c("_fn0"), c("alerts") - rejected).alias("accepted_decision_error"),
        (1000.0 * ratio_or_null(c("_fp1"), c("nonincidents"))).alias("false_escalations_per_1000_nonincidents"),
        ratio_or_null(c("_groups_detected"), c("incident_groups")).alias("incident_group_automatic_recall"),
        c("_tp1").alias("auto_true_incident"),
        c("_fp1").alias("auto_false_incident"),
        c("_tn0").alias("auto_true_nonincident"),
        c("_fn0").alias("auto_false_nonincident"),
        c("_rej1").alias("rejected_incident"),
        c("_rej0").alias("rejected_nonincident"),
        *[c(f"_{name}").alias(name) for name, _ in _CODES],
        c("_reject_other").alias("reject_other"),
    ]


def operational_metrics(
    rows: DataFrame, keys: Sequence[str] = (), truth: str = "truth", prediction: str = "prediction",
    group: str = "incident_group", weight: str | None = None,
) -> DataFrame:
    """Triage metrics in which a reject goes to review, as a predicted incident does."""
    counts = _triage_counts(rows, keys, truth, prediction, group, weight)
    return counts.select(*keys, "alerts", "incidents", "incident_groups", *_operational_columns())


def strict_metrics(
    rows: DataFrame, keys: Sequence[str] = (), truth: str = "truth", prediction: str = "prediction",
    group: str = "incident_group", weight: str | None = None,
) -> DataFrame:
    """Metrics in which a reject is unresolved work and never a detection."""
    counts = _triage_counts(rows, keys, truth, prediction, group, weight)
    rejected = (F.col("_rej1") + F.col("_rej0")) / F.col("alerts")
    return counts.select(
        *keys, "alerts", "incidents", "nonincidents", "incident_groups", rejected.alias("reject_rate"), *_strict_columns()
    )


def triage_metrics(
    rows: DataFrame, keys: Sequence[str] = (), truth: str = "truth", prediction: str = "prediction",
    group: str = "incident_group", weight: str | None = None,
) -> DataFrame:
    """Both families from one pass over the counts."""
    counts = _triage_counts(rows, keys, truth, prediction, group, weight)
    return counts.select(
        *keys, "alerts", "incidents", "nonincidents", "incident_groups", *_operational_columns(), *_strict_columns()
    )


LABELLED_FIELDS = (
    "alerts", "incidents", "nonincidents", "automatic_incident_recall", "automatic_incident_precision",
    "strict_macro_f1", "review_workload", "automatic_incident_rate", "automatic_nonincident_rate", "reject_rate",
    "false_escalations_per_1000_nonincidents", "auto_true_incident", "auto_false_incident",
    "auto_true_nonincident", "auto_false_nonincident", "rejected_incident", "rejected_nonincident",
)


def labelled_metrics(strict: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return strict.select(*keys, *LABELLED_FIELDS)


def unlabelled_metrics(rows: DataFrame, keys: Sequence[str] = (), prediction: str = "prediction", weight: str | None = None) -> DataFrame:
    """Rates that need no outcome, for blind splits."""
    w, p = _weight(weight), F.col(prediction)
    counts = rows.groupBy(*keys).agg(
        F.sum(w).alias("alerts"), _total(p > 0, w).alias("_1"), _total(p == 0, w).alias("_0"), _total(p < 0, w).alias("_r")
    )
    n = F.col("alerts")
    return counts.select(
        *keys, "alerts",
        ((F.col("_1") + F.col("_r")) / n).alias("review_workload"),
        (F.col("_1") / n).alias("automatic_incident_rate"),
        (F.col("_0") / n).alias("automatic_nonincident_rate"),
        (F.col("_r") / n).alias("reject_rate"),
    )


def retrieval_audit(
    pool: DataFrame, caps: Sequence[int] = (10, 20, 50, 100), near: int = 10,
    incident: str = "event_incident", group: str = "event_incident_group",
) -> DataFrame:
    """Redundancy, span, displacement and predecessor coverage per scenario and overall (`__all__`)."""
    from alertweave.operators.context import context_span
    from alertweave.operators.select import last_k, presence_within

    close = last_k(F.col("candidates"), near)
    any_in = presence_within(F.col("candidates"), caps, lambda x: x[incident] == 1)
    same_in = presence_within(
        F.col("candidates"), caps, lambda x: F.coalesce(x[group] == F.col(group), F.lit(False))
    )
    is_incident = F.col(incident) == 1
    rows = pool.select(
        "scenario",
        is_incident.cast("int").alias("_inc"),
        F.size(close).alias("_slots"),
        F.size(F.array_distinct(F.transform(close, lambda x: x["event_id"]))).alias("_unique"),
        context_span(close, F.col("timestamp")).alias("_span"),
        *[(is_incident & any_in[c]).cast("int").alias(f"_any{c}") for c in caps],
        *[(is_incident & same_in[c]).cast("int").alias(f"_same{c}") for c in caps],
    )
    deep = max(caps)
    c = F.col
    totals = rows.rollup("scenario").agg(
        F.count("*").alias("targets"),
        F.sum("_inc").alias("incident_targets"),
        _total(c("_slots") > 0, F.lit(1)).alias("last10_nonempty"),
        F.sum("_slots").alias("last10_slots"),
        F.sum("_unique").alias("last10_unique_sum"),
        F.sum(c("_slots") - c("_unique")).alias("last10_duplicate_sum"),
        F.coalesce(F.sum("_span"), F.lit(0)).alias("last10_span_sum"),
        F.sum(f"_any{deep}").alias(f"any_incident_opportunity_{deep}"),
        _total((c(f"_any{deep}") == 1) & (c(f"_any{near}") == 0), F.lit(1)).alias(f"any_incident_displaced_{near}"),
        F.sum(f"_same{deep}").alias(f"same_group_opportunity_{deep}"),
        _total((c(f"_same{deep}") == 1) & (c(f"_same{near}") == 0), F.lit(1)).alias(f"same_group_displaced_{near}"),
        *[F.sum(f"_any{k}").alias(f"coverage_any_{k}") for k in caps],
        *[F.sum(f"_same{k}").alias(f"coverage_same_group_{k}") for k in caps],
    ).withColumn("scenario", F.coalesce("scenario", F.lit("__all__")))
    return totals.select(
        "*",
        ratio_or_null(c("incident_targets"), c("targets")).alias("incident_prevalence"),
        ratio_or_null(c("last10_slots"), c("targets")).alias("last10_mean_filled_slots"),
        ratio_or_null(c("last10_duplicate_sum"), c("last10_slots")).alias("last10_redundancy_rate"),
        ratio_or_null(c("last10_unique_sum"), c("targets")).alias("last10_mean_unique_types"),
        ratio_or_null(c("last10_span_sum"), c("last10_nonempty")).alias("last10_mean_span_seconds_nonempty"),
        ratio_or_null(c(f"any_incident_displaced_{near}"), c(f"any_incident_opportunity_{deep}")).alias("any_incident_displacement_at_10"),
        ratio_or_null(c(f"same_group_displaced_{near}"), c(f"same_group_opportunity_{deep}")).alias("same_group_displacement_at_10"),
        *[ratio_or_null(c(f"coverage_any_{k}"), c("incident_targets")).alias(f"any_incident_predecessor_coverage_{k}") for k in caps],
        *[ratio_or_null(c(f"coverage_same_group_{k}"), c("incident_targets")).alias(f"same_group_predecessor_coverage_{k}") for k in caps],
    )
