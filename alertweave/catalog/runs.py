"""Registered queries: metrics, operating points, inference, gates and record checks over run records."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertweave.catalog import evidence as EV
from alertweave.catalog.registry import query, stored, with_
from alertweave.catalog.sqltext import ALERTS, BUDGET, FOLDS, RATIO, REVEAL, SEEDS, h32, history
from alertweave.catalog.training import alerts, folds, rounded
from alertweave.functions.policy import tri_state
from alertweave.operators import association as AS
from alertweave.operators import checks as V
from alertweave.operators import context as C
from alertweave.operators import infer as B
from alertweave.operators import joins as J
from alertweave.operators import metrics as M
from alertweave.operators import points as P
from alertweave.plans import runs as R
from alertweave.session import cut_lineage

STUDY = R.Study(budget=BUDGET, ratio=RATIO, seeds=SEEDS)
DESIGN = ("s0", "s2")
CONFIRMATORY = ("s1", "s3", "s4", "s5", "s6", "s7")
METHOD_PAIR = ("pattern_prior", "blend_prior")


def records(spark, sf_dir):
    return stored("records", spark, sf_dir, lambda: R.records_of(scored_cells(spark, sf_dir), STUDY))


def scored_cells(spark, sf_dir):
    return stored("scored", spark, sf_dir, lambda: R.scored_cells(alerts(spark, sf_dir), folds(spark, sf_dir), STUDY))


def points(spark, sf_dir):
    wide = (
        "analyst_workload", "triage_incident_recall", "triage_precision", "incident_group_recall", "review_workload",
        "automatic_incident_recall", "false_escalations_per_1000_nonincidents", "auto_false_incident", "nonincidents",
        "strict_macro_f1",
    )
    return R.side_by_side(records(spark, sf_dir), wide)


# ---- SQL over the same records ------------------------------------------------

_SETTINGS = ", ".join(f"({e}::DOUBLE, {t}::DOUBLE, {i})" for i, (e, t) in enumerate(STUDY.settings))
_RULES = ", ".join(f"(NULL::DOUBLE, {t}::DOUBLE, {i})" for i, t in enumerate(STUDY.rule_thresholds))

CELLS = """
newest AS (SELECT a.*, coalesce(c[1].e, -1) AS newest FROM alerts a JOIN ctx USING (row_id)),
cells AS (SELECT scenario, event_id, newest, event_incident AS truth, event_incident_group AS incident_group, count(*) AS n
          FROM newest GROUP BY ALL)
"""

SCORED = """
trainc AS (SELECT f.test_scenario, c.* FROM cells c JOIN folds f ON c.scenario = f.scenario AND f.role = 'train'),
pairs AS (SELECT test_scenario, event_id, newest, sum(n) AS pair_n FROM trainc GROUP BY ALL),
prev AS (SELECT test_scenario, newest, sum(pair_n) AS newest_n FROM pairs GROUP BY ALL),
seen AS (SELECT DISTINCT test_scenario, event_id FROM pairs),
vsize AS (SELECT test_scenario, count(*) + 1 AS v FROM seen GROUP BY 1),
rev AS (SELECT r.*, n.newest FROM revealed r JOIN newest n USING (row_id)),
rp AS (SELECT test_scenario, seed, event_id, (sum(event_incident) + 1.0::DOUBLE) / (count(*) + 2.0::DOUBLE) AS post FROM rev GROUP BY ALL),
pp AS (SELECT test_scenario, seed, event_id, newest, (sum(event_incident) + 1.0::DOUBLE) / (count(*) + 2.0::DOUBLE) AS post FROM rev GROUP BY ALL),
scored AS (
  SELECT f.test_scenario, f.role AS split, s.seed, c.event_id, c.newest, c.truth, c.incident_group, c.n,
         seen.event_id IS NOT NULL AS seen, pairs.pair_n IS NOT NULL AS known_pattern,
         (coalesce(pair_n, 0) + 1.0::DOUBLE) / (coalesce(newest_n, 0) + v)::DOUBLE AS confidence,
         coalesce(rp.post, 0.5::DOUBLE) AS rpost, coalesce(pp.post, rp.post, 0.5::DOUBLE) AS ppost
  FROM cells c JOIN folds f ON c.scenario = f.scenario AND f.role <> 'train' CROSS JOIN seeds s
  JOIN vsize ON vsize.test_scenario = f.test_scenario
  LEFT JOIN seen ON seen.test_scenario = f.test_scenario AND seen.event_id = c.event_id
  LEFT JOIN pairs ON pairs.test_scenario = f.test_scenario AND pairs.event_id = c.event_id AND pairs.newest = c.newest
  LEFT JOIN prev ON prev.test_scenario = f.test_scenario AND prev.newest = c.newest
  LEFT JOIN rp ON rp.test_scenario = f.test_scenario AND rp.seed = s.seed AND rp.event_id = c.event_id
  LEFT JOIN pp ON pp.test_scenario = f.test_scenario AND pp.seed = s.seed AND pp.event_id = c.event_id AND pp.newest = c.newest)
"""

PREDICTED = f"""
grid AS (SELECT * FROM (VALUES {_SETTINGS}) g(eps, threshold, grid_order)),
rgrid AS (SELECT * FROM (VALUES {_RULES}) g(eps, threshold, grid_order)),
predicted AS (
  SELECT 'rule_prior' AS method, *, CASE WHEN NOT seen THEN -2 WHEN rpost >= threshold THEN 1 ELSE 0 END AS prediction FROM scored CROSS JOIN rgrid
  UNION ALL
  SELECT method, s.*, eps, threshold, grid_order,
         CASE WHEN confidence < threshold THEN -1 WHEN NOT seen THEN -2 WHEN NOT known_pattern THEN -3
              WHEN CASE WHEN method = 'pattern_prior' THEN ppost ELSE (rpost + ppost) / 2.0::DOUBLE END >= eps THEN 1 ELSE 0 END
  FROM scored s CROSS JOIN grid CROSS JOIN (VALUES ('pattern_prior'), ('blend_prior')) m(method))
"""

KEYS = "method, test_scenario, seed, eps, threshold, grid_order, split"

RECORDS = f"""
cnt AS (
  SELECT {KEYS}, sum(n)::BIGINT AS alerts,
    coalesce(sum(n) FILTER (WHERE truth = 1), 0)::BIGINT AS incidents, coalesce(sum(n) FILTER (WHERE truth = 0), 0)::BIGINT AS nonincidents,
    coalesce(sum(n) FILTER (WHERE truth = 1 AND prediction > 0), 0)::BIGINT AS tp1, coalesce(sum(n) FILTER (WHERE truth = 0 AND prediction > 0), 0)::BIGINT AS fp1,
    coalesce(sum(n) FILTER (WHERE truth = 0 AND prediction = 0), 0)::BIGINT AS tn0, coalesce(sum(n) FILTER (WHERE truth = 1 AND prediction = 0), 0)::BIGINT AS fn0,
    coalesce(sum(n) FILTER (WHERE truth = 1 AND prediction < 0), 0)::BIGINT AS r1, coalesce(sum(n) FILTER (WHERE truth = 0 AND prediction < 0), 0)::BIGINT AS r0,
    coalesce(sum(n) FILTER (WHERE prediction = -1), 0)::BIGINT AS c1, coalesce(sum(n) FILTER (WHERE prediction = -2), 0)::BIGINT AS c2,
    coalesce(sum(n) FILTER (WHERE prediction = -3), 0)::BIGINT AS c3, coalesce(sum(n) FILTER (WHERE prediction < -3), 0)::BIGINT AS c4,
    count(DISTINCT incident_group) FILTER (WHERE truth = 1) AS incident_groups,
    count(DISTINCT incident_group) FILTER (WHERE truth = 1 AND prediction <> 0) AS gr, count(DISTINCT incident_group) FILTER (WHERE truth = 1 AND prediction > 0) AS gd
  FROM predicted GROUP BY ALL),
rat AS (
  SELECT *, (tp1 + r1) / nullif(tp1 + r1 + fp1 + r0, 0) AS precision_, (tp1 + r1) / nullif(incidents, 0) AS recall_,
    tp1 / nullif(tp1 + fp1, 0) AS p1, tp1 / nullif(tp1 + fn0, 0) AS q1, tn0 / nullif(tn0 + fn0, 0) AS p0, tn0 / nullif(tn0 + fp1, 0) AS q0 FROM cnt),
records AS (
  SELECT {KEYS}, alerts, incidents, (tp1 + fp1 + r1 + r0) / alerts AS analyst_workload, recall_ AS triage_incident_recall, precision_ AS triage_precision,
    coalesce(2.0::DOUBLE * precision_ * recall_ / nullif(precision_ + recall_, 0), 0) AS relaxed_f1,
    (r1 + r0) / alerts AS reject_rate, (alerts - r1 - r0) / alerts AS automation_coverage,
    (fp1 + fn0) / nullif(alerts - r1 - r0, 0) AS accepted_error_rate,
    CASE WHEN alerts - r1 - r0 > 0 THEN (coalesce(2.0::DOUBLE * p1 * q1 / nullif(p1 + q1, 0), 0) + coalesce(2.0::DOUBLE * p0 * q0 / nullif(p0 + q0, 0), 0)) / 2 END AS classified_macro_f1,
    gr / nullif(incident_groups, 0) AS incident_group_recall, incident_groups, (tp1 + fp1) / alerts AS auto_incident_rate,
    c1 / alerts AS reject_low_confidence_rate, c2 / alerts AS reject_unknown_event_rate, c3 / alerts AS reject_distance_rate,
    nonincidents, tp1 / nullif(incidents, 0) AS automatic_incident_recall, tp1 / nullif(tp1 + fp1, 0) AS automatic_incident_precision,
    (coalesce(2 * tp1 / nullif(2 * tp1 + fp1 + fn0 + r1, 0), 0) + coalesce(2 * tn0 / nullif(2 * tn0 + fn0 + fp1 + r0, 0), 0)) / 2 AS strict_macro_f1,
    (tp1 + fp1 + r1 + r0) / alerts AS review_workload, (tp1 + fp1) / alerts AS automatic_incident_rate, (tn0 + fn0) / alerts AS automatic_nonincident_rate,
    (fp1 + fn0) / nullif(alerts - r1 - r0, 0) AS accepted_decision_error, 1000.0::DOUBLE * (fp1 / nullif(nonincidents, 0)) AS false_escalations_per_1000_nonincidents,
    gd / nullif(incident_groups, 0) AS incident_group_automatic_recall, tp1 AS auto_true_incident, fp1 AS auto_false_incident, tn0 AS auto_true_nonincident,
    fn0 AS auto_false_nonincident, r1 AS rejected_incident, r0 AS rejected_nonincident, c1 AS reject_low_confidence, c2 AS reject_unknown_event,
    c3 AS reject_distance, c4 AS reject_other
  FROM rat),
v AS (SELECT * FROM records WHERE split = 'validation'), t AS (SELECT * FROM records WHERE split = 'test'),
points AS (
  SELECT v.method, v.test_scenario, v.seed, v.eps, v.threshold, v.grid_order,
    {', '.join(f'v.{m} AS validation_{m}, t.{m} AS test_{m}' for m in ('analyst_workload', 'triage_incident_recall', 'triage_precision', 'incident_group_recall', 'review_workload', 'automatic_incident_recall', 'false_escalations_per_1000_nonincidents', 'auto_false_incident', 'nonincidents', 'strict_macro_f1'))}
  FROM v JOIN t ON v.method = t.method AND v.test_scenario = t.test_scenario AND v.seed = t.seed AND v.grid_order = t.grid_order)
"""

BASE = (ALERTS, FOLDS, REVEAL, history(1), CELLS, SCORED, PREDICTED, RECORDS)
PRE = BASE[:-1]

_OPERATIONAL = (
    "alerts", "incidents", "analyst_workload", "triage_incident_recall", "triage_precision", "relaxed_f1", "reject_rate",
    "automation_coverage", "accepted_error_rate", "classified_macro_f1", "incident_group_recall", "incident_groups",
    "auto_incident_rate", "reject_low_confidence_rate", "reject_unknown_event_rate", "reject_distance_rate",
)
_STRICT = (
    "nonincidents", "automatic_incident_recall", "automatic_incident_precision", "strict_macro_f1", "review_workload",
    "automatic_incident_rate", "automatic_nonincident_rate", "accepted_decision_error", "false_escalations_per_1000_nonincidents",
    "incident_group_automatic_recall", "auto_true_incident", "auto_false_incident", "auto_true_nonincident", "auto_false_nonincident",
    "rejected_incident", "rejected_nonincident", "reject_low_confidence", "reject_unknown_event", "reject_distance", "reject_other",
)
_COUNTS = {
    "alerts", "incidents", "incident_groups", "nonincidents", "auto_true_incident", "auto_false_incident", "auto_true_nonincident",
    "auto_false_nonincident", "rejected_incident", "rejected_nonincident", "reject_low_confidence", "reject_unknown_event",
    "reject_distance", "reject_other",
}


def _r(columns, digits=6):
    return ", ".join(c if c in _COUNTS else f"round({c}, {digits}) AS {c}" for c in columns)


@query("m8_operational_metrics", with_(*BASE, f"SELECT {KEYS}, {_r(_OPERATIONAL)} FROM records"))
def m8(spark, sf_dir):
    return rounded(records(spark, sf_dir).select(*R.POINT_KEYS, "split", *_OPERATIONAL))


@query("m9_strict_metrics", with_(*BASE, f"SELECT {KEYS}, {_r(_STRICT)} FROM records"))
def m9(spark, sf_dir):
    return rounded(records(spark, sf_dir).select(*R.POINT_KEYS, "split", *_STRICT))


_LABELLED = [f for f in M.LABELLED_FIELDS if f not in ("reject_rate", "alerts", "incidents")]


@query(
    "m10_labelled_metrics",
    with_(*BASE, f"SELECT {KEYS}, alerts, incidents, round(reject_rate, 6) AS reject_rate, {_r(_LABELLED)} FROM records WHERE split = 'validation'"),
)
def m10(spark, sf_dir):
    scored = scored_cells(spark, sf_dir).filter("split = 'validation'")
    keys = [*R.POINT_KEYS, "split"]
    return rounded(M.labelled_metrics(M.strict_metrics(R.predictions(scored, STUDY), keys, weight="n"), keys))


@query(
    "m10_unlabelled_metrics",
    with_(
        *BASE,
        f"""SELECT {KEYS}, alerts, {_r(('review_workload', 'automatic_incident_rate', 'automatic_nonincident_rate', 'reject_rate'))}
            FROM records WHERE split = 'test'""",
    ),
)
def m10_blind(spark, sf_dir):
    scored = scored_cells(spark, sf_dir).filter("split = 'test'")
    return rounded(M.unlabelled_metrics(R.predictions(scored, STUDY), [*R.POINT_KEYS, "split"], weight="n"))


@query(
    "g13_triage_rule_prior",
    with_(
        *PRE,
        """SELECT n.row_id, p.seed, p.threshold, p.prediction FROM newest n JOIN predicted p ON p.method = 'rule_prior' AND p.split = 'test'
           AND p.test_scenario = n.scenario AND p.event_id = n.event_id AND p.newest = n.newest AND p.truth = n.event_incident""",
    ),
)
def g13(spark, sf_dir):
    """Rule-prior triage of every alert in the fold that tests it, for all seeds and thresholds; predictions are made per event and expanded."""
    rows = alerts(spark, sf_dir)
    scored = scored_cells(spark, sf_dir).filter("split = 'test'")
    coded = R.predictions(scored, STUDY).filter("method = 'rule_prior'")
    per_event = coded.groupBy(F.col("test_scenario").alias("scenario"), "event_id", "seed", "threshold").agg(F.max("prediction").alias("prediction"))
    return J.expand_unique(rows.select("row_id", "scenario", "event_id"), per_event, ["scenario", "event_id"]).select(
        "row_id", "seed", "threshold", "prediction"
    )


@query(
    "d2_tri_state",
    with_(
        *PRE,
        """SELECT method, split, CASE WHEN prediction > 0 THEN 'Incident' WHEN prediction = 0 THEN 'Non-Incident' ELSE 'Reject' END AS decision, sum(n)::BIGINT AS rows
           FROM predicted GROUP BY 1, 2, 3""",
    ),
)
def d2(spark, sf_dir):
    coded = R.predictions(scored_cells(spark, sf_dir), STUDY)
    return coded.groupBy("method", "split", tri_state(F.col("prediction")).alias("decision")).agg(F.sum("n").alias("rows"))


@query(
    "m12_stratum_metrics",
    with_(
        *PRE,
        """rt AS (SELECT f.test_scenario, a.event_id, sum(event_incident) AS p, count(*) AS n FROM alerts a JOIN folds f ON a.scenario = f.scenario
                  AND f.role = 'train' GROUP BY 1, 2),
           amb AS (SELECT test_scenario, event_id FROM rt WHERE p >= 20 AND n - p >= 20 AND p / n > 0.05 AND p / n < 0.15),
           st AS (SELECT 'all' AS stratum, * FROM predicted UNION ALL
                  SELECT 'ambiguous_rule', * FROM predicted d WHERE EXISTS (SELECT 1 FROM amb WHERE amb.test_scenario = d.test_scenario AND amb.event_id = d.event_id))""",
        """SELECT stratum, method, test_scenario, seed, grid_order, split, sum(n)::BIGINT AS alerts, coalesce(sum(n) FILTER (WHERE truth = 1), 0)::BIGINT AS incidents,
                  round(sum(n) FILTER (WHERE prediction <> 0) / sum(n), 6) AS analyst_workload,
                  round(coalesce(sum(n) FILTER (WHERE prediction <> 0 AND truth = 1), 0) / nullif(sum(n) FILTER (WHERE truth = 1), 0), 6) AS triage_incident_recall
           FROM st GROUP BY ALL""".replace("round(sum(n) FILTER (WHERE prediction <> 0) / sum(n), 6)", "round(coalesce(sum(n) FILTER (WHERE prediction <> 0), 0) / sum(n), 6)"),
    ),
)
def m12(spark, sf_dir):
    from alertweave.operators.stats import ambiguous_rules, training_rule_counts

    rows, table = alerts(spark, sf_dir), folds(spark, sf_dir)
    coded = R.predictions(scored_cells(spark, sf_dir), STUDY)
    rules = ambiguous_rules(training_rule_counts(rows, table, "event_incident", "event_id"), 0.05, 0.15, 20)
    flagged = coded.join(
        rules.select("test_scenario", "event_id").withColumn("_amb", F.lit(True)), ["test_scenario", "event_id"], "left"
    )
    strata = F.when(F.col("_amb").isNotNull(), F.array(F.lit("all"), F.lit("ambiguous_rule"))).otherwise(F.array(F.lit("all")))
    keys = ["stratum", "method", "test_scenario", "seed", "grid_order", "split"]
    got = M.operational_metrics(flagged.withColumn("stratum", F.explode(strata)), keys, weight="n")
    return rounded(got.select(*keys, "alerts", "incidents", "analyst_workload", "triage_incident_recall"))


# ---- operating points -----------------------------------------------------------


@query("o1_operating_grid", with_(*PRE, f"SELECT DISTINCT method, test_scenario, seed, eps, threshold, grid_order FROM predicted"))
def o1(spark, sf_dir):
    runs = alerts(spark, sf_dir).select(F.col("scenario").alias("test_scenario")).distinct()
    runs = runs.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in SEEDS])))
    rule = P.operating_grid(runs.withColumn("method", F.lit("rule_prior")), rule_thresholds=STUDY.rule_thresholds)
    context = runs.withColumn("method", F.explode(F.array(F.lit("pattern_prior"), F.lit("blend_prior"))))
    return rule.unionByName(P.operating_grid(context, eps=(0.05, 0.10, 0.15, 0.30), thresholds=(0.01, 0.02, 0.03)))


_BUDGETS = (0.20, 0.50, 0.80)
_RUN = ["method", "test_scenario", "seed", "budget"]
_PICK = "eps, threshold, round(validation_triage_incident_recall, 6) AS validation_recall, round(test_analyst_workload, 6) AS test_workload"
_BUDGET_SQL = f"bud AS (SELECT p.*, budget FROM points p CROSS JOIN (VALUES {', '.join(f'({b}::DOUBLE)' for b in _BUDGETS)}) b(budget))"


def _selection_sql(feasible: str, order: str) -> str:
    return f"""
best AS (SELECT * FROM bud WHERE {feasible}
         QUALIFY row_number() OVER (PARTITION BY method, test_scenario, seed, budget ORDER BY {order},
                                    coalesce(eps, -1), coalesce(threshold, -1)) = 1),
grp AS (SELECT DISTINCT method, test_scenario, seed, budget FROM bud)
SELECT g.*, b.eps, b.threshold, round(validation_triage_incident_recall, 6) AS validation_recall,
       round(test_analyst_workload, 6) AS test_workload, b.method IS NOT NULL AS feasible
FROM grp g LEFT JOIN best b ON g.method = b.method AND g.test_scenario = b.test_scenario AND g.seed = b.seed AND g.budget = b.budget"""


def _shown(selected):
    return selected.select(
        *_RUN, "eps", "threshold",
        F.round("validation_triage_incident_recall", 6).alias("validation_recall"),
        F.round("test_analyst_workload", 6).alias("test_workload"),
        "feasible",
    )


@query(
    "o2_select_validation",
    "WITH " + ",\n".join(p.strip() for p in (*BASE, _BUDGET_SQL)) + ",\n" + _selection_sql(
        "validation_analyst_workload <= budget",
        "validation_triage_incident_recall DESC NULLS LAST, validation_triage_precision DESC NULLS LAST, validation_analyst_workload DESC NULLS LAST",
    ),
)
def o2(spark, sf_dir):
    return _shown(P.select_validation(P.with_budgets(points(spark, sf_dir), _BUDGETS), _RUN))


@query(
    "o3_select_calibrated",
    "WITH " + ",\n".join(p.strip() for p in (*BASE, _BUDGET_SQL)) + ",\n" + _selection_sql(
        "test_analyst_workload <= budget",
        "test_analyst_workload DESC NULLS LAST, validation_triage_incident_recall DESC NULLS LAST, validation_triage_precision DESC NULLS LAST",
    ),
)
def o3(spark, sf_dir):
    return _shown(P.select_calibrated(P.with_budgets(points(spark, sf_dir), _BUDGETS), _RUN))


MATCHED = """
refp AS (SELECT test_scenario, seed, max(test_analyst_workload) AS budget FROM points
         WHERE method = 'pattern_prior' AND abs(eps - 0.3) <= 1e-9 AND abs(threshold - 0.02) <= 1e-9 GROUP BY 1, 2 HAVING count(*) = 1),
bp AS (SELECT p.*, budget FROM points p JOIN refp USING (test_scenario, seed)),
mbest AS (SELECT *, TRUE AS feasible FROM bp WHERE method <> 'pattern_prior' AND test_analyst_workload <= budget + 1e-12
          QUALIFY row_number() OVER (PARTITION BY method, test_scenario, seed ORDER BY test_analyst_workload DESC, coalesce(eps, -1), coalesce(threshold, -1)) = 1),
own AS (SELECT *, TRUE AS feasible FROM bp WHERE method = 'pattern_prior' AND abs(eps - 0.3) <= 1e-9 AND abs(threshold - 0.02) <= 1e-9),
mgrp AS (SELECT DISTINCT method, test_scenario, seed, budget FROM bp WHERE method <> 'pattern_prior'),
matched AS (
  SELECT g.method, g.test_scenario, g.seed, g.budget, b.eps, b.threshold, b.grid_order, b.test_analyst_workload, b.test_triage_incident_recall,
         b.validation_triage_incident_recall, coalesce(b.feasible, FALSE) AS feasible
  FROM mgrp g LEFT JOIN mbest b ON g.method = b.method AND g.test_scenario = b.test_scenario AND g.seed = b.seed
  UNION ALL SELECT method, test_scenario, seed, budget, eps, threshold, grid_order, test_analyst_workload, test_triage_incident_recall,
         validation_triage_incident_recall, feasible FROM own)
"""


def matched(spark, sf_dir):
    eps, threshold = STUDY.default_setting
    return P.select_baseline_matched(points(spark, sf_dir), ["test_scenario", "seed"], "pattern_prior", eps, threshold)


@query(
    "o4_select_baseline_matched",
    with_(
        *BASE, MATCHED,
        """SELECT method, test_scenario, seed, round(budget, 6) AS budget, eps, threshold,
                  round(test_analyst_workload, 6) AS test_workload, feasible FROM matched""",
    ),
)
def o4(spark, sf_dir):
    got = matched(spark, sf_dir)
    return got.select(
        "method", "test_scenario", "seed", F.round("budget", 6).alias("budget"), "eps", "threshold",
        F.round("test_analyst_workload", 6).alias("test_workload"), "feasible",
    )


TARGETED = """
base AS (SELECT test_scenario, seed, test_review_workload AS target_workload, validation_false_escalations_per_1000_nonincidents AS base_false,
                test_automatic_incident_recall AS baseline_recall, test_auto_false_incident AS baseline_auto_false_incident,
                test_false_escalations_per_1000_nonincidents AS baseline_false_rate, test_strict_macro_f1 AS baseline_f1, test_nonincidents AS nonincidents
         FROM points WHERE method = 'pattern_prior' AND abs(eps - 0.3) <= 1e-9 AND abs(threshold - 0.02) <= 1e-9),
targeted AS (SELECT p.*, target_workload, baseline_recall, baseline_auto_false_incident, baseline_false_rate, baseline_f1, b.nonincidents,
                    CASE WHEN base_false < 1.0 THEN base_false + 1.0::DOUBLE ELSE base_false * 1.05::DOUBLE END AS safety_limit
             FROM points p JOIN base b USING (test_scenario, seed) WHERE p.method = 'blend_prior')
"""


def targeted(spark, sf_dir):
    """Selector points with the baseline's default workload as the target and its validation safety limit."""
    every = points(spark, sf_dir)
    base = P.default_point(every.filter("method = 'pattern_prior'"), *STUDY.default_setting).select(
        "test_scenario", "seed",
        F.col("test_review_workload").alias("target_workload"),
        P.safety_limit(F.col("validation_false_escalations_per_1000_nonincidents")).alias("safety_limit"),
        F.col("test_automatic_incident_recall").alias("baseline_recall"),
        F.col("test_auto_false_incident").alias("baseline_auto_false_incident"),
        F.col("test_false_escalations_per_1000_nonincidents").alias("baseline_false_escalations_per_1000_nonincidents"),
        F.col("test_strict_macro_f1").alias("baseline_strict_macro_f1"),
        F.col("test_nonincidents").alias("nonincidents"),
    )
    return every.filter("method = 'blend_prior'").join(base, ["test_scenario", "seed"])


_CLOSE = "row_number() OVER (PARTITION BY test_scenario, seed ORDER BY abs(test_review_workload - target_workload), test_review_workload, grid_order) = 1"


@query(
    "o5_closest_workload",
    with_(*BASE, TARGETED, f"SELECT test_scenario, seed, grid_order, round(target_workload, 6) AS target_workload, round(test_review_workload, 6) AS workload FROM targeted QUALIFY {_CLOSE}"),
)
def o5(spark, sf_dir):
    got = P.closest_workload(targeted(spark, sf_dir), ["test_scenario", "seed"])
    return got.select("test_scenario", "seed", "grid_order", F.round("target_workload", 6).alias("target_workload"), F.round("test_review_workload", 6).alias("workload"))


@query(
    "o6_closest_safe_workload",
    with_(
        *BASE, TARGETED,
        f"safe AS (SELECT * FROM targeted WHERE validation_false_escalations_per_1000_nonincidents <= safety_limit QUALIFY {_CLOSE})",
        """SELECT b.test_scenario, b.seed, s.grid_order, round(s.safety_limit, 6) AS safety_limit, round(s.test_review_workload, 6) AS workload, s.grid_order IS NOT NULL AS feasible
           FROM base b LEFT JOIN safe s ON b.test_scenario = s.test_scenario AND b.seed = s.seed""",
    ),
)
def o6(spark, sf_dir):
    got = P.closest_safe_workload(targeted(spark, sf_dir), ["test_scenario", "seed"])
    return got.select(
        "test_scenario", "seed", "grid_order", F.round("safety_limit", 6).alias("safety_limit"),
        F.round("test_review_workload", 6).alias("workload"), "feasible",
    )


@query(
    "o7_bracketed_mix",
    with_(
        *BASE, TARGETED,
        """lo AS (SELECT * FROM targeted WHERE test_review_workload <= target_workload QUALIFY row_number() OVER (PARTITION BY test_scenario, seed ORDER BY test_review_workload DESC, grid_order) = 1),
           hi AS (SELECT * FROM targeted WHERE test_review_workload >= target_workload QUALIFY row_number() OVER (PARTITION BY test_scenario, seed ORDER BY test_review_workload, grid_order) = 1),
           near AS (SELECT * FROM targeted QUALIFY """ + _CLOSE + """),
           sides AS (SELECT n.test_scenario, n.seed, n.target_workload, l.seed IS NOT NULL AND h.seed IS NOT NULL AS bracketed,
             CASE WHEN l.seed IS NOT NULL AND h.seed IS NOT NULL THEN l ELSE n END AS a, CASE WHEN l.seed IS NOT NULL AND h.seed IS NOT NULL THEN h ELSE n END AS b
             FROM near n LEFT JOIN lo l ON l.test_scenario = n.test_scenario AND l.seed = n.seed LEFT JOIN hi h ON h.test_scenario = n.test_scenario AND h.seed = n.seed),
           mix AS (SELECT *, CASE WHEN bracketed AND abs(b.test_review_workload - a.test_review_workload) > 1e-15
             THEN (target_workload - a.test_review_workload) / (b.test_review_workload - a.test_review_workload) ELSE 0 END AS p FROM sides)""",
        """SELECT test_scenario, seed, bracketed, a.grid_order AS lower_index, b.grid_order AS upper_index, round(p, 6) AS upper_probability,
             round((1 - p) * a.test_review_workload + p * b.test_review_workload, 6) AS workload,
             round((1 - p) * a.test_automatic_incident_recall + p * b.test_automatic_incident_recall, 6) AS automatic_incident_recall,
             round((1 - p) * a.test_false_escalations_per_1000_nonincidents + p * b.test_false_escalations_per_1000_nonincidents, 6) AS false_escalations_per_1000_nonincidents
           FROM mix""",
    ),
)
def o7(spark, sf_dir):
    got = P.bracketed_mix(
        targeted(spark, sf_dir), ["test_scenario", "seed"],
        ["automatic_incident_recall", "false_escalations_per_1000_nonincidents"],
    )
    return rounded(got)


@query(
    "o8_lowest_workload_setting",
    with_(
        *BASE,
        """SELECT method, test_scenario, seed, eps, threshold FROM points
           QUALIFY row_number() OVER (PARTITION BY method, test_scenario, seed ORDER BY validation_analyst_workload, validation_triage_incident_recall DESC, eps NULLS FIRST, threshold) = 1""",
    ),
)
def o8(spark, sf_dir):
    return P.lowest_workload_setting(points(spark, sf_dir), list(R.RUN_KEYS)).select(*R.RUN_KEYS, "eps", "threshold")


@query(
    "o8_best_candidate",
    with_(
        *BASE,
        """SELECT method, test_scenario, seed, threshold, grid_order FROM points
           QUALIFY row_number() OVER (PARTITION BY method, test_scenario, seed ORDER BY validation_triage_incident_recall DESC NULLS LAST,
             validation_incident_group_recall DESC NULLS LAST, validation_triage_precision DESC NULLS LAST, grid_order) = 1""",
    ),
)
def o8_best(spark, sf_dir):
    got = P.best_candidate(points(spark, sf_dir), list(R.RUN_KEYS), "grid_order")
    return got.select(*R.RUN_KEYS, "threshold", "grid_order")


@query(
    "o9_safety_limit",
    with_(
        *BASE,
        """SELECT method, test_scenario, seed, grid_order, round(CASE WHEN r < 1 THEN r + 1 ELSE r * 1.05::DOUBLE END, 6) AS hybrid, round(r * 1.05::DOUBLE, 6) AS relative_only
           FROM (SELECT *, validation_false_escalations_per_1000_nonincidents AS r FROM points)""",
    ),
)
def o9(spark, sf_dir):
    rate = F.col("validation_false_escalations_per_1000_nonincidents")
    return rounded(points(spark, sf_dir).select(
        *R.RUN_KEYS, "grid_order", P.safety_limit(rate).alias("hybrid"), P.safety_limit(rate, "relative_only").alias("relative_only")
    ))


@query(
    "o10_flatten_selection",
    with_(
        *BASE, MATCHED,
        """SELECT method, test_scenario, seed, 'default_matched' AS policy, 'default_matched' AS budget_design, eps, threshold, feasible,
                  round(test_triage_incident_recall, 6) AS test_triage_incident_recall, round(validation_triage_incident_recall, 6) AS validation_triage_incident_recall FROM matched""",
    ),
)
def o10(spark, sf_dir):
    wide = P.flatten_selection(matched(spark, sf_dir), "default_matched", "default_matched")
    return rounded(wide.select(
        *R.RUN_KEYS, "policy", "budget_design", "eps", "threshold", "feasible", "test_triage_incident_recall", "validation_triage_incident_recall"
    ))


@query(
    "o11_default_point",
    with_(*BASE, "SELECT method, test_scenario, seed, grid_order FROM points WHERE abs(eps - 0.3) <= 1e-9 AND abs(threshold - 0.02) <= 1e-9"),
)
def o11(spark, sf_dir):
    return P.default_point(points(spark, sf_dir), *STUDY.default_setting).select(*R.RUN_KEYS, "grid_order")


# ---- paired effects and gates -------------------------------------------------------

PAIRS = """
sel AS (SELECT * FROM targeted QUALIFY """ + _CLOSE + """),
gains AS (SELECT test_scenario AS scenario, seed, test_automatic_incident_recall - baseline_recall AS recall_gain,
                 test_review_workload - target_workload AS workload_difference, test_strict_macro_f1 - baseline_f1 AS strict_macro_f1_gain,
                 baseline_auto_false_incident, test_auto_false_incident AS selector_auto_false_incident, nonincidents,
                 baseline_false_rate, test_false_escalations_per_1000_nonincidents AS selector_false_rate FROM sel),
effects AS (SELECT scenario, avg(recall_gain) AS effect FROM gains GROUP BY 1)
"""
PBASE = (*BASE, TARGETED, PAIRS)


def pairs(spark, sf_dir):
    chosen = P.closest_workload(targeted(spark, sf_dir), ["test_scenario", "seed"])
    return chosen.select(
        F.col("test_scenario").alias("scenario"), "seed",
        (F.col("test_automatic_incident_recall") - F.col("baseline_recall")).alias("recall_gain"),
        (F.col("test_review_workload") - F.col("target_workload")).alias("workload_difference"),
        (F.col("test_strict_macro_f1") - F.col("baseline_strict_macro_f1")).alias("strict_macro_f1_gain"),
        "baseline_auto_false_incident",
        F.col("test_auto_false_incident").alias("selector_auto_false_incident"),
        "nonincidents",
        "baseline_false_escalations_per_1000_nonincidents",
        F.col("test_false_escalations_per_1000_nonincidents").alias("selector_false_escalations_per_1000_nonincidents"),
    )


def effects(spark, sf_dir):
    # read by several resamplers: fixed once, a handful of rows
    return cut_lineage(pairs(spark, sf_dir).groupBy("scenario").agg(F.avg("recall_gain").alias("effect")))


@query(
    "j8_pair_runs",
    with_(
        *BASE,
        """SELECT a.test_scenario, a.seed, a.grid_order, a.split, round(a.review_workload, 6) AS baseline_review_workload,
                  round(b.review_workload, 6) AS selector_review_workload, round(b.review_workload - a.review_workload, 6) AS review_workload_gain
           FROM records a JOIN records b ON a.method = 'pattern_prior' AND b.method = 'blend_prior' AND a.test_scenario = b.test_scenario
             AND a.seed = b.seed AND a.grid_order = b.grid_order AND a.split = b.split""",
    ),
)
def j8(spark, sf_dir):
    return rounded(J.pair_runs(records(spark, sf_dir), ["test_scenario", "seed", "grid_order", "split"], *METHOD_PAIR, ["review_workload"]))


def _bootstrap_sql(iterations: int, seed: int, effects: str = "effects", order: str = "scenario") -> str:
    return f"""
arr AS (SELECT list(effect ORDER BY {order}) AS e, count(*) AS n FROM {effects}),
draws AS (SELECT it, avg(e[({h32(str(seed), 'it', 'slot')} % n)::INT + 1]) AS m
          FROM arr CROSS JOIN (SELECT range AS it FROM range({iterations})) CROSS JOIN (SELECT range AS slot FROM range(64)) WHERE slot < n GROUP BY it)
"""


@query(
    "b1_scenario_bootstrap_ci",
    with_(*PBASE, _bootstrap_sql(20_000, 20_260_903), "SELECT round(quantile_cont(m, 0.025), 6) AS ci_low, round(quantile_cont(m, 0.975), 6) AS ci_high FROM draws"),
)
def b1(spark, sf_dir):
    return rounded(B.scenario_bootstrap_ci(effects(spark, sf_dir)))


_SIGNS = """
arr AS (SELECT list(effect ORDER BY scenario) AS e, count(*) AS n FROM effects),
masks AS (SELECT e, n, range AS mask FROM arr CROSS JOIN range(256) WHERE n > 0 AND range < (1 << n::INT)),
flips AS (SELECT list_sum([CASE WHEN (mask >> (i - 1)::INT) & 1 = 1 THEN e[i] ELSE -e[i] END for i in range(1, n + 1)]) / n AS m,
                 list_sum(e) / n AS obs FROM masks)
"""


@query("b2_sign_flip_p", with_(*PBASE, _SIGNS, "SELECT round(avg(CASE WHEN m >= obs - 1e-15 THEN 1.0::DOUBLE ELSE 0 END), 6) AS p FROM flips"))
def b2(spark, sf_dir):
    return rounded(B.sign_flip_p(effects(spark, sf_dir)))


INFER = f"""
elig AS (SELECT method, test_scenario, seed, feasible, test_triage_incident_recall AS r, test_analyst_workload AS w FROM matched
         WHERE method IN ('pattern_prior', 'blend_prior') AND test_scenario NOT IN ('s0', 's2')),
piv AS (SELECT test_scenario, seed, avg(r) FILTER (WHERE method = 'blend_prior') - avg(r) FILTER (WHERE method = 'pattern_prior') AS dr,
               avg(w) FILTER (WHERE method = 'blend_prior') - avg(w) FILTER (WHERE method = 'pattern_prior') AS dw
        FROM elig WHERE feasible GROUP BY 1, 2 HAVING dr IS NOT NULL AND dw IS NOT NULL),
bys AS (SELECT test_scenario AS scenario, avg(dr) AS effect, avg(dw) AS dw, count(*) AS pairs FROM piv GROUP BY 1),
summ AS (SELECT count(*) AS scenario_n, sum(pairs)::BIGINT AS seed_scenario_pairs, avg(effect) AS mean_delta_recall, median(effect) AS median_delta_recall,
                avg(dw) AS mean_delta_workload FROM bys)
"""


@query(
    "b3_paired_inference",
    with_(
        *BASE, MATCHED, INFER, _bootstrap_sql(20_000, 20_260_903, "bys"), _SIGNS.replace("FROM effects", "FROM bys").replace("arr AS", "arr2 AS").replace("FROM arr ", "FROM arr2 "),
        """rk AS (SELECT scenario, effect, sign(effect) * (rank() OVER (ORDER BY abs(effect)) + (count(*) OVER (PARTITION BY abs(effect)) - 1) / 2.0::DOUBLE) AS sr FROM bys),
           ra AS (SELECT list(sr ORDER BY scenario) AS e, count(*) AS n FROM rk WHERE effect <> 0),
           rm AS (SELECT list_sum([CASE WHEN (mask >> (i - 1)::INT) & 1 = 1 THEN abs(e[i]) ELSE 0 END for i in range(1, n + 1)]) >= list_sum([greatest(x, 0) for x in e]) AS hit
                  FROM (SELECT e, n, range AS mask FROM ra CROSS JOIN range(64) WHERE n > 0 AND range < (1 << n::INT)))""",
        """SELECT 'default_matched' AS budget_design, scenario_n, seed_scenario_pairs, round(mean_delta_recall, 6) AS mean_delta_recall,
                  round(median_delta_recall, 6) AS median_delta_recall, round(mean_delta_workload, 6) AS mean_delta_workload, 6 AS expected_scenario_n, 12 AS expected_pairs,
                  scenario_n = 6 AND seed_scenario_pairs = 12 AS complete_panel,
                  CASE WHEN scenario_n = 6 AND seed_scenario_pairs = 12 THEN (SELECT round(quantile_cont(m, 0.025), 6) FROM draws) END AS ci_low,
                  CASE WHEN scenario_n = 6 AND seed_scenario_pairs = 12 THEN (SELECT round(quantile_cont(m, 0.975), 6) FROM draws) END AS ci_high,
                  CASE WHEN scenario_n = 6 AND seed_scenario_pairs = 12 THEN (SELECT round(avg(CASE WHEN m >= obs - 1e-15 THEN 1.0::DOUBLE ELSE 0 END), 6) FROM flips) END AS p,
                  CASE WHEN scenario_n = 6 AND seed_scenario_pairs = 12 THEN (SELECT round(avg(CASE WHEN hit THEN 1.0::DOUBLE ELSE 0 END), 6) FROM rm) END AS signed_rank_p
           FROM summ""",
    ),
)
def b3(spark, sf_dir):
    selected = cut_lineage(P.flatten_selection(matched(spark, sf_dir), "default_matched", "default_matched"))
    return rounded(B.paired_inference(selected, ["budget_design"], "blend_prior", "pattern_prior", CONFIRMATORY))


_METRICS = ("recall_gain", "workload_difference", "strict_macro_f1_gain")


@query(
    "b4_holm",
    with_(
        *PBASE,
        "ef AS (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, scenario, avg({m}) AS effect FROM gains GROUP BY scenario" for m in _METRICS) + ")",
        """ar AS (SELECT metric, list(effect ORDER BY scenario) AS e, count(*) AS n FROM ef WHERE effect IS NOT NULL GROUP BY 1),
           fl AS (SELECT metric, list_sum([CASE WHEN (mask >> (i - 1)::INT) & 1 = 1 THEN e[i] ELSE -e[i] END for i in range(1, n + 1)]) / n AS m, list_sum(e) / n AS obs
                  FROM ar CROSS JOIN (SELECT range AS mask FROM range(256)) WHERE mask < (1 << n::INT)),
           pv AS (SELECT metric, avg(CASE WHEN m >= obs - 1e-15 THEN 1.0::DOUBLE ELSE 0 END) AS p FROM fl GROUP BY 1),
           st AS (SELECT *, row_number() OVER (ORDER BY p, metric) AS rk, count(*) OVER () AS m FROM pv)""",
        "SELECT metric, round(p, 6) AS p, m AS family_size, round(least(max((m - rk + 1) * p) OVER (ORDER BY rk), 1), 6) AS p_holm FROM st",
    ),
)
def b4(spark, sf_dir):
    """Sign-flip p-values of the study's three effects, adjusted as one family."""
    gains = pairs(spark, sf_dir)
    each = F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in _METRICS]))
    effect = gains.select("scenario", each).groupBy("metric", "scenario").agg(F.avg("value").alias("effect"))
    tests = B.sign_flip_p(effect, ["metric"]).withColumn("family", F.lit("study"))
    return rounded(B.holm(tests, ["family"]).drop("family"))


@query(
    "b5_signed_rank_p",
    with_(
        *PBASE,
        """rk AS (SELECT scenario, effect, sign(effect) * (rank() OVER (ORDER BY abs(effect)) + (count(*) OVER (PARTITION BY abs(effect)) - 1) / 2.0::DOUBLE) AS sr
                  FROM effects),
           arr AS (SELECT list(sr ORDER BY scenario) AS e, count(*) AS n FROM rk WHERE effect <> 0),
           masks AS (SELECT e, n, range AS mask FROM arr CROSS JOIN range(256) WHERE n > 0 AND range < (1 << n::INT))""",
        """SELECT round(avg(CASE WHEN list_sum([CASE WHEN (mask >> (i - 1)::INT) & 1 = 1 THEN abs(e[i]) ELSE 0 END for i in range(1, n + 1)])
                     >= list_sum([greatest(x, 0) for x in e]) THEN 1.0::DOUBLE ELSE 0 END), 6) AS signed_rank_p FROM masks""",
    ),
)
def b5(spark, sf_dir):
    return rounded(B.signed_rank_p(effects(spark, sf_dir)))


@query(
    "b7_scenario_effects",
    with_(
        *PBASE,
        """SELECT scenario, round(avg(recall_gain), 6) AS mean_recall_gain, round(avg(workload_difference), 6) AS mean_workload_difference,
                  round(avg(strict_macro_f1_gain), 6) AS mean_strict_macro_f1_gain, count(*) AS seeds FROM gains GROUP BY 1""",
    ),
)
def b7(spark, sf_dir):
    got = B.scenario_effects(pairs(spark, sf_dir), ["recall_gain", "workload_difference", "strict_macro_f1_gain"])
    return rounded(got.select("scenario", "mean_recall_gain", "mean_workload_difference", "mean_strict_macro_f1_gain", F.size("seed_recall_gain").cast("long").alias("seeds")))


POOLED = """
pooled AS (
  SELECT 1000.0::DOUBLE * sum(b) / sum(n) AS pooled_baseline, 1000.0::DOUBLE * sum(s) / sum(n) AS pooled_selector, avg(mb) AS macro_baseline, avg(ms) AS macro_selector
  FROM (SELECT scenario, sum(baseline_auto_false_incident) AS b, sum(selector_auto_false_incident) AS s, sum(nonincidents) AS n,
               avg(baseline_false_rate) AS mb, avg(selector_false_rate) AS ms FROM gains GROUP BY 1))
"""


@query(
    "b8_pooled_rates",
    with_(
        *PBASE, POOLED,
        """SELECT round(pooled_baseline, 6) AS pooled_baseline, round(pooled_selector, 6) AS pooled_selector, round(macro_baseline, 6) AS macro_baseline, round(macro_selector, 6) AS macro_selector,
                  round(pooled_selector / pooled_baseline - 1, 6) AS pooled_relative_increase, round(macro_selector / macro_baseline - 1, 6) AS macro_relative_increase FROM pooled""",
    ),
)
def b8(spark, sf_dir):
    return rounded(B.pooled_rates(pairs(spark, sf_dir)))


@query(
    "b9_upper_bound_gate",
    with_(
        *PBASE,
        """SELECT round(min(effect), 6) AS least_gain, round(max(effect), 6) AS largest_gain, min(effect) >= 0.01 OR (max(effect) >= 0.02 AND min(effect) >= 0) AS passed FROM effects""",
    ),
)
def b9(spark, sf_dir):
    return rounded(B.upper_bound_gate(effects(spark, sf_dir), 0.01, 0.02, gain="effect"))


def _evidence_sql() -> str:
    """full_width and label_free of two selectors, from the slots they choose with the labels as they are and turned around."""
    def listed(name: str, priority: str) -> str:
        return f"""
{name} AS (SELECT row_id, string_agg(x.r, ' ' ORDER BY p) AS picked, count(*) AS n
           FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY {priority} + position * 1e-10::DOUBLE DESC, p DESC) AS rn FROM sw) WHERE rn <= 10 GROUP BY 1)"""

    parts = [
        *EV.BASE, EV.SLOT_WEIGHTS, listed("la", "round(abs(w), 7)"), listed("lo_", "round(w, 7) * (CASE WHEN y = 1 THEN 1 ELSE -1 END)"),
        listed("lt", "round(w, 7) * (CASE WHEN y = 0 THEN 1 ELSE -1 END)"),
    ]
    def side(selector: str, chosen: str, again: str) -> str:
        return f"""SELECT '{selector}' AS selector, bool_and(coalesce(a.n, 0) = least(10, len(c))) AS full_width, bool_and(coalesce(a.picked, '') = coalesce(b.picked, '')) AS label_free
                   FROM applied JOIN ctx USING (row_id) LEFT JOIN {chosen} a ON a.row_id = applied.row_id LEFT JOIN {again} b ON b.row_id = applied.row_id"""

    return f"evidence AS ({with_(*parts, side('association_abs', 'la', 'la') + ' UNION ALL ' + side('class_oracle', 'lo_', 'lt'))})"


CONFIRMED = f"""
{_evidence_sql()},
ci AS (SELECT quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM draws),
pos AS (SELECT count(*) FILTER (WHERE effect > 0) AS positive_scenarios, avg(effect) AS mean_gain FROM effects),
confirmed AS (
  SELECT selector, positive_scenarios, round(mean_gain, 6) AS mean_gain, round(lo, 6) AS ci_low, round(hi, 6) AS ci_high,
         round(pooled_selector / pooled_baseline - 1, 6) AS pooled_relative_increase, lo > 0 AS ci_pass, positive_scenarios >= 4 AS count_pass,
         pooled_selector / pooled_baseline - 1 <= 0.05 AS safety_pass, full_width AS width_pass, label_free AS label_free_pass,
         lo > 0 AND positive_scenarios >= 4 AND pooled_selector / pooled_baseline - 1 <= 0.05 AND full_width AND label_free AS succeeds
  FROM pos CROSS JOIN ci CROSS JOIN pooled CROSS JOIN evidence)
"""
CONFIRMATION = (*PBASE, POOLED, _bootstrap_sql(20_000, 20_260_903), CONFIRMED)


def selector_evidence(spark, sf_dir):
    """full_width and label_free of each selector, from its slots with the alert's label as it is and turned around."""
    rows = EV.applied(spark, sf_dir)
    sides = []
    for name in ("association_abs", "class_oracle"):
        ids = C.ids(AS.SELECTORS[name](10, 5), "row_id")
        chosen = rows.withColumn("slots", ids).withColumn("event_incident", 1 - F.col("event_incident")).withColumn("again", ids)
        contexts = chosen.select(F.size("candidates").alias("candidates"), "slots", "again")
        sides.append(B.widths_and_labels(contexts, 10, again="again").select(F.lit(name).alias("selector"), "*"))
    return sides[0].unionByName(sides[1])


def confirmation(spark, sf_dir):
    side = cut_lineage(pairs(spark, sf_dir))
    effect = side.groupBy("scenario").agg(F.avg("recall_gain").alias("effect"))
    return B.confirmation_gate(effect, B.scenario_bootstrap_ci(effect), B.pooled_rates(side), selector_evidence(spark, sf_dir), gain="effect")


@query("b9_confirmation_gate", with_(*CONFIRMATION, "SELECT * FROM confirmed"))
def b9_confirmation(spark, sf_dir):
    return rounded(confirmation(spark, sf_dir))


# ---- record checks --------------------------------------------------------------------

_V8 = {
    **{f"invalid {r}": f"({r} IS NULL OR {r} NOT BETWEEN 0 AND 1)" for r in ("analyst_workload", "triage_incident_recall", "reject_rate", "automation_coverage", "relaxed_f1", "incident_group_recall")},
    "alert count differs from the split": "alerts <> split_rows",
    "undefined precision at nonzero workload": "(triage_precision IS NULL AND analyst_workload > 1e-8)",
    "reject exceeds workload": "reject_rate > analyst_workload + 1e-12",
}


@query(
    "v8_metric_violations",
    with_(
        *BASE,
        """exp AS (SELECT f.test_scenario, f.role AS split, count(*) - CASE WHEN f.test_scenario = 's4' THEN 1 ELSE 0 END AS split_rows FROM alerts a JOIN folds f ON a.scenario = f.scenario WHERE f.role <> 'train' GROUP BY 1, 2)""",
        "j AS (SELECT r.*, split_rows FROM records r JOIN exp USING (test_scenario, split))",
        "SELECT method, test_scenario, seed, grid_order, split, violation FROM ("
        + " UNION ALL ".join(f"SELECT *, '{n}' AS violation FROM j WHERE {t}" for n, t in _V8.items())
        + ")",
    ),
)
def v8(spark, sf_dir):
    """The expected size of scenario s4's splits is off by one on purpose, so that a violation shows."""
    rows, table = alerts(spark, sf_dir), folds(spark, sf_dir)
    sizes = rows.groupBy("scenario").agg(F.count("*").alias("n")).join(table.filter("role <> 'train'"), "scenario")
    off = F.when(F.col("test_scenario") == "s4", 1).otherwise(0)
    expected = sizes.select("test_scenario", F.col("role").alias("split"), (F.col("n") - off).alias("split_rows"))
    keys = ["method", "test_scenario", "seed", "grid_order", "split"]
    return V.metric_violations(records(spark, sf_dir), keys, expected, ["test_scenario", "split"])


@query(
    "v9_missing_runs",
    with_(
        *BASE,
        "kept AS (SELECT DISTINCT method, test_scenario, seed FROM records WHERE NOT (method = 'rule_prior' AND test_scenario = 's6' AND seed = 23))",
        """SELECT m.method, s.test_scenario, d.seed FROM (SELECT DISTINCT method FROM kept) m CROSS JOIN (SELECT DISTINCT test_scenario FROM kept) s CROSS JOIN (SELECT DISTINCT seed FROM kept) d
           EXCEPT SELECT method, test_scenario, seed FROM kept""",
    ),
)
def v9(spark, sf_dir):
    kept = records(spark, sf_dir).filter("NOT (method = 'rule_prior' AND test_scenario = 's6' AND seed = 23)")
    return V.missing_runs(kept.select("method", "test_scenario", "seed").distinct(), ["method", "test_scenario", "seed"])


@query(
    "v9_grid_and_split_identity",
    with_(
        *BASE,
        """dup AS (SELECT method, test_scenario, seed, eps, threshold, split FROM records GROUP BY ALL HAVING count(*) > 1),
           spl AS (SELECT test_scenario, seed, split FROM records GROUP BY ALL HAVING count(DISTINCT (alerts, incidents)) > 1)""",
        "SELECT 'duplicate points' AS check, count(*) AS violations FROM dup UNION ALL SELECT 'unequal splits', count(*) FROM spl",
    ),
)
def v9_identity(spark, sf_dir):
    rows = cut_lineage(records(spark, sf_dir))
    duplicates = V.duplicate_runs(rows, [*R.RUN_KEYS, "eps", "threshold", "split"])
    unequal = V.unequal_splits(rows, ["test_scenario", "seed", "split"], ["alerts", "incidents"])
    count = lambda df, name: df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")
    return count(duplicates, "duplicate points").unionByName(count(unequal, "unequal splits"))


@query(
    "v10_reproduction",
    with_(
        *BASE,
        "p AS (SELECT * FROM records WHERE method = 'pattern_prior'), b AS (SELECT * FROM records WHERE method = 'blend_prior')",
        "j AS (SELECT p.review_workload AS a1, b.review_workload AS b1, p.reject_rate AS a2, b.reject_rate AS b2 FROM p FULL JOIN b USING (test_scenario, seed, grid_order, split))",
        """SELECT 'review_workload' AS metric, count(*) AS compared, count(*) FILTER (WHERE (a1 IS NULL) <> (b1 IS NULL)) AS one_sided, count(*) FILTER (WHERE abs(a1 - b1) > 1e-12) AS different, round(max(abs(a1 - b1)), 6) AS largest_gap FROM j
           UNION ALL SELECT 'reject_rate', count(*), count(*) FILTER (WHERE (a2 IS NULL) <> (b2 IS NULL)), count(*) FILTER (WHERE abs(a2 - b2) > 1e-12), round(max(abs(a2 - b2)), 6) FROM j""",
    ),
)
def v10(spark, sf_dir):
    rows = cut_lineage(records(spark, sf_dir))
    sides = [rows.filter(F.col("method") == m) for m in METHOD_PAIR]
    return rounded(V.reproduction(*sides, ["test_scenario", "seed", "grid_order", "split"], ["review_workload", "reject_rate"]))


@query(
    "v11_matched_violations",
    with_(
        *BASE,
        """SELECT a.test_scenario, a.seed, a.grid_order, a.split, round(a.reject_rate, 6) AS baseline_reject_rate, round(b.reject_rate, 6) AS selector_reject_rate,
                  round(a.review_workload, 6) AS baseline_review_workload, round(b.review_workload, 6) AS selector_review_workload
           FROM records a JOIN records b ON a.method = 'pattern_prior' AND b.method = 'blend_prior' AND a.test_scenario = b.test_scenario AND a.seed = b.seed
             AND a.grid_order = b.grid_order AND a.split = b.split WHERE a.reject_rate <> b.reject_rate OR a.review_workload <> b.review_workload""",
    ),
)
def v11(spark, sf_dir):
    paired = J.pair_runs(records(spark, sf_dir), ["test_scenario", "seed", "grid_order", "split"], *METHOD_PAIR, ["reject_rate", "review_workload"])
    bad = V.matched_violations(
        paired, ["test_scenario", "seed", "grid_order", "split"],
        [("baseline_reject_rate", "selector_reject_rate"), ("baseline_review_workload", "selector_review_workload")],
    )
    return rounded(bad)


# ---- flagship -------------------------------------------------------------------------


@query(
    "held_out_rule_triage",
    with_(
        ALERTS, FOLDS, history(10),
        """cell AS (SELECT scenario, event_id, event_incident AS y, event_incident_group AS g, count(*) AS n, sum(len(c)) AS slots FROM alerts JOIN ctx USING (row_id) GROUP BY ALL),
           fit AS (SELECT f.test_scenario, c.event_id, (coalesce(sum(n) FILTER (WHERE y = 1), 0) + 1.0::DOUBLE) / (sum(n) + 2.0::DOUBLE) AS post FROM cell c JOIN folds f ON c.scenario = f.scenario AND f.role = 'train' GROUP BY 1, 2),
           pr AS (SELECT c.*, CASE WHEN post IS NULL THEN -2 WHEN post >= 0.135 THEN 1 ELSE 0 END AS p FROM cell c LEFT JOIN fit ON fit.test_scenario = c.scenario AND fit.event_id = c.event_id)""",
        """SELECT scenario AS test_scenario, sum(n)::BIGINT AS alerts, sum(n) FILTER (WHERE y = 1)::BIGINT AS incidents, round(coalesce(sum(n) FILTER (WHERE p <> 0), 0) / sum(n), 6) AS analyst_workload,
             round(coalesce(sum(n) FILTER (WHERE p <> 0 AND y = 1), 0) / nullif(sum(n) FILTER (WHERE y = 1), 0), 6) AS triage_incident_recall,
             round(count(DISTINCT g) FILTER (WHERE p <> 0 AND y = 1) / count(DISTINCT g), 6) AS incident_group_recall, round(sum(slots) / sum(n), 6) AS mean_context_depth FROM pr GROUP BY 1""",
    ),
)
def held_out_rule_triage(spark, sf_dir):
    """What recall and review workload a rule prior fitted on the training scenarios gives on the held-out one."""
    from alertweave.operators.context import strict_past_context

    rows = strict_past_context(alerts(spark, sf_dir))
    cells = rows.groupBy(
        "scenario", "event_id", F.col("event_incident").alias("truth"), F.col("event_incident_group").alias("incident_group")
    ).agg(F.count("*").alias("n"), F.sum(F.size("context")).alias("slots"))
    table = folds(spark, sf_dir)
    train = cells.join(table.filter("role = 'train'"), "scenario").groupBy(F.col("test_scenario").alias("scenario"), "event_id").agg(
        ((F.sum(F.when(F.col("truth") == 1, F.col("n")).otherwise(0)) + 1.0) / (F.sum("n") + 2.0)).alias("posterior")
    )
    coded = cells.join(train, ["scenario", "event_id"], "left").withColumn(
        "prediction", F.when(F.col("posterior").isNull(), -2).when(F.col("posterior") >= 0.135, 1).otherwise(0)
    )
    metrics = M.operational_metrics(coded, ["scenario"], weight="n")
    depth = coded.groupBy("scenario").agg((F.sum("slots") / F.sum("n")).alias("mean_context_depth"))
    got = metrics.join(depth, "scenario").withColumnRenamed("scenario", "test_scenario")
    return rounded(got.select(
        "test_scenario", "alerts", "incidents", "analyst_workload", "triage_incident_recall", "incident_group_recall", "mean_context_depth"
    ))
