"""Registered queries: association evidence, evidence selectors and the retrieval audit."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from alertweave.catalog.contexts import POOL_PAYLOAD, pool
from alertweave.catalog.registry import query, stored, with_
from alertweave.catalog.sqltext import ALERTS, FOLDS, history
from alertweave.catalog.training import alerts, folds, rounded
from alertweave.operators import association as AS
from alertweave.operators import context as C
from alertweave.operators import metrics as M
from alertweave.operators import select as S
from alertweave.session import shared_folder

_BAND = "CASE WHEN rk <= 10 THEN 0 WHEN rk <= 20 THEN 1 WHEN rk <= 50 THEN 2 ELSE 3 END"

PRESENCE = f"""
slots AS (SELECT row_id, unnest(c) AS x, generate_subscripts(c, 1) AS p, len(c) + 1 - generate_subscripts(c, 1) AS rk FROM ctx WHERE len(c) > 0),
pres AS (SELECT DISTINCT a.scenario, s.row_id, a.event_id AS target, a.event_incident AS y, {_BAND} AS band, s.x.e AS event
         FROM slots s JOIN alerts a ON a.row_id = s.row_id)
"""

FIT = """
tt AS (SELECT f.test_scenario, a.event_id AS target, sum(event_incident) AS np, count(*) - sum(event_incident) AS nn
       FROM alerts a JOIN folds f ON a.scenario = f.scenario AND f.role = 'train' GROUP BY ALL),
gt AS (SELECT test_scenario, sum(np) AS np, sum(nn) AS nn, count(*) + 1 AS v FROM tt GROUP BY 1),
ob AS (SELECT f.test_scenario, p.target, p.band, p.event, sum(y) AS pos, count(*) - sum(y) AS neg
       FROM pres p JOIN folds f ON p.scenario = f.scenario AND f.role = 'train' GROUP BY ALL),
every AS (SELECT tt.*, v FROM tt JOIN gt USING (test_scenario) WHERE tt.np > 0 AND tt.nn > 0
          UNION ALL SELECT test_scenario, -1, np, nn, v FROM gt),
cnt AS (SELECT test_scenario, target, band, event, pos, neg FROM ob
        UNION ALL SELECT test_scenario, -1, band, event, sum(pos), sum(neg) FROM ob GROUP BY ALL),
pr AS (SELECT c.*, np, nn, v, (pos + 1.0::DOUBLE) / (np + 2.0::DOUBLE) AS pp, (neg + 1.0::DOUBLE) / (nn + 2.0::DOUBLE) AS pn
       FROM cnt c JOIN every USING (test_scenario, target)),
cells AS (SELECT test_scenario, target, band, event,
                 greatest(-6, least(6, (ln(pp) - ln(1 - pp)) - (ln(pn) - ln(1 - pn)))) AS weight, ln(1 - pp) - ln(1 - pn) AS gone FROM pr),
z AS (SELECT *, 1.0::DOUBLE / (np + 2.0::DOUBLE) AS zp, 1.0::DOUBLE / (nn + 2.0::DOUBLE) AS zn FROM every),
targets AS (
  SELECT z.test_scenario, z.target, greatest(-6, least(6, (ln(zp) - ln(1 - zp)) - (ln(zn) - ln(1 - zn)))) AS default_weight, v AS vocabulary,
         ln(np + 1.0::DOUBLE) - ln(nn + 1.0::DOUBLE) + coalesce(g, 0) + (v * 4 - coalesce(k, 0)) * (ln(1 - zp) - ln(1 - zn)) AS base
  FROM z LEFT JOIN (SELECT test_scenario, target, sum(gone) AS g, count(*) AS k FROM cells GROUP BY 1, 2) c
    ON c.test_scenario = z.test_scenario AND c.target = z.target)
"""

APPLIED = """
applied AS (
  SELECT a.row_id, a.event_incident AS y, f.test_scenario,
         CASE WHEN t.target IS NULL THEN -1 ELSE a.event_id END AS eff
  FROM alerts a JOIN folds f ON a.scenario = f.scenario AND f.role = 'test'
  LEFT JOIN targets t ON t.test_scenario = f.test_scenario AND t.target = a.event_id),
seenv AS (SELECT DISTINCT test_scenario, target AS event FROM tt)
"""

SLOT_WEIGHTS = f"""
sw AS (SELECT s.row_id, s.x, s.p, ap.y, coalesce(c.weight, t.default_weight) + 0.0::DOUBLE AS w, (SELECT max(n) FROM (SELECT 100 AS n)) - s.rk AS position
       FROM (SELECT *, {_BAND} AS band FROM slots) s JOIN applied ap ON ap.row_id = s.row_id
       JOIN targets t ON t.test_scenario = ap.test_scenario AND t.target = ap.eff
       LEFT JOIN cells c ON c.test_scenario = ap.test_scenario AND c.target = ap.eff AND c.band = s.band AND c.event = s.x.e)
"""

BASE = (ALERTS, FOLDS, history(100), PRESENCE, FIT, APPLIED)


#: What evidence depends on: alerts of a machine with equal second, event and label share pool, weights and choice.
TARGET = ["scenario", "machine", "timestamp", "event_id", "event_incident"]


def target_pool(spark, sf_dir, timeout=86_400):
    """The candidate pool once per kind of target, with its number of alerts `n`."""
    rows = alerts(spark, sf_dir)
    kinds = rows.groupBy(*TARGET).agg(F.count("*").alias("n"))
    seconds = C.strict_past_seconds(rows, 100, timeout, POOL_PAYLOAD, "candidates")
    return kinds.join(seconds, ["machine", "timestamp"])


def to_alerts(spark, sf_dir, results):
    """Results per kind of target on every alert."""
    return alerts(spark, sf_dir).select("row_id", *TARGET).join(results, TARGET)


def fitted(spark, sf_dir):
    return AS.fit_association(target_pool(spark, sf_dir), alerts(spark, sf_dir), folds(spark, sf_dir), weight="n")


def applied(spark, sf_dir):
    """The pool of every kind of target with the model of the fold that holds its scenario out."""
    rows, table = target_pool(spark, sf_dir), folds(spark, sf_dir)
    model = stored("association", spark, sf_dir, lambda: AS.association_model(rows, alerts(spark, sf_dir), table, decimals=7, weight="n"))
    return AS.with_model(rows, table, model)


@query("a13_association_cells", with_(*BASE, "SELECT test_scenario, target, band, event, round(weight, 6) AS weight FROM cells"))
def a13(spark, sf_dir):
    cells, _ = fitted(spark, sf_dir)
    return rounded(cells)


@query(
    "a13_association_targets",
    with_(*BASE, "SELECT test_scenario, target, round(base, 6) AS base, round(default_weight, 6) AS default_weight, vocabulary FROM targets"),
)
def a13_targets(spark, sf_dir):
    _, targets = fitted(spark, sf_dir)
    return rounded(targets)


def _scored(spark, sf_dir, rows):
    return to_alerts(spark, sf_dir, rows.select(*TARGET, F.round(AS.association_score(), 6).alias("score"))).select("row_id", "score")


_SCORES = """
scores AS (
  SELECT ap.test_scenario, ap.row_id, ap.y, t.base + coalesce(sum(round(coalesce(c.weight, t.default_weight), 7)) FILTER (WHERE p.row_id IS NOT NULL), 0) AS score
  FROM applied ap JOIN targets t ON t.test_scenario = ap.test_scenario AND t.target = ap.eff
  LEFT JOIN pres p ON p.row_id = ap.row_id
  LEFT JOIN cells c ON c.test_scenario = ap.test_scenario AND c.target = ap.eff AND c.band = p.band AND c.event = p.event
  GROUP BY ap.test_scenario, ap.row_id, ap.y, t.base)
"""


@query("a14_association_score", with_(*BASE, _SCORES, "SELECT row_id, round(score, 6) AS score FROM scores"))
def a14(spark, sf_dir):
    return _scored(spark, sf_dir, applied(spark, sf_dir))


@query(
    "m11_probability_metrics",
    with_(
        *BASE, _SCORES,
        "ps AS (SELECT test_scenario, y, round(score, 8) AS score, 1 / (1 + exp(-round(score, 8))) AS p FROM scores)",
        "d AS (SELECT test_scenario, p, sum(y) AS pos, count(*) - sum(y) AS neg FROM ps GROUP BY 1, 2)",
        """r AS (SELECT *, sum(pos) OVER w - pos AS above, sum(neg) OVER w - neg AS nabove FROM d
                 WINDOW w AS (PARTITION BY test_scenario ORDER BY p DESC ROWS UNBOUNDED PRECEDING))""",
        """SELECT test_scenario, sum(pos + neg)::BIGINT AS rows, round(sum(pos) / sum(pos + neg), 6) AS prevalence,
                  round(sum(neg * (above + pos / 2)) / (sum(pos) * sum(neg)), 6) AS roc_auc,
                  round(sum(pos * (above + pos) / (above + pos + nabove + neg)) / sum(pos), 6) AS average_precision,
                  round(sum(-(pos * ln(greatest(least(p, 1 - 2.220446049250313e-16), 2.220446049250313e-16)) + neg * ln(1 - greatest(least(p, 1 - 2.220446049250313e-16), 2.220446049250313e-16)))) / sum(pos + neg), 5) AS log_loss,
                  round(sum(pos * (1 - p) * (1 - p) + neg * p * p) / sum(pos + neg), 6) AS brier_score FROM r GROUP BY 1""",
    ),
)
def m11(spark, sf_dir):
    """Scores are rounded to 8 places so that both engines form the same tie groups."""
    scored = applied(spark, sf_dir).select("test_scenario", *TARGET, F.round(AS.association_score(), 8).alias("score"))
    scored = to_alerts(spark, sf_dir, scored).select("test_scenario", "event_incident", "score")
    got = AS.probability_metrics(scored, ["test_scenario"], "event_incident", "score")
    return rounded(got.withColumn("log_loss", F.round("log_loss", 5)))


@query(
    "j7_weight_lookup",
    with_(
        *BASE, SLOT_WEIGHTS,
        "SELECT row_id, count(*) AS slots, round(sum(w), 4) AS total FROM sw GROUP BY 1",
    ),
)
def j7(spark, sf_dir):
    """Three-key weight lookup with the target's default for an unseen cell, summed over an alert's slots."""
    rows, table = pool(spark, sf_dir), folds(spark, sf_dir)
    cells, targets = fitted(spark, sf_dir)
    tests = table.filter("role = 'test'").select("scenario", "test_scenario")
    slots = rows.join(tests, "scenario").select(
        "row_id", "test_scenario", F.col("event_id").alias("own"), F.posexplode(F.reverse("candidates")).alias("i", "slot")
    )
    known = targets.select("test_scenario", F.col("target").alias("own"), F.lit(True).alias("known"))
    slots = slots.join(known, ["test_scenario", "own"], "left").select(
        "row_id", "test_scenario", F.when(F.col("known"), F.col("own")).otherwise(AS.GLOBAL_TARGET).alias("target"),
        S.recency_band(F.col("i") + 1).alias("band"), F.col("slot.event_id").alias("event"),
    )
    looked = slots.join(targets.select("test_scenario", "target", "default_weight"), ["test_scenario", "target"])
    looked = looked.join(cells, ["test_scenario", "target", "band", "event"], "left")
    return looked.groupBy("row_id").agg(
        F.count("*").alias("slots"), F.round(F.sum(F.coalesce("weight", "default_weight")), 4).alias("total")
    )


def _ranked(priority: str, k: int) -> str:
    return f"""
SELECT ctx.row_id, coalesce(picked, '') AS picked FROM ctx LEFT JOIN (
  SELECT row_id, string_agg(x.r, ' ' ORDER BY p) AS picked FROM (
    SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY {priority} + position * 1e-10::DOUBLE DESC, p DESC) AS rn FROM sw)
  WHERE rn <= {k} GROUP BY row_id) s ON ctx.row_id = s.row_id
"""


def _picked(spark, sf_dir, rows, chosen):
    picked = rows.select(*TARGET, C.joined(C.ids(chosen, "row_id")).alias("picked"))
    return to_alerts(spark, sf_dir, picked).select("row_id", "picked")


@query("t6_association_abs", with_(*BASE, SLOT_WEIGHTS, _ranked("round(abs(w), 7)", 10)))
def t6(spark, sf_dir):
    rows = applied(spark, sf_dir)
    return _picked(spark, sf_dir, rows, S.association_abs(F.col("candidates"), 10, F.col("weights"), F.col("vocabulary"), AS.local_event))


@query("t7_class_oracle", with_(*BASE, SLOT_WEIGHTS, _ranked("round(w, 7) * (CASE WHEN y = 1 THEN 1 ELSE -1 END)", 10)))
def t7(spark, sf_dir):
    rows = applied(spark, sf_dir)
    chosen = S.class_oracle(
        F.col("candidates"), 10, F.col("weights"), F.col("vocabulary"), AS.local_event, F.col("event_incident")
    )
    return _picked(spark, sf_dir, rows, chosen)


_ANCHORED = """
old AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY round(abs(w), 7) + position * 1e-10::DOUBLE DESC, p DESC) AS rn FROM sw WHERE 100 - position > 5),
kept AS (SELECT row_id, x, p FROM old WHERE rn <= 5 UNION ALL SELECT row_id, x, p FROM sw WHERE 100 - position <= 5)
SELECT ctx.row_id, coalesce(picked, '') AS picked FROM ctx LEFT JOIN (
  SELECT row_id, string_agg(x.r, ' ' ORDER BY p) AS picked FROM kept GROUP BY 1) s ON ctx.row_id = s.row_id
"""


@query("t8_anchored_association", "WITH " + ",\n".join(p.strip() for p in (*BASE, SLOT_WEIGHTS)) + ",\n" + _ANCHORED.strip())
def t8(spark, sf_dir):
    rows = applied(spark, sf_dir)
    chosen = S.anchored_association(F.col("candidates"), 10, 5, F.col("weights"), F.col("vocabulary"), AS.local_event)
    return _picked(spark, sf_dir, rows, chosen)


def _chosen_sql(selector: str, ranked: str) -> str:
    return f"SELECT row_id, '{selector}' AS selector, x, p FROM ({ranked})"


def _by(priority: str, where: str = "TRUE") -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY {priority} + position * 1e-10::DOUBLE DESC, p DESC) AS rn FROM sw WHERE {where}"


_ALL_CHOSEN = " UNION ALL ".join([
    _chosen_sql("association_abs", f"SELECT * FROM ({_by('round(abs(w), 7)')}) WHERE rn <= 10"),
    _chosen_sql("class_oracle", f"SELECT * FROM ({_by('round(w, 7) * (CASE WHEN y = 1 THEN 1 ELSE -1 END)')}) WHERE rn <= 10"),
    _chosen_sql("anchored_association", f"SELECT * EXCLUDE rn FROM ({_by('round(abs(w), 7)', '100 - position > 5')}) WHERE rn <= 5 UNION ALL SELECT * FROM sw WHERE 100 - position <= 5"),
])


@query(
    "t10_select_all_scenarios",
    with_(
        *BASE, SLOT_WEIGHTS,
        f"""chosen AS ({_ALL_CHOSEN}),
        listed AS (SELECT row_id, selector, string_agg(x.r, ' ' ORDER BY p) AS picked, count(*) AS n FROM chosen GROUP BY ALL)""",
        """SELECT ap.test_scenario, ap.row_id, s.selector, coalesce(n, 0)::INT AS slots, coalesce(picked, '') AS picked
           FROM applied ap CROSS JOIN (SELECT unnest(['association_abs', 'class_oracle', 'anchored_association']) AS selector) s
           LEFT JOIN listed l ON l.row_id = ap.row_id AND l.selector = s.selector""",
    ),
)
def t10(spark, sf_dir):
    """Slots of every alert for all three selectors, by the model of the fold that holds its scenario out, written per selector and fold."""
    slots = AS.select_slots(applied(spark, sf_dir), keys=TARGET)
    path = f"{shared_folder(spark)}/selected-{uuid.uuid4().hex}"
    listed = slots.withColumn("picked", C.joined(C.ids("slots", "row_id"))).withColumn("n", F.size("slots")).drop("slots")
    AS.write_selected(to_alerts(spark, sf_dir, listed).select("test_scenario", "row_id", "selector", "n", "picked"), path)
    written = spark.read.parquet(path)
    return written.select("test_scenario", "row_id", "selector", F.col("n").alias("slots"), "picked")


# pools that a day leaves open are filled by a month: the cap and the oldest band count
LONG = 30 * 86_400
LONG_BASE = (ALERTS, FOLDS, history(100, LONG), PRESENCE, FIT, APPLIED)


def long_pool(spark, sf_dir):
    return target_pool(spark, sf_dir, LONG)


def long_applied(spark, sf_dir):
    rows, table = long_pool(spark, sf_dir), folds(spark, sf_dir)
    model = stored("long_association", spark, sf_dir, lambda: AS.association_model(rows, alerts(spark, sf_dir), table, decimals=7, weight="n"))
    return AS.with_model(rows, table, model)


@query("w2_month_candidates", with_(ALERTS, history(100, LONG), "SELECT row_id, len(c) AS slots, array_to_string([x.r for x in c], ' ') AS pool FROM ctx"))
def w2_month(spark, sf_dir):
    rows, second = alerts(spark, sf_dir), ["machine", "timestamp"]
    seconds = C.strict_past_seconds(rows, 100, LONG, name="candidates")
    pools = seconds.select(*second, F.size("candidates").alias("slots"), C.joined(C.ids("candidates", "row_id")).alias("pool"))
    return rows.select("row_id", *second).join(pools, second).drop(*second)


@query("a13_month_cells", with_(*LONG_BASE, "SELECT test_scenario, target, band, event, round(weight, 6) AS weight FROM cells"))
def a13_month(spark, sf_dir):
    cells, _ = AS.fit_association(long_pool(spark, sf_dir), alerts(spark, sf_dir), folds(spark, sf_dir), weight="n")
    return rounded(cells)


@query("a14_month_score", with_(*LONG_BASE, _SCORES, "SELECT row_id, round(score, 6) AS score FROM scores"))
def a14_month(spark, sf_dir):
    return _scored(spark, sf_dir, long_applied(spark, sf_dir))


@query("t6_month_selection", with_(*LONG_BASE, SLOT_WEIGHTS, _ranked("round(abs(w), 7)", 10)))
def t6_month(spark, sf_dir):
    return _picked(spark, sf_dir, long_applied(spark, sf_dir), AS.SELECTORS["association_abs"](10, 5))


@query("t8_month_selection", "WITH " + ",\n".join(p.strip() for p in (*LONG_BASE, SLOT_WEIGHTS)) + ",\n" + _ANCHORED.strip())
def t8_month(spark, sf_dir):
    return _picked(spark, sf_dir, long_applied(spark, sf_dir), AS.SELECTORS["anchored_association"](10, 5))


_AUDIT_CAPS = (10, 20, 50, 100)


def _audit_sql() -> str:
    flags = ", ".join(
        f"(y = 1 AND len([x for x in c[-{k}:] if x.i = 1]) > 0)::INT AS a{k}, (y = 1 AND len([x for x in c[-{k}:] if x.g = g]) > 0)::INT AS s{k}"
        for k in _AUDIT_CAPS
    )
    sums = ", ".join(f"sum(a{k})::BIGINT AS coverage_any_{k}, sum(s{k})::BIGINT AS coverage_same_group_{k}" for k in _AUDIT_CAPS)
    rates = ", ".join(
        f"round(coverage_any_{k} / nullif(incident_targets, 0), 6) AS any_incident_predecessor_coverage_{k}, round(coverage_same_group_{k} / nullif(incident_targets, 0), 6) AS same_group_predecessor_coverage_{k}"
        for k in _AUDIT_CAPS
    )
    return f"""
feat AS (SELECT scenario, y, len(k) AS n10, len(list_distinct([x.e for x in k])) AS u10, CASE WHEN len(k) > 0 THEN timestamp - k[1].t END AS span, {flags}
         FROM (SELECT a.scenario, a.timestamp, a.event_incident AS y, coalesce(a.event_incident_group, '-') AS g, c, c[-10:] AS k FROM ctx JOIN alerts a USING (row_id))),
agg AS (SELECT coalesce(scenario, '__all__') AS scenario, count(*) AS targets, sum(y)::BIGINT AS incident_targets, count(*) FILTER (WHERE n10 > 0) AS last10_nonempty,
          sum(n10)::BIGINT AS last10_slots, sum(u10)::BIGINT AS last10_unique_sum, sum(n10 - u10)::BIGINT AS last10_duplicate_sum, coalesce(sum(span), 0)::BIGINT AS last10_span_sum,
          sum(a100)::BIGINT AS any_incident_opportunity_100, count(*) FILTER (WHERE a100 = 1 AND a10 = 0) AS any_incident_displaced_10,
          sum(s100)::BIGINT AS same_group_opportunity_100, count(*) FILTER (WHERE s100 = 1 AND s10 = 0) AS same_group_displaced_10, {sums}
        FROM feat GROUP BY ROLLUP (scenario))
SELECT *, round(incident_targets / targets, 6) AS incident_prevalence, round(last10_slots / targets, 6) AS last10_mean_filled_slots,
  round(last10_duplicate_sum / nullif(last10_slots, 0), 6) AS last10_redundancy_rate, round(last10_unique_sum / targets, 6) AS last10_mean_unique_types,
  round(last10_span_sum / nullif(last10_nonempty, 0), 6) AS last10_mean_span_seconds_nonempty,
  round(any_incident_displaced_10 / nullif(any_incident_opportunity_100, 0), 6) AS any_incident_displacement_at_10,
  round(same_group_displaced_10 / nullif(same_group_opportunity_100, 0), 6) AS same_group_displacement_at_10, {rates}
FROM agg"""


@query("a15_retrieval_audit", "WITH " + ",\n".join(p.strip() for p in (ALERTS, history(100))) + ",\n" + _audit_sql().strip())
def a15(spark, sf_dir):
    return rounded(M.retrieval_audit(pool(spark, sf_dir)))
