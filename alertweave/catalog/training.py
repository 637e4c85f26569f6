"""Registered queries: encodings, interval labels, profiles, folds, revealed labels and rule statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertweave.catalog.registry import query, with_
from alertweave.catalog.sqltext import (
    ALERTS, BUDGET, FOLDS, INTERVALS, KEYED, LINES, RATIO, REVEAL, RULES_TRAIN, SEEDS, SPLITS, WINDOWED, h32, history,
)
from alertweave.functions import encode as E
from alertweave.functions.hashing import seeded_key
from alertweave.functions.ratios import effective_class_weight
from alertweave.operators import context as C
from alertweave.operators import folds as FO
from alertweave.operators import joins as J
from alertweave.operators import ordering as O
from alertweave.operators import stats as ST
from alertweave.operators import vocabulary as VO
from alertweave.session import cut_lineage
from alertweave.sources import alerts as A
from alertweave.sources.readers import parse_event_lines


def events(spark, sf_dir):
    return A.read_table(spark, sf_dir, "events")


def alerts(spark, sf_dir):
    return A.load_alerts(spark, sf_dir)


def intervals(spark, sf_dir):
    return A.attack_intervals(events(spark, sf_dir))


def windowed(spark, sf_dir):
    return A.window_labelled(alerts(spark, sf_dir), intervals(spark, sf_dir))


def folds(spark, sf_dir):
    return FO.scenario_folds(A.keyed_events(events(spark, sf_dir)))


def lines(spark, sf_dir):
    return A.document_lines(A.read_table(spark, sf_dir, "documents"), A.read_table(spark, sf_dir, "labels"))


def revealed(spark, sf_dir, *extra):
    rows = alerts(spark, sf_dir).select("scenario", "row_id", "event_id", "event_key", "event_incident", "event_incident_group", *extra)
    return FO.reveal_labels(rows, folds(spark, sf_dir), BUDGET, RATIO, SEEDS)


def rounded(df, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# ---- encodings -------------------------------------------------------------


@query("p1_epoch_seconds", "SELECT event_id AS row_id, round(epoch(ts), 6) AS seconds FROM events")
def p1(spark, sf_dir):
    iso = F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return events(spark, sf_dir).select(F.col("event_id").alias("row_id"), F.round(E.epoch_seconds(iso), 6).alias("seconds"))


@query("p2_machine_key", with_(KEYED, "SELECT row_id, machine, scenario || '_' || event_type AS agent_key FROM keyed"))
def p2(spark, sf_dir):
    keyed = A.keyed_events(events(spark, sf_dir))
    return keyed.select("row_id", "machine", E.machine_key(F.col("scenario"), F.col("event_type"), "_").alias("agent_key"))


@query(
    "p3_scenario_of",
    "SELECT event_id AS row_id, event_type || CASE WHEN event_id % 3 = 0 THEN '' ELSE '_x' END AS scenario FROM events",
)
def p3(spark, sf_dir):
    suffix = F.when(F.col("event_id") % 3 == 0, "").when(F.col("event_id") % 3 == 1, "_x_7").otherwise("_x_")
    return events(spark, sf_dir).select(
        F.col("event_id").alias("row_id"), E.scenario_of(F.concat("event_type", suffix)).alias("scenario")
    )


@query("p4_detector_of", with_(ALERTS, "SELECT detector, event_key, count(*) AS alerts FROM alerts GROUP BY 1, 2"))
def p4(spark, sf_dir):
    return alerts(spark, sf_dir).groupBy("detector", "event_key").agg(F.count("*").alias("alerts"))


_LABELS = "(CASE WHEN value > 100 THEN event_type ELSE '-' END)"


@query(
    "p5_incident_flags",
    f"""SELECT event_id AS row_id, CASE WHEN {_LABELS} <> '-' THEN 1 ELSE 0 END AS event_incident,
        CASE WHEN value > 200 THEN 1 ELSE 0 END AS window_incident FROM events""",
)
def p5(spark, sf_dir):
    rows = events(spark, sf_dir)
    event_label = F.when(F.col("value") > 100, F.col("event_type")).otherwise("-")
    time_label = F.when(F.col("value") > 200, F.col("event_type")).otherwise("false_positive")
    return rows.select(
        F.col("event_id").alias("row_id"),
        E.event_incident(event_label).alias("event_incident"),
        E.window_incident(time_label).alias("window_incident"),
    )


_STEPS = ("dns_scan", "service_scan", "wpscan", "dirb", "webshell_cmd", "crack_passwords", "online_cracking",
          "attacker_change_user", "escalated_sudo_command", "dnsteal", "novel_step")
_STAGE_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in E.ATTACK_STAGES.items())


@query(
    "p6_incident_group",
    with_(
        KEYED,
        f"""SELECT row_id, CASE WHEN event_incident = 1 THEN scenario || '::' || CASE step {_STAGE_CASES} ELSE 'unmapped' END END AS stage_group
            FROM (SELECT *, [{', '.join(repr(s) for s in _STEPS)}][(row_id % {len(_STEPS)} + 1)::INT] AS step FROM keyed)""",
    ),
)
def p6(spark, sf_dir):
    keyed = A.keyed_events(events(spark, sf_dir))
    step = F.element_at(F.array(*[F.lit(s) for s in _STEPS]), (F.col("row_id") % len(_STEPS) + 1).cast("int"))
    return keyed.select("row_id", E.incident_group(F.col("scenario"), F.col("event_incident"), step).alias("stage_group"))


@query(
    "p7_attack_dictionary",
    with_(KEYED, INTERVALS, "SELECT attack, row_number() OVER (ORDER BY attack) - 1 AS attack_id FROM (SELECT DISTINCT attack FROM intervals)"),
)
def p7(spark, sf_dir):
    return J.attack_dictionary(intervals(spark, sf_dir))


@query("p8_sorted_vocabulary", with_(ALERTS, "SELECT event_key, event_id FROM vocab"))
def p8(spark, sf_dir):
    return A.sorted_vocabulary(A.keyed_events(events(spark, sf_dir)))


def _arrival_sql(key: str) -> str:
    return f"""firsts AS (SELECT {key} AS token, min((timestamp, row_id)) AS f FROM alerts GROUP BY 1)
SELECT token, row_number() OVER (ORDER BY f) AS token_id FROM firsts"""


@query("p9_arrival_vocabulary_event", "WITH " + ALERTS.strip() + ", " + _arrival_sql("event_id::VARCHAR"))
def p9_event(spark, sf_dir):
    return VO.arrival_vocabulary(alerts(spark, sf_dir), "event")


@query("p9_arrival_vocabulary_machine_event", "WITH " + ALERTS.strip() + ", " + _arrival_sql("machine || '|' || event_id"))
def p9_machine(spark, sf_dir):
    return VO.arrival_vocabulary(alerts(spark, sf_dir), "machine_event")


@query(
    "p10_encode_closed",
    with_(
        ALERTS,
        """firsts AS (SELECT machine || '|' || event_id AS token, min((timestamp, row_id)) AS f FROM alerts WHERE scenario <> 's3' GROUP BY 1),
           ids AS (SELECT token, row_number() OVER (ORDER BY f) AS token_id FROM firsts)""",
        """SELECT a.scenario, count(token_id) AS encoded, count(*) - count(token_id) AS unseen, sum(token_id) AS checksum
           FROM alerts a LEFT JOIN ids ON ids.token = a.machine || '|' || a.event_id GROUP BY 1""",
    ),
)
def p10(spark, sf_dir):
    rows = alerts(spark, sf_dir)
    closed = VO.arrival_vocabulary(rows.filter("scenario <> 's3'"), "machine_event")
    encoded = VO.encode_closed(rows, closed, "machine_event")
    return encoded.groupBy("scenario").agg(
        F.count("token_id").alias("encoded"),
        F.sum(F.col("unseen").cast("int")).alias("unseen"),
        F.sum("token_id").alias("checksum"),
    )


_FOLD_VOCAB = """
fv AS (SELECT test_scenario, event_id, row_number() OVER (PARTITION BY test_scenario ORDER BY event_id) - 1 AS local_id,
              count(*) OVER (PARTITION BY test_scenario) AS k
       FROM (SELECT DISTINCT f.test_scenario, a.event_id FROM alerts a JOIN folds f ON a.scenario = f.scenario
             WHERE f.role = 'train' AND (a.event_id + substr(f.test_scenario, 2)::INT) % 7 <> 0))
"""


@query(
    "p11_fold_vocabulary",
    with_(
        ALERTS, FOLDS, history(10), _FOLD_VOCAB,
        "sizes AS (SELECT DISTINCT test_scenario, k FROM fv)",
        """maps AS (SELECT test_scenario, map(list(event_id), list(local_id)) AS m FROM fv GROUP BY 1)""",
        """SELECT a.row_id, coalesce(m[a.event_id], k) AS target,
                  array_to_string([coalesce(m[x.e], k) for x in c], ' ') AS context
           FROM alerts a JOIN ctx USING (row_id) JOIN folds f ON a.scenario = f.scenario AND f.role = 'test'
           JOIN sizes USING (test_scenario) JOIN maps USING (test_scenario)""",
    ),
)
def p11(spark, sf_dir):
    """Encodes each alert in the fold that tests it; some events are held out per fold so that unknowns occur."""
    rows = alerts(spark, sf_dir)
    table = folds(spark, sf_dir)
    counts = rows.groupBy("scenario", "event_id").agg(F.count("*").alias("n"))
    training = FO.fold_rows(counts, table, ["train"])
    held = (F.col("event_id") + F.substring("test_scenario", 2, 9).cast("int")) % 7 == 0
    seen = training.filter(~held).select("test_scenario", "event_id").distinct()
    by_fold = Window.partitionBy("test_scenario")
    vocabulary = seen.select(
        "test_scenario", "event_id",
        (F.row_number().over(by_fold.orderBy("event_id")) - 1).alias("local_id"),
        F.count("*").over(by_fold).alias("size"),
    )
    maps = FO.vocabulary_maps(vocabulary)
    rows = FO.fold_rows(C.strict_past_context(rows), table, ["test"]).join(maps, "test_scenario")
    local = FO.encode_array(C.ids("context"), F.col("dictionary"), F.col("size"))
    target = F.coalesce(F.try_element_at("dictionary", F.col("event_id")), F.col("size"))
    return rows.select("row_id", target.alias("target"), C.joined(local).alias("context"))


@query(
    "p12_dense_row_id",
    with_(
        KEYED,
        "SELECT row_id AS event_id, scenario, row_number() OVER (PARTITION BY scenario ORDER BY row_id) - 1 AS source_row, row_number() OVER (ORDER BY scenario, row_id) - 1 AS row_id FROM keyed",
    ),
)
def p12(spark, sf_dir):
    keyed = A.keyed_events(events(spark, sf_dir)).select(F.col("row_id").alias("event_id"), "scenario")
    placed = O.running_position(keyed, ["scenario"], ["event_id"], "source_row")
    return VO.dense_row_id(placed)


@query(
    "p13_original_event_id",
    with_(
        ALERTS, history(10),
        "firsts AS (SELECT event_id AS original, min((timestamp, row_id)) AS f FROM alerts WHERE detector <> 'Wazuh' GROUP BY 1)",
        "ids AS (SELECT original, row_number() OVER (ORDER BY f) AS token_id FROM firsts)",
        """SELECT row_id, CASE WHEN token = 0 THEN -1337 ELSE coalesce(original, token) END AS original_event
           FROM (SELECT row_id, coalesce(c[-1].e, 0) AS token FROM ctx) LEFT JOIN ids ON token_id = token""",
    ),
)
def p13(spark, sf_dir):
    rows = alerts(spark, sf_dir)
    mapping = VO.arrival_vocabulary(rows.filter("detector <> 'Wazuh'"), "event").select(
        "token_id", F.col("token").cast("int").alias("original")
    )
    newest = C.strict_past_context(rows).select(
        "row_id", F.coalesce(F.try_element_at("context", F.lit(-1))["event_id"], F.lit(0)).alias("token_id")
    )
    return newest.join(mapping, "token_id", "left").select(
        "row_id", E.original_event_id(F.col("token_id"), F.col("original"), 0).alias("original_event")
    )


@query(
    "p14_score_meaning",
    """SELECT score, CASE WHEN score >= 0 THEN 'attack id' WHEN score = -1 THEN 'not confident' WHEN score = -2 THEN 'event not seen in training'
         WHEN score = -3 THEN 'too far from the nearest cluster' WHEN score = -4 THEN 'benign cluster' WHEN score = -5 THEN 'calibrated reject'
         ELSE 'unknown code' END AS meaning, count(*) AS rows
       FROM (SELECT (event_id % 9)::INT - 7 AS score FROM events) GROUP BY 1, 2""",
)
def p14(spark, sf_dir):
    scores = events(spark, sf_dir).select((F.col("event_id") % 9 - 7).cast("int").alias("score"))
    return scores.groupBy("score", E.score_meaning(F.col("score")).alias("meaning")).agg(F.count("*").alias("rows"))


_ATTACK = """
winner AS (SELECT a.row_id, min((i.s, i.position)) AS w FROM alerts a JOIN intervals i
           ON i.scenario = a.scenario AND a.timestamp BETWEEN i.s AND i.e GROUP BY 1),
attacks AS (SELECT attack, row_number() OVER (ORDER BY attack) - 1 AS attack_id FROM (SELECT DISTINCT attack FROM intervals)),
labelled AS (SELECT a.*, coalesce(k.attack_id, -1) AS attack_id FROM alerts a LEFT JOIN winner w ON a.row_id = w.row_id
             LEFT JOIN intervals i ON i.position = w.w[2] LEFT JOIN attacks k ON k.attack = i.attack)
"""


@query("p15_binary_truth", with_(ALERTS, INTERVALS, _ATTACK, "SELECT row_id, CASE WHEN attack_id = -1 THEN 0 ELSE 1 END AS truth FROM labelled"))
def p15(spark, sf_dir):
    return windowed(spark, sf_dir).select("row_id", E.binary_truth(F.col("attack_id")).alias("truth"))


@query(
    "p16_group_codes",
    with_(
        ALERTS,
        "codes AS (SELECT g, row_number() OVER (ORDER BY g) - 1 AS code FROM (SELECT DISTINCT event_incident_group AS g FROM alerts WHERE event_incident_group IS NOT NULL))",
        "SELECT row_id, coalesce(code, -1) AS code FROM alerts LEFT JOIN codes ON g = event_incident_group",
    ),
)
def p16(spark, sf_dir):
    return VO.group_codes(alerts(spark, sf_dir), "event_incident_group").select("row_id", "code")


@query(
    "p18_feasible_filters",
    with_(ALERTS, "SELECT row_id, event_key FROM alerts WHERE scenario IN ('s1', 's3', 's5') AND event_incident_group IS NOT NULL AND detector = 'AMiner'"),
)
def p18(spark, sf_dir):
    rows = alerts(spark, sf_dir).filter(
        F.col("scenario").isin("s1", "s3", "s5") & F.col("event_incident_group").isNotNull() & (F.col("detector") == "AMiner")
    )
    return rows.select("row_id", "event_key")


# ---- interval labels and joins --------------------------------------------


@query("j1_label_by_interval", with_(ALERTS, INTERVALS, _ATTACK, "SELECT row_id, attack_id FROM labelled"))
def j1(spark, sf_dir):
    return windowed(spark, sf_dir).select("row_id", "attack_id")


@query(
    "j2_gather_candidates",
    with_(
        ALERTS, history(100),
        """SELECT s.row_id, s.p - 1 AS slot, b.event_id, b.event_incident, b.event_incident_group
           FROM (SELECT row_id, unnest([x.r for x in c]) AS r, generate_subscripts(c, 1) AS p FROM ctx WHERE len(c) > 0) s
           JOIN alerts b ON b.row_id = s.r""",
    ),
)
def j2(spark, sf_dir):
    """Slots are looked up once per second of a machine; its alerts then share them."""
    rows = alerts(spark, sf_dir)
    second = ["machine", "timestamp"]
    pools = C.strict_past_seconds(rows, 100, name="candidates").select(*second, C.ids("candidates", "row_id").alias("candidates"))
    looked = J.gather(pools, rows, keys=second)
    slots = looked.groupBy(*second).agg(F.collect_list(F.struct("slot", "event_id", "event_incident", "event_incident_group")).alias("_slots"))
    return rows.select("row_id", *second).join(slots, second).select("row_id", F.inline("_slots"))


_REV_COUNTS = """
rc AS (SELECT test_scenario, seed, event_key, sum(event_incident) AS rp, count(*) AS n,
              count(DISTINCT CASE WHEN event_incident = 1 THEN event_incident_group END) AS gp
       FROM revealed GROUP BY 1, 2, 3),
runs AS (SELECT DISTINCT test_scenario, seed FROM revealed),
ident AS (
  SELECT rt.test_scenario, runs.seed, rt.event_key, positive AS full_positive, negative AS full_negative, total AS full_total,
         incident_rate AS full_incident_rate,
         CASE WHEN incident_rate > 0 AND incident_rate < 1 THEN -(incident_rate * log2(incident_rate) + (1 - incident_rate) * log2(1 - incident_rate)) ELSE 0 END AS full_binary_entropy,
         positive >= 20 AND negative >= 20 AND incident_rate > 0.05 AND incident_rate < 0.95 AS mixed_full_truth,
         coalesce(rp, 0) AS revealed_positive, coalesce(n, 0) AS revealed_total, coalesce(gp, 0) AS revealed_positive_groups,
         coalesce(n, 0) - coalesce(rp, 0) AS revealed_negative,
         coalesce(rp, 0) >= 1 AND coalesce(n, 0) - coalesce(rp, 0) >= 1 AS pairable_revealed
  FROM rt JOIN runs USING (test_scenario) LEFT JOIN rc USING (test_scenario, seed, event_key))
"""


def identifiability(spark, sf_dir):
    counts = ST.training_rule_counts(alerts(spark, sf_dir), folds(spark, sf_dir), "event_incident")
    return ST.rule_identifiability(counts, revealed(spark, sf_dir), minimum_full=20)


@query(
    "j4_rule_left_outer",
    with_(ALERTS, FOLDS, REVEAL, RULES_TRAIN, _REV_COUNTS, "SELECT test_scenario, seed, event_key, full_total, revealed_total, revealed_positive_groups FROM ident"),
)
def j4(spark, sf_dir):
    return identifiability(spark, sf_dir).select("test_scenario", "seed", "event_key", "full_total", "revealed_total", "revealed_positive_groups")


@query(
    "j5_pairable_positives_semi",
    with_(
        ALERTS, FOLDS, REVEAL,
        """SELECT test_scenario, seed, row_id FROM revealed r WHERE event_incident = 1 AND EXISTS (
             SELECT 1 FROM revealed n WHERE n.event_incident = 0 AND n.test_scenario = r.test_scenario AND n.seed = r.seed AND n.event_id = r.event_id)""",
    ),
)
def j5(spark, sf_dir):
    return J.pairable_positives(revealed(spark, sf_dir), "event_incident", keys=["test_scenario", "seed"]).select("test_scenario", "seed", "row_id")


def _halves(rows):
    """Rows before and from the middle of the table's time span."""
    middle = rows.agg(F.floor((F.min("timestamp") + F.max("timestamp")) / 2).alias("at")).first()["at"]
    return rows.filter(F.col("timestamp") < F.lit(middle)), rows.filter(F.col("timestamp") >= F.lit(middle))


@query(
    "j5_unseen_machine_events_anti",
    with_(
        ALERTS,
        """SELECT row_id FROM alerts a WHERE timestamp >= (SELECT (min(timestamp) + max(timestamp)) // 2 FROM alerts) AND NOT EXISTS (
             SELECT 1 FROM alerts b WHERE b.timestamp < (SELECT (min(timestamp) + max(timestamp)) // 2 FROM alerts) AND b.machine = a.machine AND b.event_id = a.event_id)""",
    ),
)
def j5_anti(spark, sf_dir):
    early, late = _halves(alerts(spark, sf_dir))
    known = early.select("machine", "event_id").distinct()
    return late.join(known, ["machine", "event_id"], "left_anti").select("row_id")


@query(
    "j9_same_rule_pairs",
    with_(
        ALERTS, FOLDS, REVEAL,
        """SELECT p.test_scenario, p.seed, p.event_id, count(*) AS pairs, count(DISTINCT p.row_id) AS positives, count(DISTINCT n.row_id) AS negatives
           FROM revealed p JOIN revealed n ON p.test_scenario = n.test_scenario AND p.seed = n.seed AND p.event_id = n.event_id
                AND p.event_incident = 1 AND n.event_incident = 0 GROUP BY 1, 2, 3""",
    ),
)
def j9(spark, sf_dir):
    return J.rules_with_both_labels(revealed(spark, sf_dir), "event_incident", keys=["test_scenario", "seed"])


@query(
    "j10_align_by_row",
    with_(ALERTS, history(10), "SELECT a.row_id, a.event_id AS target, len(c) AS slots FROM alerts a JOIN ctx USING (row_id)"),
)
def j10(spark, sf_dir):
    rows = alerts(spark, sf_dir)
    context = C.strict_past_context(rows).select("row_id", "context")
    return rows.select("row_id", F.col("event_id").alias("target")).join(context, "row_id").select("row_id", "target", F.size("context").alias("slots"))


# ---- profiles and audits ---------------------------------------------------


@query(
    "a1_ingest_counts",
    with_(
        ALERTS, INTERVALS, _ATTACK,
        """SELECT coalesce(scenario, '__all__') AS scenario, count(*) AS events, count(*) FILTER (WHERE attack_id >= 0) AS attack_events
           FROM labelled GROUP BY ROLLUP (scenario)""",
    ),
)
def a1(spark, sf_dir):
    return ST.ingest_counts(windowed(spark, sf_dir))


@query(
    "a2_scenario_profile",
    with_(
        ALERTS, INTERVALS, WINDOWED,
        """SELECT scenario, count(*) AS alerts, round(avg(event_incident), 6) AS event_prevalence, round(avg(window_incident), 6) AS window_prevalence,
                  count(DISTINCT event_key) AS event_types, count(DISTINCT machine) AS machines FROM windowed GROUP BY 1""",
    ),
)
def a2(spark, sf_dir):
    return rounded(ST.scenario_profile(windowed(spark, sf_dir)))


@query(
    "a3_rule_profile",
    with_(ALERTS, "SELECT detector, event_key, count(*) AS alerts, round(avg(event_incident), 6) AS incident_rate FROM alerts GROUP BY 1, 2"),
)
def a3(spark, sf_dir):
    return rounded(ST.rule_profile(alerts(spark, sf_dir)))


@query(
    "t9_top_rules",
    with_(ALERTS, "SELECT detector, event_key, count(*) AS alerts, round(avg(event_incident), 6) AS incident_rate FROM alerts GROUP BY 1, 2 ORDER BY alerts DESC, event_key LIMIT 20"),
)
def t9(spark, sf_dir):
    return rounded(ST.top_rules(ST.rule_profile(alerts(spark, sf_dir))))


@query(
    "a4_label_crosstab",
    with_(
        ALERTS, INTERVALS, WINDOWED,
        """SELECT window_incident, count(*) FILTER (WHERE event_incident = 0) AS event_0, count(*) FILTER (WHERE event_incident = 1) AS event_1
           FROM windowed GROUP BY 1""",
    ),
)
def a4(spark, sf_dir):
    return ST.label_crosstab(windowed(spark, sf_dir))


@query(
    "a5_value_counts",
    with_(
        ALERTS,
        """SELECT 'detector' AS field, detector AS value, count(*) AS rows FROM alerts GROUP BY 2
           UNION ALL SELECT 'event_type', event_type, count(*) FROM alerts GROUP BY 2
           UNION ALL SELECT 'event_incident', event_incident::VARCHAR, count(*) FROM alerts GROUP BY 2""",
    ),
)
def a5(spark, sf_dir):
    return ST.value_counts(alerts(spark, sf_dir), "detector", "event_type", "event_incident")


@query(
    "a6_duplicate_rows",
    with_(ALERTS, "SELECT scenario, timestamp, machine, event_key, event_incident, count(*) AS rows FROM alerts GROUP BY ALL HAVING count(*) > 1"),
)
def a6(spark, sf_dir):
    return ST.duplicate_keys(alerts(spark, sf_dir), ["scenario", "timestamp", "machine", "event_key", "event_incident"])


@query(
    "a7_empty_contexts",
    with_(ALERTS, history(10), "SELECT scenario, count(*) FILTER (WHERE len(c) = 0) AS empty, count(*) AS alerts FROM alerts JOIN ctx USING (row_id) GROUP BY 1"),
)
def a7(spark, sf_dir):
    return ST.empty_contexts(C.strict_past_context(alerts(spark, sf_dir)))


_WIDE = """
wide AS (SELECT scenario, row_id, event_key || '/' || machine[-1:] || '/' || (timestamp // 900 % 16)::VARCHAR AS event_key FROM alerts)
"""


@query(
    "a8_unseen_by_fold",
    with_(
        ALERTS, FOLDS, _WIDE,
        """un AS (SELECT f.test_scenario, w.event_key, count(*) AS n FROM wide w JOIN folds f ON w.scenario = f.scenario AND f.role = 'test'
                  WHERE NOT EXISTS (SELECT 1 FROM wide t JOIN folds g ON t.scenario = g.scenario AND g.role = 'train'
                                    WHERE g.test_scenario = f.test_scenario AND t.event_key = w.event_key) GROUP BY 1, 2)""",
        """SELECT v.test_scenario, v.scenario AS validation, count(un.event_key) AS unseen_event_types, coalesce(sum(n), 0) AS unseen_test_alerts
           FROM folds v LEFT JOIN un ON un.test_scenario = v.test_scenario WHERE v.role = 'validation' GROUP BY 1, 2""",
    ),
)
def a8(spark, sf_dir):
    """Over a finer event key, so that some types are specific to a scenario."""
    rows = alerts(spark, sf_dir)
    slot = (F.floor(F.col("timestamp") / 900) % 16).cast("string")
    fine = rows.withColumn("event_key", F.concat_ws("/", "event_key", F.expr("right(machine, 1)"), slot))
    return ST.unseen_by_fold(fine, folds(spark, sf_dir))


@query(
    "a9_ambiguous_rules",
    with_(
        ALERTS, FOLDS, RULES_TRAIN,
        """SELECT test_scenario, event_key, positive, total, negative, round(incident_rate, 6) AS incident_rate FROM rt
           WHERE positive >= 20 AND negative >= 20 AND incident_rate > 0.1 AND incident_rate < 0.9""",
    ),
)
def a9(spark, sf_dir):
    counts = ST.training_rule_counts(alerts(spark, sf_dir), folds(spark, sf_dir), "event_incident")
    return rounded(ST.ambiguous_rules(counts, 0.1, 0.9, 20))


@query(
    "a10_rule_identifiability",
    with_(
        ALERTS, FOLDS, REVEAL, RULES_TRAIN, _REV_COUNTS,
        """SELECT test_scenario, seed, event_key, full_positive, full_negative, full_total, round(full_incident_rate, 6) AS full_incident_rate,
                  round(full_binary_entropy, 6) AS full_binary_entropy, mixed_full_truth, revealed_positive, revealed_total, revealed_positive_groups,
                  revealed_negative, pairable_revealed, mixed_full_truth AND pairable_revealed AS identifiable_revealed FROM ident""",
    ),
)
def a10(spark, sf_dir):
    return rounded(identifiability(spark, sf_dir))


@query(
    "a11_identifiability_gate",
    with_(
        ALERTS, FOLDS, REVEAL, RULES_TRAIN, _REV_COUNTS,
        "id2 AS (SELECT *, mixed_full_truth AND pairable_revealed AS ok FROM ident)",
        """SELECT test_scenario, seed, count(*) AS rules_total, count(*) FILTER (WHERE mixed_full_truth) AS rules_mixed_full_truth,
                  count(*) FILTER (WHERE ok) AS rules_pairable_revealed,
                  coalesce(sum(full_total) FILTER (WHERE mixed_full_truth), 0) AS full_truth_rows_in_mixed_rules,
                  coalesce(sum(full_positive) FILTER (WHERE mixed_full_truth), 0) AS full_truth_positive_in_mixed_rules,
                  coalesce(sum(revealed_positive) FILTER (WHERE ok), 0) AS revealed_positive_pairable,
                  coalesce(sum(revealed_negative) FILTER (WHERE ok), 0) AS revealed_negative_pairable,
                  coalesce(sum(revealed_positive_groups) FILTER (WHERE ok), 0) AS revealed_positive_groups_pairable,
                  round(coalesce(sum(full_total) FILTER (WHERE mixed_full_truth), 0) / sum(full_total), 6) AS fraction_train_rows_in_mixed_rules,
                  round(coalesce(sum(full_positive) FILTER (WHERE mixed_full_truth), 0) / sum(full_positive), 6) AS fraction_train_positives_in_mixed_rules,
                  round(coalesce(sum(revealed_positive) FILTER (WHERE ok), 0) / sum(revealed_positive), 6) AS fraction_revealed_positives_pairable,
                  count(*) FILTER (WHERE ok) >= 10 AND coalesce(sum(revealed_positive_groups) FILTER (WHERE ok), 0) >= 20 AS pairability_pass
           FROM id2 GROUP BY 1, 2""",
    ),
)
def a11(spark, sf_dir):
    return rounded(ST.identifiability_gate(identifiability(spark, sf_dir), 10, 20))


@query(
    "a12_rule_prior",
    with_(
        ALERTS, FOLDS, REVEAL,
        """SELECT test_scenario, seed, event_id, sum(event_incident) AS positive, count(*) AS revealed,
                  round((sum(event_incident) + 1.0::DOUBLE) / (count(*) + 2.0::DOUBLE), 6) AS posterior,
                  round(ln((sum(event_incident) + 1.0::DOUBLE) / (count(*) - sum(event_incident) + 1.0::DOUBLE)), 6) AS logit
           FROM revealed GROUP BY 1, 2, 3""",
    ),
)
def a12(spark, sf_dir):
    return rounded(ST.rule_prior(revealed(spark, sf_dir), ["test_scenario", "seed", "event_id"]))


@query(
    "a16_sequence_scan",
    with_(
        LINES, SPLITS,
        "pat AS (SELECT line, count(*) AS copies, min(label) <> max(label) AS bad, bool_or(source = 'train') AS tr FROM split GROUP BY 1)",
        """SELECT source, split, count(*) AS sequences, count(*) FILTER (WHERE copies > 1) AS duplicate_sequences,
                  count(*) FILTER (WHERE bad) AS contradictory_sequences, count(*) FILTER (WHERE tr) AS train_pattern_sequences
           FROM split JOIN pat USING (line) GROUP BY 1, 2""",
    ),
)
def a16(spark, sf_dir):
    return ST.sequence_scan(FO.sequence_split(lines(spark, sf_dir)))


@query(
    "a16_token_counts",
    with_(LINES, "SELECT token, count(*) AS rows FROM (SELECT unnest(string_split(line, ' '))::INT AS token FROM lines) GROUP BY 1"),
)
def a16_tokens(spark, sf_dir):
    return ST.token_counts(parse_event_lines(lines(spark, sf_dir), "seq_id", "source", "label"))


@query(
    "a17_distribution",
    with_(ALERTS, "SELECT scenario, (event_id % 9) - 4 AS value, count(*) AS rows FROM alerts GROUP BY 1, 2"),
)
def a17(spark, sf_dir):
    scores = alerts(spark, sf_dir).withColumn("score", F.col("event_id") % 9 - 4)
    return ST.distribution(scores, "score", ["scenario"])


@query(
    "a17_negative_distribution",
    with_(
        ALERTS,
        """SELECT scenario, string_agg(value || '=' || n, ' ' ORDER BY value) AS distribution FROM (
             SELECT scenario, (event_id % 9) - 4 AS value, count(*) AS n FROM alerts WHERE (event_id % 9) - 4 < 0 GROUP BY 1, 2) GROUP BY 1""",
    ),
)
def a17_negative(spark, sf_dir):
    scores = alerts(spark, sf_dir).withColumn("score", F.col("event_id") % 9 - 4).filter("score < 0")
    folded = ST.distribution_map(ST.distribution(scores, "score", ["scenario"]), ["scenario"])
    entries = F.transform(F.map_entries("distribution"), lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"].cast("string")))
    return folded.select("scenario", F.array_join(entries, " ").alias("distribution"))


@query(
    "a18_legacy_coverage",
    with_(
        ALERTS,
        """SELECT count(*) AS rows, count(DISTINCT event_key) AS event_types, (SELECT count(*) FROM alerts) - count(*) AS missing
           FROM alerts WHERE detector = 'AMiner'""",
    ),
)
def a18(spark, sf_dir):
    rows = alerts(spark, sf_dir)
    return ST.coverage_against(rows, rows.filter("detector = 'AMiner'"))


@query(
    "a19_effective_class_weight",
    with_(
        ALERTS,
        "n AS (SELECT event_key, sum(event_incident) AS p, count(*) - sum(event_incident) AS q FROM alerts GROUP BY 1)",
        """SELECT event_key, round(CASE WHEN p > 0 AND q > 0 THEN
                 (0.0001::DOUBLE / (1 - pow(0.9999::DOUBLE, p))) / (0.0001::DOUBLE / (1 - pow(0.9999::DOUBLE, p)) + 0.0001::DOUBLE / (1 - pow(0.9999::DOUBLE, q))) END, 6) AS alpha FROM n""",
    ),
)
def a19(spark, sf_dir):
    counts = alerts(spark, sf_dir).groupBy("event_key").agg(
        F.sum("event_incident").alias("p"), (F.count("*") - F.sum("event_incident")).alias("q")
    )
    return rounded(counts.select("event_key", effective_class_weight(F.col("p"), F.col("q"), 0.9999).alias("alpha")))


@query(
    "a20_pairability",
    with_(
        ALERTS, FOLDS, REVEAL,
        """ok AS (SELECT * FROM revealed r WHERE event_incident = 1 AND EXISTS (SELECT 1 FROM revealed n WHERE n.event_incident = 0
                  AND n.test_scenario = r.test_scenario AND n.seed = r.seed AND n.event_id = r.event_id))""",
        """SELECT test_scenario, seed, count(*) AS eligible_positive_rows, count(DISTINCT event_incident_group) AS eligible_positive_groups,
                  count(DISTINCT event_id) AS eligible_rules FROM ok GROUP BY 1, 2""",
    ),
)
def a20(spark, sf_dir):
    return ST.pairability(revealed(spark, sf_dir))


# ---- folds, splits and samples ---------------------------------------------


@query("f1_scenario_folds", with_(KEYED, FOLDS, "SELECT test_scenario, scenario, role FROM folds"))
def f1(spark, sf_dir):
    return folds(spark, sf_dir)


@query(
    "f2_reveal_labels",
    with_(ALERTS, FOLDS, REVEAL, "SELECT test_scenario, seed, row_id, event_incident, event_incident_group FROM revealed"),
)
def f2(spark, sf_dir):
    return revealed(spark, sf_dir).select("test_scenario", "seed", "row_id", "event_incident", "event_incident_group")


@query(
    "f3_uniform_sample",
    with_(
        ALERTS,
        f"ordered AS (SELECT row_id, row_number() OVER (ORDER BY {h32('7', 'row_id')}, row_id) - 1 AS rn, count(*) OVER () AS n FROM alerts)",
        "SELECT row_id, rn + n * range AS draw FROM ordered CROSS JOIN range(1500) WHERE rn + n * range < 1500",
    ),
)
def f3(spark, sf_dir):
    return FO.uniform_sample(alerts(spark, sf_dir).select("row_id"), 1500, 7)


_RANKED = f"""
ranked AS (SELECT row_id, event_id, event_incident AS y, event_incident_group AS g, {h32('5', 'row_id')} AS k FROM alerts),
gs AS (SELECT g, count(*) AS n, row_number() OVER (ORDER BY g) - 1 AS gi, count(*) OVER () AS groups FROM ranked WHERE y = 1 GROUP BY g),
pr AS (SELECT row_id, g, row_number() OVER (PARTITION BY g ORDER BY k, row_id) - 1 AS pos FROM ranked WHERE y = 1),
nr AS (SELECT row_id, row_number() OVER (ORDER BY k, row_id) - 1 AS pos FROM ranked WHERE y = 0)
"""


@query(
    "f4_group_balanced_sample",
    with_(
        ALERTS, _RANKED,
        f"draws AS (SELECT range AS draw, {h32('5', chr(39) + 'group' + chr(39), 'range')} AS u, {h32('5', chr(39) + 'member' + chr(39), 'range')} AS m FROM range(400))",
        """SELECT d.draw, pr.row_id, 1 AS label FROM draws d JOIN gs ON gs.gi = d.u % gs.groups JOIN pr ON pr.g = gs.g AND pr.pos = d.m % gs.n
           UNION ALL SELECT pos + 400, row_id, 0 FROM nr WHERE pos < 400""",
    ),
)
def f4(spark, sf_dir):
    rows = alerts(spark, sf_dir).select("row_id", F.col("event_incident").alias("label"), F.col("event_incident_group").alias("group"))
    return FO.group_balanced_sample(rows, 800, 5)


_PAIR_RANKED = f"""
ranked AS (SELECT row_id, event_id, event_incident AS y, event_incident_group AS g, {h32('5', 'row_id')} AS k FROM alerts),
nr AS (SELECT row_id, event_id, row_number() OVER (PARTITION BY event_id ORDER BY k, row_id) - 1 AS pos,
              count(*) OVER (PARTITION BY event_id) AS n FROM ranked WHERE y = 0),
pr AS (SELECT row_id, event_id, g, row_number() OVER (PARTITION BY g ORDER BY k, row_id) - 1 AS pos FROM ranked
       WHERE y = 1 AND event_id IN (SELECT event_id FROM nr)),
gs AS (SELECT g, count(*) AS n, row_number() OVER (ORDER BY g) - 1 AS gi, count(*) OVER () AS groups FROM pr GROUP BY g)
"""


@query(
    "f5_same_rule_pair_sample",
    with_(
        ALERTS, _PAIR_RANKED,
        f"draws AS (SELECT range AS draw, {h32('5', chr(39) + 'group' + chr(39), 'range')} AS u, {h32('5', chr(39) + 'member' + chr(39), 'range')} AS m, {h32('5', chr(39) + 'partner' + chr(39), 'range')} AS v FROM range(500))",
        """SELECT d.draw, pr.event_id, pr.row_id AS positive, nr.row_id AS negative
           FROM draws d JOIN gs ON gs.gi = d.u % gs.groups JOIN pr ON pr.g = gs.g AND pr.pos = d.m % gs.n
           JOIN nr ON nr.event_id = pr.event_id AND nr.pos = d.v % nr.n""",
    ),
)
def f5(spark, sf_dir):
    rows = alerts(spark, sf_dir).select("row_id", "event_id", F.col("event_incident").alias("label"), F.col("event_incident_group").alias("group"))
    return FO.same_rule_pair_sample(rows, 500, 5)


@query("f6_duplicate_safe_split", with_(LINES, SPLITS, "SELECT seq_id, source, split FROM split"))
def f6(spark, sf_dir):
    return FO.sequence_split(lines(spark, sf_dir)).select("seq_id", "source", "split")


@query("f7_blind_labels", with_(LINES, SPLITS, "SELECT seq_id, split, CASE WHEN split = 3 THEN -9 ELSE label END AS label FROM split"))
def f7(spark, sf_dir):
    return FO.blind_labels(FO.sequence_split(lines(spark, sf_dir))).select("seq_id", "split", "label")


@query(
    "w11_ratio_split",
    with_(
        ALERTS,
        """SELECT row_id, CASE WHEN row_number() OVER (ORDER BY timestamp, row_id) <= least(greatest(1, floor(count(*) OVER () * 0.2::DOUBLE)), count(*) OVER () - 1)
             THEN 'train' ELSE 'test' END AS split FROM alerts""",
    ),
)
def w11(spark, sf_dir):
    order = [F.floor(F.col("timestamp") / 86_400), F.col("timestamp"), F.floor(F.col("row_id") / 65_536), F.col("row_id")]
    return FO.ratio_split(alerts(spark, sf_dir), 0.2, order).select("row_id", "split")


# ---- set operations ---------------------------------------------------------


@query(
    "u1_union_scenarios",
    with_(ALERTS, "SELECT scenario, row_id, event_key FROM alerts"),
)
def u1(spark, sf_dir):
    """The frames of all scenarios one after another, whichever the table holds."""
    rows = alerts(spark, sf_dir).select("scenario", "row_id", "event_key")
    # one row per scenario
    names = [r["scenario"] for r in rows.select("scenario").distinct().orderBy("scenario").collect()]
    frames = [rows.filter(F.col("scenario").eqNullSafe(name)) for name in names]
    return reduce(DataFrame.unionByName, frames, rows.limit(0))


@query(
    "u2_difference",
    with_(ALERTS, "SELECT machine, event_key FROM alerts WHERE timestamp >= (SELECT (min(timestamp) + max(timestamp)) // 2 FROM alerts) EXCEPT SELECT machine, event_key FROM alerts WHERE timestamp < (SELECT (min(timestamp) + max(timestamp)) // 2 FROM alerts)"),
)
def u2(spark, sf_dir):
    early, late = _halves(alerts(spark, sf_dir))
    return late.select("machine", "event_key").subtract(early.select("machine", "event_key"))


@query(
    "u3_intersection",
    with_(LINES, SPLITS, "SELECT sha256(line) AS pattern FROM (SELECT line FROM split WHERE split = 0 INTERSECT SELECT line FROM split WHERE split = 3)"),
)
def u3(spark, sf_dir):
    # fixed once: a filter on the split would work out the digest again for each of its words
    parts = cut_lineage(FO.sequence_split(lines(spark, sf_dir)).select("split", "pattern"))
    return parts.filter("split = 0").select("pattern").intersect(parts.filter("split = 3").select("pattern"))
