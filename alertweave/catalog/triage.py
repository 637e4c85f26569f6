"""Registered queries: patterns, fingerprints, confidence, clusters, scores, triage and the metrics on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertweave.catalog.registry import query, stored, with_
from alertweave.catalog.sqltext import ALERTS, INTERVALS, h32, history
from alertweave.catalog.training import _ATTACK, rounded, windowed
from alertweave.functions import losses as L
from alertweave.functions import policy as P
from alertweave.operators import context as C
from alertweave.operators import folds as FO
from alertweave.operators import infer as B
from alertweave.operators import joins as J
from alertweave.operators import metrics as M
from alertweave.operators import triage as T
from alertweave.plans import triage as TP
from alertweave.session import cut_lineage

SETUP = TP.TriageSetup(width=3, train_ratio=0.5, scheme="recency", eps=1.0, min_samples=5, threshold=0.02)


def labelled(spark, sf_dir):
    return windowed(spark, sf_dir).withColumn("label", F.col("attack_id"))


def patterns(spark, sf_dir):
    make = lambda: TP.with_confidence(TP.split_patterns(labelled(spark, sf_dir), SETUP), SETUP)
    return stored("patterns", spark, sf_dir, make)


def clustered(spark, sf_dir):
    return stored("clustered", spark, sf_dir, lambda: TP.cluster_patterns(patterns(spark, sf_dir), SETUP))


def scores(spark, sf_dir):
    return T.with_cluster_score(clustered(spark, sf_dir), T.score_clusters(clustered(spark, sf_dir)))


def predictions(spark, sf_dir):
    def make():
        stored_vectors = T.scored_vectors(scores(spark, sf_dir))
        return T.triage_nearest(patterns(spark, sf_dir).filter("split = 'test'"), stored_vectors, SETUP.eps, SETUP.threshold)

    return stored("triage", spark, sf_dir, make)


def shown(vector="vector"):
    return F.array_join(F.transform(vector, lambda s: F.concat_ws(":", s["e"].cast("string"), s["w"].cast("string"))), " ").alias("vector")


# ---- SQL -----------------------------------------------------------------------------

SPLIT = """
rows_ AS (SELECT l.*, [x.e for x in c] AS context,
            CASE WHEN row_number() OVER (ORDER BY timestamp, l.row_id) <= floor(count(*) OVER () * 0.5::DOUBLE) THEN 'train' ELSE 'test' END AS split
          FROM labelled l JOIN ctx ON ctx.row_id = l.row_id),
pat AS (SELECT split, event_id, context, count(*) AS n, least(count(*), 5) AS weight, max(attack_id) AS label FROM rows_ GROUP BY 1, 2, 3),
pats AS (SELECT *, row_number() OVER (ORDER BY split, event_id, context) AS pid, list_concat([-1 for i in range(3 - len(context))], context) AS padded FROM pat)
"""

PRINT = """
slot AS (SELECT pid, split, event_id, n, unnest(padded) AS e, generate_subscripts(padded, 1) AS i FROM pats),
fp AS (SELECT pid, event_id, e, round(sum(CASE i WHEN 1 THEN 1.0::DOUBLE / 7 WHEN 2 THEN 2.0::DOUBLE / 7 ELSE 4.0::DOUBLE / 7 END) * 10000)::INT AS w FROM slot GROUP BY 1, 2, 3),
vec AS (SELECT pid, list({'e': e, 'w': w} ORDER BY e) AS v, string_agg(e || ':' || w, ' ' ORDER BY e) AS vector FROM fp WHERE w > 0 GROUP BY 1),
pairn AS (SELECT i, e, event_id, sum(n) AS pn FROM slot WHERE split = 'train' GROUP BY ALL),
slotn AS (SELECT i, e, sum(pn) AS sn FROM pairn GROUP BY ALL),
vs AS (SELECT count(DISTINCT event_id) + 1 AS v FROM pats WHERE split = 'train'),
conf AS (SELECT pid, sum(CASE s.i WHEN 1 THEN 1.0::DOUBLE / 7 WHEN 2 THEN 2.0::DOUBLE / 7 ELSE 4.0::DOUBLE / 7 END * ((coalesce(pn, 0) + 1.0::DOUBLE) / (coalesce(sn, 0) + vs.v))) AS confidence
         FROM slot s CROSS JOIN vs LEFT JOIN slotn ON slotn.i = s.i AND slotn.e = s.e LEFT JOIN pairn p ON p.i = s.i AND p.e = s.e AND p.event_id = s.event_id GROUP BY 1),
full_ AS (SELECT p.*, vec.v, vec.vector, confidence FROM pats p JOIN vec USING (pid) JOIN conf USING (pid))
"""

CLUSTER = """
tr AS (SELECT * FROM full_ WHERE split = 'train' AND confidence >= 0.02),
vv AS (SELECT event_id, v, vector, sum(weight) AS weight FROM tr GROUP BY 1, 2, 3),
vid AS (SELECT *, row_number() OVER (ORDER BY event_id, v) - 1 AS id FROM vv),
vf AS (SELECT id, event_id, unnest(v) AS s FROM vid),
vm AS (SELECT id, sum(s.w) AS m FROM vf GROUP BY 1),
sh AS (SELECT a.event_id, a.id AS a, b.id AS b, sum(least(a.s.w, b.s.w)) AS shared FROM vf a JOIN vf b ON a.event_id = b.event_id AND a.s.e = b.s.e GROUP BY ALL),
near AS (SELECT event_id, a, b, x.m + y.m - 2 * shared AS d FROM sh JOIN vm x ON x.id = a JOIN vm y ON y.id = b WHERE x.m + y.m - 2 * shared <= 10000),
corep AS (SELECT a AS id, sum(weight) AS neighbourhood, sum(weight) >= 5 AS core FROM near JOIN vid ON vid.id = b GROUP BY 1),
ce AS MATERIALIZED (SELECT a, b FROM near WHERE a IN (SELECT id FROM corep WHERE core) AND b IN (SELECT id FROM corep WHERE core)),
reach AS (SELECT a, b FROM ce WHERE a = b UNION SELECT r.a, ce.b FROM reach r JOIN ce ON ce.a = r.b),
comp AS (SELECT a AS id, min(b) AS cluster FROM reach GROUP BY 1),
bord AS (SELECT a AS id, min(cluster) AS cluster FROM near JOIN comp ON comp.id = near.b GROUP BY 1),
clus AS (SELECT vid.id, vid.event_id, vid.v, vid.vector, corep.core, coalesce(comp.cluster, bord.cluster, -1) AS cluster
         FROM vid JOIN corep USING (id) LEFT JOIN comp USING (id) LEFT JOIN bord USING (id)),
cp AS (SELECT tr.*, clus.cluster, clus.core FROM tr JOIN clus ON clus.event_id = tr.event_id AND clus.vector = tr.vector)
"""

SCORE = """
cs AS (SELECT cluster, coalesce(max(CASE WHEN label <> -1 THEN label END), -4) AS score FROM cp WHERE cluster <> -1 GROUP BY 1),
sv AS (SELECT cp.event_id, cp.vector, cp.v, max(score) AS score FROM cp JOIN cs USING (cluster) GROUP BY 1, 2, 3),
sid AS (SELECT *, row_number() OVER (ORDER BY event_id, v) AS id FROM sv)
"""

TRIAGE = """
qv AS (SELECT DISTINCT event_id, v, vector FROM full_ WHERE split = 'test' AND confidence >= 0.02),
qf AS (SELECT event_id, vector, unnest(v) AS s FROM qv),
qm AS (SELECT event_id, vector, sum(s.w) AS m FROM qf GROUP BY 1, 2),
sf AS (SELECT id, event_id, unnest(v) AS s FROM sid),
sm AS (SELECT id, sum(s.w) AS m FROM sf GROUP BY 1),
qs AS (SELECT q.event_id, q.vector, f.id, sum(least(q.s.w, f.s.w)) AS shared FROM qf q JOIN sf f ON q.event_id = f.event_id AND q.s.e = f.s.e GROUP BY ALL),
hit AS (SELECT qs.event_id, qs.vector, qs.id, qm.m + sm.m - 2 * shared AS d FROM qs JOIN qm ON qm.event_id = qs.event_id AND qm.vector = qs.vector JOIN sm ON sm.id = qs.id
        WHERE qm.m + sm.m - 2 * shared <= 10000 QUALIFY row_number() OVER (PARTITION BY qs.event_id, qs.vector ORDER BY qm.m + sm.m - 2 * shared, qs.id) = 1),
pred AS (SELECT f.pid, f.event_id, f.context, f.n, f.label, f.vector, f.confidence, hit.d / 10000 AS distance,
           CASE WHEN confidence < 0.02 THEN -1 WHEN f.event_id NOT IN (SELECT event_id FROM sid) THEN -2 ELSE coalesce(sid.score, -3) END AS prediction
         FROM full_ f LEFT JOIN hit ON hit.event_id = f.event_id AND hit.vector = f.vector AND f.confidence >= 0.02 LEFT JOIN sid ON sid.id = hit.id WHERE f.split = 'test')
"""

HEAD = (ALERTS, INTERVALS, _ATTACK, history(3), SPLIT)
FULL = (*HEAD, PRINT)
CLUS = (*FULL, CLUSTER)
DONE = (*CLUS, SCORE, TRIAGE)


def rec(*parts: str) -> str:
    return with_(*parts).replace("WITH ", "WITH RECURSIVE ", 1)


_CTX = "array_to_string(context, ' ') AS context"


@query("g1_compact_patterns", with_(*HEAD, f"SELECT split, event_id, {_CTX}, n, weight, label FROM pats"))
def g1(spark, sf_dir):
    return patterns(spark, sf_dir).select("split", "event_id", C.joined("context").alias("context"), "n", "weight", "label")


@query(
    "g1_compact_patterns_revealed",
    with_(
        *HEAD,
        f"SELECT event_id, {_CTX}, count(*) AS n, least(count(*), 5) AS weight, coalesce(max(CASE WHEN detector = 'AMiner' THEN event_incident END), -9) AS label FROM rows_ GROUP BY 1, 2",
    ),
)
def g1_revealed(spark, sf_dir):
    rows = C.strict_past_context(labelled(spark, sf_dir), 3).withColumn("context", C.ids("context"))
    rows = rows.withColumn("shown", F.col("detector") == "AMiner")
    got = T.compact_patterns(rows, 5, "event_incident", revealed="shown")
    return got.withColumn("context", C.joined("context"))


@query("g2_expand_multiplicity", with_(*HEAD, f"SELECT split, event_id, {_CTX}, unnest(range(1, weight + 1)) AS copy FROM pats"))
def g2(spark, sf_dir):
    return T.expand_multiplicity(patterns(spark, sf_dir)).select("split", "event_id", C.joined("context").alias("context"), "copy")


@query("g3_distinct_patterns", with_(*HEAD, f"SELECT DISTINCT split, event_id, {_CTX} FROM rows_"))
def g3(spark, sf_dir):
    return patterns(spark, sf_dir).select("split", "event_id", C.joined("context").alias("context"))


@query("j11_expand_unique", with_(*FULL, "SELECT r.row_id, f.vector, round(f.confidence, 6) AS confidence FROM rows_ r JOIN full_ f ON f.split = r.split AND f.event_id = r.event_id AND f.context = r.context"))
def j11(spark, sf_dir):
    """Results on distinct patterns back to every alert."""
    order = [F.floor(F.col("timestamp") / 86_400), F.col("timestamp"), F.floor(F.col("row_id") / 65_536), F.col("row_id")]
    rows = C.strict_past_context(labelled(spark, sf_dir), 3).withColumn("context", C.ids("context"))
    rows = FO.ratio_split(rows, 0.5, order).select("row_id", "split", "event_id", "context")
    found = patterns(spark, sf_dir).select("split", "event_id", "context", "vector", F.round("confidence", 6).alias("confidence"))
    return J.expand_unique(rows, found, ["split", "event_id", "context"]).select("row_id", shown(), "confidence")


@query("g4_fingerprint", with_(*FULL, f"SELECT split, event_id, {_CTX}, vector FROM full_"))
def g4(spark, sf_dir):
    return patterns(spark, sf_dir).select("split", "event_id", C.joined("context").alias("context"), shown())


@query("g5_next_event_confidence", with_(*FULL, f"SELECT split, event_id, {_CTX}, round(confidence, 6) AS confidence FROM full_"))
def g5(spark, sf_dir):
    return rounded(patterns(spark, sf_dir).select("split", "event_id", C.joined("context").alias("context"), "confidence"))


@query("g6_confidence_gate", with_(*FULL, "SELECT split, count(*) AS patterns, count(*) FILTER (WHERE confidence < 0.02) AS gated, sum(n)::BIGINT AS rows FROM full_ GROUP BY 1"))
def g6(spark, sf_dir):
    gate = T.confidence_gate(F.col("confidence"), SETUP.threshold, F.lit(0))
    return patterns(spark, sf_dir).groupBy("split").agg(
        F.count("*").alias("patterns"), F.sum((gate == -1).cast("long")).alias("gated"), F.sum("n").alias("rows")
    )


def train_vectors(spark, sf_dir):
    train = patterns(spark, sf_dir).filter((F.col("split") == "train") & (F.col("confidence") >= SETUP.threshold))
    return stored("train_vectors", spark, sf_dir, lambda: T.numbered_vectors(train))


@query("g7_neighbour_pairs", rec(*CLUS, "SELECT event_id, a AS left_id, b AS right_id, d AS distance FROM near"))
def g7_pairs(spark, sf_dir):
    vectors = train_vectors(spark, sf_dir)
    return T.neighbour_pairs(vectors, vectors, SETUP.eps)


@query("g7_core_points", rec(*CLUS, "SELECT id, neighbourhood::BIGINT AS neighbourhood, core FROM corep"))
def g7_core(spark, sf_dir):
    return T.neighbourhoods(train_vectors(spark, sf_dir), SETUP.eps, SETUP.min_samples)


@query("g7_density_cluster", rec(*CLUS, "SELECT id, event_id, core, cluster FROM clus"))
def g7(spark, sf_dir):
    return T.density_cluster(train_vectors(spark, sf_dir), SETUP.eps, SETUP.min_samples)


@query("g8_score_clusters_max", rec(*CLUS, SCORE, f"SELECT event_id, {_CTX}, cp.cluster, coalesce(cs.score, -1) AS score FROM cp LEFT JOIN cs USING (cluster)"))
def g8(spark, sf_dir):
    return scores(spark, sf_dir).select("event_id", C.joined("context").alias("context"), "cluster", "score")


@query(
    "g8_score_clusters_other",
    rec(
        *CLUS,
        """SELECT cluster, coalesce(min(CASE WHEN label <> -1 THEN label END), -4) AS lowest, coalesce(round_even(avg(CASE WHEN label <> -1 THEN label END), 0)::INT, -4) AS mean,
                  coalesce(max(CASE WHEN label <> -1 THEN label END), -1) AS reject_unlabelled FROM cp WHERE cluster <> -1 GROUP BY 1""",
    ),
)
def g8_other(spark, sf_dir):
    rows = clustered(spark, sf_dir)
    low = T.score_clusters(rows, "min").withColumnRenamed("score", "lowest")
    mean = T.score_clusters(rows, "avg").withColumnRenamed("score", "mean")
    reject = T.score_clusters(rows, "max", unlabelled=-1).withColumnRenamed("score", "reject_unlabelled")
    return low.join(mean, "cluster").join(reject, "cluster")


_POST = """
po AS (SELECT cluster, coalesce(6.0::DOUBLE * p / nullif(6.0::DOUBLE * p + q, 0), 0) AS prior FROM (
         SELECT cluster, sum(CASE WHEN label <> -1 THEN n ELSE 0 END) AS p, sum(CASE WHEN label <> -1 THEN 0 ELSE n END) AS q FROM cp WHERE cluster <> -1 GROUP BY 1))
"""


@query(
    "g9_posterior_clusters",
    rec(*CLUS, _POST, "SELECT cluster, round(prior, 6) AS prior, CASE WHEN prior >= 0.6 THEN 1 WHEN prior <= 0.2 THEN 0 ELSE -5 END AS score FROM po UNION ALL SELECT DISTINCT -1, 0.5::DOUBLE, -5 FROM cp WHERE cluster = -1"),
)
def g9(spark, sf_dir):
    return rounded(T.posterior_clusters(clustered(spark, sf_dir), 6.0, 1.0, 0.2, 0.6, weight="n"))


@query("g10_scored_vectors", rec(*CLUS, SCORE, "SELECT event_id, vector, score FROM sv"))
def g10(spark, sf_dir):
    return T.scored_vectors(scores(spark, sf_dir)).select("event_id", shown(), "score")


@query("g11_triage_nearest", rec(*DONE, f"SELECT event_id, {_CTX}, n, round(distance, 6) AS distance, prediction FROM pred"))
def g11(spark, sf_dir):
    return predictions(spark, sf_dir).select("event_id", C.joined("context").alias("context"), "n", F.round("distance", 6).alias("distance"), "prediction")


@query("j6_nearest_scored_vector", rec(*DONE, "SELECT q.event_id, q.vector, round(hit.d / 10000, 6) AS distance, sid.score FROM qv q JOIN hit ON hit.event_id = q.event_id AND hit.vector = q.vector JOIN sid ON sid.id = hit.id"))
def j6(spark, sf_dir):
    test = patterns(spark, sf_dir).filter((F.col("split") == "test") & (F.col("confidence") >= SETUP.threshold))
    distinct = cut_lineage(test.groupBy("event_id", "vector").agg(F.min("pattern_id").alias("id")))
    near = T.nearest_scored(distinct, T.scored_vectors(scores(spark, sf_dir)), SETUP.eps)
    return distinct.join(near, "id").select("event_id", shown(), F.round("distance", 6).alias("distance"), "score")


_CALIBRATED = """
pv AS (SELECT cp.event_id, cp.vector, max(prior) AS prior FROM cp JOIN po USING (cluster) GROUP BY 1, 2),
qc AS (SELECT event_id, vector, max(confidence) AS c FROM full_ WHERE split = 'test' AND confidence >= 0.02 GROUP BY 1, 2),
cal AS (SELECT f.event_id, f.context, f.n, f.confidence, CASE WHEN hit.d IS NOT NULL THEN greatest(0, least(1, prior * qc.c * exp(-hit.d / 10000.0::DOUBLE))) END AS posterior
        FROM full_ f LEFT JOIN qc ON qc.event_id = f.event_id AND qc.vector = f.vector AND f.confidence >= 0.02
        LEFT JOIN hit ON hit.event_id = f.event_id AND hit.vector = f.vector AND f.confidence >= 0.02
        LEFT JOIN sid ON sid.id = hit.id LEFT JOIN pv ON pv.event_id = sid.event_id AND pv.vector = sid.vector WHERE f.split = 'test')
"""


@query(
    "g12_triage_calibrated",
    rec(
        *DONE, _POST, _CALIBRATED,
        f"""SELECT event_id, {_CTX}, n, round(posterior, 6) AS posterior, CASE WHEN confidence < 0.02 THEN -1 WHEN event_id NOT IN (SELECT event_id FROM sid) THEN -2
             WHEN posterior IS NULL THEN -3 WHEN posterior >= 0.010 THEN 1 WHEN posterior <= 0.005 THEN 0 ELSE -5 END AS prediction FROM cal""",
    ),
)
def g12(spark, sf_dir):
    rows = clustered(spark, sf_dir)
    priors = T.posterior_clusters(rows, 6.0, 1.0, 0.2, 0.6, weight="n").filter("cluster <> -1").select("cluster", "prior")
    vectors = T.scored_vectors(rows.join(priors, "cluster"), "prior")
    got = T.triage_calibrated(
        patterns(spark, sf_dir).filter("split = 'test'"), vectors, SETUP.eps, SETUP.threshold, 0.005, 0.010, scale=1.0
    )
    return got.select("event_id", C.joined("context").alias("context"), "n", F.round("posterior", 6).alias("posterior"), "prediction")


_REFERENCE = "CASE WHEN event_id % 11 = 0 THEN -3 WHEN event_id % 5 = 1 THEN 1 ELSE 0 END"


@query(
    "g14_matched_workload_rerank",
    with_(
        ALERTS,
        f"r AS (SELECT row_id, scenario, {_REFERENCE} AS reference, round(value / 50, 1) AS score FROM alerts)",
        "m AS (SELECT scenario, count(*) FILTER (WHERE reference > 0) AS slots FROM r GROUP BY 1)",
        f"""k AS (SELECT r.*, slots, CASE WHEN reference >= 0 THEN row_number() OVER (PARTITION BY r.scenario, reference >= 0
                ORDER BY score DESC, {h32('13', 'row_id')}, row_id) END AS rn FROM r JOIN m USING (scenario))""",
        "SELECT row_id, scenario, CASE WHEN reference < 0 THEN reference WHEN rn <= slots THEN 1 ELSE 0 END AS prediction FROM k",
    ),
)
def g14(spark, sf_dir):
    rows = labelled(spark, sf_dir).select(
        "row_id", "scenario",
        F.when(F.col("event_id") % 11 == 0, -3).when(F.col("event_id") % 5 == 1, 1).otherwise(0).alias("reference"),
        F.round(F.col("value") / 50, 1).alias("score"),
    )
    return T.matched_workload_rerank(rows, ["scenario"], 13).select("row_id", "scenario", "prediction")


def _risk_rows(spark, sf_dir):
    """Training patterns with features, binary label, row weight and the smoothed rule log-odds."""
    train = patterns(spark, sf_dir).filter("split = 'train'").withColumn("label", F.when(F.col("label") >= 0, 1.0).otherwise(0.0))
    rule = train.groupBy("event_id").agg(
        F.ln((F.sum(F.col("label") * F.col("n")) + 1.0) / (F.sum((1 - F.col("label")) * F.col("n")) + 1.0)).alias("rule_logit")
    )
    rows = train.join(rule, "event_id").withColumn("weight", F.col("n").cast("double"))
    return rows, rule


#: Bound of the pairs that the within-rule ranking is fitted on.
_FITTED_PAIRS = 2_000


@query("g15_risk_model_context")
def g15(spark, sf_dir):
    rows, _ = _risk_rows(spark, sf_dir)
    size = T.feature_size(patterns(spark, sf_dir))
    model = T.fit_risk_model(T.risk_features(rows, size), "context_bce")
    test = T.risk_features(patterns(spark, sf_dir).filter("split = 'test'").select("pattern_id", "event_id", "n", "vector"), size)
    return model.transform(test).select("pattern_id", "event_id", "n", F.col("prediction").cast("int").alias("incident"))


@query("g15_risk_model_rule_offset")
def g15_offset(spark, sf_dir):
    rows, rule = _risk_rows(spark, sf_dir)
    size = T.feature_size(patterns(spark, sf_dir))
    model = T.fit_risk_model(T.risk_features(rows, size), "rule_context_bce")
    test = patterns(spark, sf_dir).filter("split = 'test'").select("pattern_id", "event_id", "n", "vector")
    test = test.join(rule, "event_id", "left").na.fill(0.0, ["rule_logit"])
    return model.transform(T.risk_features(test, size)).select("pattern_id", "event_id", "n", F.round("prediction", 6).alias("risk"))


@query("g16_score_risk_pairwise")
def g16(spark, sf_dir):
    """Within-rule pairwise fit on sampled pairs, then a linear score plus the rule log-odds."""
    rows, rule = _risk_rows(spark, sf_dir)
    features = rows.select(
        F.col("pattern_id").alias("row_id"), "event_id", F.col("label").cast("int").alias("label"), F.lit("all").alias("group"), "vector"
    )
    pairs = FO.same_rule_pair_sample(features.drop("vector"), _FITTED_PAIRS, 17)
    arrays = features.select("row_id", T.dense_features(F.col("vector"), T.feature_size(patterns(spark, sf_dir))).alias("f"))
    joined = pairs.join(arrays.toDF("positive", "a"), "positive").join(arrays.toDF("negative", "b"), "negative")
    model = T.fit_pairwise_risk(joined)
    test = patterns(spark, sf_dir).filter("split = 'test'").join(rule, "event_id", "left").na.fill(0.0, ["rule_logit"])
    scored = T.score_risk(test, list(model.coefficients.toArray()), 0.0, "rule_logit")
    return scored.select("pattern_id", "event_id", "n", F.round("score", 6).alias("score"))


# ---- metrics on clusters and predictions -----------------------------------------------------

_M1 = """
sz AS (SELECT cluster, sum(n) AS k FROM cp GROUP BY 1),
m AS (SELECT sum(k)::BIGINT AS total_sequences, coalesce(sum(k) FILTER (WHERE cluster >= 0), 0)::BIGINT AS clustered_sequences, coalesce(sum(k) FILTER (WHERE cluster < 0), 0)::BIGINT AS unclustered_sequences,
        count(*) FILTER (WHERE cluster >= 0) AS n_clusters, coalesce(sum(least(k, 10)) FILTER (WHERE cluster >= 0), 0)::BIGINT AS representative_alerts_capped FROM sz)
SELECT *, n_clusters * 10 AS representative_alerts, round(clustered_sequences / total_sequences, 6) AS coverage,
  round(1 - coalesce(n_clusters * 10 / nullif(clustered_sequences, 0), 0), 6) AS reduction_on_clustered,
  round(1 - (n_clusters * 10 + unclustered_sequences) / total_sequences, 6) AS overall_reduction,
  round(1 - (representative_alerts_capped + unclustered_sequences) / total_sequences, 6) AS overall_reduction_capped,
  round(coalesce(total_sequences / nullif(n_clusters, 0), 0), 6) AS events_per_cluster_all, round(coalesce(clustered_sequences / nullif(n_clusters, 0), 0), 6) AS events_per_cluster_clustered
FROM m"""


@query("m1_workload_metrics", rec(*CLUS, "x AS (SELECT 1)", "SELECT 1").rsplit(",\nx AS", 1)[0] + ",\n" + _M1.strip())
def m1(spark, sf_dir):
    return rounded(M.workload_metrics(clustered(spark, sf_dir), weight="n"))


@query(
    "m2_cluster_quality",
    rec(
        *CLUS,
        "cl AS (SELECT cluster, label, sum(n) AS k FROM cp WHERE cluster >= 0 GROUP BY 1, 2)",
        "pc AS (SELECT cluster, max(k) AS mj, sum(k) AS k, count(*) AS c FROM cl GROUP BY 1)",
        "SELECT round(coalesce(sum(mj) / nullif(sum(k), 0), 0), 6) AS cluster_purity, count(*) FILTER (WHERE c > 1) AS mixed_cluster_count FROM pc",
    ),
)
def m2(spark, sf_dir):
    return rounded(M.cluster_quality(clustered(spark, sf_dir), weight="n"))


_DECIDED = """
dc AS (SELECT prediction AS score, label, sum(n) AS k, CASE WHEN prediction IN (-1, -2, -3) THEN NULL WHEN prediction = -4 THEN -1 WHEN prediction >= 0 THEN prediction END AS d FROM pred GROUP BY 1, 2),
pm AS (SELECT sum(k) AS total, coalesce(sum(k) FILTER (WHERE d IS NOT NULL), 0) AS auto, coalesce(sum(k) FILTER (WHERE d IS NULL), 0) AS rej, coalesce(sum(k) FILTER (WHERE d = label), 0) AS ok,
  coalesce(sum(k) FILTER (WHERE label <> -1 AND d <> -1), 0) AS tp, coalesce(sum(k) FILTER (WHERE label = -1 AND d <> -1), 0) AS fp, coalesce(sum(k) FILTER (WHERE label = -1 AND d = -1), 0) AS tn,
  coalesce(sum(k) FILTER (WHERE label <> -1 AND d = -1), 0) AS fn, coalesce(sum(k) FILTER (WHERE label <> -1 AND d IS NULL), 0) AS ri, coalesce(sum(k) FILTER (WHERE label = -1 AND d IS NULL), 0) AS rb,
  coalesce(sum(k) FILTER (WHERE label <> -1), 0) AS inc, coalesce(sum(k) FILTER (WHERE label = -1), 0) AS ben FROM dc),
pq AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM pm)
"""

_PRED_COLUMNS = {
    "m3_decision_rates": {
        "total_sequences": "total::BIGINT", "auto_decided_count": "auto::BIGINT", "reject_count": "rej::BIGINT",
        "auto_decided_rate": "round(auto / total, 6)", "reject_rate": "round(rej / total, 6)",
    },
    "m4_accuracies": {"strict_accuracy_rejects_wrong": "round(ok / total, 6)", "auto_decided_accuracy": "round(ok / nullif(auto, 0), 6)"},
    "m5_binary_detection": {
        "tp": "tp::BIGINT", "fp": "fp::BIGINT", "tn": "tn::BIGINT", "fn": "fn::BIGINT", "precision": "round(p, 6)", "recall": "round(r, 6)",
        "f1": "round(coalesce(2.0::DOUBLE * p * r / nullif(p + r, 0), 0), 6)", "accuracy": "round(coalesce((tp + tn) / nullif(auto, 0), 0), 6)",
    },
    "m6_reject_by_truth": {
        "rejected_incidents": "ri::BIGINT", "rejected_benign": "rb::BIGINT", "incident_reject_rate": "round(coalesce(ri / nullif(inc, 0), 0), 6)",
        "benign_reject_rate": "round(coalesce(rb / nullif(ben, 0), 0), 6)",
    },
}


def _register_prediction_metrics():
    for name, columns in _PRED_COLUMNS.items():
        body = "SELECT " + ", ".join(f"{e} AS {c}" for c, e in columns.items()) + " FROM pq"

        def run(spark, sf_dir, columns=tuple(columns)):
            got = M.prediction_metrics(predictions(spark, sf_dir), weight="n")
            return rounded(got.select(*columns))

        query(name, rec(*DONE, _DECIDED, body))(run)


_register_prediction_metrics()


@query(
    "d1_normalize_policy",
    rec(*DONE, "SELECT prediction, CASE WHEN prediction IN (-1, -2, -3) THEN NULL WHEN prediction = -4 THEN -1 ELSE prediction END AS attack_decision, CASE WHEN prediction IN (-5, -1, -2, -3) THEN NULL WHEN prediction IN (0, -4) THEN 0 WHEN prediction = 1 THEN 1 END AS binary_decision, sum(n)::BIGINT AS rows FROM pred GROUP BY ALL"),
)
def d1(spark, sf_dir):
    codes = F.col("prediction").cast("int")
    return predictions(spark, sf_dir).groupBy(
        codes.alias("prediction"), P.decided(P.ATTACK_ID, codes).alias("attack_decision"), P.decided(P.BINARY, codes).alias("binary_decision")
    ).agg(F.sum("n").alias("rows"))


_CLASSES = """
cls AS (SELECT label AS class FROM dc UNION SELECT d FROM dc WHERE d IS NOT NULL),
cc AS (SELECT class, coalesce(sum(k) FILTER (WHERE d = class AND label = class), 0) AS tp, coalesce(sum(k) FILTER (WHERE d = class AND label <> class), 0) AS fp,
              coalesce(sum(k) FILTER (WHERE d IS NOT NULL AND d <> class AND label = class), 0) AS fn FROM cls CROSS JOIN dc GROUP BY 1),
cf AS (SELECT class, coalesce(tp / nullif(tp + fp, 0), 0) AS precision_, coalesce(tp / nullif(tp + fn, 0), 0) AS recall_, tp + fn AS support FROM cc),
cg AS (SELECT *, coalesce(2.0::DOUBLE * precision_ * recall_ / nullif(precision_ + recall_, 0), 0) AS f1 FROM cf)
"""


@query(
    "m7_class_scores",
    rec(*DONE, _DECIDED, _CLASSES, "SELECT class, round(precision_, 6) AS precision, round(recall_, 6) AS recall, round(f1, 6) AS f1, support::BIGINT AS support FROM cg"),
)
def m7_classes(spark, sf_dir):
    return rounded(M.class_scores(predictions(spark, sf_dir), weight="n"))


@query(
    "m7_multiclass_f1",
    rec(*DONE, _DECIDED, _CLASSES, "SELECT round(avg(f1), 6) AS macro_f1, round(coalesce(sum(f1 * support) / nullif(sum(support), 0), 0), 6) AS weighted_f1, count(*) AS classes FROM cg"),
)
def m7(spark, sf_dir):
    return rounded(M.multiclass_f1(M.class_scores(predictions(spark, sf_dir), weight="n")))


def evaluation(spark, sf_dir):
    """One wide row: workload, quality, decisions and multi-class scores of the triage run."""
    one = F.lit(1).alias("_one")
    predicted = predictions(spark, sf_dir)
    parts = [
        M.workload_metrics(clustered(spark, sf_dir), weight="n").drop("total_sequences"),
        M.cluster_quality(clustered(spark, sf_dir), weight="n"),
        M.prediction_metrics(predicted, weight="n").withColumnRenamed("f1", "binary_f1"),
        M.multiclass_f1(M.class_scores(predicted, weight="n")),
    ]
    wide = parts[0].select("*", one)
    for part in parts[1:]:
        wide = wide.join(part.select("*", one), "_one")
    return wide.drop("_one")


@query(
    "m13_run_evaluation",
    rec(
        *DONE, _DECIDED, _CLASSES,
        "q AS (SELECT cluster, label, sum(n) AS k FROM cp WHERE cluster >= 0 GROUP BY 1, 2), qc2 AS (SELECT cluster, max(k) AS mj, sum(k) AS k FROM q GROUP BY 1)",
        """SELECT (SELECT count(*) FROM qc2) AS n_clusters, (SELECT round(sum(mj) / sum(k), 6) FROM qc2) AS cluster_purity, round(auto / total, 6) AS auto_decided_rate,
             round(rej / total, 6) AS reject_rate, round(coalesce(2.0::DOUBLE * p * r / nullif(p + r, 0), 0), 6) AS binary_f1, (SELECT round(avg(f1), 6) FROM cg) AS macro_f1 FROM pq""",
    ),
)
def m13(spark, sf_dir):
    return rounded(evaluation(spark, sf_dir).select("n_clusters", "cluster_purity", "auto_decided_rate", "reject_rate", "binary_f1", "macro_f1"))


@query(
    "m14_undefined_to_null",
    with_(
        ALERTS,
        "SELECT scenario, event_key, round(sum(event_incident) FILTER (WHERE value > 150) / nullif(count(*) FILTER (WHERE value > 150), 0), 6) AS rate FROM alerts GROUP BY 1, 2",
    ),
)
def m14(spark, sf_dir):
    from alertweave.functions.ratios import finite_or_null

    big = F.col("value") > 150
    counts = labelled(spark, sf_dir).groupBy("scenario", "event_key").agg(
        F.sum(F.when(big, F.col("event_incident")).otherwise(0)).alias("a"), F.sum(big.cast("int")).alias("b")
    )
    ratio = F.when(F.col("b") == 0, F.lit(float("nan"))).otherwise(F.try_divide("a", "b"))
    return counts.select("scenario", "event_key", F.round(finite_or_null(ratio), 6).alias("rate"))


@query(
    "b10_compare_to_baseline",
    rec(
        *DONE, _DECIDED,
        """bl AS (SELECT auto / total AS ar, rej / total AS rr, coalesce(2.0::DOUBLE * p * r / nullif(p + r, 0), 0) AS f FROM pq),
           al AS (SELECT sum(k) FILTER (WHERE d IS NOT NULL OR score = -3) / sum(k) AS ar, sum(k) FILTER (WHERE NOT (d IS NOT NULL OR score = -3)) / sum(k) AS rr,
             coalesce(sum(k) FILTER (WHERE label <> -1 AND coalesce(d, CASE WHEN score = -3 THEN -1 END) <> -1), 0) AS tp,
             coalesce(sum(k) FILTER (WHERE label = -1 AND coalesce(d, CASE WHEN score = -3 THEN -1 END) <> -1), 0) AS fp,
             coalesce(sum(k) FILTER (WHERE label <> -1 AND coalesce(d, CASE WHEN score = -3 THEN -1 END) = -1), 0) AS fn FROM dc),
           af AS (SELECT ar, coalesce(rr, 0) AS rr, coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0) AS f FROM al)""",
        """SELECT 'distance_as_benign' AS method, round(af.ar - bl.ar, 6) AS delta_auto_decided_rate, round(af.rr - bl.rr, 6) AS delta_reject_rate, round(af.f - bl.f, 6) AS delta_binary_f1,
             CASE WHEN af.f - bl.f >= 0.02 AND af.ar - bl.ar >= -0.05 AND af.rr - bl.rr <= 0.05 THEN 'primary_candidate' ELSE 'ablation_only' END AS recommended_role FROM bl CROSS JOIN af""",
    ),
)
def b10(spark, sf_dir):
    """The triage run against a variant that dismisses alerts too far from any cluster."""
    predicted = predictions(spark, sf_dir)
    variant = predicted.withColumn("prediction", F.when(F.col("prediction") == -3, -4).otherwise(F.col("prediction")))
    def row(name, rows):
        got = M.prediction_metrics(rows, weight="n")
        none = F.lit(None).cast("double")
        return got.select(
            F.lit(name).alias("method"), "auto_decided_rate", "reject_rate", F.col("f1").alias("binary_f1"),
            *[none.alias(m) for m in ("overall_reduction", "coverage", "cluster_purity", "macro_f1", "weighted_f1")],
        )
    got = B.compare_to_baseline(row("nearest", predicted).unionByName(row("distance_as_benign", variant)), "nearest")
    return rounded(got.select("method", "recommended_role", "delta_auto_decided_rate", "delta_reject_rate", "delta_binary_f1"))


@query(
    "loss_terms",
    with_(
        ALERTS,
        "r AS (SELECT scenario, event_incident AS y, (value - 60) / 40 AS z FROM alerts)",
        "l AS (SELECT *, greatest(z, 0) + ln(1 + exp(-abs(z))) - y * z AS bce, 1 / (1 + exp(-z)) AS p FROM r)",
        """SELECT scenario, round(avg(bce), 6) AS bce, round(avg(CASE WHEN y > 0 THEN 3 ELSE 1 END * bce), 6) AS weighted,
                  round(avg((0.25::DOUBLE * y + 0.75::DOUBLE * (1 - y)) * pow(1 - (p * y + (1 - p) * (1 - y)), 2) * bce), 6) AS focal,
                  round(avg(greatest(-z, 0) + ln(1 + exp(-abs(z)))), 6) AS pairwise FROM l GROUP BY 1""",
    ),
)
def loss_terms(spark, sf_dir):
    z, y = (F.col("value") - 60) / 40, F.col("event_incident")
    return rounded(labelled(spark, sf_dir).groupBy("scenario").agg(
        F.avg(L.binary_cross_entropy(z, y)).alias("bce"),
        F.avg(L.weighted_cross_entropy(z, y, 3.0, 1.0)).alias("weighted"),
        F.avg(L.focal_loss(z, y, 2.0, 0.25)).alias("focal"),
        F.avg(L.pairwise_logistic(z)).alias("pairwise"),
    ))
