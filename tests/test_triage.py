"""Clusters, scores, triage, metrics, selection and inference: literal cases and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from alertweave.functions import policy as PO
from alertweave.operators import checks as V
from alertweave.operators import folds as FO
from alertweave.operators import infer as B
from alertweave.operators import joins as J
from alertweave.operators import metrics as M
from alertweave.operators import points as P
from alertweave.operators import stats as ST
from alertweave.operators import triage as T
from alertweave.plans import triage as TP

VECTOR = "array<struct<e:int,w:int>>"


def vec(*pairs):
    return [(e, int(w * T.UNIT)) for e, w in pairs]


def one_row(df):
    return df.first().asDict()


def patterns(spark, rows):
    """rows: event, vector, confidence, label, weight"""
    return spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)], f"pattern_id int, event_id int, vector {VECTOR}, confidence double, label int, weight long"
    )


def triage(spark, rows, eps, threshold, queries=None):
    fit = patterns(spark, rows)
    gated = fit.filter(F.col("confidence") >= threshold)
    vectors = T.numbered_vectors(gated)
    clusters = T.density_cluster(vectors, eps, 3)
    named = vectors.join(clusters.select("id", "cluster"), "id").select("event_id", "vector", "cluster")
    clustered = gated.join(named, ["event_id", "vector"])
    scored = T.with_cluster_score(clustered, T.score_clusters(clustered, no_label=-9, unlabelled=-1))
    asked = fit if queries is None else patterns(spark, queries)
    got = T.triage_nearest(asked, T.scored_vectors(scored), eps, threshold)
    return [r["prediction"] for r in got.orderBy("pattern_id").collect()]


def test_noise_is_not_scored(spark):
    rows = [(0, vec((0, 0.5), (1, 0.5)), 0.9, -9, 1), (0, vec((0, 1.0)), 0.9, 1, 1), (0, vec((0, 1.0)), 0.9, -9, 1), (0, vec((0, 1.0)), 0.9, -9, 1)]
    assert triage(spark, rows, 0.01, 0.2) == [-3, 1, 1, 1]


def test_labels_are_not_exchanged(spark):
    a, b = vec((0, 1.0)), vec((1, 1.0))
    rows = [(0, a, 0.9, 1, 1), (0, a, 0.9, -9, 1), (0, a, 0.9, -9, 1), (0, b, 0.9, 0, 1), (0, b, 0.9, -9, 1), (0, b, 0.9, -9, 1)]
    assert triage(spark, rows, 0.01, 0.2) == [1, 1, 1, 0, 0, 0]


def test_three_reject_codes(spark):
    fit = [(0, vec((0, 1.0)), 0.9, 1, 3)]
    asked = [(0, vec((0, 1.0)), 0.1, -9, 1), (1, vec((0, 1.0)), 0.9, -9, 1), (0, vec((1, 1.0)), 0.9, -9, 1), (0, vec((0, 1.0)), 0.9, -9, 1)]
    assert triage(spark, fit, 0.01, 0.2, asked) == [-1, -2, -3, 1]


def test_score_clusters(spark):
    rows = spark.createDataFrame(list(zip([0, 0, 1, 1, -1], [-1, -1, 2, -1, -1])), "cluster int, label int")
    scored = T.with_cluster_score(rows, T.score_clusters(rows))
    assert sorted((r["cluster"], r["score"]) for r in scored.collect()) == [(-1, -1), (0, -4), (0, -4), (1, 2), (1, 2)]


def brute_l1(a, b):
    x, y = dict(a), dict(b)
    return sum(abs(x.get(k, 0) - y.get(k, 0)) for k in set(x) | set(y))


def random_vectors(seed, n):
    rng, out = random.Random(seed), set()
    while len(out) < n:
        event, counts = rng.randrange(2), {}
        for _ in range(6):
            f = rng.randrange(5)
            counts[f] = counts.get(f, 0) + 1
        weights = {f: round(c * 10_000 / 6) + rng.choice((0, 0, 40)) for f, c in counts.items()}
        out.add((event, tuple(sorted(weights.items()))))
    return [(i, e, list(v), 1 + i % 2) for i, (e, v) in enumerate(sorted(out))]


@pytest.mark.parametrize("seed,eps", [(1, 0.05), (2, 0.30), (3, 0.34), (4, 0.5), (5, 1.0)])
def test_neighbours_and_clusters_brute_force(spark, seed, eps):
    rows, reach, least = random_vectors(seed, 120), int(round(eps * T.UNIT)), 5
    df = spark.createDataFrame(rows, f"id long, event_id int, vector {VECTOR}, weight long")
    near = {(a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and brute_l1(a[2], b[2]) <= reach}
    got = [(r["left_id"], r["right_id"]) for r in T.neighbour_pairs(df, df, eps).collect()]
    assert len(got) == len(set(got)) and set(got) == near
    apart = df.withColumnRenamed("weight", "w2")
    assert {(r["left_id"], r["right_id"]) for r in T.neighbour_pairs(df, apart, eps).collect()} == near

    weight = {r[0]: r[3] for r in rows}
    core = {a for a in weight if sum(weight[b] for x, b in near if x == a) >= least}
    label = {a: a for a in core}
    changed = True
    while changed:
        changed = False
        for a, b in near:
            if a in core and b in core and label[b] < label[a]:
                label[a], changed = label[b], True
    expected = {}
    for a in weight:
        joined = [label[b] for x, b in near if x == a and b in core]
        expected[a] = (a in core, label[a] if a in core else min(joined, default=-1))
    found = {r["id"]: (r["core"], r["cluster"]) for r in T.density_cluster(df, eps, least).collect()}
    assert found == expected


def test_fingerprint_pads_and_drops_zeros(spark):
    df = spark.createDataFrame([([-1, -1, 3],), ([-1, -1, -1],)], "p array<int>")
    got = [[tuple(s) for s in r["f"]] for r in df.select(T.fingerprint(F.col("p"), T.slot_weights(3)).alias("f")).collect()]
    assert got == [[(-1, 6667), (3, 3333)], [(-1, 10000)]]
    evidence = spark.createDataFrame([([0.0, -3.0, 1.0],), ([0.0, 0.0, 0.0],)], "w array<double>")
    slots = [r["x"] for r in evidence.select(T.association_slot_weights(F.col("w")).alias("x")).collect()]
    assert slots == [[0.0, 0.75, 0.25], pytest.approx([1 / 3] * 3)]


def test_matched_rerank(spark):
    rows = list(zip(range(7), ["k"] * 7, [-1, -2, -3, 1, 1, 0, 0], [99.0, 99.0, 99.0, 0.1, 0.2, 0.9, 0.8]))
    df = spark.createDataFrame(rows, "row_id long, k string, reference int, score double")
    got = T.matched_workload_rerank(df, ["k"], 1).orderBy("row_id").collect()
    assert [r["prediction"] for r in got] == [-1, -2, -3, 0, 0, 1, 1]


def test_workload_metrics(spark):
    df = spark.createDataFrame([(c,) for c in [0, 0, 0, 1, 1, -1]], "cluster int")
    got = one_row(M.workload_metrics(df, samples=2))
    assert (got["n_clusters"], got["clustered_sequences"], got["representative_alerts"]) == (2, 5, 4)
    assert got["coverage"] == pytest.approx(5 / 6) and got["overall_reduction"] == pytest.approx(1 - 5 / 6)


def test_prediction_metrics(spark):
    df = spark.createDataFrame(list(zip([-1, -1, 0, 1, 2], [-4, 0, 0, -1, -3])), "label int, prediction int")
    got = one_row(M.prediction_metrics(df))
    assert (got["auto_decided_count"], got["reject_count"]) == (3, 2) and got["auto_decided_accuracy"] == pytest.approx(2 / 3)
    df = spark.createDataFrame(list(zip([-1, 3, 9, -1], [0, 1, -5, 1])), "label int, prediction int")
    got = one_row(M.prediction_metrics(df, reading=PO.BINARY))
    assert (got["auto_decided_count"], got["tp"], got["fp"]) == (3, 1, 1) and got["auto_decided_accuracy"] == pytest.approx(2 / 3)


def triage_rows(spark, prediction):
    return spark.createDataFrame(
        list(zip([1, 1, 0, 0], prediction, ["a", "b", None, None])), "truth int, prediction int, incident_group string")


def test_operational_metrics(spark):
    got = one_row(M.operational_metrics(triage_rows(spark, [0, -1, 0, -3])))
    for name in ("analyst_workload", "triage_incident_recall", "triage_precision", "reject_rate", "automation_coverage", "incident_group_recall"):
        assert got[name] == 0.5, name


def test_strict_metrics(spark):
    got = one_row(M.strict_metrics(triage_rows(spark, [1, -1, 0, -3])))
    assert (got["automatic_incident_recall"], got["review_workload"], got["rejected_incident"]) == (0.5, 0.75, 1)
    assert got["incident_group_automatic_recall"] == 0.5


def points(spark, rows):
    return spark.createDataFrame(rows, "validation_analyst_workload double, validation_triage_incident_recall double, "
                                 "validation_triage_precision double, threshold double, eps double, test_analyst_workload double, budget double, k int")


def test_select_validation_ranks_null_worst(spark):
    df = points(spark, [(0.0, 0.0, None, 0.9, None, 0.0, 0.1, 1), (0.1, 0.0, 0.5, 0.2, None, 0.1, 0.1, 1)])
    assert one_row(P.select_validation(df, ["k"]))["threshold"] == 0.2


def test_select_calibrated(spark):
    df = points(spark, [(w, r, p, t, None, w, 0.20, 1) for w, r, p, t in [(0.10, 0.9, 0.8, 0.1), (0.20, 0.1, 0.2, 0.2), (0.21, 1.0, 1.0, 0.3)]])
    assert one_row(P.select_calibrated(df, ["k"]))["threshold"] == 0.2
    infeasible = one_row(P.select_calibrated(df.withColumn("budget", F.lit(0.01)), ["k"]))
    assert infeasible["feasible"] is False and infeasible["threshold"] is None


def test_closest_workload_prefers_lower(spark):
    df = spark.createDataFrame([(0.6, 0, 0.5), (0.4, 1, 0.5)], "test_review_workload double, grid_order int, target_workload double").withColumn("k", F.lit(1))
    assert one_row(P.closest_workload(df, ["k"]))["grid_order"] == 1


def test_safety_limit(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (2.0,)], "r double").select(P.safety_limit(F.col("r")).alias("x"))
    assert [r["x"] for r in df.collect()] == pytest.approx([1.0, 1.5, 2.1])


def test_sign_flip_and_rank(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "scenario string, effect double")
    assert one_row(B.sign_flip_p(df))["p"] == 0.25
    assert one_row(B.signed_rank_p(df))["signed_rank_p"] == 0.25


def test_sign_flip_beyond_enumeration(spark):
    df = spark.createDataFrame([(f"u{i:02d}", 1.0) for i in range(22)], "scenario string, effect double")
    assert one_row(B.sign_flip_p(df))["p"] == pytest.approx(1 / 100_001, rel=2)


def selection(spark, drop=0):
    rows = [(m, f"s{s}", d, True, 0.5 + (0.1 if m == "new" else 0.0), 0.3, "fixed_0.1") for m in ("new", "old") for s in range(6) for d in range(3)]
    return spark.createDataFrame(rows[drop:], "method string, test_scenario string, seed int, feasible boolean, "
                                 "test_triage_incident_recall double, test_analyst_workload double, budget_design string")


def test_no_inference_on_incomplete_panel(spark):
    names = [f"s{i}" for i in range(6)]
    full = one_row(B.paired_inference(selection(spark), ["budget_design"], "new", "old", names, iterations=200))
    assert full["complete_panel"] and full["p"] == pytest.approx(1 / 64) and full["ci_low"] == pytest.approx(0.1)
    part = one_row(B.paired_inference(selection(spark, 1), ["budget_design"], "new", "old", names, iterations=200))
    assert not part["complete_panel"] and part["p"] is None and part["ci_low"] is None and part["mean_delta_recall"] == pytest.approx(0.1)


def test_holm(spark):
    df = spark.createDataFrame([("f", 0.01), ("f", 0.04), ("f", 0.03), ("g", None)], "family string, p double")
    got = {r["p"]: r["p_holm"] for r in B.holm(df, ["family"]).collect()}
    assert got == {0.01: pytest.approx(0.03), 0.03: pytest.approx(0.06), 0.04: pytest.approx(0.06), None: None}


def test_grouped_bootstrap_centres_on_the_difference(spark):
    df = spark.createDataFrame([(10, i % 3, 1 + i % 4) for i in range(400)], "length long, baseline long, selector long")
    got = one_row(B.interval(B.grouped_ratio_bootstrap(df, 400), "gain"))
    assert got["mean"] == pytest.approx((2.5 - 1.0) / 10, abs=0.005) and got["ci_low"] < 0.15 < got["ci_high"]
    again = one_row(B.interval(B.grouped_ratio_bootstrap(df.repartition(7), 400), "gain"))
    assert again["mean"] == pytest.approx(got["mean"], rel=1e-12)


def test_scenario_folds(spark):
    rows = spark.createDataFrame([(s,) for s in "abcd"], "scenario string")
    got = {r["scenario"]: r["role"] for r in FO.scenario_folds(rows, list("abcd")).filter("test_scenario = 'b'").collect()}
    assert got == {"a": "train", "b": "test", "c": "validation", "d": "train"}
    with pytest.raises(ValueError):
        FO.scenario_folds(rows, ["a", "b"])


def test_reveal_labels_ratio(spark):
    rows = [(i, f"s{i % 3}", 1 if i < 30 else 0, f"g{i % 3}" if i < 30 else None) for i in range(130)]
    df = spark.createDataFrame(rows, "row_id long, scenario string, event_incident int, event_incident_group string")
    got = FO.reveal_labels(df, FO.scenario_folds(df), 22, 10, [5]).groupBy("test_scenario").agg(
        F.sum("event_incident").alias("p"), F.count("*").alias("n")).collect()
    assert {(r["p"], r["n"]) for r in got} == {(2, 22)}


def test_ambiguous_rules(spark):
    rows = [("t", "mixed", y) for y in (1, 1, 0, 0)] + [("t", "pure", 1)] * 4
    df = spark.createDataFrame(rows, "scenario string, event_key string, y int")
    folds = spark.createDataFrame([("x", "t", "train")], "test_scenario string, scenario string, role string")
    got = ST.ambiguous_rules(ST.training_rule_counts(df, folds, "y"), 0.1, 0.9, 2).collect()
    assert [(r["event_key"], r["positive"], r["negative"]) for r in got] == [("mixed", 2, 2)]


def test_interval_label_brute_force(spark):
    rng = random.Random(9)
    spans = [("s", "abc"[rng.randrange(3)], float(a), float(a + rng.randrange(1, 9_000)), i) for i, a in enumerate(rng.choices(range(20_000), k=25))]
    times = [(i, "s", rng.randrange(32_000)) for i in range(500)]
    got = J.label_by_interval(
        spark.createDataFrame(times, "row_id long, scenario string, timestamp long"),
        spark.createDataFrame(spans, "scenario string, attack string, start double, end double, position long"))
    names = sorted({s[1] for s in spans})
    for r in got.collect():
        hits = [(s[2], s[4], s[1]) for s in spans if s[2] <= r["timestamp"] <= s[3]]
        assert r["attack_id"] == (names.index(min(hits)[2]) if hits else -1)


def test_metric_violations_found(spark):
    rows = triage_rows(spark, [0, -1, 0, -3]).withColumn("k", F.lit(1))
    good = M.operational_metrics(rows, ["k"])
    expected = spark.createDataFrame([(1, 4)], "k int, split_rows long")
    assert V.metric_violations(good, ["k"], expected, ["k"]).count() == 0
    bad = good.withColumn("reject_rate", F.lit(1.2))
    assert {r["violation"] for r in V.metric_violations(bad, ["k"], expected, ["k"]).collect()} >= {"invalid reject_rate", "coverage + reject <> 1"}


def test_fingerprint_ignores_order(spark):
    df = spark.range(100).withColumn("x", F.col("id") % 7)
    assert one_row(V.table_fingerprint(df)) == one_row(V.table_fingerprint(df.orderBy(F.desc("id"))))
    assert one_row(V.fingerprint_matches(df, {"rows": 99}))["unchanged"] is False


def test_features_hold_every_event(spark):
    rows = spark.createDataFrame([([(64, 6000), (3, 4000)],), ([(-1, 10000)],)], "vector array<struct<e:int,w:int>>")
    size = T.feature_size(rows)
    assert size == 65
    features = [r["features"].toArray() for r in T.risk_features(rows, size).collect()]
    assert all(f.sum() == pytest.approx(1) for f in features) and features[0][65] == pytest.approx(0.6)
    scored = T.score_risk(rows, [0.0, 1.0], 0.5).collect()
    assert [r["score"] for r in scored] == [0.5, 0.5]


def test_gates_turn_with_their_evidence(spark):
    rows = [(12, list(range(10)), list(range(10))), (3, [1, 2, 3], [1, 2, 3])]
    frame = lambda r: spark.createDataFrame(r, "candidates int, slots array<int>, again array<int>")
    got = lambda r: tuple(one_row(B.widths_and_labels(frame(r), 10, again="again")).values())
    assert got(rows) == (True, True)
    assert got([*rows, (12, [1], [1])]) == (False, True)
    assert got([*rows, (3, [1, 2, 3], [1, 3, 2])]) == (True, False)
    assert got([]) == (False, False)
    effects = spark.createDataFrame([(f"s{i}", 0.1) for i in range(5)], "scenario string, effect double")
    span = lambda low, high: spark.createDataFrame([(low, high)], "ci_low double, ci_high double")
    pooled = lambda x: spark.createDataFrame([(x,)], "pooled_relative_increase double")
    facts = lambda w, n: spark.createDataFrame([("a", w, n)], "selector string, full_width boolean, label_free boolean")
    gate = lambda e=effects, c=(0.05, 0.2), s=0.0, w=True, n=True: one_row(B.confirmation_gate(e, span(*c), pooled(s), facts(w, n), gain="effect"))["succeeds"]
    assert gate()
    assert not gate(c=(-0.1, 0.2)) and not gate(s=0.06) and not gate(w=False) and not gate(n=False)
    assert not gate(e=effects.filter("scenario <> 's0'").withColumn("effect", F.when(F.col("scenario") == "s1", -0.1).otherwise(0.1)))
    check = lambda low, high: one_row(B.external_check(span(low, 1.0), span(-1.0, high)))["passed"]
    assert check(0.1, 0.0) and not check(0.0, 0.0) and not check(0.1, 0.1)


def test_poisson_weights_follow_their_distribution(spark):
    groups = spark.createDataFrame([(1,), (7,), (64,), (400,)], "copies long")
    keys = spark.range(4000).select(F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 8), 16, 10).cast("long").alias("a"), F.conv(F.substring(F.md5(F.col("id").cast("string")), 9, 8), 16, 10).cast("long").alias("b"))
    functions = B._poisson_functions(groups, "copies")
    drawn = groups.join(functions, "copies", "left").join(keys.withColumn("copies", F.explode(F.array(*[F.lit(c).cast("long") for c in (1, 7, 64, 400)]))), "copies")
    got = drawn.select("copies", B.poisson_weight(F.col("copies"), F.col("_cdf"), F.col("a"), F.col("b")).alias("w")).groupBy("copies").agg(F.avg("w").alias("m"), F.variance("w").alias("v")).collect()
    for r in got:
        assert r["m"] == pytest.approx(r["copies"], abs=4 * (r["copies"] / 4000) ** 0.5) and r["v"] == pytest.approx(r["copies"], rel=0.12)


def test_draws_of_a_task_are_the_column_draws(spark):
    """Draws made in blocks inside tasks give the sums of the column form, for means on both sides of the limit."""
    sizes = {(10, 1, 3): 1, (20, 5, 2): 7, (7, 0, 7): 64, (30, 4, 9): 400}
    df = spark.createDataFrame([k for k, n in sizes.items() for _ in range(n)], "length long, baseline long, selector long")
    groups = df.groupBy("length", "baseline", "selector").agg(F.count("*").alias("copies"))
    rows = groups.join(B._poisson_functions(groups, "copies"), "copies", "left").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(1499))))
    digest = F.md5(F.concat_ws("|", F.lit("5"), *[F.col(c).cast("string") for c in ("i", "length", "baseline", "selector")]))
    first, second = (F.conv(F.substring(digest, at, 8), 16, 10).cast("long") for at in (1, 9))
    rows = rows.withColumn("w", B.poisson_weight(F.col("copies"), F.col("_cdf"), first, second))
    rate = lambda c: F.sum(F.col("w") * F.col(c)) / F.sum(F.col("w") * F.col("length"))
    want = {r["i"]: (r["b"], r["s"]) for r in rows.groupBy("i").agg(rate("baseline").alias("b"), rate("selector").alias("s")).collect()}
    got = {r["iteration"]: (r["baseline_rate"], r["selector_rate"]) for r in B.grouped_ratio_bootstrap(df, 1500, seed=5).collect()}
    assert got == want and len(got) == 1500
    # the parts that leave the tasks are sums over iterations; no row is made for a draw
    plan = B.grouped_ratio_bootstrap(df, 1500, seed=5)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" in plan and plan.count("Generate") == 1


def test_sequence_tokens_carry_their_predecessor_only(spark):
    from alertweave.catalog import sources as SO

    rows = spark.createDataFrame([(1, 0, 1, "p", [5, 6, 5]), (2, 1, 3, "q", [7])], "seq_id long, label int, split int, pattern string, tokens array<long>")
    got = sorted(tuple(r) for r in SO.tokens(rows).select("seq_id", "pos", "token", "previous").collect())
    assert got == [(1, 0, 5, -1), (1, 1, 6, 5), (1, 2, 5, 6), (2, 0, 7, -1)]


def test_intersection_reads_fixed_digests(spark):
    """Neither side of the intersection works out splits and digests again."""
    from alertweave import catalog

    got = catalog.QUERIES["u3_intersection"](spark, "/root/testdata/sf0.001")
    assert "sha2(" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_model_meets_alerts_alike_shipped_or_salted(spark):
    from alertweave.operators import association as AS

    pool = spark.createDataFrame([(i, f"s{i % 3}", i % 2) for i in range(50)], "row_id long, scenario string, event_id long")
    folds = spark.createDataFrame([(f"s{i}", f"s{j}", "test" if i == j else "train") for i in range(3) for j in range(3)], "test_scenario string, scenario string, role string")
    model = spark.createDataFrame([(f"s{i}", e, [0.1 * i, 0.2 * e], [0, 1]) for i in range(3) for e in range(2)], "test_scenario string, event_id long, weights array<double>, local_of array<int>")
    rows = lambda limit: sorted(tuple(r) for r in AS.with_model(pool, folds, model, shipped_bytes=limit).select("row_id", "test_scenario", "weights").collect())
    assert rows(1 << 20) == rows(0) and len(rows(0)) == 50


def test_clusters_and_nearest_at_any_reach(spark):
    """2,000 fingerprints of one event that share a frequent feature, against plain rounds."""
    import random

    rng = random.Random(3)
    points = []
    for i in range(2000):
        rest = rng.sample(range(1, 60), 2)
        heavy = rng.choice([1000, 3000, 5000, 7000])
        part = rng.choice([500, 1000, 1500])
        points.append(sorted([(0, heavy), (rest[0], part), (rest[1], 10_000 - heavy - part)]))
    unique = sorted({tuple(p) for p in points})
    vectors = spark.createDataFrame([(i, 0, [{"e": e, "w": w} for e, w in p], 1) for i, p in enumerate(unique)], "id long, event_id int, vector array<struct<e:int,w:int>>, weight long")
    maps = [dict(p) for p in unique]

    def apart(a, b):
        return 20_000 - 2 * sum(min(w, b.get(e, 0)) for e, w in a.items())

    import numpy as np

    wide = np.zeros((len(unique), 60), np.int32)
    for i, m in enumerate(maps):
        for e, w in m.items():
            wide[i, e] = w
    away = np.stack([np.abs(wide - row).sum(axis=1) for row in wide])
    for eps in (0.1, 0.5, 1.0):
        near = away <= round(eps * 10_000)
        core = near.sum(axis=1) >= 5
        label = np.where(core, np.arange(len(unique)), -1)
        while True:
            spread = np.where(near & core[None, :], label[None, :], len(unique)).min(axis=1)
            new = np.where(core, np.minimum(label, spread), label)
            if (new == label).all():
                break
            label = new
        border = np.where(near & core[None, :], label[None, :], len(unique)).min(axis=1)
        want = {i: (bool(core[i]), int(label[i]) if core[i] else int(border[i]) if border[i] < len(unique) else -1) for i in range(len(unique))}
        got = {r["id"]: (r["core"], r["cluster"]) for r in T.density_cluster(vectors, eps, 5).collect()}
        assert got == want
    held = vectors.filter("id % 2 = 0").select("event_id", "vector", F.col("id").alias("score"))
    asked = vectors.filter("id % 2 = 1").select("id", "event_id", "vector")
    found = {r["id"]: (r["distance"], r["score"]) for r in T.nearest_scored(asked, held, 1.0).collect()}
    for i in range(1, len(unique), 2):
        best = away[i, ::2].min()
        assert (found.get(i) is None) == (best > 10_000)
        if i in found:
            assert found[i] == (best / 10_000, 2 * int(np.flatnonzero(away[i, ::2] == best)[0]))


@pytest.mark.parametrize("eps", [0.15, 0.5, 1.0])
def test_narrow_fingerprints_brute_force(spark, monkeypatch, eps):
    """Three weighted slots: pairs, counts without a list of all pairs, and the wider join agree with brute force."""
    rng, seen = random.Random(8), set()
    while len(seen) < 200:
        weights = {}
        for w in (1429, 2857, 5714):
            f = rng.choice((0, 0, 1, 2, 3, 4, 5))
            weights[f] = weights.get(f, 0) + w
        seen.add((rng.randrange(2), tuple(sorted(weights.items()))))
    rows, reach = [(i, e, list(v), 1 + i % 3) for i, (e, v) in enumerate(sorted(seen))], int(round(eps * T.UNIT))
    df = spark.createDataFrame(rows, f"id long, event_id int, vector {VECTOR}, weight long")
    near = {(a[0], b[0]): brute_l1(a[2], b[2]) for a in rows for b in rows if a[1] == b[1] and set(dict(a[2])) & set(dict(b[2])) and brute_l1(a[2], b[2]) <= reach}
    got = [(r["left_id"], r["right_id"], r["distance"]) for r in T.neighbour_pairs(df, df, eps).collect()]
    assert len(got) == len(near) and {(a, b): d for a, b, d in got} == near
    counts = {r["id"]: (r["neighbourhood"], r["core"]) for r in T.neighbourhoods(df, eps, 9).collect()}
    weight = {r[0]: r[3] for r in rows}
    sums = {a: sum(weight[b] for x, b in near if x == a) for a in weight}
    assert counts == {a: (n, n >= 9) for a, n in sums.items()}
    monkeypatch.setattr(T, "NARROW", 0)
    wide = T.neighbourhoods(df, eps, 9).collect()
    assert {r["id"]: (r["neighbourhood"], r["core"]) for r in wide} == counts


def test_neighbourhoods_list_few_pairs(spark, monkeypatch):
    """What shares its heaviest event is counted without pairs: their number grows with the fingerprints, not with their square."""
    listed, plain = [], T._narrow_pairs

    def watched(*args):
        pairs = T.cut_lineage(plain(*args))
        listed.append(pairs.count())
        return pairs

    monkeypatch.setattr(T, "_narrow_pairs", watched)
    for n in (20, 40):
        rows = [(i * n + j, 0, [(0, 5714), (1 + i, 2857), (100 + j, 1429)], 1) for i in range(n) for j in range(n)]
        df = spark.createDataFrame(rows, f"id long, event_id int, vector {VECTOR}, weight long")
        found = T.neighbourhoods(df, 1.0, 5).collect()
        assert {r["neighbourhood"] for r in found} == {n * n} and len(found) == n * n
    assert listed == [20 * 20, 40 * 40]  # each with itself


@pytest.mark.parametrize("size", [3, 4])
def test_nearest_of_narrow_fingerprints_lists_no_pairs(spark, monkeypatch, size):
    """What a query may share is looked up: distances and ties as in brute force, and no pair of fingerprints is listed."""
    rng, seen = random.Random(size), set()
    while len(seen) < 300:
        weights = {}
        for w in ((1429, 2857, 5714), (667, 1333, 2667, 5333))[size - 3]:
            f = rng.choice((0, 0, *range(1, 12)))
            weights[f] = weights.get(f, 0) + w
        seen.add((rng.randrange(2), tuple(sorted(weights.items()))))
    rows = sorted(seen)
    rng.shuffle(rows)
    held, asked = sorted(rows[:120]), rows[100:]
    stored = spark.createDataFrame([(e, list(v), i) for i, (e, v) in enumerate(held)], f"event_id int, vector {VECTOR}, score int")
    queries = spark.createDataFrame([(i, e, list(v)) for i, (e, v) in enumerate(asked)], f"id long, event_id int, vector {VECTOR}")
    expected = {}
    for i, (e, v) in enumerate(asked):
        best = min(((brute_l1(v, w), j) for j, (o, w) in enumerate(held) if o == e and set(dict(v)) & set(dict(w))), default=(20_000, 0))
        if best[0] <= 10_000:
            expected[i] = (best[0] / T.UNIT, best[1])
    found = lambda: {r["id"]: (r["distance"], r["score"]) for r in T.nearest_scored(queries, stored, 1.0).collect()}
    with monkeypatch.context() as patched:
        patched.setattr(T, "neighbour_pairs", None)
        assert found() == expected and len({d for d, _ in expected.values()}) > 3
    monkeypatch.setattr(T, "WEIGHTINGS", 0)
    assert found() == expected


def test_copies_of_a_second_are_counted_before_their_context(spark, monkeypatch):
    """Alike alerts meet their context as one row, and the split moves no row: both followed the number of alerts."""
    setup, met, plain = TP.TriageSetup(width=3, train_ratio=0.5), [], T.compact_patterns

    def watched(rows, *args, **named):
        met.append(rows.count())
        return plain(rows, *args, **named)

    monkeypatch.setattr(T, "compact_patterns", watched)
    for copies in (1, 3):
        rows = [("s", f"s::m{m}", 900 * t, 4 * (40 * c + t) + 2 * m + e, (t * t + m) % 5 + e, t % 3 - 1) for t in range(40) for m in range(2) for e in range(2) for c in range(copies)]
        alerts = spark.createDataFrame(rows, "scenario string, machine string, timestamp long, row_id long, event_id int, label int")
        key = lambda r: (r["split"], r["event_id"], tuple(r["context"]), r["n"], r["weight"], r["label"])
        got = sorted(key(r) for r in TP.split_patterns(alerts, setup).collect())
        order = [F.floor(F.col("timestamp") / 86_400), F.col("timestamp"), F.col("row_id")]
        split = FO.ratio_split(alerts, 0.5, order)
        assert "Exchange" not in split._jdf.queryExecution().executedPlan().toString()
        assert got == sorted(key(r) for r in plain(TP.CONTEXTS["strict"](split, setup), 5, keys=["split"]).collect())
        assert sum(r[3] for r in got) == 160 * copies
    assert met == [160, 160]
