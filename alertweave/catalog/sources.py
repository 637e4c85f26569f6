"""Registered queries: sources, sinks read back, sequences and data-quality checks."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from alertweave.catalog import runs as RC
from alertweave.catalog import training as TC
from alertweave.catalog import triage as TG
from alertweave.catalog.registry import query, with_
from alertweave.catalog.sqltext import ALERTS, FOLDS, INTERVALS, KEYED, LINES, SPLITS, history
from alertweave.functions import encode as E
from alertweave.operators import association as AS
from alertweave.operators import checks as V
from alertweave.operators import context as C
from alertweave.operators import folds as FO
from alertweave.operators import infer as B
from alertweave.operators import metrics as M
from alertweave.operators import ordering as O
from alertweave.operators import stats as ST
from alertweave.session import cut_lineage, shared_folder
from alertweave.sources import alerts as A
from alertweave.sources import readers as R
from alertweave.sources import writers as W


def scratch(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# ---- sources ------------------------------------------------------------------------


def _json_lines(spark, sf_dir):
    """Alert records as raw JSON lines, some blank, broken, incomplete or with a non-numeric rule."""
    i = F.col("event_id")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    agent = F.concat(F.lit("m"), (F.col("user_id") % 24).cast("string"))
    rule = F.when(i % 48 == 0, "abc").otherwise((F.get_json_object("props", "$.k").cast("int") % 8).cast("string"))
    full = F.concat(
        F.lit('{"@timestamp":"'), stamp, F.lit('","agent":{"id":"'), agent, F.lit('","name":"x"},"rule":{"id":"'), rule, F.lit('"},"n":1}')
    )
    line = (
        F.when(i % 47 == 0, "   ")
        .when(i % 50 == 0, F.substring(full, 1, 40))
        .when(i % 49 == 0, F.concat(F.lit('{"@timestamp":"'), stamp, F.lit('","rule":{"id":"1"}}')))
        .otherwise(full)
    )
    return TC.events(spark, sf_dir).select(F.concat(F.lit("s"), (F.col("user_id") % 8).cast("string")).alias("scenario"), line.alias("value"))


_S1 = """SELECT scenario, round(epoch(ts), 6) AS timestamp, scenario || '_m' || (user_id % 24) AS machine, k AS event
  FROM (SELECT *, 's' || (user_id % 8) AS scenario, regexp_extract(props, '"k": *([0-9]+)', 1)::INT % 8 AS k FROM events)
  WHERE event_id % 47 <> 0 AND event_id % 50 <> 0 AND event_id % 49 <> 0 AND event_id % 48 <> 0"""


def _alert_files(spark, sf_dir):
    """The JSON lines as `<scenario>_wazuh.json` files: one folder of text parts per scenario, renamed to the reader's pattern."""
    path = scratch(spark, "wazuh")
    _json_lines(spark, sf_dir).repartition("scenario").write.partitionBy("scenario").text(path)
    jvm, context = spark.sparkContext._jvm, spark.sparkContext
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(context._jsc.hadoopConfiguration())
    # one file per scenario, and the scenarios are the names of a dictionary
    for status in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/scenario=*/part-*")):
        source = status.getPath()
        scenario = source.getParent().getName().partition("=")[2]
        fs.rename(source, jvm.org.apache.hadoop.fs.Path(f"{path}/{scenario}_wazuh.json"))
    return path


@query("s1_read_alert_json", _S1)
def s1(spark, sf_dir):
    """Alert JSON files written and read back."""
    alerts, _ = R.read_alert_json(spark, _alert_files(spark, sf_dir))
    return alerts.withColumn("timestamp", F.round("timestamp", 6))


@query(
    "s1_quarantine",
    "SELECT 's' || (user_id % 8) AS scenario, count(*) AS lines FROM events WHERE event_id % 47 <> 0 AND event_id % 50 <> 0 AND event_id % 49 <> 0 AND event_id % 48 = 0 GROUP BY 1",
)
def s1_quarantine(spark, sf_dir):
    _, rejected = R.read_alert_json(spark, _alert_files(spark, sf_dir))
    return rejected.groupBy("scenario").agg(F.count("*").alias("lines"))


@query("s2_read_attack_intervals", with_(KEYED, INTERVALS, 'SELECT scenario, attack, s::DOUBLE AS start, e::DOUBLE AS "end" FROM intervals'))
def s2(spark, sf_dir):
    """Interval CSV written and read back."""
    path = scratch(spark, "intervals")
    TC.intervals(spark, sf_dir).select("scenario", "attack", "start", "end").write.csv(path, header=True)
    return R.read_attack_intervals(spark, path).drop("position")


@query(
    "s3_read_alert_csv",
    with_(
        KEYED,
        """SELECT scenario, count(*) AS rows, sum(timestamp)::BIGINT AS time_sum, 0 AS first_row, count(*) - 1 AS last_row, count(*) AS distinct_rows FROM keyed GROUP BY 1""",
    ),
)
def s3(spark, sf_dir):
    """One alert CSV per scenario, written and read back with dense source rows."""
    path = scratch(spark, "alerts")
    keyed = A.keyed_events(TC.events(spark, sf_dir))
    rows = keyed.select(
        F.col("timestamp").alias("time"), F.col("event_type").alias("name"), F.lit("10.0.0.1").alias("ip"),
        F.col("machine").alias("host"), F.col("event_key").alias("short"),
        F.when(F.col("value") > 200, "attack").otherwise("false_positive").alias("time_label"),
        F.when(F.col("event_incident") == 1, F.col("event_type")).otherwise("-").alias("event_label"), "scenario",
    )
    rows.write.partitionBy("scenario").csv(path, header=True)
    read = R.read_alert_csv(spark, path, per_folder=True)
    return read.groupBy("scenario").agg(
        F.count("*").alias("rows"), F.sum("time").alias("time_sum"), F.min("source_row").alias("first_row"),
        F.max("source_row").alias("last_row"), F.countDistinct("source_row").alias("distinct_rows"),
    )


@query("s4_read_canonical", "SELECT event_id, event_type FROM events")
def s4(spark, sf_dir):
    return R.read_canonical(spark, f"{sf_dir}/events.parquet", ["event_id", "event_type"])


@query(
    "s5_read_event_sequences",
    with_(
        LINES,
        """SELECT source, count(*) AS sequences, sum(len(string_split(line, ' ')))::BIGINT AS tokens, sum(list_sum([t::BIGINT for t in string_split(line, ' ')]))::BIGINT AS total,
                  count(DISTINCT line) AS distinct_lines FROM lines WHERE source <> 'train' GROUP BY 1""",
    ),
)
def s5(spark, sf_dir):
    """One text file set per source, written and read; lines of the training source get a negative token and must be rejected, the others a line end."""
    spoiled = F.when(F.col("source") == "train", F.concat("line", F.lit(" -3"))).otherwise(F.concat("line", F.lit("\r")))
    raw = cut_lineage(TC.lines(spark, sf_dir).select("source", spoiled.alias("line")))
    paths = {r["source"]: scratch(spark, "sequences") for r in raw.select("source").distinct().collect()}
    for name, path in paths.items():
        raw.filter(F.col("source") == name).select("line").write.text(path)
    rows = R.read_event_sequences(spark, paths, strict=False)
    total = F.aggregate("tokens", F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.groupBy("source").agg(
        F.count("*").alias("sequences"), F.sum(F.size("tokens")).alias("tokens"), F.sum(total).alias("total"),
        F.countDistinct(F.rtrim("line", F.lit("\r"))).alias("distinct_lines"),
    )


@query(
    "s6_read_processed_events",
    with_(
        ALERTS,
        "SELECT scenario, count(*) AS rows, sum(event_id)::BIGINT AS event_sum, sum(timestamp)::BIGINT AS time_sum FROM alerts GROUP BY 1",
    ),
)
def s6(spark, sf_dir):
    """Processed event CSV written (the sink) and read back (the source)."""
    rows = TC.alerts(spark, sf_dir).select(
        F.col("timestamp").cast("double").alias("timestamp"),
        E.machine_key(F.col("scenario"), F.element_at(F.split("machine", "::"), 2), "_").alias("machine"),
        F.col("event_id").alias("event"), F.col("event_incident").alias("label"),
    )
    path = W.write_processed_events(rows, scratch(spark, "processed"))
    read = R.read_processed_events(spark, path)
    return read.groupBy("scenario").agg(
        F.count("*").alias("rows"), F.sum("event").alias("event_sum"), F.sum("timestamp").cast("long").alias("time_sum")
    )


@query(
    "s7_read_report_csv",
    with_(ALERTS, "SELECT detector, event_key, count(*) AS alerts, round(avg(event_incident), 6) AS incident_rate FROM alerts GROUP BY 1, 2"),
)
def s7(spark, sf_dir):
    """A report with a comment line, written as text and read back."""
    rows = ST.rule_profile(TC.alerts(spark, sf_dir))
    line = F.concat_ws(",", "detector", "event_key", F.col("alerts").cast("string"), F.col("incident_rate").cast("string"))
    path = scratch(spark, "report")
    rows.select(F.explode(F.array(F.lit("# generated report"), line)).alias("value")).write.text(path)
    return TC.rounded(R.read_report_csv(spark, path, "detector string, event_key string, alerts long, incident_rate double", header=False))


_DOC_METRICS = ("review_workload", "automatic_incident_recall")


@query(
    "s8_read_run_records",
    with_(
        *RC.BASE,
        f"SELECT method, test_scenario, seed, eps, threshold, split, {', '.join(f'round({m}, 6) AS {m}' for m in _DOC_METRICS)} FROM records",
    ),
)
def s8(spark, sf_dir):
    """Run documents written as JSON, read back recursively, incomplete ones dropped, one row per point."""
    documents = W.run_documents(RC.records(spark, sf_dir), ("method", "test_scenario", "seed"), _DOC_METRICS)
    path = scratch(spark, "runs")
    documents.write.json(path)
    documents.withColumn("status", F.lit("failed")).write.json(f"{path}/nested")
    read = R.read_run_records(spark, path, documents.schema, multi_line=False)
    return TC.rounded(read.select("method", "test_scenario", "seed", "point.eps", "point.threshold", "point.split", *[f"point.{m}" for m in _DOC_METRICS]))


# ---- sinks, read back --------------------------------------------------------------------


@query("k1_write_canonical", with_(ALERTS, "SELECT scenario, row_id, event_key, event_id, event_incident FROM alerts"))
def k1(spark, sf_dir):
    rows = TC.alerts(spark, sf_dir).select("scenario", "row_id", "event_key", "event_id", "event_incident")
    return R.read_canonical(spark, W.write_canonical(rows, scratch(spark, "canonical")), rows.columns)


@query("k3_write_contexts", with_(ALERTS, history(10), "SELECT row_id, array_to_string([x.e for x in c], ' ') AS context FROM ctx"))
def k3(spark, sf_dir):
    rows = C.strict_past_context(TC.alerts(spark, sf_dir)).select("machine", "timestamp", "row_id", C.ids("context").alias("context"))
    path = W.write_contexts(rows, scratch(spark, "contexts"), buckets=8)
    return spark.read.parquet(path).select("row_id", C.joined("context").alias("context"))


_MAP = "firsts AS (SELECT event_id AS original, min((timestamp, row_id)) AS f FROM alerts GROUP BY 1), mp AS (SELECT original, row_number() OVER (ORDER BY f) AS token FROM firsts)"


def mapping(spark, sf_dir):
    from alertweave.operators.vocabulary import arrival_vocabulary

    return arrival_vocabulary(TC.alerts(spark, sf_dir), "event").select(F.col("token_id").alias("event_id"), F.col("token").cast("int").alias("original"))


@query(
    "k4_prediction_report",
    with_(
        ALERTS, INTERVALS, TC._ATTACK, _MAP,
        """SELECT row_id AS sequence_index, token AS internal_event_id, original AS original_event_id, (event_id % 8) - 4 AS predicted_score,
             CASE WHEN (event_id % 8) - 4 >= 0 THEN 'attack id' WHEN (event_id % 8) = 3 THEN 'not confident' WHEN (event_id % 8) = 2 THEN 'event not seen in training'
                  WHEN (event_id % 8) = 1 THEN 'too far from the nearest cluster' ELSE 'benign cluster' END AS meaning, attack_id AS true_label
           FROM labelled JOIN mp ON original = event_id""",
    ),
)
def k4(spark, sf_dir):
    table = mapping(spark, sf_dir)
    rows = TC.windowed(spark, sf_dir).withColumn("score", F.col("event_id") % 8 - 4)
    rows = rows.withColumnRenamed("event_id", "original").join(table, "original").select(
        F.col("row_id").alias("sequence_index"), "event_id", "score", F.col("attack_id").alias("label")
    )
    report = W.report_rows(rows, "score", "predicted_score", table, E.score_meaning(F.col("score")))
    path = W.write_report(report, scratch(spark, "predictions"))
    return spark.read.schema(report.schema).csv(path, header=True)


@query("k4_cluster_report", TG.rec(*TG.CLUS, "SELECT cluster AS cluster_id, label AS true_label, count(*) AS patterns FROM cp GROUP BY 1, 2"))
def k4_clusters(spark, sf_dir):
    rows = TG.clustered(spark, sf_dir).select(F.col("pattern_id").alias("sequence_index"), "event_id", "cluster", "label")
    meaning = F.when(F.col("cluster") < 0, "noise").otherwise("cluster")
    report = W.report_rows(rows, "cluster", "cluster_id", mapping(spark, sf_dir), meaning)
    read = spark.read.schema(report.schema).csv(W.write_report(report, scratch(spark, "clusters")), header=True)
    return read.groupBy("cluster_id", "true_label").agg(F.count("*").alias("patterns"))


@query("k5_write_summary", TG.rec(*TG.DONE, TG._DECIDED, "SELECT (SELECT count(DISTINCT cluster) FROM cp WHERE cluster >= 0) AS n_clusters, auto::BIGINT AS auto_decided_count, rej::BIGINT AS reject_count FROM pq"))
def k5(spark, sf_dir):
    document = W.summary_document({
        "workload": M.workload_metrics(TG.clustered(spark, sf_dir), weight="n"),
        "prediction": M.prediction_metrics(TG.predictions(spark, sf_dir), weight="n"),
    })
    path = W.write_summary(document, scratch(spark, "summary"))
    return spark.read.schema(document.schema).json(path).select("workload.n_clusters", "prediction.auto_decided_count", "prediction.reject_count")


@query("k6_write_mapping", with_(ALERTS, _MAP, "SELECT token AS event_id, original FROM mp"))
def k6(spark, sf_dir):
    table = mapping(spark, sf_dir)
    return spark.read.schema(table.schema).json(W.write_mapping(table, scratch(spark, "mapping")))


@query("k6_label_legend", with_(KEYED, INTERVALS, "SELECT row_number() OVER (ORDER BY attack) - 1 AS attack_id, attack AS name FROM (SELECT DISTINCT attack FROM intervals)"))
def k6_legend(spark, sf_dir):
    """The legend written next to the mapping and read back."""
    legend = W.label_legend(TC.intervals(spark, sf_dir))
    return spark.read.schema(legend.schema).json(W.write_mapping(legend, scratch(spark, "legend")))


@query("k7_write_comparison", with_(*RC.PBASE, "SELECT scenario, round(avg(recall_gain), 6) AS mean_recall_gain FROM gains GROUP BY 1"))
def k7(spark, sf_dir):
    gains = RC.pairs(spark, sf_dir)
    deltas = gains.groupBy("scenario").agg(F.avg("recall_gain").alias("mean_recall_gain"))
    written = W.write_comparison(gains.select("scenario", "seed", "recall_gain"), deltas, scratch(spark, "comparison"))
    return TC.rounded(spark.read.schema(deltas.schema).csv(written["deltas"], header=True))


# ---- sequences --------------------------------------------------------------------------------


def sequences(spark, sf_dir):
    return FO.sequence_split(TC.lines(spark, sf_dir))


def parsed_sequences(spark, sf_dir):
    """Token arrays of every sequence, read, split and checked once for all passes over them."""
    # lines are fixed before they are parsed, or the optimizer would work out split and digest again in each filter, in the tasks of the scan
    split = cut_lineage(sequences(spark, sf_dir).repartition("seq_id"))
    return cut_lineage(R.parse_event_lines(split, "seq_id", "source", "label", "split", "pattern").drop("line"))


def tokens(rows):
    """One row per token of every parsed sequence with the token before it."""
    # pairs are made in the array, so that no token carries its whole sequence
    earlier = F.slice(F.concat(F.array(F.lit(-1).cast("long")), "tokens"), F.lit(1), F.size("tokens"))
    slots = rows.select("seq_id", "label", "split", "pattern", F.posexplode(F.arrays_zip(F.col("tokens").alias("token"), earlier.alias("previous"))).alias("pos", "_t"))
    return slots.select("seq_id", "label", "split", "pattern", "pos", "_t.token", "_t.previous")


TOKENS = """
tk AS (SELECT seq_id, label, split, sha256(line) AS pattern, unnest(string_split(line, ' '))::INT AS token, generate_subscripts(string_split(line, ' '), 1) AS pos FROM split),
tok AS (SELECT *, coalesce(lag(token) OVER (PARTITION BY seq_id ORDER BY pos), -1) AS previous FROM tk),
prev_ AS (SELECT avg(label) AS p FROM tok WHERE split = 1),
ft AS (SELECT token, (sum(label) + 1.0::DOUBLE) / (count(*) + 2.0::DOUBLE) AS post FROM tok WHERE split = 1 GROUP BY 1),
fb AS (SELECT previous, token, (sum(label) + 1.0::DOUBLE) / (count(*) + 2.0::DOUBLE) AS post FROM tok WHERE split = 1 GROUP BY 1, 2),
fin AS (SELECT t.*, CASE WHEN ft.post IS NULL THEN -2 WHEN ft.post >= p THEN 1 ELSE 0 END AS baseline, CASE WHEN fb.post IS NULL THEN -2 WHEN fb.post >= p THEN 1 ELSE 0 END AS selector
        FROM tok t CROSS JOIN prev_ LEFT JOIN ft ON ft.token = t.token LEFT JOIN fb ON fb.token = t.token AND fb.previous = t.previous WHERE split = 3)
"""


#: A generous size of a (split, previous, token, label) count in memory.
_CELL_BYTES = 100


def token_predictions(spark, sf_dir):
    """Final-split tokens with codes of a token prior and of a (previous, token) prior fitted on development sequences."""
    rows = tokens(parsed_sequences(spark, sf_dir))
    cells = cut_lineage(rows.groupBy("split", "previous", "token", "label").agg(F.count("*").alias("n")))
    train = cells.filter("split = 1")
    def prior(*keys):
        return train.groupBy(*keys).agg(((F.sum(F.col("label") * F.col("n")) + 1.0) / (F.sum("n") + 2.0)).alias("_post"))
    share = train.agg((F.sum(F.col("label") * F.col("n")) / F.sum("n")).alias("_p")).withColumn("_one", F.lit(1))
    # cells of a measured small size are shipped to the tokens: their keys are few and frequent
    ship = F.broadcast if cells.count() * _CELL_BYTES <= AS.SHIPPED_BYTES else lambda df: df
    def code(name):
        return F.when(F.col(name).isNull(), -2).when(F.col(name) >= F.col("_p"), 1).otherwise(0)
    final = rows.filter("split = 3").withColumn("_one", F.lit(1)).join(F.broadcast(share), "_one")
    final = final.join(ship(prior("token").withColumnRenamed("_post", "_b")), "token", "left")
    final = final.join(ship(prior("previous", "token").withColumnRenamed("_post", "_s")), ["previous", "token"], "left")
    return final.select("seq_id", "label", "pattern", code("_b").alias("baseline"), code("_s").alias("selector"))


def sequence_totals(spark, sf_dir):
    """Per sequence: length and automatic-incident rows of both methods."""
    return token_predictions(spark, sf_dir).groupBy("seq_id", "label", "pattern").agg(
        F.count("*").alias("length"),
        F.sum((F.col("baseline") > 0).cast("long")).alias("baseline"),
        F.sum((F.col("selector") > 0).cast("long")).alias("selector"),
    )


@query(
    "w3_preceding_windows",
    with_(
        LINES,
        "tk AS (SELECT seq_id, unnest(string_split(line, ' ')) AS token, generate_subscripts(string_split(line, ' '), 1) AS pos FROM lines)",
        "wd AS (SELECT coalesce(string_agg(token, ' ') OVER (PARTITION BY seq_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS preceding FROM tk)",
        "SELECT preceding, count(*) AS rows FROM wd GROUP BY 1",
    ),
)
def w3(spark, sf_dir):
    rows = R.parse_event_lines(TC.lines(spark, sf_dir), "seq_id")
    windows = rows.select(F.explode(C.preceding_windows(F.col("tokens"), 3)).alias("w"))
    return windows.groupBy(C.joined("w").alias("preceding")).agg(F.count("*").alias("rows"))


@query(
    "w12_sequence_offsets",
    with_(
        LINES,
        """SELECT seq_id, len(string_split(line, ' ')) AS length, (sum(len(string_split(line, ' '))) OVER (ORDER BY seq_id) - len(string_split(line, ' ')))::BIGINT AS start FROM lines""",
    ),
)
def w12(spark, sf_dir):
    lengths = R.parse_event_lines(TC.lines(spark, sf_dir), "seq_id").select("seq_id", F.size("tokens").alias("length"))
    return O.running_sums(lengths, [], ["seq_id"], {"start": F.col("length").cast("long")})


SEQ = (LINES, SPLITS, TOKENS)


@query(
    "a21_sequence_counts",
    with_(*SEQ, "SELECT seq_id, count(*) AS length, count(*) FILTER (WHERE baseline > 0) AS baseline, count(*) FILTER (WHERE selector > 0) AS selector FROM fin GROUP BY 1"),
)
def a21(spark, sf_dir):
    return sequence_totals(spark, sf_dir).select("seq_id", "length", "baseline", "selector")


def _bootstrap_sql(name: str, rows: str, seed: int, scale: float) -> str:
    """Weights, sums and rates of the iterations over the sequences in `rows` (length, baseline, selector)."""
    text = " || '|' || ".join(["'" + str(seed) + "'", *(f"{c}::VARCHAR" for c in ("iteration", "length", "baseline", "selector"))])
    key = lambda at: f"(('0x' || substr(md5({text}), {at}, 8))::BIGINT)"
    return f"""
{name}_g AS (SELECT length, baseline, selector, count(*) AS copies FROM ({rows}) GROUP BY ALL),
{name}_p AS (SELECT copies, k, exp(-copies::DOUBLE + k * ln(copies::DOUBLE) - sum(ln(greatest(k, 1)::DOUBLE)) OVER (PARTITION BY copies ORDER BY k)) AS p
             FROM (SELECT DISTINCT copies FROM {name}_g WHERE copies <= 64) CROSS JOIN (SELECT range AS k FROM range(172))),
{name}_c AS (SELECT copies, list(round(c, 10) ORDER BY k) AS cdf FROM (SELECT copies, k, sum(p) OVER (PARTITION BY copies ORDER BY k) AS c FROM {name}_p) WHERE round(c, 10) < 1 GROUP BY 1),
{name}_u AS (SELECT length, baseline, selector, copies, cdf, iteration, ({key(1)} + 0.5) / 4294967296.0::DOUBLE AS u, ({key(9)} + 0.5) / 4294967296.0::DOUBLE AS v
             FROM {name}_g LEFT JOIN {name}_c USING (copies) CROSS JOIN (SELECT range AS iteration FROM range(20000))),
{name}_z AS (SELECT *, sqrt(-2.0::DOUBLE * ln(u)) * cos(2.0::DOUBLE * pi() * v) AS z FROM {name}_u),
{name}_w AS (SELECT iteration, length, baseline, selector, CASE WHEN copies <= 64 THEN len([x for x in cdf if x < u]) ELSE greatest(floor(copies + sqrt(copies::DOUBLE) * z + (z * z - 1.0) / 6.0 + 0.5), 0) END AS w FROM {name}_z),
{name}_r AS (SELECT iteration, {scale}::DOUBLE * sum(w * baseline) / nullif(sum(w * length), 0) AS b, {scale}::DOUBLE * sum(w * selector) / nullif(sum(w * length), 0) AS s FROM {name}_w GROUP BY 1),
{name} AS (SELECT s - b AS gain, s - CASE WHEN b < 1 THEN b + 1 ELSE b * 1.05::DOUBLE END AS safety_violation FROM {name}_r)
"""


_SPAN = "round(quantile_cont({0}, 0.025), 6) AS ci_low, round(quantile_cont({0}, 0.975), 6) AS ci_high"


def _both(totals):
    """Intervals of the recall gain over incident sequences and of the safety violation over the others."""
    gain = B.interval(B.grouped_ratio_bootstrap(totals.filter("label = 1"), seed=260_908), "gain")
    safety = B.interval(B.grouped_ratio_bootstrap(totals.filter("label = 0"), seed=260_909, scale=1000.0), "safety_violation")
    return gain, safety


@query(
    "b6_grouped_ratio_bootstrap",
    with_(
        *SEQ,
        """totals AS (SELECT seq_id, label, count(*) AS length, count(*) FILTER (WHERE baseline > 0) AS baseline, count(*) FILTER (WHERE selector > 0) AS selector FROM fin GROUP BY 1, 2)""",
        _bootstrap_sql("gain_", "SELECT * FROM totals WHERE label = 1", 260_908, 1.0),
        _bootstrap_sql("safe_", "SELECT * FROM totals WHERE label = 0", 260_909, 1000.0),
        f"SELECT 'gain' AS statistic, {_SPAN.format('gain')}, round(avg(gain), 6) AS mean FROM gain_ UNION ALL SELECT 'safety_violation', {_SPAN.format('safety_violation')}, round(avg(safety_violation), 6) FROM safe_",
    ),
)
def b6(spark, sf_dir):
    """Percentile intervals of the recall gain (incident sequences) and of the safety violation (normal ones)."""
    gain, safety = _both(cut_lineage(sequence_totals(spark, sf_dir)))
    name = lambda df, n: df.select(F.lit(n).alias("statistic"), "*")
    return TC.rounded(name(gain, "gain").unionByName(name(safety, "safety_violation")))


@query(
    "b12_study_decision",
    with_(
        *RC.CONFIRMATION, *SEQ,
        """totals AS (SELECT seq_id, label, count(*) AS length, count(*) FILTER (WHERE baseline > 0) AS baseline, count(*) FILTER (WHERE selector > 0) AS selector FROM fin GROUP BY 1, 2)""",
        _bootstrap_sql("gain_", "SELECT * FROM totals WHERE label = 1", 260_908, 1.0),
        _bootstrap_sql("safe_", "SELECT * FROM totals WHERE label = 0", 260_909, 1000.0),
        """d AS (SELECT min(effect) >= 0.01 OR (max(effect) >= 0.02 AND min(effect) >= 0) AS upper_bound FROM effects),
           e AS (SELECT (SELECT quantile_cont(gain, 0.025) FROM gain_) > 0 AND (SELECT quantile_cont(safety_violation, 0.975) FROM safe_) <= 0 AS external_check)""",
        """SELECT upper_bound, coalesce(succeeds, FALSE) AS confirmation, coalesce(external_check, FALSE) AS external_check,
                  upper_bound AND coalesce(succeeds, FALSE) AND coalesce(external_check, FALSE) AS study_succeeds FROM d CROSS JOIN e CROSS JOIN (SELECT succeeds FROM confirmed WHERE selector = 'association_abs')""",
    ),
)
def b12(spark, sf_dir):
    """The study succeeds if the upper bound, the confirmation and the external check on the final sequences do."""
    upper = B.upper_bound_gate(RC.effects(spark, sf_dir), 0.01, 0.02, gain="effect").select(F.lit("upper_bound").alias("name"), "passed")
    confirmed = RC.confirmation(spark, sf_dir).filter("selector = 'association_abs'").select(F.lit("confirmation").alias("name"), F.col("succeeds").alias("passed"))
    outside = B.external_check(*_both(cut_lineage(sequence_totals(spark, sf_dir)))).select(F.lit("external_check").alias("name"), "passed")
    return B.study_decision(upper.unionByName(confirmed).unionByName(outside), ["upper_bound", "confirmation", "external_check"])


_FRESH = """
trp AS (SELECT DISTINCT sha256(line) AS pattern FROM split WHERE split = 0),
nv AS (SELECT fin.*, trp.pattern IS NOT NULL AS overlap FROM fin LEFT JOIN trp ON trp.pattern = fin.pattern),
fresh AS (SELECT seq_id, label, count(*) AS length, count(*) FILTER (WHERE baseline > 0) AS baseline, count(*) FILTER (WHERE selector > 0) AS selector FROM nv WHERE NOT overlap GROUP BY 1, 2)
"""


@query(
    "b11_subset_sensitivity",
    with_(
        *SEQ, _FRESH,
        _bootstrap_sql("gain_", "SELECT * FROM fresh WHERE label = 1", 260_908, 1.0),
        _bootstrap_sql("safe_", "SELECT * FROM fresh WHERE label = 0", 260_909, 1000.0),
        """whole AS (SELECT count(*) FILTER (WHERE baseline > 0 OR baseline < 0)::DOUBLE / count(*) AS workload, 1000.0::DOUBLE * count(*) FILTER (WHERE label = 0 AND baseline > 0) / nullif(count(*) FILTER (WHERE label = 0), 0) AS false_rate,
                    count(DISTINCT CASE WHEN overlap THEN seq_id END) AS overlapping, count(DISTINCT seq_id) AS sequences FROM nv)""",
        f"""sums AS (SELECT count(*) AS fresh_sequences, coalesce(sum(label), 0)::BIGINT AS fresh_incident_sequences,
                    sum(selector) FILTER (WHERE label = 1) / nullif(sum(length) FILTER (WHERE label = 1), 0) - sum(baseline) FILTER (WHERE label = 1) / nullif(sum(length) FILTER (WHERE label = 1), 0) AS gain FROM fresh),
            gi AS (SELECT {_SPAN.format('gain')} FROM gain_), si AS (SELECT {_SPAN.format('safety_violation')} FROM safe_)""",
        """SELECT sequences, overlapping AS overlap_sequences, round(overlapping / sequences, 6) AS overlap_share, fresh_sequences, fresh_incident_sequences, round(gain, 6) AS fresh_recall_gain,
                  gi.ci_low AS gain_ci_low, gi.ci_high AS gain_ci_high, si.ci_low AS safety_ci_low, si.ci_high AS safety_ci_high,
                  round(workload, 6) AS baseline_workload, round(false_rate, 6) AS baseline_false_rate, false_rate * 1.05::DOUBLE > 1000 AS limit_nonbinding,
                  workload > 0.95 AS workload_nonbinding, false_rate > 900 AS escalation_nonbinding, overlapping / sequences > 0.5 AS overlap_nonbinding
           FROM whole CROSS JOIN sums CROSS JOIN gi CROSS JOIN si""",
    ),
)
def b11(spark, sf_dir):
    """Gain and safety with both bootstraps again on final sequences whose content does not occur in training, and what does not bind."""
    rows = token_predictions(spark, sf_dir)
    trained = sequences(spark, sf_dir).filter("split = 0").select("pattern").distinct()
    return TC.rounded(B.subset_sensitivity(rows, trained))


# ---- checks --------------------------------------------------------------------------------------


_EXPECTED = [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"), ("event_type", "string"), ("value", "bigint"), ("host", "string")]


@query(
    "v1_column_violations",
    with_(
        "want AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{t}')" for c, t in _EXPECTED) + ") v(name, type))",
        "have AS (SELECT column_name AS name, CASE column_type WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(column_type) END AS actual FROM (DESCRIBE events))",
        """filled AS (UNPIVOT (SELECT count(event_id) AS event_id, count(ts) AS ts, count(user_id) AS user_id, count(event_type) AS event_type, count("value") AS "value", count(props) AS props FROM events)
                     ON COLUMNS(*) INTO NAME name VALUE n)""",
        """SELECT coalesce(h.name, w.name) AS "column", CASE WHEN h.name IS NULL THEN 'missing' WHEN w.name IS NULL THEN 'unexpected' ELSE 'type' END AS problem, coalesce(n, 0) AS filled
           FROM have h FULL JOIN want w ON h.name = w.name LEFT JOIN filled f ON f.name = h.name WHERE h.name IS NULL OR w.name IS NULL OR type <> actual""",
    ),
)
def v1(spark, sf_dir):
    """The events table against a schema that misses one of its columns, wants one that it lacks and another type of a third."""
    return V.column_violations(A.read_table(spark, sf_dir, "events"), spark.createDataFrame(_EXPECTED, "column string, type string"))



@query(
    "v2_null_counts",
    with_(
        ALERTS,
        """SELECT 'row_id' AS "column", count(*) FILTER (WHERE row_id IS NULL) AS nulls FROM alerts UNION ALL SELECT 'event_key', count(*) FILTER (WHERE event_key IS NULL) FROM alerts
           UNION ALL SELECT 'event_incident_group', count(*) FILTER (WHERE event_incident_group IS NULL) FROM alerts""",
    ),
)
def v2(spark, sf_dir):
    return V.null_counts(TC.alerts(spark, sf_dir), ["row_id", "event_key", "event_incident_group"])


@query(
    "v3_row_count_differences",
    with_(
        KEYED,
        "e AS (SELECT scenario, count(*) FILTER (WHERE value <= 300) AS expected, count(*) AS actual FROM keyed GROUP BY 1)",
        "SELECT coalesce(scenario, '__all__') AS scenario, sum(expected)::BIGINT AS expected, sum(actual)::BIGINT AS actual FROM e GROUP BY ROLLUP (scenario) HAVING sum(expected) <> sum(actual)",
    ),
)
def v3(spark, sf_dir):
    keyed = A.keyed_events(TC.events(spark, sf_dir))
    expected = keyed.filter("value <= 300").groupBy("scenario").agg(F.count("*").alias("expected"))
    return V.row_count_differences(keyed, expected)


@query(
    "v4_domain_violations",
    with_(
        ALERTS,
        """SELECT 'binary label' AS "check", count(*) FILTER (WHERE event_incident NOT IN (0, 1)) AS violations FROM alerts
           UNION ALL SELECT 'known detector', count(*) FILTER (WHERE detector NOT IN ('AMiner', 'Suricata')) FROM alerts
           UNION ALL SELECT 'group only for incidents', count(*) FILTER (WHERE (event_incident_group IS NOT NULL) <> (event_incident = 1)) FROM alerts""",
    ),
)
def v4(spark, sf_dir):
    """One detector is left out of the allowed set, so that violations show."""
    return V.violation_counts(TC.alerts(spark, sf_dir), {
        "binary label": F.col("event_incident").isin(0, 1),
        "known detector": F.col("detector").isin("AMiner", "Suricata"),
        "group only for incidents": F.col("event_incident_group").isNotNull() == (F.col("event_incident") == 1),
    })


@query(
    "v5_row_id_density",
    "SELECT min(event_id) AS lowest, max(event_id) AS highest, count(*) AS rows, count(DISTINCT event_id) AS ids, min(event_id) = 0 AND max(event_id) = count(*) - 1 AND count(DISTINCT event_id) = count(*) AS dense FROM events",
)
def v5(spark, sf_dir):
    return V.row_id_density(A.keyed_events(TC.events(spark, sf_dir)))


@query("v6_ids_outside", with_(ALERTS, "SELECT row_id, event_id FROM alerts WHERE event_id NOT IN (SELECT event_id FROM vocab WHERE event_key NOT LIKE 'view%')"))
def v6(spark, sf_dir):
    rows = TC.alerts(spark, sf_dir)
    kept = A.sorted_vocabulary(A.keyed_events(TC.events(spark, sf_dir))).filter("event_key NOT LIKE 'view%'")
    return V.ids_outside(rows.select("row_id", "event_id"), "event_id", kept, "event_id")


@query(
    "v7_fold_overlaps",
    with_(KEYED, FOLDS, "SELECT test_scenario, scenario, 2 AS roles FROM folds WHERE test_scenario = 's3' AND role = 'validation'"),
)
def v7(spark, sf_dir):
    """The validation scenario of one fold is added to its training set, so that the overlap shows."""
    table = TC.folds(spark, sf_dir)
    leak = table.filter("test_scenario = 's3' AND role = 'validation'").withColumn("role", F.lit("train"))
    return V.fold_overlaps(table.unionByName(leak))


_V12 = " || ".join(
    f"length(coalesce({c}::VARCHAR, '\\N'))::VARCHAR || ':' || coalesce({c}::VARCHAR, '\\N')"
    for c in ("event_incident", "event_key", "machine", "row_id", "scenario", "timestamp")
)


@query(
    "v12_table_fingerprint",
    with_(
        ALERTS, f"h AS (SELECT ('0x' || substr(md5({_V12}), 1, 15))::BIGINT AS h FROM alerts)",
        "SELECT count(*) AS rows, bit_xor(h) AS hash_xor, sum(h)::VARCHAR AS hash_sum FROM h",
    ),
)
def v12(spark, sf_dir):
    return V.table_fingerprint(TC.alerts(spark, sf_dir).select("row_id", "scenario", "machine", "timestamp", "event_key", "event_incident"))
