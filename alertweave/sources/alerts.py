"""The canonical alerts view over an event stream table, and its derived inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alertweave.functions import encode as E

# Detector names by first letter of this table's event types.
EVENT_DETECTORS = {"c": "AMiner", "e": "AMiner", "p": "Suricata", "s": "Suricata", "v": "Wazuh"}
SLOT_SECONDS = 900
INTERVAL_SECONDS = 7_200


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def keyed_events(events: DataFrame) -> DataFrame:
    """Event rows with scenario, machine, whole-second timestamp and event key."""
    epoch = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    scenario = F.concat(F.lit("s"), (F.col("user_id") % 8).cast("string"))
    incident = F.when(F.col("value") > 100, 1).otherwise(0)
    return events.select(
        F.col("event_id").alias("row_id"),
        scenario.alias("scenario"),
        E.machine_key(scenario, F.concat(F.lit("m"), (F.col("user_id") % 24).cast("string"))).alias("machine"),
        (F.floor(epoch / SLOT_SECONDS) * SLOT_SECONDS).alias("timestamp"),
        F.concat_ws(":", "event_type", (F.get_json_object("props", "$.k").cast("int") % 8).cast("string")).alias("event_key"),
        "event_type",
        "user_id",
        "value",
        incident.alias("event_incident"),
        E.incident_group(scenario, incident, F.col("event_type"), stages=None).alias("event_incident_group"),
    )


def sorted_vocabulary(keys: DataFrame, column: str = "event_key", name: str = "event_id") -> DataFrame:
    """Sorted distinct keys with dense ids. The window runs over the dictionary, not over rows."""
    return keys.select(column).distinct().select(
        column, (F.row_number().over(Window.orderBy(column)) - 1).cast("int").alias(name)
    )


def alerts_view(events: DataFrame) -> DataFrame:
    keyed = keyed_events(events)
    return keyed.join(sorted_vocabulary(keyed), "event_key").withColumn(
        "detector", E.detector_of(F.col("event_key"), EVENT_DETECTORS)
    )


def load_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts_view(read_table(spark, sf_dir, "events"))


def attack_intervals(events: DataFrame) -> DataFrame:
    """`scenario, attack, start, end, position`: one interval per very large value."""
    return (
        keyed_events(events)
        .filter("value > 300")
        .select(
            "scenario",
            F.col("event_type").alias("attack"),
            F.col("timestamp").alias("start"),
            (F.col("timestamp") + INTERVAL_SECONDS).alias("end"),
            F.col("row_id").alias("position"),
        )
    )


def window_labelled(alerts: DataFrame, intervals: DataFrame) -> DataFrame:
    """Alerts with `attack_id` from the intervals and the derived `window_incident`."""
    from alertweave.operators.joins import label_by_interval

    labelled = label_by_interval(alerts, intervals)
    return labelled.withColumn("window_incident", F.when(F.col("attack_id") >= 0, 1).otherwise(0))


def document_lines(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """An event-sequence corpus from texts: `seq_id, source, label, line` with one token per word, its length."""
    words = F.split("text", "[ \n]+")
    toxic = F.coalesce("toxic", F.lit(0))
    source = F.when(F.col("doc_id") % 10 < 3, "train").when(toxic == 1, "test_abnormal").otherwise("test_normal")
    return documents.join(labels.select("doc_id", "toxic"), "doc_id", "left").select(
        F.col("doc_id").alias("seq_id"),
        source.alias("source"),
        toxic.alias("label"),
        F.array_join(F.transform(words, lambda w: F.length(w).cast("string")), " ").alias("line"),
    )
