"""Sinks. Each takes a DataFrame and a path and returns the path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertweave.functions import encode as E

# The columns of the canonical alert table.
CANONICAL_COLUMNS = (
    "row_id", "scenario", "source_row", "timestamp", "machine", "host", "ip", "detector", "event_key", "event_id", "name",
    "time_label", "event_label", "event_incident", "window_incident", "event_incident_group", "window_incident_group",
)


def canonical_alerts(rows: DataFrame) -> DataFrame:
    """Per-scenario CSV alerts (`read_alert_csv`) as the canonical table."""
    from alertweave.operators.vocabulary import dense_row_id
    from alertweave.sources.alerts import sorted_vocabulary

    scenario = F.col("scenario")
    event, window = E.event_incident(F.col("event_label")), E.window_incident(F.col("time_label"))
    keyed = dense_row_id(rows).withColumn("event_key", F.col("short"))
    return keyed.join(sorted_vocabulary(keyed), "event_key").select(
        "row_id", "scenario", "source_row",
        F.col("time").alias("timestamp"),
        E.machine_key(scenario, F.col("host")).alias("machine"),
        "host", "ip",
        E.detector_of(F.col("event_key")).alias("detector"),
        "event_key", "event_id", "name", "time_label", "event_label",
        event.alias("event_incident"),
        window.alias("window_incident"),
        E.incident_group(scenario, event, F.col("event_label")).alias("event_incident_group"),
        E.incident_group(scenario, window, F.col("time_label"), stages=None).alias("window_incident_group"),
    )


def write_canonical(alerts: DataFrame, path: str) -> str:
    alerts.write.mode("overwrite").option("compression", "zstd").partitionBy("scenario").parquet(path)
    return path


def write_processed_events(events: DataFrame, path: str, reuse: bool = True) -> str:
    """`timestamp, machine, event, label` CSV; with `reuse` an existing output is kept."""
    rows = events.select("timestamp", "machine", "event", "label")
    rows.write.mode("ignore" if reuse else "overwrite").csv(path, header=True)
    return path


def write_contexts(contexts: DataFrame, path: str, buckets: int = 64) -> str:
    """Context arrays clustered by machine, so that later per-machine reads prune files.

    The hash of the row spreads one machine over `buckets` files.
    """
    spread = F.pmod(F.xxhash64("row_id"), F.lit(buckets))
    contexts.repartition(F.col("machine"), spread).sortWithinPartitions("machine", "timestamp").write.mode("overwrite").parquet(path)
    return path


def report_rows(
    rows: DataFrame, code: str, code_name: str, mapping: DataFrame, meaning: Column, extra: tuple[str, ...] = ()
) -> DataFrame:
    """`sequence_index, internal_event_id, original_event_id, <code>, meaning, true_label` plus `extra`.

    `rows` has `sequence_index, event_id, label`; `mapping` has `event_id, original`.
    """
    named = rows.join(mapping, "event_id", "left")
    return named.select(
        "sequence_index",
        F.col("event_id").alias("internal_event_id"),
        E.original_event_id(F.col("event_id"), F.col("original"), 0).alias("original_event_id"),
        F.col(code).alias(code_name),
        meaning.alias("meaning"),
        F.col("label").alias("true_label"),
        *extra,
    )


def write_report(report: DataFrame, path: str) -> str:
    """A report grows with the alerts, so it stays a folder of part files."""
    report.write.mode("overwrite").csv(path, header=True)
    return path


def summary_document(parts: dict[str, DataFrame]) -> DataFrame:
    """One row with one struct per part; each part has one row."""
    document = None
    for name, part in parts.items():
        one = part.select(F.struct(*part.columns).alias(name), F.lit(1).alias("_one"))
        document = one if document is None else document.join(one, "_one")
    return document.drop("_one")


def write_summary(document: DataFrame, path: str) -> str:
    document.coalesce(1).write.mode("overwrite").json(path)
    return path


def write_mapping(mapping: DataFrame, path: str) -> str:
    mapping.coalesce(1).write.mode("overwrite").json(path)
    return path


def label_legend(intervals: DataFrame) -> DataFrame:
    from alertweave.operators.joins import attack_dictionary

    return attack_dictionary(intervals).select("attack_id", F.col("attack").alias("name"))


def write_comparison(rows: DataFrame, deltas: DataFrame, path: str) -> dict[str, str]:
    """Rows and deltas of compared runs, each as CSV and JSON."""
    written = {}
    for name, frame in {"rows": rows, "deltas": deltas}.items():
        small = frame.coalesce(1)
        small.write.mode("overwrite").csv(f"{path}/{name}_csv", header=True)
        small.write.mode("overwrite").json(f"{path}/{name}_json")
        written[name] = f"{path}/{name}_csv"
    return written


def run_documents(records: DataFrame, keys: tuple[str, ...], metrics: tuple[str, ...]) -> DataFrame:
    """Records as one nested document per run: identity, status and its operating points in grid order."""
    point = F.struct("grid_order", "eps", "threshold", "split", *metrics)
    return records.groupBy(*keys).agg(
        F.lit("complete").alias("status"), F.sort_array(F.collect_list(point)).alias("operating_points")
    )
