"""Registered queries: the streaming operators, run to completion over the event table as a file stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertweave.catalog import training as TC
from alertweave.catalog.registry import query, with_
from alertweave.catalog.sources import scratch
from alertweave.catalog.sqltext import ALERTS, INTERVALS, history
from alertweave.operators import context as C
from alertweave.sources import alerts as A
from alertweave.streaming import contexts as X


def event_stream(spark, sf_dir):
    """The table as a file stream, whether it is one file or a folder of part files (a pattern may match either)."""
    return spark.readStream.schema(TC.events(spark, sf_dir).schema).parquet(f"{sf_dir}/event[s].parquet")


def run_to_end(spark, stream, name, out=None):
    """Write everything available to a folder, fail if a row came late, and read the folder back."""
    out = out or scratch(spark, name)
    job = (
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{out}-state")
        .trigger(availableNow=True).start(out)
    )
    job.awaitTermination()
    if late := X.late_rows(job):
        raise RuntimeError(f"{name}: {late} rows behind the watermark")
    return spark.read.schema(stream.schema).parquet(out)


@query(
    "x1_stream_strict_past_context",
    with_(ALERTS, history(10), "SELECT a.row_id, array_to_string([x.e for x in c], ' ') AS context FROM alerts a JOIN ctx USING (row_id)"),
)
def x1(spark, sf_dir):
    """All alerts, in whatever order the files hold them: the delay is the span of the table, and a second input closes it."""
    X.use_state_store(spark)
    static = A.keyed_events(TC.events(spark, sf_dir))
    span = static.agg(F.min("timestamp").alias("low"), F.max("timestamp").alias("high")).first()
    vocabulary = A.sorted_vocabulary(static)
    columns = ("machine", "timestamp", "row_id", "event_id")
    alerts = A.keyed_events(event_stream(spark, sf_dir)).join(vocabulary, "event_key").select(*columns)
    seconds = int(span["high"] - span["low"]) + 1 if span["low"] is not None else 1
    end = X.closing_row(spark, (span["high"] or 0) + seconds + 1)
    closing = scratch(spark, "closing")
    end.limit(0).write.parquet(closing)
    both = alerts.unionByName(spark.readStream.schema(end.schema).parquet(closing))
    stream = X.stream_strict_past_context(both, delay=f"{seconds} seconds")
    out = scratch(spark, "x1")
    run_to_end(spark, stream, "x1", out)
    end.write.mode("append").parquet(closing)
    got = run_to_end(spark, stream, "x1", out)
    return got.select("row_id", C.joined("context").alias("context"))


@query("x2_stream_label_by_interval", with_(ALERTS, INTERVALS, TC._ATTACK, "SELECT row_id, attack_id FROM labelled"))
def x2(spark, sf_dir):
    alerts = A.keyed_events(event_stream(spark, sf_dir)).select("row_id", "scenario", "timestamp")
    labelled = X.stream_label_by_interval(alerts, TC.intervals(spark, sf_dir))
    return run_to_end(spark, labelled, "x2").select("row_id", F.col("attack_id"))
