"""Dictionaries by order of arrival, closed encodings and dense ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertweave.operators.ordering import running_position


def token(scope: str, machine: str = "machine", event: str = "event_id") -> Column:
    """Vocabulary key: the event, or machine and event joined by a vertical bar."""
    if scope == "event":
        return F.col(event).cast("string")
    if scope == "machine_event":
        return F.concat_ws("|", F.col(machine), F.col(event).cast("string"))
    raise ValueError(f"unknown token scope {scope!r}")


def arrival_vocabulary(alerts: DataFrame, scope: str = "event") -> DataFrame:
    """`token, token_id`: ids from 1 in first-seen order (0 is the empty slot)."""
    first = alerts.groupBy(token(scope).alias("token")).agg(F.min(F.struct("timestamp", "row_id")).alias("first"))
    placed = running_position(first, [], ["first"], "_pos")
    return placed.select("token", (F.col("_pos") + 1).alias("token_id"))


def encode_closed(alerts: DataFrame, vocabulary: DataFrame, scope: str = "event", strict: bool = False) -> DataFrame:
    """Encode with a fixed vocabulary. Unseen tokens are flagged, or fail the job when `strict`."""
    joined = alerts.withColumn("token", token(scope)).join(vocabulary, "token", "left")
    if strict:
        message = F.concat(F.lit("token not in the training vocabulary: "), F.col("token"))
        checked = F.when(F.col("token_id").isNull(), F.raise_error(message)).otherwise(F.col("token_id"))
        return joined.withColumn("token_id", checked)
    return joined.withColumn("unseen", F.col("token_id").isNull())


def dense_row_id(rows: DataFrame, source_row: str = "source_row") -> DataFrame:
    """`row_id` = rows of the scenarios before + position in the own scenario; no sort of the rows."""
    before = Window.orderBy("scenario").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("scenario").agg(F.count("*").alias("_n"))
    offsets = sizes.select("scenario", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return rows.join(offsets, "scenario").withColumn("row_id", F.col("_offset") + F.col(source_row)).drop("_offset")


def group_codes(rows: DataFrame, column: str, name: str = "code") -> DataFrame:
    """Sorted distinct group -> code, null -> -1. The window runs over the distinct groups."""
    groups = rows.select(column).filter(F.col(column).isNotNull()).distinct()
    codes = groups.select(column, (F.row_number().over(Window.orderBy(column)) - 1).alias(name))
    return rows.join(codes, column, "left").withColumn(name, F.coalesce(name, F.lit(-1)))
