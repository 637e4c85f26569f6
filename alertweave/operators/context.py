"""Context windows: the alerts that precede each alert.

Two properties hold for every operator here. A context is an array of slot
structs, oldest first, that carries its payload, so no later lookup by row id is
needed. And no task depends on the size of one machine, scenario or timestamp:
strict operators first keep the newest `n` rows of each (machine, second), which
bounds a one-timeout chunk by its number of seconds; arrival operators cut each
machine into chunks of equal row counts. Either way the neighbouring chunk lends
its last rows ("halo"), which is all the history a chunk can need.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertweave.operators.ordering import running_position

_CHUNK_ROWS = 100_000


def _slot(payload: Sequence[str]) -> Column:
    return F.struct("timestamp", "row_id", *payload)


def _newest(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    # row_number() <= n is pre-limited on the map side (window group limit)
    newest_first = Window.partitionBy(*keys).orderBy(F.desc("timestamp"), F.desc("row_id"))
    return df.withColumn("_rank", F.row_number().over(newest_first)).filter(F.col("_rank") <= n).drop("_rank")


def strict_past_seconds(
    alerts: DataFrame, n: int = 10, timeout: int = 86_400, payload: Sequence[str] = ("event_id",), name: str = "context"
) -> DataFrame:
    """`machine, timestamp, <name>`: the strict-past context of every second of a machine that holds an alert.

    What follows from the context alone is worked out here, once a second, and then joined to the alerts.
    """
    base = alerts.select("machine", "timestamp", "row_id", *payload)
    recent = _newest(base, ["machine", "timestamp"], n)
    recent = recent.withColumn("_chunk", F.floor(F.col("timestamp") / F.lit(max(int(timeout), 1))))
    halo = _newest(recent, ["machine", "_chunk"], n).withColumn("_chunk", F.col("_chunk") + 1)
    rows = recent.withColumn("_halo", F.lit(False)).unionByName(halo.withColumn("_halo", F.lit(True)))
    order = Window.partitionBy("machine", "_chunk").orderBy("timestamp", "row_id")
    return (
        rows.select(
            "machine",
            "timestamp",
            "_halo",
            F.lag("timestamp").over(order).alias("_before"),
            F.collect_list(_slot(payload)).over(order.rowsBetween(-n, -1)).alias("_past"),
        )
        .filter(~F.col("_halo") & ~F.col("_before").eqNullSafe(F.col("timestamp")))
        .select(
            "machine",
            "timestamp",
            F.filter("_past", lambda x: F.col("timestamp") - x["timestamp"] <= timeout).alias(name),
        )
    )


def strict_past_context(
    alerts: DataFrame,
    n: int = 10,
    timeout: int = 86_400,
    payload: Sequence[str] = ("event_id",),
    name: str = "context",
) -> DataFrame:
    """Per machine, the last `n` alerts strictly earlier and at most `timeout` old.

    All alerts of one second share one context. `n` may be any pool depth.
    """
    return alerts.join(strict_past_seconds(alerts, n, timeout, payload, name), ["machine", "timestamp"])


def strict_past_candidates(alerts: DataFrame, cap: int = 100, timeout: int = 86_400, payload: Sequence[str] = ("event_id",)) -> DataFrame:
    """The deep candidate pool: as the strict-past context, `cap` slots."""
    return strict_past_context(alerts, cap, timeout, payload, "candidates")


def _positional_history(rows: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, slot: Column, name: str) -> DataFrame:
    """Last `n` slots before each row in arrival order, chunked by position."""
    placed = running_position(rows, keys, order, "_pos")
    size = max(_CHUNK_ROWS, 4 * n)
    placed = placed.withColumn("_chunk", F.floor(F.col("_pos") / size)).withColumn("_halo", F.lit(False))
    halo = placed.filter(F.col("_pos") % size >= size - n).withColumn("_chunk", F.col("_chunk") + 1)
    every = placed.unionByName(halo.withColumn("_halo", F.lit(True)))
    window = Window.partitionBy(*keys, "_chunk").orderBy("_pos").rowsBetween(-n, -1)
    return every.withColumn(name, F.collect_list(slot).over(window)).filter(~F.col("_halo")).drop("_halo", "_chunk", "_pos")


def arrival_context(alerts: DataFrame, n: int = 10, payload: Sequence[str] = ("event_id",), name: str = "context") -> DataFrame:
    """Per machine, the last `n` alerts by arrival; ties visible, no age limit."""
    return _positional_history(alerts, ["machine"], ["timestamp", "row_id"], n, _slot(payload), name)


def short_long_context(
    alerts: DataFrame,
    short: int = 10,
    long: int = 8,
    limit: int = 64,
    window: int = 86_400,
    strategy: str = "recent_distinct",
) -> DataFrame:
    """`long_memory` landmarks of the older history and the `short_context` suffix.

    History is the last `short + limit` arrivals of the machine that are at most
    `window` old; landmarks come from what precedes the short suffix.
    """
    from alertweave.operators.select import LANDMARKS

    history = arrival_context(alerts, short + limit, name="_history")
    fresh = F.transform(
        F.filter("_history", lambda x: F.col("timestamp") - x["timestamp"] <= window), lambda x: x["event_id"]
    )
    history = history.withColumn("_fresh", fresh)
    keep = F.least(F.lit(short), F.size("_fresh"))
    older = F.slice("_fresh", F.lit(1), F.size("_fresh") - keep)
    return (
        history.withColumn("short_context", F.slice("_fresh", F.size("_fresh") - keep + 1, keep))
        .withColumn("long_memory", LANDMARKS[strategy](older, long))
        .drop("_history", "_fresh")
    )


def companion_context(
    alerts: DataFrame,
    k: int = 5,
    window: int = 3_600,
    payload: Sequence[str] = ("event_id",),
    name: str = "companions",
) -> DataFrame:
    """Last `k` alerts of the scenario on other machines, strictly earlier, within `window` seconds.

    Within a chunk the scenario's alerts form islands of one machine each.
    Neighbouring islands differ in machine, so among the last 2k islands at least
    k belong to other machines: their final k rows, plus the open island's own
    tail, hold every slot that can be chosen.
    """
    slot_columns = ["timestamp", "row_id", "machine", *payload]
    base = alerts.select("scenario", "machine", "timestamp", "row_id", *payload)
    recent = _newest(base, ["scenario", "machine", "timestamp"], k)
    recent = recent.withColumn("_chunk", F.floor(F.col("timestamp") / F.lit(max(int(window), 1))))
    halo = _newest(recent, ["scenario", "machine", "_chunk"], k).withColumn("_chunk", F.col("_chunk") + 1)
    rows = recent.withColumn("_halo", F.lit(False)).unionByName(halo.withColumn("_halo", F.lit(True)))

    chunk = ["scenario", "_chunk"]
    order = Window.partitionBy(*chunk).orderBy("timestamp", "row_id")
    opens = F.when(F.lag("machine").over(order).eqNullSafe(F.col("machine")), 0).otherwise(1)
    marked = rows.withColumn("_opens", opens)
    marked = marked.withColumn("_island", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(*chunk, "_island").orderBy("timestamp", "row_id")
    marked = marked.withColumn("_tail", F.collect_list(F.struct(*slot_columns)).over(inside.rowsBetween(-(k - 1), 0)))

    tails = marked.groupBy(*chunk, "_island").agg(F.max_by("_tail", F.struct("timestamp", "row_id")).alias("_final"))
    by_island = Window.partitionBy(*chunk).orderBy("_island")
    earlier = tails.select(
        *chunk, "_island", F.flatten(F.collect_list("_final").over(by_island.rowsBetween(-2 * k, -1))).alias("_earlier")
    )
    # the first row of a second sees what the row before it saw, plus that row
    previous = marked.select(
        *chunk,
        "machine",
        "timestamp",
        "row_id",
        "_halo",
        F.lag("_tail").over(order).alias("_open_tail"),
        F.lag("_island").over(order).alias("_island"),
        F.lag("timestamp").over(order).alias("_before"),
    )
    seconds = previous.filter(~F.col("_before").eqNullSafe(F.col("timestamp"))).select(
        *chunk, "timestamp", "_open_tail", "_island"
    )
    pools = seconds.join(earlier, [*chunk, "_island"], "left").select(
        "scenario",
        "timestamp",
        F.concat(
            F.coalesce("_earlier", F.array().cast(earlier.schema["_earlier"].dataType)),
            F.coalesce("_open_tail", F.array().cast(marked.schema["_tail"].dataType)),
        ).alias("_pool"),
        "_chunk",
    )
    # a halo second also appears in its own chunk; keep that one
    pools = pools.filter(F.col("_chunk") == F.floor(F.col("timestamp") / F.lit(max(int(window), 1)))).drop("_chunk")
    others = F.filter(
        "_pool",
        lambda x: (x["machine"] != F.col("machine")) & (F.col("timestamp") - x["timestamp"] <= window),
    )
    joined = alerts.join(pools, ["scenario", "timestamp"]).withColumn("_other", F.array_sort(others))
    keep = F.least(F.lit(k), F.size("_other"))
    picked = F.slice("_other", F.size("_other") - keep + 1, keep)
    slots = F.transform(picked, lambda x: F.struct(x["timestamp"].alias("timestamp"), x["row_id"].alias("row_id"), *[x[p].alias(p) for p in payload]))
    return joined.withColumn(name, slots).drop("_pool", "_other")


def preceding_windows(tokens: Column, width: int) -> Column:
    """For every position of a token array, the up-to-`width` tokens before it."""
    return F.transform(
        F.sequence(F.lit(1), F.size(tokens)),
        lambda i: F.slice(tokens, F.greatest(i - width, F.lit(1)), F.least(i - 1, F.lit(width))),
    )


def tie_groups(alerts: DataFrame) -> DataFrame:
    """Seconds of a machine that hold more than one alert."""
    return alerts.groupBy("machine", "timestamp").agg(F.count("*").alias("rows")).filter("rows > 1")


def context_span(context: Column, timestamp: Column) -> Column:
    """Seconds from the oldest slot to the target; null for an empty context."""
    return timestamp - F.try_element_at(context, F.lit(1))["timestamp"]


def ids(context: Column, field: str = "event_id") -> Column:
    return F.transform(context, lambda x: x[field])


def left_pad(values: Column, width: int, pad: Column | int) -> Column:
    fill = pad if isinstance(pad, Column) else F.lit(pad)
    return F.concat(F.array_repeat(fill, F.lit(width) - F.size(values)), values)


def joined(values: Column) -> Column:
    """Array as a space-separated string, for display and comparison."""
    return F.array_join(F.transform(values, lambda v: v.cast("string")), " ")
