"""Order-based building blocks that never sort a whole group in one task."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertweave.session import cut_lineage


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: dict[str, Column],
) -> DataFrame:
    """Exclusive running sums per `keys` in `order`, for groups of any size.

    Rows are range-partitioned on (keys, order), so a hot group spreads over as
    many partitions as its size asks for. The partition numbers are fixed by a
    checkpoint, per-partition totals give each slice its starting value (at most
    one row per slice), and a window inside the slice adds the rest. `order`
    must be unique within `keys`.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(
        df.select("*", *[expr.alias(f"_v_{name}") for name, expr in sums.items()])
        .repartitionByRange(parts, *keys, *order)
        .withColumn("_slice", F.spark_partition_id())
    )
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy(*keys, "_slice").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    starts = starts.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_slice").alias("_s"),
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums],
    )
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.select(
        "*", *[F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)).alias(f"_l_{n}") for n in sums]
    )
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_slice") == F.col("_s")]
    condition = on[0]
    for extra in on[1:]:
        condition = condition & extra
    joined = local.join(starts, condition)
    return joined.select(*df.columns, *[(F.col(f"_o_{n}") + F.col(f"_l_{n}")).alias(n) for n in sums])


def running_position(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "position") -> DataFrame:
    """Dense 0-based position per `keys` in `order` (distributed `row_number() - 1`)."""
    return running_sums(df, keys, order, {name: F.lit(1).cast("long")})


def order_cut(df: DataFrame, keys: Sequence[str], want: str, levels: Sequence[Column]) -> DataFrame:
    """Per `keys`, the level values of the row at 1-based rank `want`.

    `levels` refine each other from coarse to unique in sort order. Each level is
    one map-side-combined count over the rows that still match; only the counts
    are windowed. The input is read twice: for the first counts, and for the rows
    of the one cell they pick, which are kept for the finer levels. Groups with
    fewer than `want` rows give no row.
    """
    names = [f"_lv{i}" for i in range(len(levels))]
    rows = df.select(*keys, F.col(want).alias("_want"), *[c.alias(n) for c, n in zip(levels, names)])
    live, picked = rows, None
    for depth, level in enumerate(names):
        head = list(keys) + names[: depth + 1]
        counts = live.groupBy(*head).agg(F.count("*").alias("_n"), F.max("_want").alias("_want"))
        up_to = Window.partitionBy(*keys, *names[:depth]).orderBy(level).rowsBetween(Window.unboundedPreceding, 0)
        running = counts.withColumn("_cum", F.sum("_n").over(up_to))
        picked = running.filter((F.col("_cum") >= F.col("_want")) & (F.col("_cum") - F.col("_n") < F.col("_want")))
        picked = picked.select(*head, (F.col("_want") - F.col("_cum") + F.col("_n")).alias("_left"))
        if depth + 1 < len(names):
            source = rows if depth == 0 else live
            live = source.drop("_want").join(picked.withColumnRenamed("_left", "_want"), head)
            live = cut_lineage(live) if depth == 0 else live
    return picked.select(*keys, F.struct(*names).alias("_cut"))


def whole_cut(df: DataFrame, want: Callable[[Column], Column], levels: Sequence[Column]) -> Column | None:
    """The level values of the row at 1-based rank `want(number of rows)` of the whole table, as a constant struct.

    `levels` as in `order_cut`, and the input is read twice likewise. One row per level comes to the driver and narrows the next.
    None if there is no such row.
    """
    names = [f"_lv{i}" for i in range(len(levels))]
    live = df.select(*[c.alias(n) for c, n in zip(levels, names)])
    types = dict(live.dtypes)
    found, left = [], None
    for depth, level in enumerate(names):
        counts = live.groupBy(level).agg(F.count("*").alias("_n"))
        up_to = Window.orderBy(level).rowsBetween(Window.unboundedPreceding, 0)
        running = counts.withColumn("_cum", F.sum("_n").over(up_to)).withColumn("_all", F.sum("_n").over(Window.partitionBy()))
        rank = want(F.col("_all")) if left is None else F.lit(left)
        picked = running.filter((F.col("_cum") >= rank) & (F.col("_cum") - F.col("_n") < rank)).select(level, (rank - F.col("_cum") + F.col("_n")).alias("_left")).first()
        if picked is None:
            return None
        found.append(F.lit(picked[level]).cast(types[level]))
        live, left = live.filter(F.col(level) == found[-1]), picked["_left"]
        live = cut_lineage(live) if depth == 0 and len(names) > 1 else live
    return F.struct(*[v.alias(n) for v, n in zip(found, names)])


def take_smallest(df: DataFrame, keys: Sequence[str], want: str, levels: Sequence[Column]) -> DataFrame:
    """Flag `taken`: the first `want` rows per `keys` in the order given by `levels`.

    `want` is a column, constant within a group. All rows are kept.
    """
    cuts = order_cut(df.filter(F.col(want) > 0), keys, want, levels)
    position = F.struct(*[c.alias(f"_lv{i}") for i, c in enumerate(levels)])
    if keys:
        joined = df.join(cuts, list(keys), "left")
    else:
        joined = df.withColumn("_one", F.lit(1)).join(cuts.withColumn("_one", F.lit(1)), "_one", "left").drop("_one")
    taken = F.when(F.col(want) <= 0, F.lit(False)).otherwise(F.col("_cut").isNull() | (position <= F.col("_cut")))
    return joined.withColumn("taken", taken).drop("_cut")


#: Spark's limit for ranked filters that run before the shuffle (spark.sql.optimizer.windowGroupLimitThreshold); both ways give the same rows.
_MAP_SIDE_LIMIT = 1_000


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], levels: Sequence[Column], want: int) -> DataFrame:
    """The first `want` rows per `keys` in `order`.

    Small limits use a ranked filter, which Spark applies per map task before the
    shuffle; larger ones find the cut row from counts over `levels` (the same
    order, refined from coarse to unique).
    """
    if want <= _MAP_SIDE_LIMIT:
        ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
        return ranked.filter(F.col("_rank") <= want).drop("_rank")
    flagged = take_smallest(df.withColumn("_take", F.lit(want)), keys, "_take", levels)
    return flagged.filter("taken").drop("taken", "_take")
