"""Sharding by sampled splitters (DataFrame functions only): shards of near equal bytes, in key order.

A size-weighted sample of keys gives quantile boundaries; records fall into
the ranges between them. Ranges with too many bytes or rows are subdivided by a
second hash, which also cuts apart copies of one text. Bytes and rows before
each piece come from its totals, so a record's place follows from its rank
inside its own piece, and no task sees more than one piece.

Defined cases: a null text counts one byte; doc_id may be null or repeated;
identical rows are interchangeable; an empty table gives an empty result.
Columns that the result names replace columns of the input with the same name.
"""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alertweave.llm.common import balanced_sum, stored

#: Ranges cut by the sample, and keys drawn for each of them.
RANGES = 128
KEYS_PER_RANGE = 32
#: A piece of a range holds so many rows at most, on average.
PIECE_ROWS = 500_000


def _keyed(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    body = F.coalesce(docs[text], F.lit(""))
    return docs.withColumns({
        "size": (F.octet_length(body) + 1).cast("long"),
        "text_crc32": F.crc32(body.cast("binary")),
        "_first": F.xxhash64(body),
        "_second": F.xxhash64(docs[id_column], F.lit(1), body),
    })


def _boundaries(keys: DataFrame) -> list[int]:
    """Quantile boundaries of a weighted sample: the smallest of -ln(u) / size, with u from a hash of the record."""
    uniform = (F.pmod(F.xxhash64("_second", F.lit("draw")), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    drawn = (
        keys.select("_first", "_second", (-F.log(uniform) / F.col("size")).alias("_priority"))
        .orderBy("_priority", "_first", "_second")
        .limit(RANGES * KEYS_PER_RANGE)
    )
    quantiles = [i / RANGES for i in range(1, RANGES)]
    found = drawn.agg(F.percentile_approx("_first", quantiles, 1_000_000).alias("q")).first()["q"] or []
    return sorted(set(found))


def shard_records(docs: DataFrame, shards: int = 8, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with size, text_crc32, shard and slot; shard s takes the records whose middle lies in bytes [s, s+1) / shards of all."""
    given = [c for c in docs.columns if c not in {"size", "text_crc32", "shard", "slot"}]
    docs = docs.select(*given)
    keys = stored(_keyed(docs, id_column, text).select("_first", "_second", "size"))
    splitters = _boundaries(keys)
    in_range = balanced_sum([(F.col("_first") >= F.lit(b)).cast("int") for b in splitters] + [F.lit(0)])
    ranged = keys.withColumn("_range", in_range)
    totals = {r["_range"]: (r["b"], r["n"]) for r in ranged.groupBy("_range").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()}
    all_bytes, all_rows = (sum(t[i] for t in totals.values()) for i in (0, 1))
    fair_bytes, fair_rows = max(1, 2 * all_bytes // RANGES), max(1, min(PIECE_ROWS, 2 * all_rows // RANGES))
    parts = [max(1, ceil(b / fair_bytes), ceil(n / fair_rows)) for b, n in (totals.get(r, (0, 0)) for r in range(len(splitters) + 1))]
    piece = {
        "_range": in_range,
        "_part": F.pmod(F.xxhash64("_second", F.lit("part")), F.get(F.lit(parts), in_range)).cast("int"),
    }
    keys = keys.withColumns(piece)
    before = Window.orderBy("_range", "_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per piece: their number follows PIECE_ROWS, not the keys
    pieces = keys.groupBy("_range", "_part").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
    pieces = stored(pieces.select(
        F.col("_range").alias("_p_range"), F.col("_part").alias("_p_part"), "_bytes", "_rows",
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes_before"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
    ))
    # by the middle of a record, in half bytes
    shard_at = lambda at: F.least(F.floor(at * shards / F.lit(max(1, 2 * all_bytes))), F.lit(shards - 1)).cast("int")
    meet = (F.col("_range") == F.col("_p_range")) & (F.col("_part") == F.col("_p_part"))

    def placed(rows: DataFrame, of: DataFrame) -> DataFrame:
        own = Window.partitionBy("_range", "_part").orderBy("_first", "_second", "size")
        upto = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return (
            rows.join(of, meet)
            .withColumns({
                "_at": F.col("_bytes_before") + F.sum("size").over(upto) - F.col("size"),
                "_index": F.col("_rows_before") + F.row_number().over(own) - 1,
            })
            .withColumn("shard", shard_at(2 * F.col("_at") + F.col("size")))
        )

    # a shard starts with a piece, or inside one of the few pieces that reach over a cut
    pieces = pieces.withColumn("_lowest", shard_at(2 * F.col("_bytes_before")))
    within = F.col("_lowest") == shard_at(2 * (F.col("_bytes_before") + F.col("_bytes")) - 1)
    cuts = pieces.where(~within)
    first = lambda rows, at: rows.groupBy("shard").agg(F.min(at).alias("_start"))
    starts = first(placed(keys, cuts), "_index").union(
        first(pieces.where(within).withColumn("shard", F.col("_lowest")), "_rows_before")
    )
    starts = {r["shard"]: r["s"] for r in starts.groupBy("shard").agg(F.min("_start").alias("s")).collect()}
    start = reduce(lambda c, s: c.when(F.col("shard") == s, F.lit(starts[s])), starts, F.when(F.lit(False), F.lit(0)))
    rows = placed(_keyed(docs, id_column, text).withColumns(piece), pieces)
    return rows.withColumn("slot", (F.col("_index") - start).cast("long")).select(*given, "size", "text_crc32", "shard", "slot")


def write_shards(sharded: DataFrame, folder: str) -> None:
    """One folder of Parquet files per shard, each file in slot order."""
    sharded.repartition("shard", F.floor(F.col("slot") / PIECE_ROWS)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)
