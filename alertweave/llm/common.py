"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertweave.session import shared_folder

#: White space between words, the class [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"


#: Lets Spark remove the shuffle files of a query once the query has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """Write `df` as a table in the shared checkpoint folder and read it back.

    Cuts the lineage: a lost executor costs a re-read of its files. The shuffle files
    of the write go when it ends, the folder when `discard` is called or the
    application's file system closes.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(folder)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    table = spark.read.schema(df.schema).parquet(folder)
    table.stored_in = folder
    return table


def discard(*tables: DataFrame) -> None:
    """Delete the folders of tables that `stored` returned and nothing reads any more."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table.stored_in)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once per row, however often `body` uses it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text as an array; null and empty texts have none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES)), " "), "")


def balanced_sum(terms: list[Column]) -> Column:
    """Sum of many columns as a shallow tree, so that the expression stays small to walk."""
    while len(terms) > 1:
        terms = [a + b for a, b in zip(terms[::2], terms[1::2])] + ([terms[-1]] if len(terms) % 2 else [])
    return terms[0]


#: A membership bitmap has so many bits for each of its entries, and 2**LEAST_BITS at least; 2**MOST_BITS (128 MB) bound what a task holds.
BITS_PER_ENTRY = 16
LEAST_BITS, MOST_BITS = 16, 30


def bitmap_of(hashes: DataFrame, column: str) -> np.ndarray:
    """Bitmap over the top bits of a 64-bit hash column, or-ed together in Spark; as 64-bit words.

    Its size follows the number of entries, so that few other hashes pass at any size.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, (BITS_PER_ENTRY * hashes.count()).bit_length()))
    place = F.shiftrightunsigned(column, 64 - bits)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    words = hashes.groupBy(F.shiftright(place, 6).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bitmap = np.zeros(1 << (bits - 6), np.uint64)
    bitmap[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return bitmap


def in_bitmap(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which 64-bit hashes may be in the bitmap: all that are, and few others while it is sparse."""
    place = hashes.view(np.uint64) >> np.uint64(64 - (len(bitmap).bit_length() + 5))
    return (bitmap[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


class WordHashes(dict):
    """64-bit hash of a word, remembered for a bounded number of words (an aid to speed only)."""

    REMEMBERED = 400_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words; k takes part, so runs of two lengths do not meet."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, np.uint64(k))
    for i in range(k):
        out = (out ^ hashes[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def components(edges: DataFrame, parts: int | None = None) -> DataFrame:
    """(vertex, component) of the vertices of `edges` (a, b); the component is its smallest vertex. The result is a stored table.

    Each round every vertex takes the smallest label around it and then the
    label of that label, so a chain of n vertices takes about log n rounds. Labels
    are stored round by round, in `parts` files at most if given, so that few edges
    are joined without a shuffle; rounds end when none changes.
    """
    few = lambda df: df.coalesce(parts) if parts else df
    both = stored(few(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where(F.col("a") != F.col("b")).distinct()))
    labels = stored(few(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("l")).select(F.col("a").alias("v"), "l", F.col("a").alias("old"))))
    while True:
        near = both.join(labels.select("v", "l"), F.col("b") == F.col("v")).groupBy("a").agg(F.min("l").alias("m"))
        hooked = labels.join(near, F.col("v") == F.col("a")).select("v", "l", F.least("l", "m").alias("n"))
        up = labels.select(F.col("v").alias("u"), F.col("l").alias("up"))
        new = stored(few(hooked.join(up, F.col("n") == F.col("u"), "left").select("v", F.least("n", "up").alias("l"), F.col("l").alias("old"))))
        discard(labels)
        labels = new
        if not labels.where("l <> old").limit(1).count():
            discard(both)
            out = labels.select(F.col("v").alias("vertex"), F.col("l").alias("component"))
            out.stored_in = labels.stored_in
            return out
