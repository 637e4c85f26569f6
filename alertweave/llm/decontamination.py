"""Benchmark decontamination by winnowing.

Words of documents and items are hashed into k-grams; of every window of
`span - k + 1` consecutive k-grams the smallest is kept, so any shared run of
`span` words shares a kept fingerprint. Documents first meet a bitmap of the
benchmark's fingerprints (of fixed size, whatever the benchmark's size);
what passes is joined with the benchmark on the fingerprint and extended word by
word to both sides. An item of fewer than `span` words is one fingerprint of
its own length, met by all runs of that length.

Defined cases: a null text has no words; a null item_id marks words but is not
counted or listed; doc_id may be null or repeated (documents equal in id and
text share one verdict); empty tables give no hits or no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertweave.llm.common import WordHashes, bitmap_of, gram_hashes, in_bitmap, stored

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_HIT = "struct<k:int, at:int, print:bigint, left:int, context:string>"


def split_words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words of ASCII letters, digits and all other code points above 127."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def winnowed(grams: np.ndarray, window: int) -> np.ndarray:
    """Places that are smallest in some window of consecutive k-grams (all of them on ties)."""
    n = len(grams) - window + 1
    if n <= 0:
        return np.arange(len(grams))
    least = grams[:n].copy()
    for i in range(1, window):
        np.minimum(least, grams[i : i + n], out=least)
    chosen = np.zeros(len(grams), bool)
    for i in range(window):
        chosen[i : i + n] |= grams[i : i + n] == least
    return np.flatnonzero(chosen)


def _prints(batches: Iterator[pa.RecordBatch], k: int, span: int, bitmap: np.ndarray | None, lengths: list[int]) -> Iterator[pa.RecordBatch]:
    """Adds n_words and the fingerprints with their context; the last column is the text, which goes."""
    remembered = WordHashes()
    hit = pa.struct([("k", pa.int32()), ("at", pa.int32()), ("print", pa.int64()), ("left", pa.int32()), ("context", pa.string())])

    def met(values: np.ndarray) -> np.ndarray:
        return np.ones(len(values), bool) if bitmap is None else in_bitmap(bitmap, values)

    def of(text: str | None) -> tuple[int, list[tuple]]:
        words = split_words(text)
        n = len(words)
        hashes = np.fromiter(map(remembered.__getitem__, words), np.uint64, n)
        found: list[tuple] = []
        own = n >= span
        if own:
            grams = gram_hashes(hashes, k)
            places = winnowed(grams, span - k + 1)
            reach = span - k
            for at in places[met(grams[places])].tolist():
                low, high = max(0, at - reach), min(n, at + k + reach)
                found.append((k, at, int(grams[at].view(np.int64)), at - low, b" ".join(words[low:high]).decode("utf-8", "replace")))
        for length in lengths if bitmap is not None else [n] if 0 < n < span else []:
            grams = gram_hashes(hashes, length)
            for at in np.flatnonzero(met(grams)).tolist():
                found.append((-length, at, int(grams[at].view(np.int64)), 0, b" ".join(words[at : at + length]).decode("utf-8", "replace")))
        return n, found

    for batch in batches:
        counts, hits = [], []
        for text in batch.column(batch.num_columns - 1):
            n, found = of(text.as_py())
            counts.append(n)
            hits.append([dict(zip(("k", "at", "print", "left", "context"), f, strict=True)) for f in found])
        kept = [batch.column(i) for i in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays(
            [*kept, pa.array(counts, pa.int64()), pa.array(hits, pa.list_(hit))],
            names=[*batch.schema.names[:-1], "n_words", "hits"],
        )


def _agreeing(a: Column, b: Column, reach: int) -> Column:
    """How many leading elements two arrays share."""
    same = [F.coalesce(F.get(a, F.lit(i)) == F.get(b, F.lit(i)), F.lit(False)) for i in range(reach)]
    return (F.array_position(F.array(*same, F.lit(False)), F.lit(False)) - 1).cast("int")


def _covered(spans: Column) -> Column:
    """Number of places that sorted half-open spans cover."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("int").alias("end"))
    step = lambda a, s: F.struct(
        (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["end"]))).cast("long").alias("n"),
        F.greatest(a["end"], s["end"]).alias("end"),
    )
    return F.aggregate(spans, zero, step)["n"]


def contaminated_spans(docs: DataFrame, items: DataFrame, span: int = 10, k: int = 5, id_column: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, spans): key and word count of each document; hit spans [start, end) in words with the item."""
    item_schema = f"item_id string, n_words bigint, hits array<{_HIT}>"
    prints = stored(
        items.select(F.col("item_id").cast("string").alias("item_id"), "text")
        .mapInArrow(lambda batches: _prints(batches, k, span, None, []), item_schema)
        .select("item_id", F.explode("hits").alias("h"))
        .select("item_id", "h.*")
        .distinct()
    )
    bitmap = bitmap_of(prints, "print")
    lengths = sorted(-r["k"] for r in prints.where("k < 0").select("k").distinct().collect())
    id_type = docs.schema[id_column].dataType.simpleString()
    documents = stored(
        docs.select(F.col(id_column).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("text"))
        .mapInArrow(lambda batches: _prints(batches, k, span, bitmap, lengths), f"doc_id {id_type}, text_hash bigint, n_words bigint, hits array<{_HIT}>")
    )
    found = documents.select("doc_id", "text_hash", F.explode("hits").alias("h")).select("doc_id", "text_hash", "h.*").distinct()
    other = prints.select("item_id", F.col("k").alias("_k"), F.col("print").alias("_print"), F.col("left").alias("_left"), F.col("context").alias("_context"))
    met = found.join(other, (F.col("print") == F.col("_print")) & (F.col("k") == F.col("_k")))
    met = met.withColumns({"_a": F.split("context", " "), "_b": F.split("_context", " ")})
    core = lambda words, left: F.slice(words, F.col(left) + 1, F.abs("k"))
    before = lambda words, left: F.reverse(F.slice(words, F.lit(1), F.col(left)))
    after = lambda words, left: F.slice(words, F.col(left) + F.abs("k") + 1, F.lit(span))
    reach = span - k
    met = met.where(core(F.col("_a"), "left") == core(F.col("_b"), "_left"))
    spans = met.select(
        "doc_id", "text_hash", "item_id", "k",
        (F.col("at") - F.when(F.col("k") > 0, _agreeing(before(F.col("_a"), "left"), before(F.col("_b"), "_left"), reach)).otherwise(0)).alias("start"),
        (F.col("at") + F.abs("k") + F.when(F.col("k") > 0, _agreeing(after(F.col("_a"), "left"), after(F.col("_b"), "_left"), reach)).otherwise(0)).alias("end"),
    )
    return documents.drop("hits"), spans.where((F.col("k") < 0) | (F.col("end") - F.col("start") >= span)).drop("k").distinct()


def contamination(docs: DataFrame, items: DataFrame, span: int = 10, k: int = 5, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_words, n_hit, the sorted ids of items met, contaminated."""
    documents, spans = contaminated_spans(docs, items, span, k, id_column, text)
    hit = spans.groupBy("doc_id", "text_hash").agg(
        F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"),
        F.array_sort(F.collect_set("item_id")).alias("items"),
    )
    hit = hit.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), _covered(F.col("spans")).alias("n_hit"), "items")
    meet = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    none = F.array().cast("array<string>")
    return documents.join(hit, meet, "left").select(
        "doc_id", "text_hash", "n_words",
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("items", none).alias("items"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """`docs` without the documents that hold a window of an item."""
    bad = contamination(docs, items).where("contaminated").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    meet = docs["doc_id"].eqNullSafe(F.col("_id")) & (F.xxhash64(docs["text"]) == F.col("_hash"))
    return docs.join(bad.hint("merge"), meet, "left_anti")
