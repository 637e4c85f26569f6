"""Toxicity scores from a factorization machine over hashed terms.

A text is the set of its distinct terms, hashed into 2**HASH_BITS buckets. The
machine scores b + sum w_i + sum_{i<j} <v_i, v_j> over the buckets it knows, so
a pair of terms (an insult with a group mention) can weigh more than its parts.
It is fitted on at most `max_rows` labelled rows, those of smallest id hash,
in one task; buckets enter by document frequency and a test against the label,
over all rows or within the rows of a bucket that passed over all rows, so a term
without a bearing of its own enters for the pair it makes. Scoring reads all texts where they lie and shuffles nothing.

Defined cases: a null or empty text has no terms and gets the score of the bias;
rows without a label, or whose id has none, are scored but not learned from;
several labels of one id count as toxic if one is; without labels of both kinds
the score is the smoothed share of toxic rows; doc_id may be null or repeated;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASH_BITS = 26
#: Bound of the fitted sample, and of the model.
MAX_ROWS = 20_000
MAX_TERMS = 20_000
LEAST_DOCUMENTS = 3
LEAST_CHI2 = 10.0
FACTORS = 4
STEPS = 200
RATE = 0.05
L1, L2 = 1.5e-4, 1e-4
REMEMBERED_WORDS = 400_000

_BREAKS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Buckets(dict):
    """Bucket of a term, remembered for a bounded number of terms (an aid to speed only)."""

    def __missing__(self, term: bytes) -> int:
        import xxhash

        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        value = self[term] = xxhash.xxh64_intdigest(term) >> (64 - HASH_BITS)
        return value


def buckets_of(text: str | None, buckets: Buckets) -> np.ndarray:
    """Sorted buckets of the distinct terms (letters and code points above 127) of a text."""
    terms = set((text or "").lower().encode("utf-8", "surrogatepass").translate(_BREAKS).split())
    return np.unique(np.fromiter(map(buckets.__getitem__, terms), np.int64, len(terms)))


def held_out(id_column: str) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def _summed(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of rows that end at `ends`."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0)])
    return np.diff(total[np.concatenate([[0], ends])], axis=0)


def _beside_strong(flat: np.ndarray, ends: np.ndarray, labels: np.ndarray, strong: np.ndarray, leaning: np.ndarray, terms: int) -> np.ndarray:
    """Largest likelihood ratio of each term against the label within the rows of one strong term, or of any that leans to toxic.

    It is lowered for the number of strong terms, so that LEAST_CHI2 admits as many terms by chance as over all rows.
    """
    best = np.zeros(terms)
    starts = np.concatenate([[0], ends[:-1]])
    owner = np.repeat(np.arange(len(labels)), ends - starts)
    marked = strong[flat]
    at = np.argsort(flat[marked], kind="stable")
    groups = np.split(owner[marked][at], np.flatnonzero(np.diff(flat[marked][at])) + 1)
    groups.append(np.unique(owner[(strong & leaning)[flat]]))
    counts = np.arange(len(labels) + 1)
    plogp = counts * np.log(np.maximum(counts, 1))
    toxic = labels > 0
    for rows in groups:
        n, positive = len(rows), int(toxic[rows].sum())
        if positive in (0, n):
            continue
        # the toxic rows first
        met = np.concatenate([flat[starts[r] : ends[r]] for r in rows[np.argsort(~toxic[rows], kind="stable")]])
        toxic_end = (ends[rows] - starts[rows])[toxic[rows]].sum()
        c, k = np.bincount(met, minlength=terms), np.bincount(met[:toxic_end], minlength=terms)
        at = np.flatnonzero(c >= LEAST_DOCUMENTS)
        c, k = c[at], k[at]
        cells = plogp[k] + plogp[c - k] + plogp[positive - k] + plogp[n - c - positive + k]
        ratio = 2 * (cells - plogp[c] - plogp[n - c] - plogp[positive] - plogp[n - positive] + plogp[n])
        best[at] = np.maximum(best[at], ratio)
    tail = NormalDist().cdf(-(LEAST_CHI2**0.5)) / len(groups)
    return best - (NormalDist().inv_cdf(tail) ** 2 - LEAST_CHI2)


def fit(rows: list[np.ndarray], labels: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """(bias, known buckets, w, v) of the machine for sets of buckets and 0/1 labels."""
    n, positive = len(labels), labels.sum()
    bias = float(np.log((positive + 1) / (n - positive + 1)))
    nothing = np.empty(0, np.int64), np.empty(0), np.empty((0, FACTORS))
    if positive in (0, n):
        return bias, *nothing
    sizes = np.array([len(r) for r in rows])
    flat, owner = np.concatenate(rows), np.repeat(np.arange(n), sizes)
    known, column, df = np.unique(flat, return_inverse=True, return_counts=True)
    with_label = np.bincount(column, labels[owner], len(known))
    expected = df * positive / n
    chi2 = (with_label - expected) ** 2 * n / np.maximum(expected * (n - positive) / n * (n - df), 1e-9) * n / n
    usable = (df >= LEAST_DOCUMENTS) & (chi2 >= LEAST_CHI2)
    if usable.any():
        often = (df >= LEAST_DOCUMENTS)[column]
        dense = np.cumsum(df >= LEAST_DOCUMENTS) - 1
        ends = np.cumsum(np.bincount(owner[often], minlength=n))
        at = np.flatnonzero(df >= LEAST_DOCUMENTS)
        beside = _beside_strong(dense[column[often]], ends, labels, usable[at], (with_label > expected)[at], len(at))
        chi2[at] = np.maximum(chi2[at], beside)
        usable = (df >= LEAST_DOCUMENTS) & (chi2 >= LEAST_CHI2)
    if usable.sum() > MAX_TERMS:
        usable &= chi2 >= np.sort(chi2[usable])[-MAX_TERMS]
    if not usable.any():
        return bias, *nothing
    keep = usable[column]
    place = np.cumsum(usable) - 1
    owner, column = owner[keep], place[column[keep]]
    known = known[usable]
    row_ends = np.searchsorted(owner, np.arange(n), side="right")
    by_column = np.argsort(column, kind="stable")
    column_ends = np.searchsorted(column[by_column], np.arange(len(known)), side="right")
    w, v = np.zeros(len(known)), np.random.default_rng(7).normal(0, 0.02, (len(known), FACTORS))
    moments = [np.zeros(1), np.zeros(1), np.zeros_like(w), np.zeros_like(w), np.zeros_like(v), np.zeros_like(v)]

    def step(value, gradient, k: int, t: int):
        moments[k] = 0.9 * moments[k] + 0.1 * gradient
        moments[k + 1] = 0.999 * moments[k + 1] + 0.001 * gradient * gradient
        return value - RATE * (moments[k] / (1 - 0.9**t)) / (np.sqrt(moments[k + 1] / (1 - 0.999**t)) + 1e-8)

    for t in range(1, STEPS + 1):
        sums = _summed(v[column], row_ends)
        pairs = 0.5 * (sums**2 - _summed(v[column] ** 2, row_ends)).sum(axis=1)
        error = 1 / (1 + np.exp(-np.clip(bias + _summed(w[column], row_ends) + pairs, -30, 30))) - labels
        on_term = error[owner[by_column]]
        grad_w = _summed(on_term, column_ends) / n
        grad_v = _summed(on_term[:, None] * (sums[owner[by_column]] - v[column[by_column]]), column_ends) / n + L2 * v
        bias = float(step(np.array([bias]), np.array([error.mean()]), 0, t)[0])
        w = step(w, grad_w + L1 * np.sign(w), 2, t)
        v = step(v, grad_v, 4, t)
    return bias, known, w, v


def score(rows: list[np.ndarray], model: tuple[float, np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    bias, known, w, v = model
    ends = np.cumsum([len(r) for r in rows])
    flat = np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64)
    place = np.minimum(np.searchsorted(known, flat), max(0, len(known) - 1))
    met = known[place] == flat if len(known) else np.zeros(len(flat), bool)
    counts = np.cumsum(np.concatenate([[0], met]))[ends]
    place = place[met]
    if not len(place):
        return np.full(len(rows), 1 / (1 + np.exp(-bias)))
    sums = _summed(v[place], counts)
    pairs = 0.5 * (sums**2 - _summed(v[place] ** 2, counts)).sum(axis=1)
    return 1 / (1 + np.exp(-np.clip(bias + _summed(w[place], counts) + pairs, -30, 30)))


def trained(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """The machine fitted on at most `max_rows` labelled rows outside the held-out third."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    sample = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # bounded by max_rows rows of two numbers
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select((F.col("toxic") > 0).cast("int").alias("toxic"), "text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets()
        for batch in batches:
            terms = [buckets_of(t.as_py(), buckets).astype(np.int32) for t in batch.column(1)]
            ends = np.cumsum([0, *map(len, terms)]).astype(np.int32)
            flat = np.concatenate([*terms, np.empty(0, np.int32)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, flat)], names=["toxic", "terms"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: list[np.ndarray] = []
        truth: list[int] = []
        for batch in batches:
            truth += batch.column(0).to_pylist()
            sets += [t.values.to_numpy().astype(np.int64) for t in batch.column(1)]
        if not sets:
            return
        # in one order, whichever task's rows came first
        order = sorted(range(len(sets)), key=lambda i: (sets[i].tobytes(), truth[i]))
        bias, known, w, v = fit([sets[i] for i in order], np.array([truth[i] for i in order], float))
        known, w, v = np.append(known, -1), np.append(w, bias), np.vstack([v, np.zeros(FACTORS)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(known, pa.int64()), pa.array(w, pa.float64()), pa.ListArray.from_arrays(np.arange(0, v.size + 1, FACTORS, np.int32), v.ravel())],
            names=["bucket", "w", "v"],
        )

    found = rows.mapInArrow(hashed, "toxic int, terms array<int>").repartition(1).mapInArrow(fitted, "bucket bigint, w double, v array<double>").collect()
    known = sorted((r for r in found if r["bucket"] >= 0), key=lambda r: r["bucket"])
    bias = next((r["w"] for r in found if r["bucket"] < 0), 0.0)
    v = np.array([r["v"] for r in known]).reshape(len(known), FACTORS)
    return bias, np.array([r["bucket"] for r in known], np.int64), np.array([r["w"] for r in known]), v


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_rows: int = MAX_ROWS) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    model = trained(docs, labels, max_rows)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets()
        for batch in batches:
            values = score([buckets_of(t.as_py(), buckets) for t in batch.column(2)], model) if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values, pa.float64())], names=["doc_id", "held_out", "score"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out("doc_id").alias("held_out"), "text").mapInArrow(scored, f"doc_id {id_type}, held_out boolean, score double")
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
