"""Source divergence audit: which terms set a source apart from its language, and sources from each other.

The terms of a language are found by iceberg prefix refinement. Every document
is one row with its distinct terms, sorted, a space behind each, and their counts. Level by level the
byte prefixes of its terms are counted by distinct documents (prefixes of sorted
terms are sorted, so a document counts each once), and only terms whose prefix
reaches the least number of documents go on to the next, longer level. A term
shorter than the level's length is complete there, its space within the prefix. What no level discards are the
kept terms; their occurrences are counted per (lang, source).

A prefix is dropped by a bitmap of the survivors. Survivors and hashes that
collide pass, so no term is lost, and a term that passed wrongly has too few
documents at the next level as well: counts decide, not the bitmap.

Each kept term of a group with `count` occurrences has the smoothed share
p = 1 + floor(SCALE * (count + 1) / (N + V)), in whole numbers. The
divergence f = floor((p - q)^2 / q) is summed over all kept terms for each pair
of sources of a language, and ranked by term against the whole language.
Terms of a language are dealt into buckets; a bucket holds the counts of all its
sources, so sums and best terms are worked out there and merged.

Defined cases: null text, lang or source is ''; a row is one document, whether or
not its doc_id repeats; a group without terms has p for every kept term all the
same; a language without kept terms has value 0 for every pair and no term rows;
columns besides lang, source and text are not read; an empty table gives no rows.
Memory of a task: one batch of documents, or one bucket of at most CELLS counts.
The groups (lang, source) are known to every task: the result itself holds a row
for each pair of them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from decimal import Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alertweave.llm.common import bitmap_of, in_bitmap, stored

#: Documents of its language that a term needs.
LEAST_DOCUMENTS = 3
#: Bytes of the first level's prefixes; each level doubles them.
FIRST_LEVEL = 4
SCALE = 1_000_000_000
#: Ranks of the term part.
TOP = 200
#: Counts (sources x terms) in a bucket, and the fewest terms.
CELLS, LEAST_TERMS = 1 << 17, 64
#: Terms of whole documents that a task looks at together, and rows of sums that it gathers.
BLOCK, GATHERED = 1 << 17, 300_000

_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_DOCUMENT = "lang string, source string, terms binary, counts binary"
#: Documents cut into terms together.
DOCUMENTS = 512


def _tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text as bytes) to (lang, source, its distinct terms, sorted and each with a space behind it, their counts as 32-bit numbers)."""
    for batch in batches:
        for low in range(0, batch.num_rows, DOCUMENTS):
            block = batch.slice(low, DOCUMENTS)
            terms: list[bytes] = []
            counts: list[bytes] = []
            for text in block.column(2):
                found = Counter((text.as_py() or b"").translate(_TERMS).split())
                own = sorted(found)
                terms.append(b" ".join([*own, b""]))
                counts.append(np.fromiter(map(found.__getitem__, own), np.int32, len(own)).tobytes())
            yield pa.RecordBatch.from_arrays(
                [block.column(0), block.column(1), pa.array(terms, pa.binary()), pa.array(counts, pa.binary())],
                names=["lang", "source", "terms", "counts"],
            )


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all values one after the other, ends of the values)."""
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends[1:] - ends[0]


class _Terms:
    """The terms of a batch of documents as one column, each with its space, and the document of each."""

    def __init__(self, column: pa.Array):
        self.data, ends = _bytes(column)
        stop = np.flatnonzero(self.data == 32)
        offsets = np.concatenate([[-1], stop]).astype(np.int32) + 1
        self.doc = np.searchsorted(ends, stop, "right")
        self.start, self.length = offsets[:-1], stop - offsets[:-1]
        self.values = pa.BinaryArray.from_buffers(pa.binary(), len(stop), [None, pa.py_buffer(offsets), pa.py_buffer(self.data)])

    def prefixes(self, at: np.ndarray, size: int) -> np.ndarray:
        """The first `size` bytes of the terms at `at`, as rows of 64-bit words; terms hold no zero byte, which fills up."""
        place = np.arange(size, dtype=np.int32)
        wide = np.zeros((len(at), (size + 7) // 8 * 8), np.uint8)
        if len(at):
            held = self.data[np.minimum(self.start[at, None] + place, len(self.data) - 1)]
            wide[:, :size] = np.where(place < self.length[at, None], held, 0)
        return wide.view(np.uint64)


def _hashed(seeds: np.ndarray, words: np.ndarray) -> np.ndarray:
    """64-bit hash of each row of words under a seed; words of zero, which only fill up, take no part."""
    out = seeds.copy()
    for word in words.T:
        mixed = (out ^ word) * np.uint64(0x9E3779B97F4A7C15)
        out = np.where(word == 0, out, mixed ^ (mixed >> np.uint64(29)))
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def _seeds(langs: pa.Array) -> np.ndarray:
    """A seed for the language of each document."""
    import xxhash

    names = langs.dictionary_encode()
    seeds = np.array([xxhash.xxh64_intdigest(x.as_py()) for x in names.dictionary], np.uint64)
    return seeds[names.indices.to_numpy()]


def _blocks(doc: np.ndarray) -> Iterator[slice]:
    """Slices of about BLOCK terms that hold whole documents."""
    low = 0
    while low < len(doc):
        high = len(doc) if low + BLOCK >= len(doc) else int(np.searchsorted(doc, doc[low + BLOCK - 1], "right"))
        yield slice(low, high)
        low = high


def _gathered(tables: Iterator[pa.Table], keys: list[str], value: str) -> Iterator[pa.Table]:
    """Sums of `value` by `keys` over the tables of a task; what has been gathered goes out whenever it is GATHERED rows."""
    held, rows = [], 0
    for table in tables:
        held.append(table.group_by(keys, use_threads=False).aggregate([(value, "sum")]).rename_columns([*keys, value]))
        rows += held[-1].num_rows
        if rows >= 2 * GATHERED:
            held = [pa.concat_tables(held).group_by(keys, use_threads=False).aggregate([(value, "sum")]).rename_columns([*keys, value])]
            rows = held[0].num_rows
            if rows >= GATHERED:
                yield held[0]
                held, rows = [], 0
    if rows:
        yield pa.concat_tables(held).group_by(keys, use_threads=False).aggregate([(value, "sum")]).rename_columns([*keys, value])


def _level(documents: DataFrame, size: int, before: int, survivors: np.ndarray | None) -> DataFrame:
    """(lang, prefix, hash, n): documents of each prefix of `size` bytes, or shorter complete term, whose prefix of `before` bytes survived."""
    shared = documents.sparkSession.sparkContext.broadcast(survivors)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for batch in batches:
            terms, seeds = _Terms(batch.column(1)), _seeds(batch.column(0))
            for block in _blocks(terms.doc):
                at = np.flatnonzero(terms.length[block] >= before) + block.start
                if shared.value is not None:
                    at = at[in_bitmap(shared.value, _hashed(seeds[terms.doc[at]], terms.prefixes(at, before)))]
                words, doc = terms.prefixes(at, size), terms.doc[at]
                new = np.ones(len(at), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (words[1:] != words[:-1]).any(axis=1)
                yield pa.table({
                    "lang": batch.column(0).take(pa.array(doc[new])),
                    "prefix": pc.binary_slice(terms.values.take(pa.array(at[new])), 0, size),
                    "hash": _hashed(seeds[doc[new]], words[new]).view(np.int64),
                    "n": np.ones(int(new.sum()), np.int64),
                })

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gathered(found(batches), ["lang", "prefix", "hash"], "n"):
            yield from table.to_batches()

    rows = documents.select("lang", "terms").mapInArrow(counted, "lang string, prefix binary, hash bigint, n bigint")
    return rows.groupBy("lang", "prefix").agg(F.min("hash").alias("hash"), F.sum("n").alias("n"))


def kept_terms(documents: DataFrame, least: int = LEAST_DOCUMENTS) -> tuple[DataFrame, list[int]]:
    """((lang, term, hash) of the terms in at least `least` documents of their language, lengths of the levels)."""
    complete, sizes, before, survivors = [], [], 0, None
    while True:
        size = 2 * before or FIRST_LEVEL
        whole = F.endswith("prefix", F.lit(b" "))
        level = stored(_level(documents, size, before, survivors).where(F.col("n") >= least))
        complete.append(level.where(whole).select("lang", F.col("prefix").alias("term"), "hash"))
        sizes.append(size)
        going = level.where(~whole)
        if not going.limit(1).count():
            return stored(reduce(DataFrame.union, complete)), sizes
        before, survivors = size, bitmap_of(going, "hash")


_BUCKET = "lang string, bucket int, kind int, terms binary, sources binary, counts binary"


def _packed(terms: pa.Array) -> bytes:
    """Terms one after the other, each with its space."""
    return _bytes(terms)[0].tobytes()


def _unpacked(data: bytes) -> pa.Array:
    held = np.frombuffer(data, np.uint8)
    offsets = np.concatenate([[0], np.flatnonzero(held == 32) + 1]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def term_counts(documents: DataFrame, kept: DataFrame, sizes: list[int], groups: dict[str, list[str]], buckets: dict[str, int]) -> DataFrame:
    """(lang, bucket, terms, counts): the kept terms of a bucket and their occurrences in each source of the language, source by source.

    What a task has counted travels to the buckets as packed columns; a bucket starts with its
    kept terms, which settle what hashes have let pass, and adds what comes in, one row after the other.
    """
    shared = documents.sparkSession.sparkContext.broadcast(bitmap_of(kept, "hash"))
    number = {lang: {source: i for i, source in enumerate(sources)} for lang, sources in groups.items()}

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for batch in batches:
            terms, seeds = _Terms(batch.column(2)), _seeds(batch.column(0))
            counts = _bytes(batch.column(3))[0].view(np.int32).astype(np.int64)
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            source = np.array([number[lang][name] for lang, name in zip(langs, sources)], np.int32)
            share = np.array([buckets.get(lang, 1) for lang in langs])
            for block in _blocks(terms.doc):
                length = terms.length[block]
                for low, size in zip([0, *sizes], sizes):
                    at = np.flatnonzero((length >= low) & (length < size)) + block.start
                    hashes = _hashed(seeds[terms.doc[at]], terms.prefixes(at, size))
                    alive = in_bitmap(shared.value, hashes)
                    at, hashes = at[alive], hashes[alive]
                    doc = terms.doc[at]
                    yield pa.table({
                        "lang": batch.column(0).take(pa.array(doc)), "bucket": np.mod(hashes.view(np.int64), share[doc]).astype(np.int32),
                        "source": source[doc], "term": terms.values.take(pa.array(at)), "count": counts[at],
                    })

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gathered(found(batches), ["lang", "bucket", "source", "term"], "count"):
            table = table.sort_by([("lang", "ascending"), ("bucket", "ascending")]).combine_chunks()
            lang = table.column("lang").combine_chunks().dictionary_encode().indices.to_numpy()
            bucket = table.column("bucket").to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], (lang[1:] != lang[:-1]) | (bucket[1:] != bucket[:-1])]))
            rows = []
            for low, high in zip(starts, [*starts[1:], len(lang)]):
                part = table.slice(low, high - low)
                packed = _packed(part.column("term").combine_chunks()), part.column("source").to_numpy().tobytes(), part.column("count").to_numpy().tobytes()
                rows.append((part.column("lang")[0].as_py(), int(bucket[low]), 1, *packed))
            yield pa.RecordBatch.from_pylist([dict(zip(("lang", "bucket", "kind", "terms", "sources", "counts"), r)) for r in rows], schema=schema)

    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("kind", pa.int32()), ("terms", pa.binary()), ("sources", pa.binary()), ("counts", pa.binary())])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, names, total = None, None, None

        def out() -> Iterator[pa.RecordBatch]:
            if key is not None:
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, _packed(names), total.tobytes())], schema=done)

        for batch in batches:
            for i in range(batch.num_rows):
                lang, bucket, kind, terms, sources, counts = (column[i].as_py() for column in batch.columns)
                if kind == 0:
                    yield from out()
                    key, names = (lang, bucket), _unpacked(terms)
                    total = np.zeros((len(groups[lang]), len(names)), np.int64)
                elif (lang, bucket) == key:  # else only hashes met there, no kept term
                    place = pc.index_in(_unpacked(terms), names).to_numpy(zero_copy_only=False)
                    real = ~np.isnan(place)
                    np.add.at(total, (np.frombuffer(sources, np.int32)[real], place[real].astype(np.int64)), np.frombuffer(counts, np.int64)[real])
        yield from out()

    done = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("terms", pa.binary()), ("counts", pa.binary())])
    known = kept.sparkSession.createDataFrame(list(buckets.items()), "lang string, buckets int")
    none = F.lit(None).cast("binary")
    lists = kept.join(F.broadcast(known), "lang").groupBy("lang", F.pmod("hash", "buckets").cast("int").alias("bucket"))
    lists = lists.agg(F.array_join(F.array_sort(F.collect_list(F.col("term").cast("string"))), "").cast("binary").alias("terms"))
    rows = documents.mapInArrow(dealt, _BUCKET).unionByName(lists.select("lang", "bucket", F.lit(0).alias("kind"), "terms", none.alias("sources"), none.alias("counts")))
    met = rows.repartition("lang", "bucket").sortWithinPartitions("lang", "bucket", "kind")
    return met.mapInArrow(merged, "lang string, bucket int, terms binary, counts binary")


def shares(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """p of each count, exactly; int64 (p is at most SCALE + 1)."""
    if total + terms >= 2**62 // SCALE:
        counts = counts.astype(object)
    return (1 + SCALE * (counts + 1) // (total + terms)).astype(np.int64)


def divergences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """f of each term; below 2**63, as p and q are at most SCALE + 1."""
    return (p - q) ** 2 // q


def exact_sum(values: np.ndarray) -> int:
    """Sum of non-negative 64-bit integers, past 64 bits if need be."""
    return (int((values >> 31).sum()) << 31) + int((values & (2**31 - 1)).sum())


_PART = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.binary()), ("value", pa.decimal128(38, 0))])


def source_divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): `pair` rows for each other source, `term` rows for the `top` terms above the language."""
    name = lambda column: F.coalesce(F.col(column).cast("string"), F.lit("")).alias(column)
    documents = stored(docs.select(name("lang"), name("source"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(_tokenised, _DOCUMENT))
    kept, sizes = kept_terms(documents, least)

    # one row per group and per language: fewer than the result has pairs
    vocabulary = {r["lang"]: r["n"] for r in kept.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    groups: dict[str, list[str]] = {}
    for row in documents.select("lang", "source").distinct().orderBy("lang", "source").collect():
        groups.setdefault(row["lang"], []).append(row["source"])
    # buckets of a language in proportion to its terms
    buckets = {lang: -(-n // max(LEAST_TERMS, CELLS // len(groups[lang]))) for lang, n in vocabulary.items()}
    counts = stored(term_counts(documents, kept, sizes, groups, buckets))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, table in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums = np.frombuffer(table.as_buffer(), np.int64).reshape(len(groups[lang]), -1).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(sums)), pa.array(range(len(sums)), pa.int32()), pa.array(sums)], names=["lang", "at", "n"])

    each = counts.select("lang", "counts").mapInArrow(summed, "lang string, at int, n bigint")
    totals = {(r["lang"], groups[r["lang"]][r["at"]]): int(r["n"]) for r in each.groupBy("lang", "at").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect()}

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, terms, table in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                sources, size = groups[lang], vocabulary[lang]
                names = _unpacked(terms.as_py())
                counted = np.frombuffer(table.as_buffer(), np.int64).reshape(len(sources), len(names))
                p = np.stack([shares(c, totals[lang, source], size) for source, c in zip(sources, counted)])
                whole = shares(counted.sum(axis=0), sum(totals[lang, source] for source in sources), size)
                out: list[tuple] = []
                for i, source in enumerate(sources):
                    out += [(source, "pair", other.encode(), exact_sum(divergences(p[i], p[j]))) for j, other in enumerate(sources) if i != j]
                    above = np.flatnonzero((counted[i] > 0) & (p[i] > whole))
                    value = divergences(p[i][above], whole[above])
                    named = sorted(zip((-value).tolist(), names.take(pa.array(above)).to_pylist()))[:top]
                    out += [(source, "term", item[:-1], -v) for v, item in named]
                source, part, item, value = zip(*out) if out else ((), (), (), ())
                values = pa.array([Decimal(v) for v in value], pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(out), pa.string()), pa.array(source, pa.string()), pa.array(part, pa.string()), pa.array(item, pa.binary()), values], schema=_PART)

    parts = stored(counts.select("lang", "terms", "counts").mapInArrow(compared, "lang string, source string, part string, item binary, value decimal(38,0)"))
    # groups of a language without kept terms are as far from each other as can be told: not at all
    bare = [(lang, a, b) for lang, sources in groups.items() if lang not in vocabulary for a in sources for b in sources if a != b]
    none = counts.sparkSession.createDataFrame(bare, "lang string, source string, item string").select("lang", "source", F.lit("pair").alias("part"), F.encode("item", "UTF-8").alias("item"), F.lit(0).cast("decimal(38,0)").alias("value"))
    pairs = parts.where("part = 'pair'").union(none).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    ranked = lambda frame: frame.withColumn("rank", F.row_number().over(order))
    result = ranked(pairs).union(ranked(parts.where("part = 'term'")).where(F.col("rank") <= top))
    return result.select("lang", "source", "part", F.decode("item", "UTF-8").alias("item"), F.col("value").cast("long").alias("value"), "rank")
