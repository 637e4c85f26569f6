"""Removal of byte strings that occur earlier in the corpus, by partitioned suffix sorting.

A byte goes if a string of SPAN bytes around it also starts earlier (smaller
doc_id, or the same document at an earlier byte). The suffixes that take part
start at anchors: of the GRAM-byte grams in each SPAN-byte string the one of
smallest hash, so equal strings have their anchor at the same place.

1. Anchors are range-partitioned by the hash of their leading GRAM bytes, with
   splitters from a sample of documents. A gram that fills whole ranges is
   spread over them by document. Each bucket sorts by (gram, document, place). An
   anchor whose surroundings (all strings through its gram) were seen earlier in
   the bucket is settled, as is the first anchor of a gram; only anchors whose
   surroundings differ from all earlier ones are left.
2. The strings through the anchors left, and through those they may repeat, are
   partitioned by the same splitters, sorted by multikey quicksort over 8-byte
   tokens, and runs of equal strings compared: all but the first of a run go. Of a
   gram that is very frequent or spread over ranges each string travels by its own
   hash, over even ranges of it, so no bucket depends on the frequency of one gram.
   Of equal strings in a block of documents only the first travels, the others are
   settled there, so none depends on the frequency of one string either.

Anchors and surroundings are compared by 64-bit hashes, strings by their bytes.

Defined cases: a null text is empty; texts shorter than SPAN bytes lose nothing;
doc_id is an integer, null sorts last; rows equal in doc_id are ordered by neither,
so a string of one is not removed for the other, and rows equal in doc_id and text
share one result; other columns are not read; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertweave.llm.common import bitmap_of, in_bitmap, stored

SPAN, GRAM = 100, 32
REACH = SPAN - GRAM
#: A bucket holds about so many anchors; a gram with more surroundings in a bucket travels by string.
BUCKET_ANCHORS = 600_000
FREQUENT = 5_000
#: Distinct strings a task holds back to settle equal ones, and strings in a bucket where they travel by their own hash.
BLOCK_STRINGS = 50_000
BUCKET_STRINGS = 300_000
#: Documents sampled for the splitters (expected number), and for each bucket where that is more.
SAMPLED, SAMPLED_PER_BUCKET = 3_000, 30
#: Splitters are leading bits of the hash, so many as a double holds: quantiles are found in doubles, and must equal a frequent gram's key.
KEY_SHIFT = 12
#: Strings sorted at once, and bytes of a text hashed at once.
SORT_STRINGS = 150_000
_CHUNK = 1 << 16
_MARGIN = 512
_NONE = (1 << 63) - 1

_RANDOM = np.random.default_rng(20_240_602)
_LETTER = _RANDOM.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.array([1], np.uint64), np.full(n, base, np.uint64)]))


class Grams:
    """Rolling hashes of a text: sum of letter * base**-place, so a run's hash does not depend on where it lies."""

    def __init__(self):
        n = _CHUNK + 2 * _MARGIN
        self.up, self.down = _powers(_BASE, n), _powers(pow(_BASE, -1, 2**64), n)

    def anchors(self, data: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Per chunk: (place, gram hash, surroundings hash, first and last string start) of the anchors of a text."""
        for begin in range(0, max(0, len(data) - SPAN + 1), _CHUNK):
            strings = min(_CHUNK, len(data) - SPAN + 1 - begin)
            base = max(0, begin - REACH)
            part = data[base : begin + strings + 2 * SPAN + REACH]
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(_LETTER[part] * self.down[: len(part)], out=sums[1:])
            skip = begin - base
            grams = _mixed((sums[skip + GRAM : skip + strings + SPAN] - sums[skip : skip + strings + REACH]) * self.up[skip : skip + strings + REACH])
            # hash above, place below: the smallest is the leftmost of equal grams
            keys = (grams & np.uint64(~((1 << 17) - 1) & (2**64 - 1))) | np.arange(len(grams), dtype=np.uint64)
            least = _sliding_min(keys, REACH + 1)
            first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
            last = np.append(first[1:], strings) - 1
            place = (least[first] & np.uint64((1 << 17) - 1)).astype(np.int64)
            left, right = np.maximum(0, place + skip - REACH), np.minimum(len(part), place + skip + SPAN)
            around = (sums[right] - sums[left]) * self.up[left]
            around = _mixed(around ^ ((place + skip - left).astype(np.uint64) << np.uint64(48)) ^ ((right - left).astype(np.uint64) << np.uint64(32)))
            yield place + begin, grams[place], around, first + begin, last + begin


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive values, from running minima of blocks in both directions."""
    n = len(values) - width + 1
    blocks = np.full(-(-len(values) // width) * width, np.uint64(2**64 - 1))
    blocks[: len(values)] = values
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def _bytes_of(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def _bucket(splitters: np.ndarray, keys: np.ndarray, spread: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, whether the key fills whole ranges): a key that is itself a splitter is dealt over its ranges."""
    low, high = np.searchsorted(splitters, keys, "left"), np.searchsorted(splitters, keys, "right")
    return (low + spread % (high - low + 1)).astype(np.int32), high > low


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Whether each row of sorted columns begins a new run."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return new


def multikey_order(tokens: list[np.ndarray], rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, run starts) of strings given as token columns, equal strings by rank.

    Token by token, as multikey quicksort does: only rows still tied are sorted by the next token, and a run
    whose remaining tokens are all equal is left as it is.
    """
    order = np.lexsort((rank, tokens[0]))
    starts = _runs(tokens[0][order])
    for depth in range(1, len(tokens)):
        run = np.cumsum(starts) - 1
        begin = np.flatnonzero(starts)
        differs = np.zeros(len(order), bool)
        for token in tokens[depth:]:
            seen = token[order]
            differs |= seen != seen[begin][run]
        open_run = np.zeros(len(begin), bool)
        open_run[run[differs]] = True
        if not open_run.any():
            break
        places = np.flatnonzero(open_run[run])
        tied, token = order[places], tokens[depth][order[places]]
        again = np.lexsort((rank[tied], token, run[places]))
        order[places] = tied[again]
        starts[places] |= _runs(run[places], token[again])
    return order, starts


def _classified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of a bucket to settled places (kind 0) and anchors to look at (1, or 2 to travel by string)."""
    parts = [[c.to_numpy(zero_copy_only=False) for c in b.columns[1:]] for b in batches if b.num_rows]
    if not parts:
        return
    gram, around, doc, place, spread = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.lexsort((place, doc, gram))
    gram, around, doc, place, spread = (c[order] for c in (gram, around, doc, place, spread))
    once = _runs(gram, doc, place)
    gram, around, doc, place, spread = (c[once] for c in (gram, around, doc, place, spread))
    first = _runs(gram)
    run = np.cumsum(first) - 1
    by_class = np.lexsort((np.arange(len(run)), around, run))
    lead = np.zeros(len(run), bool)
    lead[by_class] = _runs(run[by_class], around[by_class])
    classes = np.bincount(run, lead)[run]
    ahead = np.empty(len(run), np.int64)
    ahead[by_class] = by_class[lead[by_class]][np.cumsum(lead[by_class]) - 1]
    # rows of one doc_id but other texts are not earlier than each other
    unordered = (doc == doc[ahead]) & (place >> 32 != place[ahead] >> 32)
    look = (lead & ((classes > 1) | spread)) | unordered
    kind = np.where(look, np.where(spread | (classes > FREQUENT), 2, 1), 0).astype(np.int8)
    keep = look | ~lead
    for at in range(0, int(keep.sum()), 1 << 16):
        rows = np.flatnonzero(keep)[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(doc[rows]), pa.array(place[rows]), pa.array(kind[rows])], names=["doc", "place", "kind"])


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings of a bucket to the spans (doc, salt, begin, end) of those that occur earlier; rows without bytes are settled."""
    tables = []
    for batch in batches:
        open_ = batch.column(7).is_valid()
        if known := batch.num_rows - open_.true_count:
            _, _, doc, salt, at, _, last, _ = batch.filter(batch.column(7).is_null()).columns
            yield pa.RecordBatch.from_arrays([doc, salt, at, pa.array(at.to_numpy() + last.to_numpy() + SPAN)], names=["doc", "salt", "begin", "end"])
        if known < batch.num_rows:
            tables.append(batch.filter(open_) if known else batch)
    if not tables:
        return
    table = pa.Table.from_batches(tables)
    key, doc, salt, at, first, last = (table.column(i).to_numpy() for i in range(1, 7))
    text = table.column(7).combine_chunks()
    order = np.argsort(key, kind="stable")
    ends = np.flatnonzero(np.append(_runs(key[order])[1:], True)) + 1
    width = np.cumsum((last - first + 1)[order])[ends - 1]
    begin = 0
    while begin < len(order):
        # whole keys, about SORT_STRINGS strings
        done = width[np.searchsorted(ends, begin, "right") - 1] if begin else 0
        upto = ends[min(len(ends) - 1, np.searchsorted(width, done + SORT_STRINGS))]
        yield from _sorted_strings(key, doc, salt, at, first, last, text, order[begin:upto])
        begin = upto


def _sorted_strings(key, doc, salt, at, first, last, text, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    counts = (last - first + 1)[rows]
    owner = np.repeat(np.arange(len(rows)), counts)
    start = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + first[rows][owner]
    room = np.zeros((len(rows), 2 * SPAN + REACH), np.uint8)
    for i, r in enumerate(rows):
        data = np.frombuffer(text[int(r)].as_buffer(), np.uint8)
        room[i, : len(data)] = data
    eights = np.lib.stride_tricks.sliding_window_view(room, 8, axis=1)
    places = [*range(0, SPAN - 8, 8), SPAN - 8]
    tokens = [key[rows][owner], *(np.ascontiguousarray(eights[owner, start + p]).view(">u8").ravel().astype(np.uint64) for p in places)]
    doc, salt, begin = doc[rows][owner], salt[rows][owner], at[rows][owner] + start
    rank = np.empty(len(owner), np.int64)
    rank[np.lexsort((begin, salt, doc))] = np.arange(len(owner))
    order, starts = multikey_order(tokens, rank)
    head = order[np.flatnonzero(starts)][np.cumsum(starts) - 1]
    d, s, b = doc[order], salt[order], begin[order]
    # rows equal in doc_id and text bring the same start twice
    own = np.concatenate([[False], (d[1:] == d[:-1]) & (s[1:] == s[:-1]) & (b[1:] > b[:-1])]) & ~starts
    gone = order[(d > doc[head]) | own]
    if len(gone):
        d, s, b, last = _joined_starts(doc[gone], salt[gone], begin[gone])
        yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(s), pa.array(b), pa.array(last + SPAN)], names=["doc", "salt", "begin", "end"])


def _joined_starts(doc: np.ndarray, salt: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, ...]:
    """(doc, salt, first, last) of the runs of string starts one byte apart."""
    order = np.lexsort((begin, salt, doc))
    doc, salt, begin = doc[order], salt[order], begin[order]
    new = _runs(doc, salt)
    new[1:] |= begin[1:] > begin[:-1] + 1
    opens = np.flatnonzero(new)
    return doc[opens], salt[opens], begin[opens], begin[np.append(opens[1:], len(begin)) - 1]


class FirstStrings:
    """Of the equal strings of a block of documents the first, and the starts (doc, salt, begin) of those after it."""

    def __init__(self):
        self.first: dict[bytes, tuple[int, int, int]] = {}
        self.gone: list[tuple[int, int, int]] = []
        self.apart: list[tuple[bytes, tuple[int, int, int]]] = []

    def add(self, string: bytes, doc: int, salt: int, begin: int) -> None:
        new = (doc, salt, begin)
        held = self.first.setdefault(string, new)
        if held == new:
            return
        if doc == held[0] and salt != held[1]:
            # rows of one doc_id but other texts are not earlier than each other
            self.apart.append((string, new))
        else:
            self.gone.append(max(held, new))
            self.first[string] = min(held, new)

    def __len__(self) -> int:
        return len(self.first) + len(self.gone) + len(self.apart)


def merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of half-open spans."""
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], begin[1:] > end[:-1]]) if len(begin) else np.empty(0, bool)
    opens = np.flatnonzero(new)
    return begin[opens], end[np.append(opens[1:], len(begin)) - 1] if len(opens) else end


def repeated_spans(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, salt, begin, end): spans of bytes to remove, some overlapping; doc is the id (null: the largest), salt 31 bits of the text's hash."""
    spark = docs.sparkSession
    rows = keyed(docs, id_column, text)
    total = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    anchors = (total["b"] or 0) * 2 / (REACH + 2)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(anchors / BUCKET_ANCHORS))

    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, out = batch.slice(at, 512), []
                for doc, salt, value in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), strict=True):
                    for place, gram, around, _, _ in grams.anchors(_bytes_of(value.as_py())):
                        out.append((gram, around, np.full(len(gram), doc), (np.int64(salt) << np.int64(32)) | place))
                if not out:
                    continue
                gram, around, doc, place = (np.concatenate(c) for c in zip(*out, strict=True))
                gram = gram.view(np.int64)
                bucket, spread = _bucket(splitters, gram >> KEY_SHIFT, (doc * 31 + (place >> 32)) & 0x7FFFFFFF)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket), pa.array(gram), pa.array(around.view(np.int64)), pa.array(doc), pa.array(place), pa.array(spread)],
                    names=["bucket", "gram", "around", "doc", "place", "spread"],
                )

    schema = "bucket int, gram bigint, around bigint, doc bigint, place bigint, spread boolean"
    splitters = np.empty(0, np.int64)
    share = min(1.0, max(SAMPLED, SAMPLED_PER_BUCKET * buckets) / max(1, total["n"]))
    sample = rows.where(F.pmod(F.xxhash64("doc", "salt", F.lit("sample")), F.lit(1 << 20)) < int(share * (1 << 20))).mapInArrow(anchored, schema)
    quantiles = [i / buckets for i in range(1, buckets)]
    found = sample.agg(F.percentile_approx(F.shiftright("gram", KEY_SHIFT), quantiles, 1_000_000).alias("q")).first()["q"] if quantiles else None
    splitters = np.array(found or [], np.int64)

    looked = stored(
        rows.mapInArrow(anchored, schema)
        .repartitionById(buckets, "bucket")
        .mapInArrow(_classified, "doc bigint, place bigint, kind tinyint")
        .select("doc", F.shiftright("place", 32).cast("int").alias("salt"), F.col("place").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias("place"), "kind")
    )

    lists = looked.where("kind > 0").groupBy("doc", "salt").agg(F.sort_array(F.collect_list(F.struct("place", "kind"))).alias("found"))
    lists = stored(lists)

    ranges = np.unique(splitters)
    # an anchor has (REACH + 2) / 2 strings on average
    string_buckets = max(buckets, ceil(looked.where("kind = 2").count() * (REACH + 2) / 2 / BUCKET_STRINGS))

    def stringed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        out: list[tuple] = []
        met = FirstStrings()
        for batch in batches:
            for doc, salt, value, found in zip(*(batch.column(i) for i in range(4)), strict=True):
                doc, salt, data = doc.as_py(), salt.as_py(), _bytes_of(value.as_py())
                wanted = found.values
                at, kinds = wanted.field(0).to_numpy(), wanted.field(1).to_numpy()
                for place, gram, _, first, last in grams.anchors(data):
                    hit = np.minimum(np.searchsorted(at, place), len(at) - 1)
                    for i in np.flatnonzero(at[hit] == place).tolist():
                        low, high = int(first[i]), int(last[i])
                        if kinds[hit[i]] == 1:
                            key = int(gram[i].view(np.int64))
                            out.append((key, doc, salt, low, 0, high - low, data[low : high + SPAN].tobytes()))
                        else:
                            part = data[low : high + SPAN].tobytes()
                            for s in range(high - low + 1):
                                met.add(part[s : s + SPAN], doc, salt, low + s)
                        if len(out) >= 8192:
                            yield ranged(out)
                            out = []
                        if len(met) >= BLOCK_STRINGS:
                            yield from block(met)
                            met = FirstStrings()
        if out:
            yield ranged(out)
        yield from block(met)

    def ranged(out: list[tuple]) -> pa.RecordBatch:
        return emitted(out, _bucket(ranges, np.array([o[0] for o in out], np.int64) >> KEY_SHIFT, np.zeros(len(out), np.int64))[0])

    def block(met: FirstStrings) -> Iterator[pa.RecordBatch]:
        strings = [*met.first.items(), *met.apart]
        for begin in range(0, len(strings), 8192):
            out = []
            for string, (doc, salt, at) in strings[begin : begin + 8192]:
                key = int.from_bytes(hashlib.blake2b(string, digest_size=8).digest(), "little", signed=True)
                out.append((key, doc, salt, at, 0, 0, string))
            high = np.array([o[0] for o in out], np.int64).view(np.uint64) >> np.uint64(32)
            yield emitted(out, (high * np.uint64(string_buckets) >> np.uint64(32)).astype(np.int32))
        if met.gone:
            doc, salt, first, last = _joined_starts(*np.array(met.gone, np.int64).T)
            out = [(0, d, s, f, 0, t - f, None) for d, s, f, t in zip(doc.tolist(), salt.tolist(), first.tolist(), last.tolist(), strict=True)]
            yield emitted(out, ((doc + salt) % string_buckets).astype(np.int32))

    def emitted(out: list[tuple], bucket: np.ndarray) -> pa.RecordBatch:
        names = ["bucket", "key", "doc", "salt", "at", "first", "last", "bytes"]
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(bucket), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), types[1:], strict=True))], names=names)

    texts = _only(rows, lists)
    joined = texts.join(lists, ["doc", "salt"]).select("doc", "salt", "text", "found")
    strings = joined.mapInArrow(stringed, "bucket int, key bigint, doc bigint, salt int, at bigint, first bigint, last bigint, bytes binary")
    # equal strings have one key and so one bucket: nothing is left to compare across buckets
    repeats = strings.repartitionById(string_buckets, "bucket").mapInArrow(_repeats, "doc bigint, salt int, begin bigint, end bigint")
    settled = looked.where("kind = 0").select(
        "doc", "salt", F.greatest(F.lit(0), F.col("place") - REACH).cast("bigint").alias("begin"), (F.col("place") + SPAN).cast("bigint").alias("end")
    )
    return settled.union(repeats)


def keyed(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """(doc, salt, text) of all rows."""
    return docs.select(
        F.coalesce(F.col(id_column).cast("bigint"), F.lit(_NONE)).alias("doc"),
        F.pmod(F.xxhash64(text), F.lit((1 << 31) - 1)).cast("int").alias("salt"),
        F.col(text).alias("text"),
    )


def _only(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows whose key may be in `wanted`, so that others are not shuffled."""
    bitmap = bitmap_of(wanted.select(F.xxhash64("doc", "salt").alias("hash")), "hash")

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(bitmap, batch.column(0).to_numpy()))).select([1, 2, 3])

    return rows.select(F.xxhash64("doc", "salt").alias("hash"), "doc", "salt", "text").mapInArrow(passed, "doc bigint, salt int, text string")


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, spans (begin, end) removed, kept (the remaining bytes; null if nothing was removed), kept_sha256."""
    spans = repeated_spans(docs, id_column, text)
    spans = stored(spans.groupBy("doc", "salt").agg(F.collect_list(F.struct("begin", "end")).alias("spans")))
    bitmap = bitmap_of(spans.select(F.xxhash64("doc", "salt").alias("hash")), "hash")

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents that surely stay whole get their result; the text of the others goes on to the join."""
        for batch in batches:
            maybe = in_bitmap(bitmap, batch.column(0).to_numpy())
            sizes, digests, texts = [], [], []
            for value, open_ in zip(batch.column(3), maybe.tolist(), strict=True):
                data = _bytes_of(value.as_py())
                sizes.append(len(data))
                digests.append(hashlib.sha256(data).hexdigest())
                texts.append(data.tobytes() if open_ else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), pa.array(sizes, pa.int64()), pa.array(digests), pa.array(texts, pa.binary())],
                names=["doc", "salt", "n_bytes", "whole", "data"],
            )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                removed, runs, digests, left = [], [], [], []
                for size, whole, data, found in zip(*(part.column(i) for i in range(1, 5)), strict=True):
                    if found.as_py() is None:
                        removed.append(0), runs.append([]), digests.append(whole.as_py()), left.append(None)
                        continue
                    n = size.as_py()
                    begin, end = merged(found.values.field(0).to_numpy(), np.minimum(n, found.values.field(1).to_numpy()))
                    data, at, kept = data.as_py(), 0, []
                    for b, e in zip(begin.tolist(), end.tolist(), strict=True):
                        kept.append(data[at:b])
                        at = e
                    rest = b"".join([*kept, data[at:]])
                    removed.append(n - len(rest))
                    runs.append([{"begin": b, "end": e} for b, e in zip(begin.tolist(), end.tolist(), strict=True)])
                    digests.append(hashlib.sha256(rest).hexdigest())
                    left.append(rest)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(removed, pa.int64()), pa.array(runs, kinds), pa.array(left, pa.binary()), pa.array(digests)],
                    names=["doc_id", "n_bytes", "n_removed", "spans", "kept", "kept_sha256"],
                )

    rows = keyed(docs, id_column, text).select(F.xxhash64("doc", "salt").alias("hash"), "doc", "salt", "text")
    rows = rows.mapInArrow(untouched, "doc bigint, salt int, n_bytes bigint, whole string, data binary")
    joined = rows.join(spans, ["doc", "salt"], "left").select(F.nullif("doc", F.lit(_NONE)).alias("doc"), "n_bytes", "whole", "data", "spans")
    return joined.mapInArrow(cut, "doc_id bigint, n_bytes bigint, n_removed bigint, spans array<struct<begin:bigint,end:bigint>>, kept binary, kept_sha256 string")
