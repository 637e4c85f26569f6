"""Near-duplicate documents by chosen-path set similarity join.

A document's set holds the hashes of its distinct 5-word shingles. Equal sets are
one vertex. Each set has TOKENS minwise tokens and a sketch of SKETCH further ones, a
byte each; independent trees branch the sets: the root of tree r sends a set to the node
named by the two tokens at 2r and 2r + 1. Links join sets to classes; only nodes that hold
several classes are looked at:

* first every set of another class than its root's largest one is compared with the head of
  that class, once for all its roots: it joins large groups of near copies with one
  comparison per set;
* a small node is compared exhaustively inside a task, by sketches, as is what a
  larger node holds besides its largest class (in blocks with the members of that class);
* other nodes send each set to one child, or two with probability 1 / 3, each by a token
  chosen for the node: a pair at the threshold shares one child on average, pairs
  below it ever fewer from level to level, so nodes fall apart until they are small.
  What is large after LEVELS levels holds pairs close to the threshold and is
  compared in blocks.

Only pairs whose sketches agree are confirmed on the full sets. The best pairs of each set
come out of a task and are confirmed first. Of what is still between classes no pair leaves its
meeting: the full sets travel to the first meeting of each pair, once per set, and only links
that join classes come out, so masses of near misses do not multiply rows. A pair at the threshold has too few equal
bytes with a probability under 4e-6. It misses the root of one tree with probability 7/16,
and of all TREES trees with 1e-9; after one, two, three levels it is left in a tree's
small nodes with probability 0.46, 0.39, 0.34, and misses all trees with 3e-7, 8e-6, 5e-5.

Defined cases: a null or wordless text has an empty set and is linked with
nothing; texts of fewer than five words are one shingle; doc_id may be null (the
component is then the smallest doc_id that is not null, if any) or repeated; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertweave.llm.common import WordHashes, bitmap_of, components, discard, gram_hashes, in_bitmap, stored

SHINGLE = 5
TOKENS = 48
SKETCH = 512
TREES = 24
LEVELS = 6
#: A node is compared exhaustively if no set of it makes more pairs than this; what is compared in blocks has blocks of SMALL sets.
PAIRS_PER_SET, SMALL = 2048, 512
#: Similarity of a link, in percent, and the least number of equal sketch bytes of a candidate: four and a half deviations below.
LINK = 75
LEAST_EQUAL = int(SKETCH * 0.75 - 4.5 * (SKETCH * 0.75 * 0.25) ** 0.5)
#: Chosen children: one, and a second one in so many hundredths of the nodes.
SECOND_CHILD = 33
#: Sets that a task compares together, shingles that it confirms together, and pairs of sketches looked at in one block.
ROWS_TOGETHER, SHINGLES_TOGETHER, PAIRS_TOGETHER = 10_000, 4_000_000, 1 << 13
SETS_PER_FILE = 20_000
#: Shingles hashed at once, which bounds the memory of long texts.
_CHUNK = 1024

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_RANDOM = np.random.default_rng(20_240_601)
_FACTORS = (_RANDOM.integers(0, 2**31, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)).astype(np.uint32)
_OFFSETS = _RANDOM.integers(0, 2**32, SKETCH, dtype=np.uint64).astype(np.uint32)


def shingle_set(text: str | None, words: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    hashes = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    return np.unique(gram_hashes(hashes, min(SHINGLE, len(found))) if found else hashes)


def minwise_tokens(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of the set under each of SKETCH 32-bit hash functions."""
    least = np.full(SKETCH, 2**32 - 1, np.uint32)
    folded = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    for at in range(0, len(folded), _CHUNK):
        np.minimum(least, (folded[at : at + _CHUNK, None] * _FACTORS + _OFFSETS).min(axis=0), out=least)
    return least


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text_hash, text) to (doc_id, text_hash, n_shingles, set_id, tokens, sketch)."""
    import xxhash

    words = WordHashes()
    for batch in batches:
        sizes, ids, tokens, sketches = [], [], [], []
        for text in batch.column(2):
            shingles = shingle_set(text.as_py(), words)
            least = minwise_tokens(shingles) if len(shingles) else None
            sizes.append(len(shingles))
            ids.append(None if least is None else xxhash.xxh3_128_digest(shingles.tobytes()))
            tokens.append(None if least is None else least[:TOKENS].view(np.int32).tolist())
            sketches.append(None if least is None else least.astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(tokens, pa.list_(pa.int32())), pa.array(sketches, pa.binary())],
            names=["doc_id", "text_hash", "n_shingles", "set_id", "tokens", "sketch"],
        )


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(set_id, shingles) of the sets in `wanted` (doc_id, text_hash of one of their documents), and of few others."""
    key = F.xxhash64("doc_id", "text_hash").alias("hash")
    bitmap = docs.sparkSession.sparkContext.broadcast(bitmap_of(wanted.select(key), "hash"))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        words = WordHashes()
        for batch in batches:
            batch = batch.filter(pa.array(in_bitmap(bitmap.value, batch.column(0).to_numpy())))
            for at in range(0, batch.num_rows, 256):
                sets = [shingle_set(text.as_py(), words) for text in batch.slice(at, 256).column(1)]
                ids = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["set_id", "shingles"])

    rows = docs.withColumn("text_hash", F.xxhash64("text")).select(key, "text")
    made = rows.mapInArrow(found, "set_id binary, shingles binary")
    return made.groupBy("set_id").agg(F.first("shingles").alias("shingles")).select(F.xxhash64("set_id").alias("hash"), "set_id", "shingles")


def linked_pairs(left: np.ndarray, right: np.ndarray) -> bool:
    """Whether two sorted sets reach the similarity of a link."""
    common = len(np.intersect1d(left, right, assume_unique=True))
    return 100 * common >= LINK * (len(left) + len(right) - common)


def _bucket(buckets: int) -> Column:
    """Meetings are dealt into buckets for their confirmation."""
    return F.pmod(F.xxhash64("meet"), F.lit(buckets)).cast("int").alias("bucket")


def _sent(ends: DataFrame, sets: DataFrame) -> DataFrame:
    """(bucket, set_id, shingles): the full sets of distinct (bucket, set_id)."""
    bitmap = sets.sparkSession.sparkContext.broadcast(bitmap_of(ends.select(F.xxhash64("set_id").alias("hash")), "hash"))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(bitmap.value, batch.column(0).to_numpy()))).select([1, 2])

    near = sets.mapInArrow(named, "set_id binary, shingles binary")
    return ends.withColumnRenamed("set_id", "_id").join(near, F.col("_id") == F.col("set_id")).select("bucket", "set_id", "shingles")


def _held(sent: pa.Table) -> dict[bytes, np.ndarray]:
    shingles = (np.frombuffer(x.as_buffer(), np.uint64) for x in sent.column("shingles").combine_chunks())
    return dict(zip(sent.column("set_id").to_pylist(), shingles))


def _confirmed(pairs: DataFrame, sets: DataFrame, buckets: int) -> DataFrame:
    """Of pairs (meet, a, b) those (a, b) whose full sets reach the similarity of a link.

    Each set travels once to each meeting that has a pair of it; meetings are dealt into buckets.
    """
    ends = pairs.select("meet", F.explode(F.array("a", "b")).alias("set_id")).select(_bucket(buckets), "set_id").distinct()

    def settled(looked: pa.Table, sent: pa.Table) -> pa.Table:
        held = _held(sent)
        fine = [linked_pairs(held[a], held[b]) for a, b in zip(looked.column("a").to_pylist(), looked.column("b").to_pylist())]
        return looked.select(["a", "b"]).filter(pa.array(fine, pa.bool_()))

    dealt = pairs.select(_bucket(buckets), "a", "b")
    return dealt.groupBy("bucket").cogroup(_sent(ends, sets).groupBy("bucket")).applyInArrow(settled, "a binary, b binary")


def _joined_inside(rows: DataFrame, sets: DataFrame, buckets: int) -> DataFrame:
    """Links (a, b) that join the classes of the sets of each meeting; `rows` as `with_partner` gives them.

    Pairs are confirmed where they meet first, the most similar ones before others, unless their classes are
    joined already. A task gives fewer links than it has classes.
    """
    dealt = rows.withColumn("bucket", _bucket(buckets))

    def joined(looked: pa.Table, sent: pa.Table) -> pa.Table:
        looked = looked.sort_by("meet")
        held, names, first = _held(sent), looked.column("set_id").to_pylist(), _first_meeting(looked)
        left, right, equal = agreeing_places(looked)
        label = _labels(looked).tolist()
        parent = list(range(len(label)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        a, b = [], []
        for at in np.argsort(-equal, kind="stable"):
            i, j = int(left[at]), int(right[at])
            one, other = root(label[i]), root(label[j])
            if one != other and first(i, j) and linked_pairs(held[names[i]], held[names[j]]):
                parent[other] = one
                a.append(min(names[i], names[j]))
                b.append(max(names[i], names[j]))
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    ends = rows.select(_bucket(buckets), "set_id").distinct()
    return dealt.groupBy("bucket").cogroup(_sent(ends, sets).groupBy("bucket")).applyInArrow(joined, "a binary, b binary")


def _fits(x: str, y: str) -> Column:
    """Whether two set sizes allow a link."""
    return 100 * F.least(x, y) >= LINK * F.greatest(x, y)


def _whole(rows: pa.Table, name: str) -> pa.Array:
    return rows.column(name).combine_chunks()


def _labels(rows: pa.Table) -> np.ndarray:
    return _whole(rows, "class").dictionary_encode().indices.to_numpy().astype(np.int64)


def agreeing_places(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (left, right) of sets of one meeting and different classes whose sketches agree, and their equal bytes; rows are sorted by meeting."""
    meet, size, label = _whole(rows, "meet").to_numpy(), _whole(rows, "n_shingles").to_numpy(), _labels(rows)
    sketch = np.frombuffer(b"".join(_whole(rows, "sketch").to_pylist()), np.uint8).reshape(rows.num_rows, SKETCH)
    left, right, equal = [], [], []  # 32-bit places, as a mass of near copies may give many
    for apart in range(1, rows.num_rows):
        same = meet[apart:] == meet[:-apart]
        if not same.any():
            break
        near = 100 * np.minimum(size[apart:], size[:-apart]) >= LINK * np.maximum(size[apart:], size[:-apart])
        at = np.flatnonzero(same & near & (label[apart:] != label[:-apart]))
        for low in range(0, len(at), PAIRS_TOGETHER):
            block = at[low : low + PAIRS_TOGETHER]
            alike = np.count_nonzero(sketch[block] == sketch[block + apart], axis=1)
            good = alike >= LEAST_EQUAL
            left.append(block[good].astype(np.int32))
            right.append((block[good] + apart).astype(np.int32))
            equal.append(alike[good].astype(np.int32))
    return tuple(np.concatenate([*x, np.empty(0, np.int32)]) for x in (left, right, equal))


def best_agreeing(rows: pa.Table) -> pa.Table:
    """Pairs (meet, a, b) of sets of one meeting and different classes whose sketches agree, two of a set at most.

    These are the pair with the most equal bytes and the best one with its meeting's largest class.
    """
    rows = rows.sort_by("meet")
    meet, label = _whole(rows, "meet").to_numpy(), _labels(rows)
    meet_number = np.cumsum(np.concatenate([[0], meet[1:] != meet[:-1]])) if len(meet) else meet
    left, right, equal = agreeing_places(rows)
    if len(left):
        # the largest class of each meeting, as the label of every row
        pair = meet_number * (int(label.max()) + 1) + label
        count = np.unique(pair, return_counts=True)[1][np.unique(pair, return_inverse=True)[1]]
        order = np.lexsort((label, -count, meet_number))
        largest = label[order[np.searchsorted(meet_number[order], meet_number)]]
        keep = np.zeros(len(left), bool)
        for one, other in ((left, right), (right, left)):
            for rows_at in (np.arange(len(left)), np.flatnonzero(label[other] == largest[other])):
                ordered_at = rows_at[np.lexsort((-equal[rows_at], one[rows_at]))]
                first = np.ones(len(ordered_at), bool)
                first[1:] = one[ordered_at][1:] != one[ordered_at][:-1]
                keep[ordered_at[first]] = True
        left, right = left[keep], right[keep]
    names = _whole(rows, "set_id")
    rank = np.empty(rows.num_rows, np.int64)
    rank[pc.sort_indices(names).to_numpy()] = np.arange(rows.num_rows)
    turned = rank[left] > rank[right]
    left, right = np.where(turned, right, left), np.where(turned, left, right)
    return pa.table({"meet": pa.array(meet[left], pa.int64()), "a": names.take(pa.array(left)), "b": names.take(pa.array(right))})


def _first_meeting(rows: pa.Table) -> Callable[[int, int], bool]:
    """Whether the sets at two places of one meeting have no common meeting before it."""
    meet, meets = _whole(rows, "meet").to_pylist(), [frozenset(x) for x in _whole(rows, "meets").to_pylist()]
    return lambda i, j: min(meets[i] & meets[j]) == meet[i]


def with_partner(rows: pa.Table) -> pa.Table:
    """The rows with a set of another class whose sketch agrees and which they meet here first; all without their bucket."""
    rows = rows.sort_by("meet")
    first, keep = _first_meeting(rows), np.zeros(rows.num_rows, bool)
    for i, j in zip(*(x.tolist() for x in agreeing_places(rows)[:2])):
        if not (keep[i] and keep[j]) and first(i, j):
            keep[i] = keep[j] = True
    return rows.filter(pa.array(keep)).drop_columns(["bucket"])


class _Classes:
    """The classes of the sets so far, and what their links were found from."""

    def __init__(self, vertices: DataFrame, sets: DataFrame):
        self.vertices, self.sets = vertices, sets
        empty = F.lit(None).cast("binary")
        self.classes = stored(vertices.sparkSession.range(0, 0, 1, 1).select(empty.alias("set_id"), empty.alias("class")))
        self.tried: list[DataFrame] = []
        # a bucket of confirmations holds about so many sets that their shingles stay within bounds
        total = vertices.agg(F.sum("n_shingles").alias("n"), F.count("*").alias("sets")).first()
        self.buckets = max(1, -(-(total["n"] or 0) // SHINGLES_TOGETHER)) * 16
        #: Files of a table with a few narrow rows per set: many tiny ones cost more than their rows.
        self.parts = 1 + total["sets"] // SETS_PER_FILE

    def of(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.classes, "set_id", "left").withColumn("class", F.coalesce("class", "set_id"))

    def link(self, pairs: DataFrame) -> None:
        """Confirm pairs (meet, a, b), each once however many meetings propose it, and join the classes of those that are links."""
        pairs = pairs.groupBy("a", "b").agg(F.min("meet").alias("meet"))
        for before in self.tried:
            pairs = pairs.join(before.select("a", "b"), ["a", "b"], "left_anti")
        pairs = stored(pairs.coalesce(self.parts))
        any_pair = pairs.limit(1).count()
        if self.tried and not any_pair:
            discard(pairs)
            return
        self.tried.append(pairs)
        if any_pair:
            self.join(stored(_confirmed(pairs, self.sets, self.buckets)))
        if len(self.tried) > 3:
            joined = stored(reduce(DataFrame.union, self.tried).coalesce(self.parts))
            discard(*self.tried)
            self.tried = [joined]

    def join(self, links: DataFrame) -> None:
        """Join the classes of the ends of links (a, b), a stored table that is deleted."""
        if not links.limit(1).count():
            discard(links)
            return
        name = lambda side: self.classes.select(F.col("set_id").alias(side), F.col("class").alias(f"_{side}"))
        edges = links.join(name("a"), "a", "left").join(name("b"), "b", "left")
        edges = edges.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")).where("a <> b")
        merged = components(edges, self.parts)
        ends = links.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
        every = ends.join(self.classes, "set_id", "full").select("set_id", F.coalesce("class", "set_id").alias("class"))
        joined = every.join(merged, F.col("class") == F.col("vertex"), "left")
        after = stored(joined.select("set_id", F.coalesce("component", "class").alias("class")).coalesce(self.parts))
        discard(links, merged, self.classes)
        self.classes = after

    def heads(self, rows: DataFrame) -> None:
        """Compare each set of (set_id, n_shingles, class, most) with the most popular set of the class `most`, once."""
        head = self.of(self.vertices.select("set_id", "n_shingles", "rank", "sketch")).groupBy("class").agg(F.min(F.struct("rank", "set_id", "n_shingles", "sketch")).alias("h"))
        head = head.select(F.col("class").alias("most"), F.col("h.set_id").alias("b"), F.col("h.n_shingles").alias("bn"), F.col("h.sketch").alias("_b"))
        near = rows.where("class <> most").select("set_id", "most").distinct().join(head, "most")
        near = near.join(self.vertices.select("set_id", "n_shingles", "sketch"), "set_id").where(_fits("n_shingles", "bn"))

        def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                one, other = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, SKETCH) for i in (2, 3))
                yield batch.filter(pa.array(np.count_nonzero(one == other, axis=1) >= LEAST_EQUAL)).select([0, 1])

        pairs = near.select(F.least("set_id", "b").alias("a"), F.greatest("set_id", "b").alias("b"), "sketch", "_b").mapInArrow(alike, "a binary, b binary")
        # confirmed in meetings of a head with some of its sets
        self.link(pairs.select(F.xxhash64("a", F.pmod(F.xxhash64("b"), F.lit(64))).alias("meet"), "a", "b"))

    def meet(self, rows: DataFrame) -> None:
        """Compare the sets of each meeting (meet, set_id) across classes: the best pairs of each set, then all that is still between classes, inside the meetings."""
        total = rows.count()
        if not total:
            return
        known = self.vertices.select("set_id", "n_shingles", "sketch")
        bucket = F.pmod(F.xxhash64("meet", F.lit(1)), F.lit(-(-total // ROWS_TOGETHER) * 4)).cast("int").alias("bucket")

        def apart(rows: DataFrame) -> DataFrame:
            now = self.of(rows)
            mixed = now.groupBy("meet").agg((F.min("class") != F.max("class")).alias("several")).where("several").select("meet")
            return stored(now.join(mixed, "meet", "left_semi"))

        left = apart(rows)
        if left.limit(1).count():
            dealt = left.join(known, "set_id").select(bucket, "meet", "n_shingles", "class", "set_id", "sketch")
            self.link(dealt.groupBy("bucket").applyInArrow(best_agreeing, "meet bigint, a binary, b binary"))
            still = apart(left.select("meet", "set_id"))
            visits = still.groupBy("set_id").agg(F.collect_list("meet").alias("meets"))
            dealt = still.join(visits, "set_id").join(known, "set_id").select(bucket, "meet", "meets", "n_shingles", "class", "set_id", "sketch")
            paired = stored(dealt.groupBy("bucket").applyInArrow(with_partner, dealt.drop("bucket").schema))
            if paired.limit(1).count():
                self.join(stored(_joined_inside(paired, self.sets, self.buckets)))
            discard(still, paired)
        discard(left)


def _mixed(nodes: DataFrame) -> DataFrame:
    """Rows of the nodes that hold several classes, with the class, the node's largest class, its size and the sets outside it."""
    per_class = nodes.groupBy("node", "class").agg(F.count("*").alias("n"))
    whole = per_class.groupBy("node").agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.max(F.struct("n", "class")).alias("m"))
    whole = whole.where("k > 1").select("node", "n", F.col("m.class").alias("most"), (F.col("n") - F.col("m.n")).alias("others"))
    return nodes.join(whole, "node")


def _many() -> Column:
    """Whether a node holds more sets outside its largest class than each block of that class can meet."""
    return F.col("others") > min(SMALL, PAIRS_PER_SET)


def _meetings(mixed: DataFrame, last: bool) -> DataFrame:
    """(meet, set_id): whole small nodes; of larger ones the sets outside the largest class with blocks of it; at the last level blocks by blocks."""
    blocks = F.ceil(F.col("n") / SMALL).cast("int")
    block = F.pmod(F.xxhash64("set_id"), blocks).cast("int")
    named = lambda *parts: F.xxhash64("node", *parts).alias("meet")
    small = mixed.where(F.col("n") <= PAIRS_PER_SET).select(named(), "set_id")
    main = mixed.where((F.col("n") > PAIRS_PER_SET) & ~_many())
    inside = main.where("class = most").select(named(block), "set_id")
    beside = main.where("class <> most").select("node", "set_id", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("i")).select(named("i"), "set_id")
    out = small.union(inside).union(beside)
    if last:
        large = mixed.where((F.col("n") > PAIRS_PER_SET) & _many()).select("node", "set_id", block.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("i"))
        out = out.union(large.select(named(F.least("own", "i"), F.greatest("own", "i")), "set_id"))
    return out


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, text_hash, n_shingles, set_id, component_id (smallest doc_id reachable by links)."""
    docs = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    sketched = stored(
        docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
            _sketched, f"doc_id {id_type}, text_hash bigint, n_shingles bigint, set_id binary, tokens array<int>, sketch binary"
        )
    )
    one = F.min(F.struct("doc_id", "text_hash", "n_shingles", "tokens", "sketch")).alias("o")
    different = stored(sketched.where("set_id is not null").groupBy("set_id").agg(one).select("set_id", "o.*"))
    # a first star on one token, and the roots of the trees on two
    token = lambda i: F.get("tokens", F.lit(i))
    paths = [F.struct(F.lit(-1).alias("tree"), F.xxhash64(F.lit(-1), token(TOKENS - 1)).alias("node"))]
    paths += [F.struct(F.lit(r).alias("tree"), F.xxhash64(F.lit(r), token(2 * r % TOKENS), token((2 * r + 1) % TOKENS)).alias("node")) for r in range(TREES)]
    roots = different.select("set_id", F.explode(F.array(*paths)).alias("p")).select("p.*", "set_id")
    shared = roots.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
    nodes = stored(roots.join(shared, "node"))
    # the more sets meet a set in its nodes, the lower its rank
    popular = nodes.groupBy("set_id").agg((-F.sum("n")).alias("rank"))
    # only sets that share a node can be linked; their shingles are worked out once
    vertices = stored(different.join(popular, "set_id"))
    discard(different)
    sets = stored(_sets(docs, vertices.select("doc_id", "text_hash")))
    found = _Classes(vertices, sets)

    # the first star joins the large groups before the trees are looked at
    found.heads(_mixed(found.of(nodes.where("tree < 0").select("node", "set_id"))))
    level = stored(nodes.where("tree >= 0").select("node", "set_id"))
    discard(nodes)
    found.heads(_mixed(found.of(level)))
    for depth in range(LEVELS + 1):
        mixed = stored(_mixed(found.of(level)))
        discard(level)
        meetings = stored(_meetings(mixed, depth == LEVELS))
        found.meet(meetings)
        discard(meetings)
        large = mixed.where((F.col("n") > PAIRS_PER_SET) & _many()).select("node", "set_id")
        if depth == LEVELS or not large.limit(1).count():
            discard(mixed)
            break
        chosen = F.array(F.pmod(F.xxhash64("node", F.lit(0)), F.lit(TOKENS)).cast("int"), F.when(F.pmod(F.xxhash64("node", F.lit(2)), F.lit(100)) < SECOND_CHILD, F.pmod(F.xxhash64("node", F.lit(1)), F.lit(TOKENS)).cast("int")))
        branched = large.join(vertices.select("set_id", "tokens"), "set_id").select("node", "set_id", "tokens", F.explode(F.array_distinct(F.array_compact(chosen))).alias("at"))
        level = stored(branched.select(F.xxhash64("node", "at", F.get("tokens", F.col("at"))).alias("node"), "set_id"))
        discard(mixed)

    named = sketched.select("doc_id", "text_hash", "n_shingles", "set_id").join(found.classes, "set_id", "left")
    named = named.withColumn("class", F.coalesce("class", "set_id"))
    # documents with an empty set stand alone and take no part in the join below
    first = named.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("first"))
    result = named.join(first, "class", "left").select(
        "doc_id", "text_hash", "n_shingles", "set_id", F.coalesce("first", "doc_id").alias("component_id")
    )
    discard(vertices, sets, *found.tried)
    return result


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """`docs` with one document of each component: the one of smallest doc_id (rows equal in doc_id and text stay together)."""
    found = near_duplicates(docs)
    gone = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id")) & F.col("component_id").isNotNull())
    gone = gone.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    return docs.join(gone.hint("merge"), docs["doc_id"].eqNullSafe(F.col("_id")) & (F.xxhash64(docs["text"]) == F.col("_hash")), "left_anti")
