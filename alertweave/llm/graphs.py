"""Approximate nearest neighbours by hierarchical navigable small-world graphs, one per shard.

Equal vectors are one node that carries their smallest ids, as many as any answer can
use. Nodes are dealt to shards by hash; a task builds the graph of its shard and
stores it as one row per node with flat arrays of neighbour numbers. Every query meets
every shard: a shard's graph and its queries come to one task as a stream, graph
first; the answers of the shards are merged by query.

Inside a shard the nodes are in random order and level l holds the first n / SPREAD**l
of them, so that a level is a prefix of the arrays. Nodes are inserted in batches: a
beam search from the top level down gives candidates, the other nodes of the batch
are candidates too, links are chosen so that they lead different ways (a candidate closer to a
chosen link than to the node waits), and links back are chosen anew where they are
too many. Vectors get one more component, which makes their lengths equal in
a shard, so that the largest inner product is the nearest point. The scores of what
the graph finds are inner products of the original vectors in double precision,
added component by component.

The number of shards follows the square root of the nodes until a shard is as large as a task's
memory allows; the work of a query grows with the number of shards, a graph's own with the
logarithm of its size.

Defined cases: vectors null, empty, zero or with null or non-finite components take
no part; vectors of different lengths do not meet; rows equal in id and vector ask once,
and are two candidates; a query leaves out its own row only; a null id is no query and no candidate; fewer candidates than
`k` give them all that the graph reaches; an empty table gives no rows; columns besides
id and vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertweave.llm.common import stored

NEIGHBOURS = 20
#: Every how many ids a row asks.
ASKING = 20
#: Links of a node above and on the ground level, and the ratio of the levels' sizes.
LINKS, GROUND_LINKS, SPREAD = 12, 24, 16
#: Beam of insertion and of search, and the nodes that a step of a beam looks at.
BEAM_IN, BEAM_OUT, STRIDE = 48, 80, 4
#: Nodes inserted or queries searched together, and the bytes of their marks of visited nodes.
BATCH, MARKS = 512, 1 << 26
#: Nodes of a shard: so many times the square root of all nodes, within these bounds (the upper one for vectors of 64 components).
PER_ROOT, LEAST_SHARD, LARGEST_SHARD, LEAST_SHARDS = 32, 1024, 1 << 18, 4
#: Ids of a group that are sorted together; larger groups of equal vectors are salted.
SALT_ROWS = 100_000


def choose(near: np.ndarray, score: np.ndarray, vectors: np.ndarray, most: int) -> np.ndarray:
    """Of candidates `near` (rows of node numbers, -1 for none) with their scores, at most `most` links per row that lead different ways."""
    order = np.argsort(-score, axis=1, kind="stable")
    near, score = np.take_along_axis(near, order, 1), np.take_along_axis(score, order, 1)
    points = vectors[near]
    between = points @ points.transpose(0, 2, 1)
    rows, width = near.shape
    taken = np.zeros((rows, width), bool)
    for c in range(width):
        clear = ~(taken & (between[:, c, :] > score[:, c, None])).any(axis=1)
        taken[:, c] = clear & (near[:, c] >= 0) & (taken.sum(axis=1) < most)
    # those that waited fill up what is left, nearest first
    rank = np.where(taken, 0, np.where(near >= 0, 1, 2))
    first = np.argsort(rank, axis=1, kind="stable")[:, :most]
    return np.take_along_axis(near, first, 1)


class Graph:
    """A hierarchical navigable small-world graph over points of equal length; more alike is a larger inner product."""

    def __init__(self, points: np.ndarray, sizes: list[int], links: list[np.ndarray]):
        self.points, self.sizes, self.links = points, sizes, links

    @staticmethod
    def level_sizes(n: int) -> list[int]:
        sizes = [n]
        while sizes[-1] > 4 * SPREAD:
            sizes.append(-(-sizes[-1] // SPREAD))
        return sizes

    @classmethod
    def build(cls, points: np.ndarray) -> Graph:
        sizes = cls.level_sizes(len(points))
        links = [np.full((size, LINKS if level else GROUND_LINKS), -1, np.int32) for level, size in enumerate(sizes)]
        graph = cls(points, sizes, links)
        at = 0
        while at < len(points):
            # a batch never outgrows the graph that it is inserted into, nor passes the end of a level
            ends = [size for size in sizes if size > at]
            to = min(at + max(16, min(BATCH, at // 2, MARKS // len(points))), min(ends))
            graph._insert(at, to)
            at = to
        return graph

    def _insert(self, at: int, to: int) -> None:
        batch = np.arange(at, to)
        queries = self.points[batch]
        entry = np.zeros(len(batch), np.int64)
        among = queries @ queries.T
        np.fill_diagonal(among, -np.inf)
        beside = min(len(batch) - 1, GROUND_LINKS)
        mates = np.argpartition(-among, beside - 1, axis=1)[:, :beside] if beside else np.empty((len(batch), 0), np.int64)
        mate_score = np.take_along_axis(among, mates, 1)
        for level in range(len(self.sizes) - 1, -1, -1):
            size = min(at, self.sizes[level])
            inserted = to <= self.sizes[level]
            if size:
                near, score = self.beam(queries, entry, level, BEAM_IN if inserted else 1)
                entry = near[np.arange(len(batch)), np.argmax(score, axis=1)]
            if not inserted:
                continue
            near = np.concatenate([near, mates + at], axis=1) if size else mates + at
            score = np.concatenate([score, mate_score], axis=1) if size else mate_score
            if near.shape[1]:
                self._link(batch, near, score, level)

    def _link(self, batch: np.ndarray, near: np.ndarray, score: np.ndarray, level: int) -> None:
        links = self.links[level]
        most = links.shape[1]
        chosen = choose(near, score, self.points, most)
        links[batch, : chosen.shape[1]] = chosen
        # links back, grouped by the node that gets them; of very many the nearest can be kept only
        source, target = np.repeat(batch, chosen.shape[1]), chosen.ravel()
        source, target = source[target >= 0], target[target >= 0]
        alike = np.einsum("ij,ij->i", self.points[source], self.points[target])
        order = np.lexsort((-alike, target))
        source, target = source[order], target[order]
        nodes, start, count = np.unique(target, return_index=True, return_counts=True)
        place = np.arange(len(target)) - np.repeat(start, count)
        width = min(int(count.max(initial=0)), most)
        added = np.full((len(nodes), width), -1, np.int64)
        row = np.repeat(np.arange(len(nodes)), count)
        fits = place < width
        added[row[fits], place[fits]] = source[fits]
        # a batch may have linked both ways already
        known = links[nodes]
        added[(added[:, :, None] == known[:, None, :]).any(axis=2)] = -1
        merged = np.concatenate([known, added], axis=1)
        merged = np.take_along_axis(merged, np.argsort(merged < 0, axis=1, kind="stable"), 1)
        full = (merged >= 0).sum(axis=1) > most
        links[nodes[~full]] = merged[~full][:, :most]
        if full.any():
            own = merged[full]
            score = np.einsum("ijk,ik->ij", self.points[own], self.points[nodes[full]])
            score[own < 0] = -np.inf
            links[nodes[full]] = choose(own, score, self.points, most)

    def beam(self, queries: np.ndarray, entry: np.ndarray, level: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The `width` best nodes that a beam search from `entry` finds for each query: (numbers, scores), -1 and -inf for none."""
        links, n = self.links[level], len(queries)
        stride = min(STRIDE, width)
        near = np.full((n, width), -1, np.int64)
        score = np.full((n, width), -np.inf, np.float32)
        opened = np.zeros((n, width), bool)
        near[:, 0] = entry
        score[:, 0] = np.einsum("ij,ij->i", queries, self.points[entry])
        seen = np.zeros((n, self.sizes[level]), bool)
        seen[np.arange(n), entry] = True
        active = np.arange(n)
        while True:
            waiting = np.where(opened[active], -np.inf, score[active])
            going = waiting.max(axis=1) > -np.inf
            active, waiting = active[going], waiting[going]
            if not len(active):
                return near, score
            best = np.argpartition(-waiting, stride - 1, axis=1)[:, :stride] if stride < width else np.argsort(-waiting, axis=1)[:, :stride]
            real = np.take_along_axis(waiting, best, 1) > -np.inf
            opened[active[:, None], best] |= real
            step = near[active[:, None], best]
            found = np.full((len(active), stride, links.shape[1]), -1, np.int64)
            for s in range(stride):
                ahead = np.where(real[:, s, None], links[step[:, s]], -1)
                fresh = (ahead >= 0) & ~seen[active[:, None], ahead]
                row, column = np.nonzero(fresh)
                seen[active[row], ahead[row, column]] = True
                found[row, s, column] = ahead[row, column]
            found = found.reshape(len(active), -1)
            row, column = np.nonzero(found >= 0)
            gained = np.full(found.shape, -np.inf, np.float32)
            gained[row, column] = np.einsum("ij,ij->i", queries[active[row]], self.points[found[row, column]])
            both, scores = np.concatenate([near[active], found], axis=1), np.concatenate([score[active], gained], axis=1)
            state = np.concatenate([opened[active], np.zeros(found.shape, bool)], axis=1)
            kept = np.argpartition(-scores, width - 1, axis=1)[:, :width]
            near[active], score[active], opened[active] = (np.take_along_axis(x, kept, 1) for x in (both, scores, state))

    def search(self, queries: np.ndarray, width: int = BEAM_OUT) -> np.ndarray:
        """Numbers of the nodes found for each query (-1 for none), from the top level down."""
        entry = np.zeros(len(queries), np.int64)
        for level in range(len(self.sizes) - 1, 0, -1):
            near, score = self.beam(queries, entry, level, 1)
            entry = near[:, 0]
        return self.beam(queries, entry, 0, width)[0]


def lengthened(vectors: np.ndarray) -> np.ndarray:
    """The vectors scaled together and with one more component, so that all have length one."""
    norms = np.einsum("ij,ij->i", vectors, vectors, dtype=np.float64)
    scale = max(norms.max(initial=0.0), np.finfo(np.float64).tiny)
    rest = np.sqrt(np.maximum(0.0, 1.0 - norms / scale))
    return np.concatenate([vectors / np.sqrt(scale), rest[:, None]], axis=1).astype(np.float32)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, component after component, whatever stands beside them."""
    total = np.zeros(len(a))
    for x, y in zip(a.T, b.T):
        total += x * y
    return total


_NODE = "dims int, shard int, kind int, number int, ids array<bigint>, vector array<double>, ground array<int>, upper array<int>"


def _nodes(sound: DataFrame, k: int) -> DataFrame:
    """(vector, ids): one row per different vector, with its k + 1 smallest ids."""
    salts = max(1, -(-sound.count() // SALT_ROWS))
    first = lambda ids: F.slice(F.array_sort(ids), 1, k + 1)
    salted = sound.groupBy("vector", F.pmod(F.xxhash64("vec_id"), F.lit(salts)).alias("salt")).agg(first(F.collect_list("vec_id")).alias("ids"))
    return salted.groupBy("vector").agg(first(F.flatten(F.collect_list("ids"))).alias("ids"))


def build_index(vectors: DataFrame, k: int = NEIGHBOURS, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The stored index: one row per node with its shard, number, ids, vector and the flat neighbour arrays of its levels."""
    nodes = stored(_nodes(_sound(vectors, id_column, vector), k).withColumn("dims", F.size("vector")))
    # as many rows as there are lengths of vectors; a shard's bytes are bounded whatever their length
    shards = []
    for row in nodes.groupBy("dims").count().collect():
        most = max(1, LARGEST_SHARD * 64 // max(64, row["dims"]))
        size = min(most, max(LEAST_SHARD, int(PER_ROOT * row["count"] ** 0.5)))
        shards.append((row["dims"], max(LEAST_SHARDS, -(-row["count"] // size))))
    plan = nodes.sparkSession.createDataFrame(shards, "dims int, shards int")
    dealt = nodes.join(F.broadcast(plan), "dims").select("dims", F.pmod(F.xxhash64("vector"), "shards").cast("int").alias("shard"), F.xxhash64("vector", F.lit(1)).alias("place"), "ids", "vector")

    def built(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        dims, n = rows.column("dims")[0].as_py(), rows.num_rows
        points = rows.column("vector").combine_chunks().flatten().to_numpy().reshape(n, dims)
        graph = Graph.build(lengthened(points))
        upper = [[] for _ in range(n)]
        for links in graph.links[1:]:
            for number, own in enumerate(links.tolist()):
                upper[number] += own
        number = pa.array(np.arange(n), pa.int32())
        ground = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * GROUND_LINKS, pa.int32()), pa.array(graph.links[0].ravel(), pa.int32()))
        return pa.table({
            "dims": rows.column("dims"), "shard": rows.column("shard"), "kind": pa.array(np.zeros(n), pa.int32()), "number": number,
            "ids": rows.column("ids"), "vector": rows.column("vector"), "ground": ground, "upper": pa.array(upper, pa.list_(pa.int32())),
        })

    return stored(dealt.groupBy("dims", "shard").applyInArrow(built, _NODE))


def _sound(vectors: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(vec_id, vector in double precision) of the rows that take part."""
    value = F.col(vector)
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.where(F.col(id_column).isNotNull() & value.isNotNull() & finite & F.exists(value, lambda x: x != 0))
    return rows.select(F.col(id_column).cast("long").alias("vec_id"), F.transform(value, lambda x: x.cast("double")).alias("vector"))


def _loaded(rows: pa.Table) -> tuple[Graph, np.ndarray, pa.Array]:
    """A shard's graph from its rows, its original vectors and its ids."""
    n, dims = rows.num_rows, rows.column("dims")[0].as_py()
    whole = lambda name: rows.column(name).combine_chunks()
    vectors = whole("vector").flatten().to_numpy().reshape(n, dims)
    sizes = Graph.level_sizes(n)
    links = [whole("ground").flatten().to_numpy().reshape(n, GROUND_LINKS)]
    lists = whole("upper")
    for level, size in enumerate(sizes[1:]):
        flat = [own[level * LINKS : (level + 1) * LINKS] for own in lists.slice(0, size).to_pylist()]
        links.append(np.array(flat, np.int32).reshape(size, LINKS))
    return Graph(lengthened(vectors), sizes, links), vectors, whole("ids")


def _answers(graph: Graph, vectors: np.ndarray, ids: pa.Array, asked: np.ndarray, queries: np.ndarray, k: int) -> list[list[tuple[float, int]]]:
    """The k best (score, id) of each query in a shard, without the query's own row."""
    room = np.concatenate([queries / max(np.abs(queries).max(), np.finfo(np.float64).tiny), np.zeros((len(queries), 1))], axis=1).astype(np.float32)
    out: list[list[tuple[float, int]]] = []
    step = max(1, min(BATCH, MARKS // len(vectors)))
    for at in range(0, len(queries), step):
        near = graph.search(room[at : at + step])
        row, column = np.nonzero(near >= 0)
        number = near[row, column]
        score = inner(queries[at + row], vectors[number])
        own = (queries[at + row] == vectors[number]).all(axis=1)
        order = np.lexsort((-score, row))
        bounds = np.searchsorted(row[order], np.arange(len(near) + 1))
        for i in range(len(near)):
            found: list[tuple[float, int]] = []
            for j in order[bounds[i] : bounds[i + 1]]:
                if len(found) >= k and score[j] < found[k - 1][0]:
                    break
                listed = ids[int(number[j])].as_py()
                if own[j] and int(asked[at + i]) in listed:
                    listed.remove(int(asked[at + i]))
                found += [(float(score[j]), x) for x in listed]
            out.append(sorted(found, key=lambda x: (-x[0], x[1]))[:k])
    return out


def nearest(vectors: DataFrame, asking: DataFrame, k: int = NEIGHBOURS, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the `k` nearest rows of `vectors` that the graphs find for each row of `asking`."""
    index = build_index(vectors, k, id_column, vector)
    queries = _sound(asking, id_column, vector).distinct().withColumn("dims", F.size("vector"))
    shards = index.groupBy("dims").agg(F.collect_set("shard").alias("shards"))
    spread = queries.join(F.broadcast(shards), "dims").select("dims", F.explode("shards").alias("shard"), F.array("vec_id").alias("ids"), "vector")
    none = F.lit(None).cast("array<int>")
    spread = spread.select("dims", "shard", F.lit(1).alias("kind"), F.lit(0).alias("number"), "ids", "vector", none.alias("ground"), none.alias("upper"))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        parts: list[pa.RecordBatch] = []
        for batch in batches:
            key = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)])) if len(key) else np.empty(0, int)
            for low, high in zip(starts, [*starts[1:], len(key)]):
                rows = batch.slice(low, high - low)
                if key[low, 2] == 0:
                    if held is not None or (parts and parts[0].column(1)[0].as_py() != key[low, 1]):
                        held, parts = None, []
                    parts.append(rows)
                    continue
                if held is None:
                    held, parts = _loaded(pa.Table.from_batches(parts)), []
                asked = rows.column(4).flatten().to_numpy()
                points = rows.column(5).flatten().to_numpy().reshape(rows.num_rows, -1)
                found = _answers(*held, asked, points, k)
                kind = pa.list_(pa.struct([("score", pa.float64()), ("vec_id", pa.int64())]))
                listed = pa.array([[{"score": s, "vec_id": v} for s, v in own] for own in found], kind)
                yield pa.RecordBatch.from_arrays([pa.array(asked, pa.int64()), rows.column(5), listed], names=["query_id", "vector", "found"])

    total = index.select("dims", "shard").distinct().count()
    met = index.unionByName(spread).repartitionByRange(max(1, total), "dims", "shard").sortWithinPartitions("dims", "shard", "kind", "number")
    found = met.mapInArrow(searched, "query_id bigint, vector array<double>, found array<struct<score:double,vec_id:bigint>>")
    by_query = found.groupBy("query_id", F.xxhash64("vector").alias("_vector")).agg(F.flatten(F.collect_list("found")).alias("found"))
    order = lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["vec_id"] < b["vec_id"], -1).when(a["vec_id"] > b["vec_id"], 1).otherwise(0)
    best = by_query.select("query_id", F.posexplode(F.slice(F.array_sort("found", order), 1, k)).alias("at", "near"))
    return best.select("query_id", (F.col("at") + 1).alias("rank"), F.col("near.vec_id").alias("vec_id"), F.col("near.score").alias("score"))
