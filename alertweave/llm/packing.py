"""Packing of tokenised documents into sequences by estimated attention cost.

Each task packs the documents of its own partition, so nothing is shuffled and
memory is bounded by one block. A document is cut into full sequences and a
rest. Rests are packed block by block: in descending length, each goes to the
sequence of lowest estimated cost (linear plus quadratic in the piece length)
that still has room; where none has, it is cut to fill the cheapest open one. A
block fills whole sequences only and hands the remaining tokens to the next, so
a partition pads one sequence at most.

Defined cases: a null text is empty, and an empty text is the separator alone;
doc_id may be null or repeated; other columns are not read; an empty table gives
an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Rests packed together, and words whose ids a worker remembers (an aid to speed only).
BLOCK_PIECES = 1024
REMEMBERED_WORDS = 400_000
#: Rows handed to Spark at once.
_EMIT_ROWS = 1024


class _Whole(Exception):
    """The text has white space that words cannot be cut at."""


class WordIds(dict):
    """Ids of ' ' + word as little-endian 32-bit integers, worked out on first use.

    A byte-level vocabulary never merges over the start of ' word', so ids of a
    text are those of its words joined, unless white space runs touch the cut;
    such texts are encoded whole.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        special = {t["content"] for t in spec.get("added_tokens", [])}
        plain = {b for span in ((33, 127), (161, 173), (174, 256)) for b in range(*span)}
        # the vocabulary file writes the other bytes as the code points after 255, in their order
        others = [b for b in range(256) if b not in plain]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.encoding = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def packed(self, text: str) -> bytes:
        return np.asarray(self.encoding.encode_ordinary(text), "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        if not word or word[-1].isspace():
            raise _Whole
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        ids = self[word] = self.packed(" " + word)
        return ids

    def of(self, text: str) -> np.ndarray:
        first, *rest = text.split(" ")
        try:
            if first[-1:].isspace():
                raise _Whole
            joined = self.packed(first) + b"".join(map(self.__getitem__, rest))
        except _Whole:
            joined = self.packed(text)
        return np.frombuffer(joined, "<u4")


def fill(pieces: list[tuple], sequences: int, size: int, linear: float, quadratic: float) -> tuple[list[tuple], list[tuple]]:
    """Place pieces (document, start, ids) in `sequences` of `size` ids: (piece, sequence, offset) rows, and what is left over."""
    cost, room = np.zeros(sequences), np.full(sequences, size)
    placed, left = [], []
    for piece in sorted(pieces, key=lambda p: -len(p[2])):
        document, start, ids = piece
        while len(ids):
            fits = room >= len(ids)
            if fits.any():
                take = len(ids)
            elif room.any():
                fits = room > 0
                take = None
            else:
                left.append((document, start, ids))
                break
            at = int(np.argmin(np.where(fits, cost, np.inf)))
            take = take or int(room[at])
            placed.append(((document, start, ids[:take]), at, size - int(room[at])))
            room[at] -= take
            cost[at] += linear * take + quadratic * take * take
            start, ids = start + take, ids[take:]
    return placed, left


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    size: int = 1024,
    separator: int = 0,
    linear: float = 1.0,
    quadratic: float = 1 / 512,
    id_column: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per piece: id, start in the document, length, tokens of the document, sequence_id, offset in it, and the ids (little-endian 32-bit)."""
    fields = [docs.schema[id_column], *(T.StructField(c, T.LongType()) for c in ("start", "length", "doc_tokens", "sequence_id", "offset"))]
    schema = T.StructType([*fields, T.StructField("ids", T.BinaryType())])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(tokenizer)
        base, used = TaskContext.get().partitionId() << 40, 0
        pool: list[tuple] = []
        rows: list[tuple] = []
        id_type = None

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], id_type), *(pa.array(c, pa.int64()) for c in columns[1:6]), pa.array(columns[6], pa.binary())],
                names=schema.names,
            )

        def put(piece: tuple, sequence: int, offset: int) -> None:
            (doc_id, tokens), start, ids = piece
            rows.append((doc_id, start, len(ids), tokens, base + sequence, offset, ids.tobytes()))

        for batch in batches:
            id_type = batch.schema.field(0).type
            for i in range(batch.num_rows):
                ids = np.append(words.of(batch.column(1)[i].as_py() or ""), np.uint32(separator)).astype("<u4")
                document = (batch.column(0)[i].as_py(), len(ids))
                whole = len(ids) - len(ids) % size
                for start in range(0, whole, size):
                    put((document, start, ids[start : start + size]), used, 0)
                    used += 1
                    if len(rows) >= _EMIT_ROWS:
                        yield flushed()
                if whole < len(ids):
                    pool.append((document, whole, ids[whole:].copy()))
                if len(pool) >= BLOCK_PIECES:
                    full = sum(len(p[2]) for p in pool) // size
                    placed, pool = fill(pool, full, size, linear, quadratic)
                    for piece, at, offset in placed:
                        put(piece, used + at, offset)
                    used += full
                if len(rows) >= _EMIT_ROWS:
                    yield flushed()
        if pool:
            placed, _ = fill(pool, -(-sum(len(p[2]) for p in pool) // size), size, linear, quadratic)
            for piece, at, offset in placed:
                put(piece, used + at, offset)
        if rows:
            yield flushed()

    return docs.select(id_column, text).mapInArrow(packed, schema)
