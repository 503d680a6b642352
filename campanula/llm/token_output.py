"""Token matrices: best-fit-decreasing packing in shards, with lengths and positions.

A task tokenises its texts and packs them in shards of at most ``SHARD_TOKENS`` tokens,
so memory does not depend on the size of its input. The pieces of a shard go, longest
first, to the open sequence with the least room that is enough; a segment tree over
capacities finds it. Overlong documents are cut into pieces; the document and the place
in it stand beside each segment, so every document can be put together again.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campanula.llm.bestfit import CAPACITY, END, TEXTS, pieces_of
from campanula.llm.common import text_or_empty
from campanula.llm.tokens import encoder, tokenizer_path

SHARD_TOKENS = 1 << 22

SCHEMA = (
    "task int, shard int, sequence int, n_tokens int, ids binary, positions binary, "
    "cu_seqlens array<int>, doc_ids array<{id}>, doc_starts array<long>"
)


class CapacityTree:
    """Open sequences by the room left in them; finds the least room of at least some size."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(self.leaves)]

    def put(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        node = room + self.leaves
        while node and not self.any[node]:
            self.any[node] = 1
            node >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """Take out a sequence with the least room of at least ``size``: (room, sequence)."""
        node = size + self.leaves
        if not self.any[node]:
            while node > 1 and (node & 1 or not self.any[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.any[2 * node] else 2 * node + 1
        room = node - self.leaves
        sequence = self.open[room].pop()
        if not self.open[room]:
            self.any[node] = 0
            node >>= 1
            while node and not (self.any[2 * node] or self.any[2 * node + 1]):
                self.any[node] = 0
                node >>= 1
        return room, sequence


def pack(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: the pieces of each sequence, in the order they were placed."""
    tree, sequences = CapacityTree(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = tree.take(lengths[i])
        if found is None:
            room, at = capacity, len(sequences)
            sequences.append([])
        else:
            room, at = found
        sequences[at].append(i)
        if room > lengths[i]:
            tree.put(room - lengths[i], at)
    return sequences


def _matrices(batches: Iterator[pa.RecordBatch], path: str, capacity: int, shard_tokens: int, kind: str) -> Iterator[pa.RecordBatch]:
    encode, task = encoder(path).encode, TaskContext.get().partitionId()
    pieces: list[tuple] = []
    held = shard = 0
    end = END.to_bytes(4, "little")
    positions = np.arange(capacity).astype(kind)
    id_type = None

    def flush() -> Iterator[pa.RecordBatch]:
        packed = pack([p[3] for p in pieces], capacity)
        for at in range(0, len(packed), 1000):
            rows = []
            for k, members in enumerate(packed[at : at + 1000], at):
                sizes = [pieces[i][3] for i in members]
                bounds = np.cumsum([0, *sizes])
                ids = np.zeros(capacity, kind)
                ids[: bounds[-1]] = np.concatenate([pieces[i][2] for i in members])
                places = np.zeros(capacity, kind)
                places[: bounds[-1]] = np.concatenate([positions[:n] for n in sizes])
                rows.append((task, shard, k, int(bounds[-1]), ids.tobytes(), places.tobytes(), bounds.tolist(), [pieces[i][0] for i in members], [pieces[i][1] for i in members]))
            columns = list(zip(*rows, strict=True))
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(id_type), pa.list_(pa.int64()))
            names = ["task", "shard", "sequence", "n_tokens", "ids", "positions", "cu_seqlens", "doc_ids", "doc_starts"]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    for batch in batches:
        id_type = batch.column(0).type
        for at in range(0, batch.num_rows, TEXTS):
            some = batch.slice(at, TEXTS)
            for doc, raw in zip(some.column(0).to_pylist(), encode(some.column(1).to_pylist()), strict=True):
                ids = np.frombuffer(raw + end, "<u4").astype(kind)
                for start, length in pieces_of(len(ids), capacity):
                    pieces.append((doc, start, ids[start : start + length], length))
                held += len(ids)
            if held >= shard_tokens:
                yield from flush()
                pieces, held, shard = [], 0, shard + 1
    if pieces:
        yield from flush()


def token_matrices(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, shard_tokens: int = SHARD_TOKENS, kind: str = "<u2") -> DataFrame:
    """One row per packed sequence of ``capacity`` ids.

    ``ids`` and ``positions`` are little-endian rows of the id matrix and of positions
    that start anew with each segment, filled up with zeros behind ``n_tokens``;
    ``cu_seqlens`` are the segments' bounds; ``doc_ids`` and ``doc_starts`` say which
    ids of which document a segment holds. ``kind`` must hold the vocabulary: two bytes
    do for 50,257 ids. Null texts count as empty and hold the closing id alone; every
    row is a document of its own, with a null or repeated id too.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), text_or_empty(text_col))
    work = partial(_matrices, path=path or tokenizer_path(), capacity=capacity, shard_tokens=shard_tokens, kind=kind)
    return rows.mapInArrow(work, SCHEMA.format(id=id_type))


def write(docs: DataFrame, folder: str, **options) -> None:
    """Write the matrices as Parquet, one file per task."""
    token_matrices(docs, **options).write.parquet(folder)


def op8(docs: DataFrame) -> DataFrame:
    return token_matrices(docs)
