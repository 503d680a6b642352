"""Bulk-synchronous best-fit packing of token pieces.

Pieces and gaps (sequences with room left) are rows and stay rows. Sizes are taken class
by class, the largest first. A round of a class is one sweep: gaps and unplaced pieces
are range-sorted along the line of sizes, descending; every partition walks its stretch
and gives each piece the nearest gap above it that still has room, its successor; what
room a gap keeps goes back to the line at its new size. Pieces compete for gaps by rank,
that is by their place on the line. What a stretch could not match is carried over:
pieces left over take the gaps that the stretches before them left, nearest first, by
counts per partition. Then the gaps are updated, and the next round starts. When no gap
takes even the least piece left of the class, as many new sequences open as the count and
the volume of those pieces need in any case.

A gap much larger than the rest of the line offers several places at once when it is
carried over, so that a class takes a few rounds only. Equal sizes are ordered by piece or
sequence number too, so that a size which most rows share is spread over partitions. The
state after a round is written to the checkpoint folder; a lost task repeats its own round
only, with the same result.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from campanula.llm.common import cut, text_or_empty
from campanula.llm.tokens import encoder, tokenizer_path

CAPACITY = 2048
#: Id that closes a document.
END = 0
#: Texts that the encoder gets at once.
TEXTS = 256

PIECES = "doc_id {id}, piece int, start long, length long, ids_crc32 long, number long"
#: Numbers of pieces by task: task * PER_TASK + count.
PER_TASK = 1 << 40

#: Rows of a round's small frames that one task reads.
ROWS_PER_TASK = 200_000

#: What a row of a sweep's outcome is: a piece with its sequence, a piece or a gap left over,
#: the stretch's sums (pieces left in ``at``, the largest in ``id``, the least in ``size``).
PLACED, PIECE_LEFT, GAP_LEFT, SUMS = 0, 1, 2, 3
SWEPT = "what int, part int, id long, size int, at long, places long"
#: Pieces and places that meet under one key; a piece that stays has a key of its own.
MEETING = "part int, place long, number long, length int, sequence_id long"
STAYS = -1


def pieces_of(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all full but the first, which has the rest."""
    first = total % capacity or min(total, capacity)
    return [(0, first), *((s, capacity) for s in range(first, total, capacity))]


def _cut_up(batches: Iterator[pa.RecordBatch], path: str, capacity: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, text) to pieces; ``number`` tells all pieces apart."""
    encode, number = encoder(path).encode, TaskContext.get().partitionId() * PER_TASK
    end = END.to_bytes(4, "little")
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            some = batch.slice(at, TEXTS)
            rows: list[list] = [[] for _ in range(5)]
            take: list[int] = []
            for i, ids in enumerate(encode(some.column(1).to_pylist())):
                ids += end
                for k, (start, length) in enumerate(pieces_of(len(ids) // 4, capacity)):
                    take.append(i)
                    row = (k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), number)
                    number += 1
                    for column, value in zip(rows, row, strict=True):
                        column.append(value)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch(
                [some.column(0).take(pa.array(take, pa.int64())), *(pa.array(c, t) for c, t in zip(rows, kinds, strict=True))],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "number"],
            )


class Rest(NamedTuple):
    """Pieces still without a sequence: number, least size, bounds of the largest size (above) and of all sizes' sum (below)."""

    n: int
    least: int
    most: int
    volume: int


def classes(capacity: int) -> list[tuple[int, int]]:
    """Classes of sizes (largest, least), descending: by how many pieces fill a sequence."""
    tops, share = [], 1
    while capacity // share:
        tops.append(capacity // share)
        share = share + 1 if share < 4 else 2 * share
    tops = sorted(set(tops), reverse=True)
    return [(top, low + 1) for top, low in zip(tops, [*tops[1:], 0], strict=True)]


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64()}
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.record_batch([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _sweep(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """One stretch of the line, rows (size, is_gap, id), with pieces of at most ``most``.

    Gaps that take the piece at hand stand on a stack, the smallest on top; gaps that have
    become smaller wait until the line comes to their size. A piece goes to the top of the
    stack; without any it is left over, numbered in ``at``. Gaps left on the stack have as
    many ``places`` as pieces of the later stretches surely fit, and in ``at`` the places
    below them; gaps still waiting have none.
    """
    part = TaskContext.get().partitionId()
    stack: list[list[int]] = []  # sequence, room
    waiting: list[tuple[int, int]] = []  # -room, sequence
    left, largest, size = 0, 0, 0
    seen = False
    for batch in batches:
        rows = []
        for size, is_gap, number in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            seen = True
            while waiting and -waiting[0][0] >= size:
                room, sequence = heapq.heappop(waiting)
                stack.append([sequence, -room])
            if is_gap:
                stack.append([number, size])
            elif stack:
                top = stack[-1]
                rows.append((PLACED, part, number, size, top[0], 0))
                top[1] -= size
                if top[1] < size:
                    stack.pop()
                    if top[1]:
                        heapq.heappush(waiting, (-top[1], top[0]))
            else:
                rows.append((PIECE_LEFT, part, number, size, left, 0))
                left, largest, least = left + 1, largest or size, size
        yield _batch(rows, SWEPT)
    if not seen:
        return
    fits, below = min(size, most), 0
    for first in range(0, len(stack), 10_000):
        rows = []
        for sequence, room in stack[first : first + 10_000]:
            rows.append((GAP_LEFT, part, sequence, room, below, room // fits))
            below += room // fits
        yield _batch(rows, SWEPT)
    for first in range(0, len(waiting), 10_000):
        yield _batch([(GAP_LEFT, part, sequence, -room, 0, 0) for room, sequence in waiting[first : first + 10_000]], SWEPT)
    yield _batch([(SUMS, part, largest, least if left else 0, left, below)], SWEPT)


def carry_over(left: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Which leftovers meet, from (part, pieces, places) by part: (part, first piece, pieces, part of the gaps, top).

    Piece ``first + k`` takes place ``top - 1 - k``. There are fewer than twice as many
    rows as parts, whatever the number of pieces.
    """
    met, stack = [], []
    for part, pieces, places in sorted(left):
        first = 0
        while first < pieces and stack:
            other, top = stack.pop()
            n = min(top, pieces - first)
            met.append((part, first, n, other, top))
            first += n
            if top > n:
                stack.append((other, top - n))
        if places:
            stack.append((part, places))
    return met


def _meet(batches: Iterator[pa.RecordBatch], met: list[tuple[int, int, int, int, int]]) -> Iterator[pa.RecordBatch]:
    """Rows left over by a sweep to MEETING: a piece and the place it takes get the same key."""
    takes, gives = defaultdict(list), defaultdict(list)
    for part, first, n, other, top in met:
        takes[part].append((first, n, other, top))
        gives[other].append((top - n, top))
    for batch in batches:
        rows = []
        for what, part, number, size, at, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if what == GAP_LEFT:
                for low, high in gives[part]:
                    rows += [(part, place, None, None, number) for place in range(max(low, at), min(high, at + places))]
                continue
            k = bisect_right(takes[part], at, key=lambda x: x[0]) - 1
            first, n, other, top = takes[part][k] if k >= 0 else (0, 0, 0, 0)
            if at < first + n:
                rows.append((other, top - 1 - (at - first), number, size, None))
            else:
                rows.append((STAYS, number, number, size, None))
        yield _batch(rows, MEETING)


class Round(NamedTuple):
    """Outcome of a round: placed rows (number, length, sequence_id), pieces left, gaps, sums of the pieces left."""

    placed: list[DataFrame]
    rest: DataFrame
    gaps: DataFrame
    state: Rest


def _match(pieces: DataFrame, gaps: DataFrame, state: Rest, tasks: int) -> Round:
    """One round over pieces (number, length) and gaps (sequence_id, room) that take the least of them."""
    line = gaps.select(F.col("room").alias("size"), F.lit(True).alias("is_gap"), F.col("sequence_id").alias("id"))
    line = line.unionByName(pieces.select(F.col("length").alias("size"), F.lit(False).alias("is_gap"), F.col("number").alias("id")))
    order = (F.desc("size"), F.desc("is_gap"), F.col("id"))
    sweep = partial(_sweep, most=state.most)
    swept = cut(line.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(sweep, SWEPT)).coalesce(tasks)
    sums = swept.filter(F.col("what") == SUMS).collect()  # one row per partition
    met = carry_over([(r["part"], r["at"], r["places"]) for r in sums])
    left = {r["part"]: r["at"] for r in sums}
    for part, _, n, _, _ in met:
        left[part] -= n
    # pieces go in descending order: the least of a partition is among those that stay
    stay = [(left[r["part"]], r["size"], r["id"]) for r in sums if left[r["part"]]]
    n, volume = sum(x[0] for x in stay), sum(x[0] * x[1] for x in stay)
    state = Rest(n, min((x[1] for x in stay), default=0), max((x[2] for x in stay), default=0), volume)
    placed = [swept.filter(F.col("what") == PLACED).select(F.col("id").alias("number"), F.col("size").alias("length"), F.col("at").alias("sequence_id"))]
    gaps = swept.filter(F.col("what") == GAP_LEFT).select(F.col("id").alias("sequence_id"), F.col("size").alias("room"))
    if not met:
        rest = swept.filter(F.col("what") == PIECE_LEFT).select(F.col("id").alias("number"), F.col("size").alias("length"))
        return Round(placed, rest, gaps, state)
    over = swept.filter(F.col("what").isin(PIECE_LEFT, GAP_LEFT)).mapInArrow(partial(_meet, met=met), MEETING)
    pairs = over.groupBy("part", "place").agg(*(F.max(c).alias(c) for c in ("number", "length", "sequence_id")))
    pairs = cut(pairs.select("number", "length", "sequence_id").coalesce(tasks))
    carried = pairs.filter("sequence_id is not null")
    used = carried.select("sequence_id", (-F.col("length")).alias("room"))
    gaps = gaps.unionByName(used).groupBy("sequence_id").agg(F.sum("room").cast("int").alias("room"))
    return Round([*placed, carried], pairs.filter("sequence_id is null").select("number", "length"), gaps, state)


def _all(frames: list[DataFrame], spark: SparkSession, schema: str) -> DataFrame:
    out = spark.createDataFrame([], schema)
    for df in frames:
        out = out.unionByName(df)
    return out


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Rows (number, length, sequence_id) for pieces (number, length), by rounds of best fit.

    Numbers must be unique, lengths from 1 to ``capacity``. No rows: no sequences. The
    driver sees counts per length and per partition, never rows.
    """
    spark = pieces.sparkSession
    pieces = pieces.select("number", F.col("length").cast("int").alias("length"))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    tasks = max(spark.sparkContext.defaultParallelism, sum(counts.values()) // ROWS_PER_TASK)
    pieces = cut(pieces.coalesce(tasks))
    placed: list[DataFrame] = []
    gaps, opened = spark.createDataFrame([], "sequence_id long, room int"), 0
    largest = 0  # room of the largest gap
    for top, low in classes(capacity):
        lengths = [n for n in counts if low <= n <= top]
        rest = pieces.filter(F.col("length").between(low, top))
        state = Rest(sum(counts[n] for n in lengths), min(lengths, default=0), max(lengths, default=0), sum(n * counts[n] for n in lengths))
        while state.n:
            if state.least > largest:
                # as many new sequences as the rest needs in any case
                new = max(-(-state.n // (capacity // state.least)), -(-state.volume // capacity))
                numbers = spark.range(opened, opened + new).select(F.col("id").alias("sequence_id"), F.lit(capacity).alias("room"))
                gaps, opened = gaps.unionByName(numbers), opened + new
            small = gaps.filter(F.col("room") < state.least)
            done, rest, gaps, state = _match(rest, gaps.filter(F.col("room") >= state.least), state, tasks)
            placed += done
            gaps = cut(gaps.unionByName(small).filter(F.col("room") >= min(counts)).coalesce(tasks))
            largest = gaps.agg(F.max("room")).first()[0] or 0
    return _all(placed, spark, "number long, length int, sequence_id long").coalesce(tasks)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces that have ``number`` and ``length``.

    A sequence has at most ``capacity`` pieces, so its running sum stays small.
    """
    found = place(pieces, capacity)
    before = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "number").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")
    return pieces.join(found.select("number", "sequence_id", offset.alias("offset")), "number")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null texts count as empty and hold only the closing id. Every row is a document of
    its own, with a null or repeated id too.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col))
    cut_up = partial(_cut_up, path=path or tokenizer_path(), capacity=capacity)
    pieces = cut(rows.mapInArrow(cut_up, PIECES.format(id=kind)))
    out = pack_pieces(pieces, capacity)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op10(docs: DataFrame) -> DataFrame:
    return pack(docs)
