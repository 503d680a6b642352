"""Exact top-k inner products by block-at-a-time pruning.

Every dimension is a term. A task cuts its vectors into document-range blocks, each with
a forward index (its vectors) and the terms' maxima and minima. For each query the blocks
are ordered by the bound that these give; blocks are scored in that order until the next
bound falls below the k-th score found. Queries travel in blocks of at most ``QUERIES``,
so what is broadcast at once has a fixed size; every block meets all vectors where they
lie. A task hands on k rows per query.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from campanula.llm.common import cut

K = 5
BLOCK = 128
#: Queries that are broadcast at once.
QUERIES = 8192
#: Vectors that a task holds at once.
HELD = 1 << 15
#: Sums of products below it are exact in double precision.
EXACT = 1 << 53
_LONG = (1 << 63) - 1


def _matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    rows = [np.asarray(v, np.float64) for v in column.to_pylist()]
    width = max([len(r) for r in rows], default=0) if width is None else width
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : min(width, len(r))] = r[:width]
    return out


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows; beyond 64 bits the nearest long."""
    most = lambda m: float(np.abs(m).max(initial=0))
    if most(q) * most(x) * max(1, q.shape[1]) < EXACT:
        return (q @ x.T).astype(np.int64)
    wide = lambda m: np.vectorize(int, otypes=[object])(m)
    exact = wide(q) @ wide(x).T
    return np.vectorize(lambda v: max(-_LONG, min(_LONG, v)), otypes=[np.int64])(exact)


class Best:
    """The k best (score, smaller id first) per query so far."""

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.scores = np.full((queries, k), -_LONG - 1, np.int64)
        self.ids = np.full((queries, k), _LONG, np.int64)
        self.filled = np.zeros((queries, k), bool)

    def kth(self) -> np.ndarray:
        return np.where(self.filled[:, -1], self.scores[:, -1].astype(np.float64), -np.inf)

    def take(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, valid: np.ndarray) -> None:
        s = np.concatenate([self.scores[rows], scores], axis=1)
        i = np.concatenate([self.ids[rows], np.broadcast_to(ids, scores.shape)], axis=1)
        f = np.concatenate([self.filled[rows], valid], axis=1)
        order = np.lexsort((i, -s.astype(object) if s.min(initial=0) <= -_LONG else -s, ~f), axis=1)[:, : self.k]
        pick = lambda m: np.take_along_axis(m, order, axis=1)
        self.scores[rows], self.ids[rows], self.filled[rows] = pick(s), pick(i), pick(f)


def search(query_rows: np.ndarray, queries: np.ndarray, rows_of: np.ndarray, ids: np.ndarray, vectors: np.ndarray, best: Best) -> None:
    """Offer ``vectors`` to all queries but the one of the same row, block by block, the most promising block first."""
    alike = np.argmax(np.abs(vectors), axis=1) if vectors.size else np.zeros(len(ids), int)
    sign = vectors[np.arange(len(ids)), alike] > 0 if vectors.size else np.zeros(len(ids), bool)
    order = np.lexsort((ids, sign, alike))
    rows_of, ids, vectors = rows_of[order], ids[order], vectors[order]
    starts = np.arange(0, len(ids), BLOCK)
    high = np.maximum.reduceat(vectors, starts, axis=0)
    low = np.minimum.reduceat(vectors, starts, axis=0)
    bounds = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
    bounds *= 1 + 1e-12 * np.sign(bounds)  # rounding must not lower a bound
    ranked = np.argsort(-bounds, axis=1, kind="stable")
    going = np.arange(len(query_rows))
    for step in range(len(starts)):
        block = ranked[going, step]
        alive = bounds[going, block] >= best.kth()[going]
        going, block = going[alive], block[alive]
        if not len(going):
            break
        by_block = np.argsort(block, kind="stable")
        for rows in np.split(going[by_block], np.flatnonzero(np.diff(block[by_block])) + 1):
            a = starts[ranked[rows[0], step]]
            others = query_rows[rows, None] != rows_of[None, a : a + BLOCK]
            best.take(rows, _products(queries[rows], vectors[a : a + BLOCK]), ids[a : a + BLOCK], others)


def _task(batches: Iterator[pa.RecordBatch], sent, k: int) -> Iterator[pa.RecordBatch]:
    query_rows, query_ids, queries = sent.value
    best, held, rows = Best(len(query_rows), k), [], 0

    def flush() -> None:
        nonlocal held, rows
        if rows:
            search(query_rows, queries, *(np.concatenate(part) for part in zip(*held, strict=True)), best)
        held, rows = [], 0

    for batch in batches:
        for at in range(0, batch.num_rows, HELD):
            some = batch.slice(at, HELD)
            held.append((some.column(0).to_numpy(), some.column(1).to_numpy(), _matrix(some.column(2), queries.shape[1])))
            rows += some.num_rows
            if rows >= HELD:
                flush()
    flush()
    q, place = np.nonzero(best.filled)
    columns = {"query_row": query_rows[q], "query_id": query_ids[q], "vec_id": best.ids[q, place], "score": best.scores[q, place]}
    yield pa.record_batch([pa.array(c) for c in columns.values()], names=list(columns))


def whole(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double"))


def top_k(vectors: DataFrame, is_query: Column, k: int = K, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k best of all other rows for each query row.

    ``is_query`` is a condition on the column ``id``.

    Components become floor(scale * x). Rows without id or vector, or with a null or
    non-finite component, take no part. Every other row is a candidate for every query
    but itself: rows that share an id stand for themselves, and a query id that several
    rows have gets the results of each. Shorter vectors end in zeros; a query's own length is what counts.
    """
    usable = F.col(id_col).isNotNull() & F.coalesce(F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    clean = vectors.filter(usable).select(F.col(id_col).cast("long").alias("id"), whole(F.col(vector_col), scale).alias("v"))
    clean = cut(clean.select(F.monotonically_increasing_id().alias("row"), "id", "v"))
    spark, found = vectors.sparkSession, None
    wanted = clean.filter(is_query)

    def run(block: list) -> DataFrame:
        rows, ids = (np.array([r[c] for r in block], np.int64) for c in ("row", "id"))
        sent = spark.sparkContext.broadcast((rows, ids, _matrix(pa.array([r["v"] for r in block], pa.list_(pa.float64())))))
        return clean.mapInArrow(partial(_task, sent=sent, k=k), "query_row long, query_id long, vec_id long, score long")

    block: list = []
    for row in wanted.toLocalIterator():
        block.append(row)
        if len(block) == QUERIES:
            found, block = run(block) if found is None else found.union(run(block)), []
    if block or found is None:
        found = run(block) if found is None else found.union(run(block))
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7(vectors: DataFrame) -> DataFrame:
    return top_k(vectors, F.col("id") % 50 == 0)
