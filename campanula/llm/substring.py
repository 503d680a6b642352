"""Repeated passages: winnowed anchors as seeds, extension to both sides, removal.

A window is ``WINDOW`` consecutive words. Among the ``GRAM``-word hashes inside it the
smallest (the rightmost of equals) is its anchor, so equal windows have equal anchors at
equal places, and a document has about one anchor per twenty words. An anchor owns the
run of windows that chose it: its words plus up to ``WINDOW - GRAM`` more on either side.

Seeds are anchors that two documents share. Their occurrences fall into classes by all
the words their windows span. One class only: every occurrence extends to its full span
in the smallest document. Several classes: one occurrence of each is extended word by
word, window by window, and each extension looks up the smallest document that has it.
Documents are never paired: a class or a window costs one row whatever its copies. What
is covered merges to maximal repeats, which are at least ``WINDOW`` words long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campanula.llm.common import stored, text_or_empty

WINDOW = 50
GRAM = 10
SPREAD = WINDOW - GRAM + 1
#: Windows of a document that are looked at together.
CHUNK = 1 << 15

_ODD = 0x9E3779B97F4A7C15
_ODD_INVERSE = pow(_ODD, -1, 1 << 64)


class _Powers:
    """Powers of an odd number and of its inverse modulo 2 ** 64, as far as asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 4096)
            self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)], dtype=np.uint64) for b in (_ODD, _ODD_INVERSE))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashed:
    """Words of a text with hashes of any run of them in constant time."""

    def __init__(self, ws: list[bytes]) -> None:
        digest = xxhash.xxh64_intdigest
        h = np.array([digest(w) for w in ws], np.uint64)
        up, self.down = _POWERS.to(len(ws) + 1)
        self.sums = np.r_[np.uint64(0), np.cumsum(h * up[:-1], dtype=np.uint64)]

    def runs(self, first: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return _mix((self.sums[first + size] - self.sums[first]) * self.down[first])


def anchors(ws: list[bytes]) -> tuple[np.ndarray, ...]:
    """(anchor hash, class hash, first window, number of windows) of each anchor of a text."""
    n = len(ws) - WINDOW + 1
    if n < 1:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none
    hashed = Hashed(ws)
    grams = hashed.runs(np.arange(len(ws) - GRAM + 1), GRAM)
    place = np.empty(n, np.int64)
    for at in range(0, n, CHUNK):
        to = min(n, at + CHUNK)
        view = np.lib.stride_tricks.sliding_window_view(grams[at : to + SPREAD - 1], SPREAD)
        place[at:to] = np.arange(at, to) + SPREAD - 1 - np.argmin(view[:, ::-1], axis=1)
    first = np.r_[0, np.flatnonzero(np.diff(place)) + 1]
    number = np.diff(np.r_[first, n])
    offset = (place[first] - first).astype(np.uint64)
    return grams[place[first]], _mix(hashed.runs(first, number + WINDOW - 1) + offset), first, number


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, digest, text) to (anchor, class, id, digest, first, number)."""
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            some = batch.slice(at, 500)
            found = [anchors(t.encode().split()) for t in some.column(2).to_pylist()]
            rows = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]))
            parts = [np.concatenate(c) for c in zip(*found, strict=True)]
            yield pa.record_batch(
                [_long(parts[0]), _long(parts[1]), some.column(0).take(rows), some.column(1).take(rows), pa.array(parts[2].astype(np.int32)), pa.array(parts[3].astype(np.int32))],
                names=["anchor", "kind", "id", "digest", "first", "number"],
            )


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, text, seeds) to (anchor, class, place, window hash, id, most): all extensions of each seed."""
    for batch in batches:
        for i in range(batch.num_rows):
            seeds = batch.column(2)[i].as_py()
            hashed = Hashed(batch.column(1)[i].as_py().encode().split())
            number = np.array([s["number"] for s in seeds])
            total = int(number.sum())
            place = np.arange(total) - np.repeat(np.cumsum(number) - number, number)
            start = np.repeat([s["first"] for s in seeds], number) + place
            rows = np.repeat(np.arange(len(seeds)), number)
            yield pa.record_batch(
                [
                    pa.array(np.array([s["anchor"] for s in seeds], np.int64)[rows]),
                    pa.array(np.array([s["kind"] for s in seeds], np.int64)[rows]),
                    pa.array(place.astype(np.int32)),
                    _long(hashed.runs(start, WINDOW)),
                    pa.repeat(batch.column(0)[i], total),
                    pa.array([s["most"] for s in seeds], batch.column(0).type).take(pa.array(rows)),
                ],
                names=["anchor", "kind", "place", "window", "id", "most"],
            )


def _kept_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, text, marks) to (id, n_words, n_removed, kept, repeats)."""
    for batch in batches:
        out: list[tuple] = []
        for text, marks in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            ws = text.encode().split()
            repeats: list[list[int]] = []
            for first, end in sorted((m["first"], m["first"] + m["number"] - 1 + WINDOW) for m in marks or ()):
                if repeats and first <= repeats[-1][1]:
                    repeats[-1][1] = max(repeats[-1][1], end)
                else:
                    repeats.append([first, end])
            kept, at = [], 0
            for first, end in repeats:
                kept += ws[at:first]
                at = end
            kept += ws[at:]
            out.append((len(ws), len(ws) - len(kept), b" ".join(kept).decode(), [{"first": a, "end": b} for a, b in repeats]))
        n, removed, text, spans = zip(*out, strict=True) if out else ((), (), (), ())
        yield pa.record_batch(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(text, pa.string()), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))],
            names=["id", "n_words", "n_removed", "kept", "repeats"],
        )


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_or_empty(text_col)
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("digest"), text.alias("text"))


def marks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, digest, first, number): runs of windows that a document with a smaller id has too.

    ``digest`` is the text's hash, so that repeated ids with different texts stay apart.
    Documents without an id neither lose words nor make others lose them.
    """
    texts = _texts(docs, id_col, text_col).filter("id is not null")
    kind = texts.schema["id"].dataType.simpleString()
    found = texts.mapInArrow(_anchor_rows, f"anchor long, kind long, id {kind}, digest long, first int, number int")
    seeds = found.groupBy("anchor").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.min("kind").alias("k1"), F.max("kind").alias("k2"))
    seeds = stored(seeds.filter("least < most").select("anchor", "least", (F.col("k1") == F.col("k2")).alias("one_class")))
    hits = stored(found.join(seeds, "anchor"))
    sure = hits.filter("one_class and id > least").select("id", "digest", "first", "number")

    opened = hits.filter("not one_class").select("anchor", "kind", "id", "digest", "first", "number")
    rep = opened.groupBy("anchor", "kind").agg(F.min(F.struct("id", "digest", "first", "number")).alias("r"), F.max("id").alias("most"))
    rep = stored(rep.select("anchor", "kind", "r.*", "most"))
    by_doc = rep.groupBy("id", "digest").agg(F.collect_set(F.struct("anchor", "kind", "first", "number", "most")).alias("seeds"))
    windows = texts.join(by_doc, ["id", "digest"]).dropDuplicates(["id", "digest"]).select("id", "text", "seeds")
    windows = stored(windows.mapInArrow(_window_rows, f"anchor long, kind long, place int, window long, id {kind}, most {kind}"))
    # a window matters only where some document that has it comes after the smallest one
    least = windows.groupBy("anchor", "window").agg(F.min("id").alias("least"), F.max("most").alias("most"))
    least = stored(least.filter("least < most").drop("most"))
    known = windows.join(least, ["anchor", "window"]).groupBy("anchor", "kind").agg(
        F.collect_set(F.struct("place", "least")).alias("places")
    )
    extended = opened.join(stored(known), ["anchor", "kind"])
    here = F.filter("places", lambda p: p["least"] < F.col("id"))
    some = extended.select("id", "digest", "first", F.explode(F.transform(here, lambda p: p["place"])).alias("place"))
    return sure.union(some.select("id", "digest", F.col("first") + F.col("place"), F.lit(1)))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_removed, kept (words joined by blanks), repeats.

    ``repeats`` are the maximal covered runs as (first word, end). Null texts have no
    words. Of exactly repeated rows each gives its row; equal ids are not smaller.
    """
    texts = _texts(docs, id_col, text_col)
    kind = texts.schema["id"].dataType.simpleString()
    by_doc = marks(docs, id_col, text_col).groupBy("id", "digest").agg(F.collect_set(F.struct("first", "number")).alias("marks"))
    rows = texts.join(by_doc, ["id", "digest"], "left").select("id", "text", "marks")
    return rows.mapInArrow(_kept_rows, f"id {kind}, n_words long, n_removed long, kept string, repeats array<struct<first:long,end:long>>")


def op4(docs: DataFrame) -> DataFrame:
    out = remove_repeats(docs.select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
