"""SimHash near-duplicates: fingerprints, shard BK-trees, components.

Equal fingerprints become one node first, so copies cost one row each and no pairs.
Two fingerprints within the radius agree on one of radius + 1 blocks of bits, and on
one of radius + 1 blocks of the remaining bits: every node joins the shards of all such
agreements, and each shard builds a BK-tree, whose children hang on the integer distance
to their parent, and follows only edges within the radius. Shard trees are sent to the
task that searches them by the shuffle, not by a broadcast, as their total size grows
with the corpus. A shard beyond ``SHARD`` nodes (a dense family of near copies) is dealt
anew by the fingerprints half a radius away, which at most 65 nodes share for radius 2;
no link is lost, as two nodes within the radius always share one of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.functions import pandas_udf

from campanula.llm.common import cut, text_or_empty
from campanula.llm.graph import components

BITS = 64
SHINGLE = 3
RADIUS = 2
SEED = 42
#: Nodes that one shard tree may hold; larger shards are dealt anew.
SHARD = 1000
#: Shingle hashes whose bits are counted at once.
CHUNK = 1 << 15


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """SimHash over word shingles, A-Z lower-cased; unsigned. No words: zero."""
    ws = text.encode().lower().split()
    if not ws:
        return 0
    joined = b" ".join(ws)
    ends = list(accumulate(ws, lambda at, w: at + 1 + len(w), initial=-1))[1:]
    starts = [0, *(e + 1 for e in ends[:-1])]
    size = min(shingle, len(ws))
    spans = list(zip(starts, ends[size - 1 :], strict=False))
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(spans), CHUNK):
        h = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans[at : at + CHUNK]], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(spans)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _fingerprints(texts: pd.Series, shingle: int) -> pd.Series:
    return pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, text_col: str = "text", out_col: str = "fp", shingle: int = SHINGLE) -> DataFrame:
    """Add ``out_col``, the fingerprint of each whole text as a signed long; null counts as empty."""


    def of(texts: pd.Series) -> pd.Series:
        return _fingerprints(texts, shingle)

    return docs.withColumn(out_col, pandas_udf(of, "long")(text_or_empty(text_col)))


class BKTree:
    """Integers under Hamming distance."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        if self.values:
            at, d = 0, (self.values[0] ^ value).bit_count()
            while d in self.children[at]:
                at = self.children[at][d]
                d = (self.values[at] ^ value).bit_count()
            self.children[at][d] = len(self.values)
        self.values.append(value)
        self.children.append({})

    def within(self, value: int, radius: int) -> list[int]:
        """Places of the values at most ``radius`` bits away."""
        found, open_ = [], [0] if self.values else []
        while open_:
            at = open_.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            below = self.children[at]
            open_ += [below[k] for k in range(d - radius, d + radius + 1) if k in below]
        return found


def shard_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """(value, root) for the values of a shard that reach another one through links within it."""
    tree, parent = BKTree(), list(range(len(values)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, v in enumerate(values):
        for j in tree.within(v, radius):
            parent[root(j)] = root(i)
        tree.add(v)
    return [(v, values[root(i)]) for i, v in enumerate(values) if root(i) != i]


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp) sorted by key: the links of each shard. One shard is held at a time."""
    held_key, held = None, []

    def out(rows: list[tuple[int, int]]) -> pa.RecordBatch:
        u, v = zip(*rows, strict=True) if rows else ((), ())
        return pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    def linked(values: list[int]) -> list[tuple[int, int]]:
        # Python's unbounded integers need the unsigned reading; the edges go back signed
        signed = lambda x: x - (1 << BITS) if x >> (BITS - 1) else x
        rows = shard_links([x & ((1 << BITS) - 1) for x in values], radius) if len(values) > 1 else []
        return [(signed(a), signed(b)) for a, b in rows]

    for batch in batches:
        if not batch.num_rows:
            continue
        keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        bounds = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        rows: list[tuple[int, int]] = []
        if held_key is not None and keys[0] == held_key:
            held += fps[: bounds[1]].tolist()
            bounds = bounds[1:]
        if len(bounds) > 1:
            rows += linked(held)
            for a, b in zip(bounds[:-2], bounds[1:-1], strict=True):
                if b - a > 1:
                    rows += linked(fps[a:b].tolist())
            held_key, held = keys[-1], fps[bounds[-2] :].tolist()
        yield out(rows)
    yield out(linked(held))


def _slices(bits: int, parts: int) -> list[tuple[int, int]]:
    """``parts`` (first bit, width) that cover ``bits``."""
    edges = [bits * k // parts for k in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _bits(x: Column, first: int, width: int) -> Column:
    shifted = F.shiftrightunsigned(x, first) if first else x
    return shifted if width >= BITS else shifted.bitwiseAND(F.lit((1 << width) - 1))


def shard_keys(fp: Column, radius: int) -> Column:
    """Array of the shards of a fingerprint: one for each pair of a block and a block of the rest."""
    keys = []
    for i, (first, width) in enumerate(_slices(BITS, radius + 1)):
        low, high = _bits(fp, 0, first), _bits(fp, first + width, BITS - first - width)
        parts = [p for p, w in ((low, first), (F.shiftleft(high, first), BITS - first - width)) if w]
        rest = parts[0] if len(parts) == 1 else parts[0].bitwiseOR(parts[1])
        for j, (sub, size) in enumerate(_slices(BITS - width, radius + 1)):
            keys.append(F.xxhash64(F.lit(i), F.lit(j), _bits(fp, first, width), _bits(rest, sub, size)))
    return F.array_distinct(F.array(*keys))


def _search(sharded: DataFrame, radius: int) -> DataFrame:
    rows = sharded.repartition("key").sortWithinPartitions("key", "fp")
    return rows.mapInArrow(partial(_links, radius=radius), "u long, v long")


def links(nodes: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Edges (u, v) over distinct fingerprints ``fp`` whose components are those of all links."""
    keyed = nodes.select(F.explode(shard_keys(F.col("fp"), radius)).alias("key"), "fp")
    large = cut(keyed.groupBy("key").count().filter(F.col("count") > shard).select("key"))
    if large.isEmpty():
        return _search(keyed, radius)
    masks = [sum(1 << b for b in bits) for n in range((radius + 1) // 2 + 1) for bits in combinations(range(BITS), n)]
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]
    dense = keyed.join(large, "key", "left_semi").select("fp").distinct()
    # the near fingerprint itself is the key: hashing it would only mix groups
    near = F.transform(F.array(*map(F.lit, signed)), lambda m: F.col("fp").bitwiseXOR(m))
    dealt = dense.select(F.explode(near).alias("key"), "fp")
    return _search(keyed.join(large, "key", "left_anti"), radius).union(_search(dealt, radius))


def classes(prints: DataFrame, id_col: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """Rows (fp, least_id, root, component_id), one per distinct ``fp`` of ``prints``, written out.

    ``least_id`` is the smallest id with that fingerprint, ``root`` names its component,
    and ``component_id`` is the smallest id there; null ids count only where there is no other.
    """
    nodes = cut(prints.groupBy("fp").agg(F.min(id_col).alias("least_id")))
    roots = cut(components(links(nodes, radius)))
    member = nodes.join(roots, nodes["fp"] == roots["node"])
    least = cut(member.groupBy("root").agg(F.min("least_id").alias("component_id")))
    of_node = cut(roots.join(least, "root").select(F.col("node").alias("fp"), "root", "component_id"))
    out = nodes.join(of_node, "fp", "left")
    return cut(out.select(
        "fp", "least_id", F.coalesce("root", "fp").alias("root"),
        F.when(F.col("root").isNull(), F.col("least_id")).otherwise(F.col("component_id")).alias("component_id"),
    ))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """Rows (id, fp, component_id), one for each row of ``docs``; ids may be null or repeated.

    Empty texts share the zero fingerprint and are linked like all others.
    """
    prints = cut(fingerprints(docs.select(id_col, text_col), text_col, "fp", shingle).select(id_col, "fp"))
    return prints.join(classes(prints, id_col, radius).select("fp", "component_id"), "fp").select(id_col, "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """One document of each component: the one with the smallest id, with the columns of ``docs``.

    Of repeated rows of that id the first by its other columns stays. A component whose
    ids are all null keeps one row.
    """
    fp = "_simhash"
    marked = docs.select(F.struct(*docs.columns).alias("_doc"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    marked = fingerprints(marked, "_text", fp, shingle).drop("_text")
    prints = cut(marked.select(F.col("_id"), F.col(fp).alias("fp")))
    found = classes(prints, "_id", radius)
    chosen = found.filter(F.col("least_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min(F.struct("fp", "component_id")).alias("c"))
    chosen = cut(chosen.select("c.*"))
    kept = marked.join(chosen, (marked[fp] == chosen["fp"]) & marked["_id"].eqNullSafe(chosen["component_id"]))
    first = F.row_number().over(Window.partitionBy(fp, "_id").orderBy(*(F.col("_doc")[c] for c in docs.columns)))
    return kept.select("_doc", fp, "_id").withColumn("_first", first).filter("_first = 1").select("_doc.*")


def op6(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
