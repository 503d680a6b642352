"""Prefix trie of conversations: member intervals from sorted conversations.

Turns become 16-byte digests, a conversation the string of its digests. Equal ones are
counted first; distinct ones are sorted, and a task works on blocks of them. In a block,
a sparse table holds range minima over the lengths of the common prefixes of neighbours.
The members of a prefix are the rows around it between which that length never falls
below its depth; each prefix finds both ends by its own binary search in the table.
Counts, smallest members and subtree sums follow from prefix sums over the block.

Only prefixes of a block's first or last row can have members in other blocks. Those few
go, by a hash of the prefix, to one aggregation that adds up the blocks' parts. Memory
is that of one block, however many conversations share a prefix.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from campanula.llm.common import stored

#: Turn numbers that are numbered together.
SPAN = 1024
#: Span of the rows without a turn number, before all others.
FIRST = -(1 << 62)
#: Turns from which a block is closed.
BLOCK = 1 << 19
DIGEST = 16
EMPTY = hashlib.sha256(b"").hexdigest()

NODES = (
    "part int, block int, side int, depth long, prefix binary, above binary, up_side int, conv_id long, parent_conv_id long, "
    "n_convs long, n_children long, n_leaves long, saved_tokens long, n_bytes long, ends_sha256 string"
)
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def _numbered(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, position from 1, digest, n_bytes), in order of turn (null first), then digest."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turn = F.col("turn").cast("long")
    rows = turns.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.coalesce(F.floor(turn / SPAN), F.lit(FIRST)).alias("span"),
        turn.alias("turn"),
        F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("digest"),
        F.octet_length(text).alias("n_bytes"),
    )
    before = Window.partitionBy("conv_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("conv_id", "span").agg(F.count("*").alias("n"))
    starts = totals.select("conv_id", "span", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("conv_id", "span").orderBy(F.col("turn").asc_nulls_first(), "digest")
    counted = rows.withColumn("k", F.row_number().over(inside)).join(starts, ["conv_id", "span"])
    return counted.select("conv_id", (F.col("start") + F.col("k")).alias("position"), "digest", "n_bytes")


def rebuilt(turns: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """Rows (conv_id, stage, position, digest, n_bytes): the turns of every rebuilt conversation, in order of stage and position.

    Conversation c opens with the first h turns of c - c % ``family`` and goes on with its
    own turns after its first h; h = crc32(c) % ``most``. A row of stage -1 without
    a turn stands for the conversation itself. Rows without conv_id belong to none and
    are left out.
    """
    numbered = stored(_numbered(turns))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    convs = numbered.filter("position = 1").select("conv_id", (F.col("conv_id") - F.col("conv_id") % family).alias("base"), h.alias("h"))
    heads = numbered.filter(F.col("position") < most).select(F.col("conv_id").alias("base"), "position", "digest", "n_bytes")
    lent = convs.join(heads, "base").filter("position <= h").select("conv_id", F.lit(0).alias("stage"), "position", "digest", "n_bytes")
    own = numbered.filter(F.col("position") > h).select("conv_id", F.lit(1).alias("stage"), "position", "digest", "n_bytes")
    bare = convs.select("conv_id", F.lit(-1), F.lit(0), F.lit(""), F.lit(0))
    return lent.union(own).union(bare)


def _sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, key, sizes): the digests of a conversation's turns one behind the other, and their texts' bytes."""
    ordered = F.array_sort(F.collect_list(F.struct("stage", "position", "digest", "n_bytes")))
    rows = turns.groupBy("conv_id").agg(ordered.alias("turns"))
    key = F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), ""))
    sizes = F.transform(F.slice("turns", F.lit(2), F.size("turns")), lambda t: t["n_bytes"])
    return rows.select("conv_id", key.alias("key"), sizes.alias("sizes"))


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per run of equal sequences (whose members come in order): its first member and the hash of all members."""
    last = first = digest = None
    done: tuple[list, list] = ([], [])

    def close() -> None:
        if digest is not None:
            done[0].append(first)
            done[1].append(digest.hexdigest())

    def made() -> pa.RecordBatch:
        out = pa.record_batch([pa.array(done[0], pa.int64()), pa.array(done[1], pa.string())], names=["conv_id", "ends_sha256"])
        done[0].clear()
        done[1].clear()
        return out

    for batch in batches:
        names, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        bounds = [0, *(k for k in range(1, len(names)) if names[k] != names[k - 1]), len(names)]
        for a, b in zip(bounds, bounds[1:], strict=False):
            if a == b:
                continue
            if names[a] != last:
                close()
                last, first, digest = names[a], ids[a], hashlib.sha256()
                digest.update(str(ids[a]).encode())
                a += 1
            if a < b:
                digest.update(("," + ",".join(map(str, ids[a:b]))).encode())
        yield made()
    close()
    yield made()


class Sorted:
    """Distinct sorted sequences, and range minima over their neighbours' common prefixes."""

    def __init__(self, keys: list[bytes]) -> None:
        rows = [np.frombuffer(k, "<u8").reshape(-1, 2) for k in keys]
        self.n, self.length = len(keys), np.array([len(r) for r in rows], np.int64)
        self.common = np.full(self.n, -1, np.int64)
        for i in range(1, self.n):
            m = min(len(rows[i - 1]), len(rows[i]))
            same = (rows[i - 1][:m] == rows[i][:m]).all(1)
            self.common[i] = m if same.all() else int(np.argmin(same))
        self.least = self._table(self.common)

    @staticmethod
    def _table(values: np.ndarray) -> list[np.ndarray]:
        table, step = [values], 1
        while 2 * step <= len(values):
            table.append(np.minimum(table[-1][:-step], table[-1][step:]))
            step *= 2
        return table

    def right(self, row: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Last row that shares the first ``depth`` turns with ``row``."""
        at = row.copy()
        for k in reversed(range(len(self.least))):
            level, step = self.least[k], 1 << k
            ok = at + step < self.n
            ok &= level[np.where(ok, at + 1, 0)] >= depth
            at += ok * step
        return at

    def left(self, row: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """First row that shares the first ``depth`` turns with ``row``."""
        at = row.copy()
        for k in reversed(range(len(self.least))):
            level, step = self.least[k], 1 << k
            ok = at >= step
            ok &= level[np.where(ok, at - step + 1, 0)] >= depth
            at -= ok * step
        return at

    @staticmethod
    def minima(table: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Least value of each range of a table, both ends included."""
        k = np.frexp(right - left + 1)[1] - 1
        out = np.empty(len(left), table[0].dtype)
        for level in np.unique(k):
            some = k == level
            out[some] = np.minimum(table[level][left[some]], table[level][right[some] - (1 << int(level)) + 1])
        return out


def _prefixes(key: bytes) -> list[bytes]:
    """Hashes of the key's prefixes, from the empty one on."""
    running = hashlib.md5()
    out = [running.digest()]
    for at in range(0, len(key), DIGEST):
        running.update(key[at : at + DIGEST])
        out.append(running.copy().digest())
    return out


def _block(keys: list[bytes], sizes: list[list[int]], copies: list[int], firsts: list[int], ends: list[str], part: int, block: int) -> pa.RecordBatch:
    """The nodes of one block of sorted distinct sequences.

    Nodes without a side are whole. Nodes of side 0 and 1, prefixes of the first and
    last row, may go on elsewhere; their counts are this block's part, their sums hold
    only nodes without a side. A row of side 1 that repeats one of side 0 counts nothing.
    """
    s = Sorted(keys)
    n = s.n
    # a candidate is a prefix at the first row that has it
    each = s.length - s.common
    offset = np.concatenate([[0], np.cumsum(each)])
    row = np.repeat(np.arange(n), each)
    depth = np.arange(len(row)) - offset[row] + s.common[row] + 1
    left, right = s.left(row, depth), s.right(row, depth)

    count = np.concatenate([[0], np.cumsum(np.array(copies, np.int64))])
    n_convs = count[right + 1] - count[left]
    conv = Sorted.minima(Sorted._table(np.array(firsts, np.int64)), left, right)
    size = np.concatenate([np.array([0, *x], np.int64)[c + 1 :] for x, c in zip(sizes, s.common.tolist(), strict=True)])
    inner = (left > 0) & (right < n - 1)

    # parents: one turn less, found from the same row
    has = np.flatnonzero(depth > 0)
    up_left = s.left(row[has], depth[has] - 1)
    up = offset[up_left] + depth[has] - 2 - s.common[up_left]
    parent = np.full(len(row), -1)
    parent[has] = up
    mine = has[inner[has]]
    n_children = np.bincount(parent[mine], minlength=len(row))

    leaf = np.append(s.common[1:] < s.length[:-1], False)
    leaf[0] = False
    leaves = np.concatenate([[0], np.cumsum(leaf)])
    n_leaves = leaves[right + 1] - leaves[left]
    worth = np.concatenate([[0], np.cumsum(np.where(inner, (n_convs - 1) * size, 0))])
    saved = worth[offset[right + 1]] - worth[np.arange(len(row))]

    side = np.where(inner, -1, np.where(left == 0, 0, 1))
    whole = depth == s.length[row]
    up_side = np.where(parent < 0, -1, side[parent])
    known = (parent >= 0) & (up_side == -1)
    first_chain, last_chain = _prefixes(keys[0]), _prefixes(keys[-1])

    def named(sides: np.ndarray, depths: np.ndarray) -> list[bytes | None]:
        chains = (first_chain, last_chain)
        return [None if k < 0 or d < 0 else chains[k][d] for k, d in zip(sides.tolist(), depths.tolist(), strict=True)]

    edge = side >= 0
    columns = {
        "side": side,
        "depth": depth,
        "prefix": named(side, depth),
        "above": named(side, np.where(edge, depth - 1, -1)),
        "up_side": up_side,
        "conv_id": conv,
        "parent_conv_id": pa.array(conv[parent], pa.int64(), mask=~known),
        "n_convs": n_convs,
        "n_children": n_children,
        "n_leaves": n_leaves,
        "saved_tokens": saved,
        "n_bytes": size,
        "ends_sha256": [ends[i] if w else None for i, w in zip(row.tolist(), whole.tolist(), strict=True)],
    }
    # the last row's chain is listed from the root on; what it shares with the first row counts there
    shared = int(s.common[1:].min()) + 1 if n > 1 else 0
    blank = np.zeros(shared, np.int64)
    repeats = {
        "side": blank + 1,
        "depth": np.arange(shared),
        "prefix": last_chain[:shared],
        "above": [None, *last_chain[: shared - 1]][:shared],
        "up_side": blank,
        "conv_id": pa.nulls(shared, pa.int64()),
        "parent_conv_id": pa.nulls(shared, pa.int64()),
        **{c: blank for c in ("n_convs", "n_children", "n_leaves", "saved_tokens", "n_bytes")},
        "ends_sha256": [None] * shared,
    }
    types = {"side": pa.int32(), "up_side": pa.int32(), "prefix": pa.binary(), "above": pa.binary(), "ends_sha256": pa.string()}

    def batch(given: dict, m: int) -> pa.RecordBatch:
        given = {"part": np.full(m, part), "block": np.full(m, block), **given}
        kinds = types | {"part": pa.int32(), "block": pa.int32()}
        return pa.record_batch([v if isinstance(v, pa.Array) else pa.array(v, kinds.get(k, pa.int64())) for k, v in given.items()], names=list(given))

    return [batch(columns, len(row)), batch(repeats, shared)]


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    part, number, held = TaskContext.get().partitionId(), 0, 0
    rows: list[tuple] = []
    for batch in batches:
        for given in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows.append(given)
            held += len(given[1]) + 1
            if held >= most:
                yield from _block(*map(list, zip(*rows, strict=True)), part=part, block=number)
                rows, held, number = [], 0, number + 1
    if rows:
        yield from _block(*map(list, zip(*rows, strict=True)), part=part, block=number)


def _joined_edges(edges: DataFrame) -> DataFrame:
    """(prefix, above, and the node's columns) of the nodes that several blocks may share, with their blocks' parts added up."""
    added = ("n_convs", "n_children", "n_leaves", "saved_tokens")
    whole = stored(
        edges.groupBy("prefix", "above", "depth").agg(
            *(F.sum(c).alias(c) for c in added),
            F.min("conv_id").alias("conv_id"),
            F.max("n_bytes").alias("n_bytes"),
            F.max("ends_sha256").alias("ends_sha256"),
            F.min(F.struct("part", "block", "side")).alias("chain"),
        )
    )
    below = whole.filter("above is not null").groupBy(F.col("above").alias("prefix")).agg(F.count("*").alias("below"))
    whole = whole.join(below, "prefix", "left").withColumn("n_children", F.col("n_children") + F.coalesce("below", F.lit(0)))
    # each node gives its own leaf and its own saving once, on one of its chains, to all nodes above it there
    own = whole.select("prefix", F.col("chain.*"), (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saving"))
    chains = edges.select("prefix", "part", "block", "side", "depth").join(own, ["prefix", "part", "block", "side"], "left")
    deeper = Window.partitionBy("part", "block", "side").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    upward = chains.select("prefix", *(F.coalesce(F.sum(c).over(deeper), F.lit(0)).alias(c) for c in ("leaf", "saving")))
    sums = upward.groupBy("prefix").agg(F.sum("leaf").alias("leaf"), F.sum("saving").alias("saving"))
    return whole.join(sums, "prefix").withColumns({"n_leaves": F.col("n_leaves") + F.col("leaf"), "saved_tokens": F.col("saved_tokens") + F.col("saving")})


def prefix_trie(turns: DataFrame, most: int = BLOCK) -> DataFrame:
    """One row per node of the trie of ``turns``, rows as :func:`rebuilt` gives them.

    A node is a distinct sequence of first turns; conv_id is its smallest member. Equal
    conversations are members of the same nodes. An empty table has no node, not even
    the root. A conversation's digests, 16 bytes a turn, stand in one row; its texts
    never do. The members of one sequence are hashed in order by one task, as the hash
    demands, without being held there.
    """
    sequences = stored(_sequences(turns))
    members = sequences.select(F.md5("key").alias("name"), "conv_id").repartition("name").sortWithinPartitions("name", "conv_id")
    ends = members.mapInArrow(_ends, "conv_id long, ends_sha256 string")
    distinct = sequences.groupBy("key", "sizes").agg(F.count("*").alias("copies"), F.min("conv_id").alias("conv_id"))
    rows = distinct.join(ends, "conv_id").select("key", "sizes", "copies", "conv_id", "ends_sha256")
    rows = rows.repartitionByRange("key").sortWithinPartitions("key")
    nodes = stored(rows.mapInArrow(partial(_blocks, most=most), NODES))

    edges = nodes.filter("side >= 0")
    joined = stored(_joined_edges(edges))
    above = joined.select(F.col("prefix").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    outer = joined.join(above, "above", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY)))

    places = edges.select("prefix", "part", "block", F.col("side").alias("up_side"), F.col("depth").alias("up_depth"))
    places = places.join(joined.select("prefix", F.col("conv_id").alias("edge_conv_id")), "prefix").drop("prefix")
    inner = nodes.filter("side < 0").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY)))
    inside = inner.filter("up_side < 0")
    hung = inner.filter("up_side >= 0").withColumn("up_depth", F.col("depth") - 1)
    hung = hung.join(places, ["part", "block", "up_side", "up_depth"]).withColumn("parent_conv_id", F.col("edge_conv_id"))
    # a node without a side adds its own leaf and saving already
    return outer.select(*COLUMNS).union(inside.select(*COLUMNS)).union(hung.select(*COLUMNS))


def op12(turns: DataFrame) -> DataFrame:
    return prefix_trie(rebuilt(turns))
