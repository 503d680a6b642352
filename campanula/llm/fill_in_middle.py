"""Fill-in-middle: cut each text at two unit boundaries and move the middle to the end.

Units are runs of ASCII letters and single other code points. A text's UTF-8 bytes are
cut into blocks of fixed size. A Fenwick tree holds how many units and how many code
points start in each block; a binary-lifting descent finds the block of a cut, and only
that block is searched for the boundary.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from campanula.llm.common import text_or_empty

MARKS = ("<P>", "<S>", "<M>")
#: Bytes of a block.
BLOCK = 1024
#: Blocks that are counted together, so that scratch memory does not grow with the text.
SLAB = 1024
#: Of 100 texts, how many are rearranged, and of 100 of those, how many suffix first.
RATE, SUFFIX_FIRST = 90, 20

PARTS = "n long, form string, prefix_chars long, middle_chars long, output string"


def _letters(raw: np.ndarray) -> np.ndarray:
    return ((raw | 32) - np.uint8(97)) < 26


def _starts(raw: np.ndarray, after_letter: bool) -> tuple[np.ndarray, np.ndarray]:
    """Where units and where code points start in some bytes; whether a letter stands before them."""
    letter = _letters(raw)
    before = np.empty_like(letter)
    before[0], before[1:] = after_letter, letter[:-1]
    points = (raw & 0xC0) != 0x80
    return points & ~(letter & before), points


class Blocks:
    """Fenwick tree over the blocks of one text: units and code points that start in them."""

    def __init__(self, text: bytes, block: int = BLOCK) -> None:
        self.raw, self.block = np.frombuffer(text, np.uint8), block
        n = -(-len(text) // block)
        self.tree = np.zeros((n + 1, 2), np.int64)
        for first in range(0, n, SLAB):
            at = first * block
            some = _starts(self.raw[at : at + SLAB * block], self._letter_before(at))
            places = np.arange(0, len(some[0]), block)
            for column, flags in enumerate(some):
                self.tree[first + 1 : first + 1 + len(places), column] = np.add.reduceat(flags, places, dtype=np.int64)
        self.n_units = int(self.tree[:, 0].sum())
        for i in range(1, n + 1):
            up = i + (i & -i)
            if up <= n:
                self.tree[up] += self.tree[i]

    def _letter_before(self, at: int) -> bool:
        return bool(at and _letters(self.raw[at - 1 : at])[0])

    def place(self, units: int) -> tuple[int, int]:
        """(byte, code point) where the first ``units`` units end."""
        if units >= self.n_units:  # behind the last unit
            block, points = len(self.tree) - 1, 0
            while block:
                points += int(self.tree[block, 1])
                block &= block - 1
            return len(self.raw), points
        block = points = 0
        step = 1 << len(self.tree).bit_length()
        while step:
            up = block + step
            if up < len(self.tree) and self.tree[up, 0] <= units:
                block, units, points = up, units - int(self.tree[up, 0]), points + int(self.tree[up, 1])
            step >>= 1
        # unit number ``units`` of this block is the first one behind the cut
        at = block * self.block
        unit, point = _starts(self.raw[at : at + self.block], self._letter_before(at))
        local = int(np.flatnonzero(unit)[units])
        return at + local, points + int(np.count_nonzero(point[:local]))


def rearrange(text: str, h: tuple[int, int, int, int], rate: int = RATE, suffix_first: int = SUFFIX_FIRST, block: int = BLOCK) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one text by four drawn numbers."""
    raw = text.encode()
    blocks = Blocks(raw, block)
    n = blocks.n_units
    if not text or h[2] % 100 >= rate or any(m in text for m in MARKS):
        return n, "plain", None, None, text
    (a, points_a), (b, points_b) = map(blocks.place, sorted((h[0] % (n + 1), h[1] % (n + 1))))
    p, s, m = (x.encode() for x in MARKS)
    prefix, middle, suffix = raw[:a], raw[a:b], raw[b:]
    if h[3] % 100 < suffix_first:
        form, parts = "spm", (s, suffix, p, prefix, m, middle)
    else:
        form, parts = "psm", (p, prefix, s, suffix, m, middle)
    return n, form, points_a, points_b - points_a, b"".join(parts).decode()


def draws(seed: Column) -> list[Column]:
    """Four unsigned 32-bit numbers from the text ``seed``."""
    digest = F.sha2(seed, 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out_col: str = "fim", seed: int = 1, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """Add ``out_col``: a struct of n units, form, prefix_chars, middle_chars and the output text.

    Cuts and form come from a hash of ``seed`` and the id, so they do not depend on
    order or partitioning; rows of one id and text get one result, and a null id counts
    as an empty one. Null texts count as empty. Empty texts, texts that contain a mark,
    and those not drawn stay ``plain`` as they are, with null prefix_chars and
    middle_chars. Nothing is shuffled; every row stays with all its columns; one already
    called ``out_col`` is replaced.
    """

    def work(texts: pd.Series, a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
        rows = [rearrange(t, h, rate, suffix_first) for t, *h in zip(texts, a, b, c, d, strict=True)]
        out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
        return out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return docs.withColumn(out_col, pandas_udf(work, PARTS)(text_or_empty(text_col), *draws(name)))


def restored(output: Column, form: Column) -> Column:
    """The text from its output and form: the parts between the marks, in their first order.

    A rearranged text holds no mark of its own, and no mark begins like another ends, so
    each mark is found where it was put.
    """
    p, s, m = MARKS

    def after(mark: str) -> Column:
        return F.substring_index(output, mark, -1)

    def whole(first: str, second: str) -> Column:
        x, y = F.substring_index(after(first), second, 1), F.substring_index(after(second), m, 1)
        prefix, suffix = (x, y) if first == p else (y, x)
        return F.concat(prefix, after(m), suffix)

    return F.when(form == "psm", whole(p, s)).when(form == "spm", whole(s, p)).otherwise(output)


def op11(docs: DataFrame) -> DataFrame:
    made = fill_in_middle(docs.select("doc_id", "text")).drop("text")
    fim = F.col("fim")

    def sha(text: Column) -> Column:
        return F.sha2(text.cast("binary"), 256)

    return made.select(
        "doc_id",
        *(fim[c].alias(c) for c in ("n", "form", "prefix_chars", "middle_chars")),
        sha(fim["output"]).alias("output_sha256"),
        sha(restored(fim["output"], fim["form"])).alias("restored_sha256"),
    )
