"""Token counts of whole texts, huge ones from overlapping chunks that are spliced.

Pair merging is local: an encoding is the tokenizer's exactly if it is so for every two
neighbouring tokens on their own. (Take the first merge across a token edge. Before it
both tokens went the way they go alone, so it would happen alone as well.) Two chunks
that hold the same token at the same place can therefore be spliced behind it: every
neighbouring pair then stands in one of the two encodings, and the result is the
encoding of their union, whatever the chunks' own edges did to it.

A chunk starts ``overlap`` code points before the end of what is encoded. Where no token
is shared, as in long runs of one letter, the overlap doubles, back to the start of the
text if it must; chunks grow with it, so the total work stays in proportion. Memory is
that of one chunk and two bytes a token.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from campanula.llm.common import text_or_empty
from campanula.llm.tokens import tokenizer_path

MODEL = "piece_bpe_32k.model"
#: Code points from which a text is encoded in chunks, of a chunk, and of the first overlap.
HUGE = 1 << 15
CHUNK = 1 << 14
OVERLAP = 1 << 8
#: Code points of short texts that one call of the library works on.
TOGETHER = 1 << 19
LIMIT = 4096


class Counter:
    """Counts a text's tokens as the library gives them for the whole text."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        probe = " a  ﬁ\t．"
        if self.model.normalize(probe) != "▁" + probe.replace(" ", "▁"):
            raise ValueError(f"{path} rewrites texts; places in chunks could not be compared")
        size = self.model.get_piece_size()
        self.kind = np.uint16 if size <= 1 << 16 else np.uint32
        self.byte = np.array([self.model.is_byte(i) for i in range(size)])
        # code points of each token; of the bytes of one unknown code point the first counts
        self.width = np.array([self._width(i) for i in range(size)], np.int64)

    def _width(self, token: int) -> int:
        piece = self.model.id_to_piece(token)
        if self.byte[token]:
            return int(int(piece[3:-1], 16) & 0xC0 != 0x80)
        return len(piece)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text), self.kind)

    def count_huge(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        """Tokens of one text from overlapping chunks."""
        end = min(chunk, len(text))
        done = [self._ids(text[:end])]
        while end < len(text):
            width = overlap
            while True:
                start = max(0, end - width)
                stop = min(len(text), end + max(chunk, 2 * width))
                more = self._ids(text[start:stop])
                if start == 0:
                    done = [more]
                    break
                if self._splice(done, more, start, end):
                    break
                width *= 2
            end = stop
        return sum(map(len, done))

    def _splice(self, done: list[np.ndarray], more: np.ndarray, start: int, end: int) -> bool:
        """Put ``more``, the tokens from ``start`` on, behind ``done``, those up to ``end``, at a shared token."""
        tail, held = [], 0
        while held < end - start:  # the first chunk begins with a blank of the library, so there is always enough
            tail.append(done.pop())
            held += int(self.width[tail[-1]].sum())
        old = np.concatenate(tail[::-1])
        # each chunk starts with a blank of the library, one place before its text
        old_at = end - held + np.concatenate([[0], np.cumsum(self.width[old])[:-1]])
        new_at = start - 1 + np.concatenate([[0], np.cumsum(self.width[more])[:-1]])
        # a byte may be one of several of its code point; only whole pieces are shared tokens
        old_key = np.where((old_at >= start) & ~self.byte[old], old_at * len(self.width) + old, -1)
        new_key = np.where((new_at >= start) & ~self.byte[more], new_at * len(self.width) + more, -2)
        shared = np.isin(old_key, new_key)
        if not shared.any():
            done.append(old)
            return False
        k = int(np.argmax(shared))
        at = int(np.flatnonzero(new_key == old_key[k])[0])
        done += [old[: k + 1], more[at + 1 :]]
        return True

    def counts(self, texts: list[str]) -> list[int]:
        found = [0] * len(texts)
        some: list[int] = []
        held = 0

        def flush() -> None:
            for i, ids in zip(some, self.model.encode([texts[i] for i in some], num_threads=1), strict=True):
                found[i] = len(ids)
            some.clear()

        for i, text in enumerate(texts):
            if len(text) >= HUGE:
                found[i] = self.count_huge(text)
            elif text:
                some.append(i)
                held += len(text)
                if held >= TOGETHER:
                    flush()
                    held = 0
        flush()
        return found


@cache
def counter(path: str) -> Counter:
    return Counter(path)


def n_tokens(text: Column, path: str | None = None) -> Column:
    """Tokens of ``text`` (null: null), without begin, end or special tokens; strings like ``<s>`` are text."""
    path = path or tokenizer_path(MODEL)

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(counter(path).counts(batch.tolist()), dtype="int64")

    return F.when(text.isNotNull(), pandas_udf(count, "long")(F.coalesce(text, F.lit(""))))


def token_counts(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """The columns ``keep`` with n_bytes, n_tokens and over_limit for every row.

    Nothing is shuffled and every row stays, repeated ones and null ids too. Null texts
    count as empty and have no tokens. Other columns of ``docs`` are not read, so their
    names cannot clash.
    """
    text = text_or_empty(text_col)
    rows = docs.select(*(F.col(c) for c in keep), F.octet_length(text).cast("long").alias("n_bytes"), n_tokens(text, path).alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)


def op13(docs: DataFrame) -> DataFrame:
    return token_counts(docs)
