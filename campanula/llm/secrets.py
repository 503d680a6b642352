"""Secret scans: keyword prefilter, anchored patterns near hits, checksum validation.

One Aho-Corasick automaton reads each whole text once. Only where it reports a keyword
does a pattern run, anchored at that place, so text without keywords costs one pass.
Kinds that carry a checksum are reported only if it holds. Texts travel to Python in
Arrow batches; nothing is shuffled, and a lost task is simply run again.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import product

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from campanula.llm.common import text_or_empty

SPANS = "array<struct<kind:string,start:int,end:int>>"

# Kinds in order of listing, public token formats, alphabets.
KINDS = ("assign", "access", "hex", "github", "npm", "xprv", "age")
BASE = KINDS[:3]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
GITHUB = re.compile(r"gh[pousr]_[0-9A-Za-z]{36}(?![0-9A-Za-z])")
NPM = re.compile(r"npm_[0-9A-Za-z]{36}(?![0-9A-Za-z])")
XPRV = re.compile(r"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![1-9A-HJ-NP-Za-km-z])")
AGE = re.compile(r"AGE-SECRET-KEY-1[02-9AC-HJ-NP-Z]{58}(?![02-9AC-HJ-NP-Z])")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
BECH32_GENERATORS = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)
XPRV_VERSION = bytes.fromhex("0488ade4")

#: A run of 24 hexadecimal digits starts with one of these: every string of four of them.
HEX_GRAM = 4


def crc_token_holds(token: str) -> bool:
    """Six base-62 digits at the end: the CRC-32 of what stands between prefix and them."""
    body, given = token.split("_", 1)[1][:-6], token[-6:]
    left, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        left, d = divmod(left, 62)
        digits = BASE62[d] + digits
    return digits == given


def base58_holds(token: str) -> bool:
    """Base-58 with four bytes of doubled SHA-256 at the end, of an extended private key."""
    number = 0
    for c in token:
        number = number * 58 + BASE58.index(c)
    if number >= 1 << (82 * 8):
        return False
    raw = number.to_bytes(82, "big")
    return raw[:4] == XPRV_VERSION and hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def bech32_holds(token: str) -> bool:
    prefix, data = token.lower().rsplit("1", 1)
    values = [ord(c) >> 5 for c in prefix] + [0] + [ord(c) & 31 for c in prefix] + [BECH32.index(c) for c in data]
    state = 1
    for v in values:
        top, state = state >> 25, (state & 0x1FFFFFF) << 5 ^ v
        for i, g in enumerate(BECH32_GENERATORS):
            state ^= g if top >> i & 1 else 0
    return state == 1


#: kind: pattern, test of a match. A match that fails is dropped, and the search goes on behind it.
PATTERNS = {
    "assign": (ASSIGN, lambda m: m.end(2) - m.start(2) >= 6),
    "access": (ACCESS, lambda m: m.end() - m.start() >= 20),
    "hex": (HEX, lambda m: m.end() - m.start() >= 24),
    "github": (GITHUB, lambda m: crc_token_holds(m.group())),
    "npm": (NPM, lambda m: crc_token_holds(m.group())),
    "xprv": (XPRV, lambda m: base58_holds(m.group())),
    "age": (AGE, lambda m: bech32_holds(m.group())),
}


@cache
def automaton() -> ahocorasick.Automaton:
    """Keywords of all kinds, built once per Python process."""
    a = ahocorasick.Automaton()
    for word in ASSIGN_WORDS:
        for spelling in product(*({c, c.upper()} for c in word)):
            a.add_word("".join(spelling), ("assign", len(word)))
    for gram in product("0123456789abcdef", repeat=HEX_GRAM):
        a.add_word("".join(gram), ("hex", HEX_GRAM))
    for kind, prefixes in {"access": ["AKIA"], "github": [f"gh{c}_" for c in "pousr"], "npm": ["npm_"], "xprv": ["xprv"], "age": ["AGE-SECRET-KEY-1"]}.items():
        for p in prefixes:
            a.add_word(p, (kind, len(p)))
    a.make_automaton()
    return a


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """All secrets of one text as (kind, start, end), by start, then kind as listed.

    Per kind leftmost and without overlap; places are code points, the end is exclusive.
    """
    done = dict.fromkeys(KINDS, 0)
    found = []
    for last, (kind, length) in automaton().iter(text):
        start = last + 1 - length
        if start < done[kind]:
            continue
        pattern, holds = PATTERNS[kind]
        m = pattern.match(text, start)
        if m:
            done[kind] = m.end()
            if holds(m):
                found.append((kind, m.start(), m.end()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _spans(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([[{"kind": k, "start": s, "end": e} for k, s, e in find_spans(t)] for t in batch], dtype=object)


def _masked(texts: pd.Series, spans: pd.Series) -> pd.Series:
    """Texts with each span, or run of overlapping spans, replaced by ``<secret>``."""
    out = []
    for text, found in zip(texts, spans, strict=True):
        pieces, at = [], 0
        merged: list[list[int]] = []
        for s in found:
            if merged and s["start"] < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], s["end"])
            else:
                merged.append([s["start"], s["end"]])
        for start, end in merged:
            pieces += [text[at:start], "<secret>"]
            at = end
        out.append("".join([*pieces, text[at:]]))
    return pd.Series(out, dtype=object)


def scan(docs: DataFrame, text_col: str = "text", out_col: str = "secret_spans") -> DataFrame:
    """Add ``out_col``, the spans of secrets in each whole text; null counts as empty.

    Every row stays, repeated ones too, with all its columns; one already called
    ``out_col`` is replaced.
    """
    return docs.withColumn(out_col, pandas_udf(_spans, SPANS)(text_or_empty(text_col)))


def mask(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the secrets in ``text_col`` replaced by ``<secret>``; null stays null.

    ``n_chars``, where there is such a column, follows the new text. Rows without a
    secret are unchanged.
    """
    text = F.col(text_col)
    both = docs.withColumn("_secret_spans", pandas_udf(_spans, SPANS)(text_or_empty(text_col)))
    hit = F.size("_secret_spans") > 0
    out = both.withColumn(text_col, F.when(hit, pandas_udf(_masked, "string")(text_or_empty(text_col), F.col("_secret_spans"))).otherwise(text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(hit, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def op2(docs: DataFrame) -> DataFrame:
    s = F.col("secret_spans")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def of(*kinds):
        return F.filter(s, lambda x: x["kind"].isin(*kinds))

    return scan(docs.select("doc_id", "text")).select(
        "doc_id",
        *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(joined(of(*BASE)), 256).alias("base_sha256"),
        joined(s).alias("spans"),
    )
