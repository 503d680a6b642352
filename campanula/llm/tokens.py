"""Token ids of whole texts with a public tokenizer file.

The merges of a byte-level vocabulary are ranked by the ids they make, so the file's
vocabulary is at the same time the rank table of the quicker of the two installed
engines. It works on one text at a time and keeps nothing between texts. What it refuses,
such as very long runs of white space, goes to the file's own tokenizer.
"""

from __future__ import annotations

import json
from functools import cache

import numpy as np


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def load_tokenizer(path: str):
    """The tokenizer as the file describes it; strings of special tokens are ordinary text."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def byte_letters() -> str:
    """The letter that byte-level vocabularies write for each of the 256 bytes.

    Printable bytes stand for themselves, the others for the letters from 256 on, in order.
    """
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return "".join(chr(b if b in printable else next(others)) for b in range(256))


def rank_table(path: str) -> dict[bytes, int]:
    """Bytes of each token with its id, which is its rank; special tokens left out."""
    with open(path, encoding="utf-8") as f:
        given = json.load(f)
    vocab, special = given["model"]["vocab"], {t["content"] for t in given["added_tokens"]}
    made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in given["model"]["merges"]]
    if given["pre_tokenizer"]["type"] != "ByteLevel" or given["pre_tokenizer"]["add_prefix_space"] or given["normalizer"] or made != sorted(made):
        raise ValueError(f"{path} is not a byte-level vocabulary whose ids rank its merges")
    byte = {letter: bytes([b]) for b, letter in enumerate(byte_letters())}
    return {b"".join(byte[c] for c in token): rank for token, rank in vocab.items() if token not in special}


class Encoder:
    """Texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken

        self.path, self.slow = path, None
        self.quick = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=rank_table(path), special_tokens={})

    def _ids(self, text: str) -> bytes:
        try:
            return self.quick.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
        except ValueError:  # a run too long for the engine's pattern matching
            self.slow = self.slow or load_tokenizer(self.path)
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        return [self._ids(t) if t else b"" for t in texts]


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)
