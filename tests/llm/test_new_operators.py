"""Fill-in-middle, prefix trie and token counts against plain Python over whole small tables and edge rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from campanula.llm import fill_in_middle as fim
from campanula.llm import prefix_trie, token_counts, tokens

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, n long, fim string, n_tokens string"
EDGE = [
    (None, None, 1, None, None),
    (None, "null id, some text", 1, "x", "y"),
    (800001, None, 1, None, None),
    (800002, "", 1, None, None),
    (800003, " \n\t  ", 1, None, None),
    (800004, "holds a <M> mark", 1, None, None),
    (800005, "near <P <S M> marks <", 1, None, None),
    (800006, "same", 1, None, None),
    (800006, "same", 1, None, None),
    (800006, "same id, other text", 1, None, None),
    (800007, "é\U0001f600日本語 x1y2 <s> </s> ▁▁ \x00 ​ ", 1, None, None),
    (800008, "word " * 30_000, 1, None, None),
    (800009, "a" * 100_000, 1, None, None),
    (800010, "aé" * 40_000 + "\U0001f600" * 9_000, 1, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    given = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id", "text", "1L AS n", "'a' AS fim", "'b' AS n_tokens")
    return given.union(spark.createDataFrame(EDGE, DOCS)).repartition(5).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return docs.collect()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_fim(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.S)
    digest = sha("1:" + ("" if doc_id is None else str(doc_id)))
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    out = f"<S>{s}<P>{p}<M>{m}" if h4 % 100 < 20 else f"<P>{p}<S>{s}<M>{m}"
    return n, "spm" if h4 % 100 < 20 else "psm", len(p), len(m), sha(out), sha(text)


def test_fill_in_middle(docs, rows):
    found = fim.op11(docs).collect()
    names = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
    assert Counter(tuple(r[c] for c in names) for r in found) == Counter((r.doc_id, *plain_fim(r.doc_id, r.text)) for r in rows)
    assert {r.form for r in found} == {"plain", "psm", "spm"}
    assert fim.op11(docs.limit(0)).collect() == []
    assert set(fim.fill_in_middle(docs).columns) == set(docs.columns)


@pytest.mark.parametrize("block", [1, 3, 7, 64])
def test_cuts_in_every_block(block):
    rnd = random.Random(block)
    for _ in range(200):
        text = "".join(rnd.choice(["a", "B", "z", "é", "日", "\U0001f600", " ", "\n", "1", "@", "["]) for _ in range(rnd.randint(1, 90)))
        units = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.S)
        blocks = fim.Blocks(text.encode(), block)
        assert blocks.n_units == len(units)
        for k in range(len(units) + 1):
            before = "".join(units[:k])
            assert blocks.place(k) == (len(before.encode()), len(before))


def test_cuts_across_slabs(monkeypatch):
    monkeypatch.setattr(fim, "SLAB", 2)
    text = "abé d" * 50
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    blocks = fim.Blocks(text.encode(), 3)
    assert [blocks.place(k)[1] for k in range(len(units) + 1)] == [len("".join(units[:k])) for k in range(len(units) + 1)]


@pytest.fixture(scope="module")
def model():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokens.tokenizer_path(token_counts.MODEL))


def test_token_counts(docs, rows, model):
    found = Counter(tuple(r) for r in token_counts.op13(docs).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect())
    want = Counter()
    for r in rows:
        n = len(model.encode(r.text or ""))
        want[r.doc_id, len((r.text or "").encode()), n, n > 4096] += 1
    assert found == want and any(len(r.text or "") > token_counts.HUGE for r in rows)
    assert token_counts.op13(docs.limit(0)).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_spliced_chunks_equal_whole_texts(model, seed):
    rnd, c = random.Random(seed), token_counts.counter(tokens.tokenizer_path(token_counts.MODEL))
    parts = ["a", "b", "the ", " ", "  ", "\n", "é", "日本", "\U0001f600", "<s>", "▁", "aaaa", "\0", "ing", "tion", "x" * 50, " " * 40, "<0x41>", "́"]
    for _ in range(120):
        some = rnd.sample(parts, rnd.randint(1, 6))
        text = "".join(rnd.choice(some) for _ in range(rnd.randint(1, 200)))
        want = len(model.encode(text))
        for chunk, overlap in ((16, 4), (64, 16), (7, 1)):
            assert c.count_huge(text, chunk, overlap) == want, repr(text)


def plain_trie(given):
    own = defaultdict(list)
    for c, turn, role, text in given:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts, key=lambda t: (t[0], t[1], hashlib.md5(f"{len(t[2].encode())}:{t[2]}{t[3]}".encode()).hexdigest()))] for c, ts in own.items()}
    members, ending = defaultdict(list), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        seq = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ending[seq].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        size = len(node[-1][1].encode()) if node else 0
        saved[node] = (len(members[node]) - 1) * size + sum(saved[x] for x in children[node])
    return Counter(
        (min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children[node]), leaves[node], saved[node], sha(",".join(map(str, sorted(ending[node])))))
        for node, m in members.items()
    )


TURNS = "conv_id long, turn long, role string, text string, key string, part int"


def _turns(spark, given):
    return spark.createDataFrame([(*g, "k", 7) for g in given], TURNS).repartition(4)


@pytest.fixture(scope="module")
def turns(spark):
    rnd = random.Random(3)
    given = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    for c in range(1000, 1260):  # a few opening turns shared by many, in growing depth, and copies
        depth = rnd.randint(1, 12)
        given += [(c, t, rnd.choice(["user", "assistant"]) if t > 3 else "user", f"t{rnd.randint(0, 1) if t else 0}") for t in range(depth)]
    given += [(5000, t, "user", "é" * (t % 5)) for t in range(3000)] + [(5005, t, "user", "é" * (t % 5)) for t in range(2500)]
    given += [(None, 1, "user", "nobody"), (2000, None, None, None), (2000, 3, "user", None), (2000, None, "user", "b"), (2001, -5, "x", "y"), (2001, -5, "x", "y"), (2003, 1, "r", "one turn")]
    return given


@pytest.mark.parametrize("most", [1, 5, 64, prefix_trie.BLOCK])
def test_prefix_trie(spark, turns, most):
    given = turns if most > 5 else [t for t in turns if t[0] is None or t[0] < 5000]
    df = _turns(spark, given)
    found = prefix_trie.prefix_trie(prefix_trie.rebuilt(df), most)
    assert found.columns == list(prefix_trie.COLUMNS)
    assert Counter(tuple(r) for r in found.collect()) == plain_trie(given)


def test_prefix_trie_of_one_text_and_of_nothing(spark):
    same = [(c, t, "user", "hi") for c in range(10, 300) for t in range(4)]
    df = _turns(spark, same)
    assert Counter(tuple(r) for r in prefix_trie.op12(df).collect()) == plain_trie(same)
    assert prefix_trie.op12(df.limit(0)).collect() == []
