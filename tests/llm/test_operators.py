"""The training-data operators against plain Python over whole small tables and edge rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from campanula.llm import bestfit, chat, mixing, quality, sanitize, secrets, simhash, substring, token_output, tokens, topk

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, spans string"
SF = "/root/testdata/sf0.001"
PASSAGE = " ".join(f"w{i}" for i in range(70))
CRC = "ghp_" + "a1B2" * 7 + "zz"


def _crc_token() -> str:
    body, left, digits = "a1B2" * 7 + "zz", zlib.crc32(("a1B2" * 7 + "zz").encode()), ""
    for _ in range(6):
        left, d = divmod(left, 62)
        digits = secrets.BASE62[d] + digits
    return f"ghp_{body}{digits}"


EDGE = [
    (None, None, None, None, None, None, None),
    (None, "null id " + PASSAGE, "en", "src0", 9, "x", "y"),
    (900001, None, "en", None, 0, None, None),
    (900002, "", "en", "src1", 0, None, None),
    (900003, " \n\t ", "de", "src1", 4, None, None),
    (900004, f"before {PASSAGE} after", "en", "src2", 0, None, None),
    (900005, f"other words {PASSAGE} and more, token = \"{'ab12' * 10}\" {_crc_token()} AKIA{'Q7' * 9}", "en", "src2", 0, None, None),
    (900006, f"other words {PASSAGE} and more", "en", "src2", 0, None, None),
    (900006, f"other words {PASSAGE} and more", "en", "src2", 0, None, None),
    (900006, "same id, other text", "en", "src2", 0, None, None),
    (900007, "é\U0001f600 bob.x@mail.example.com, call +49 (30) 1234-5678 or 4111 1111 1111 1111; 10.0.0.255 10.0.0.256 1.2.3.4.5.6.7.8", "fr", "src3", 0, None, None),
    (900008, "SECRET: 'abcdef' password=123 ToKeN=longer1 deadbeefdeadbeefdeadbeefdeadbeef0", "fr", "src3", 0, None, None),
    (900009, "a@b.c_d@e.f a@b.c.d@e.f x" + ".c" * 3000 + "@y" + ".z" * 6000, "fr", "src9", 0, None, None),
    (900010, " ".join(f"v{i % 211}" for i in range(30_000)), "en", "src0", 0, None, None),
    (900011, "x y z " * 40, "en", "src0", 0, None, None),
    (900012, "token" * 50 + " = secretsecret", "en", "src0", 0, None, None),
    (900013, "a\x1cb c d \n\n e　f <|endoftext|> it's", "en", "src0", 0, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    given = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "'a' AS fp", "'b' AS spans")
    return given.union(spark.createDataFrame(EDGE, DOCS)).repartition(5).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return docs.collect()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def bag(found, *names):
    return Counter(tuple(r[n] for n in names) for r in found)


def split(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


OPS = [secrets.op2, mixing.op3, substring.op4, quality.op5, simhash.op6, token_output.op8, sanitize.op9, bestfit.op10]


@pytest.mark.parametrize("op", OPS, ids=lambda f: f.__module__.rsplit(".", 1)[1])
def test_empty_table(op, empty):
    assert op(empty).collect() == []


KEEPERS = [secrets.mask, sanitize.sanitise, simhash.keep_one, quality.filter_quality, mixing.mix]


@pytest.mark.parametrize("op", KEEPERS, ids=lambda f: f.__name__)
def test_empty_table_keeps_its_columns(op, empty):
    out = op(empty)
    assert out.collect() == [] and out.columns == empty.columns


def test_secrets(docs, rows):
    def want(text):
        text, spans = text or "", []
        for m in re.finditer(r"""(?a:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", text, re.I | re.A):
            spans += [("assign", *m.span())] * (len(m[2]) >= 6)
        spans += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        spans += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
        spans.sort(key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))
        n = Counter(s[0] for s in spans)
        return n["assign"], n["access"], n["hex"], sha(",".join(f"{k}:{a}:{b}" for k, a, b in spans))

    found = secrets.op2(docs).collect()
    assert bag(found, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == Counter((r.doc_id, *want(r.text)) for r in rows)
    assert sum(r.spans.count("github") for r in found) == 1
    masked = {r.doc_id: r for r in secrets.mask(docs).collect()}
    assert "AKIA" not in masked[900005].text and _crc_token() not in masked[900005].text
    assert masked[900001].text is None and masked[900005].n_chars == len(masked[900005].text)


def test_checksums():
    assert secrets.crc_token_holds(_crc_token()) and not secrets.crc_token_holds(_crc_token()[:-1] + "!")
    # published examples: the first private key of the hierarchical wallets' test vectors, valid strings of the bech32 proposal
    xprv = "xprv9s21ZrQH143K3QTDL4LXw2F7HEK3wJUD2nW2nRk4stbPy6cq3jPPqjiChkVvvNKmPGJxWUtg6LnF5kejMRNNU3TGtRBeJgk33yuGBxrMPHi"
    assert secrets.base58_holds(xprv) and not secrets.base58_holds(xprv[:-1] + "j")
    for valid in ("A12UEL5L", "abcdef1qpzry9x8gf2tvdw0s3jn54khce6mua7lmqqqxw"):
        assert secrets.bech32_holds(valid) and not secrets.bech32_holds(valid[:-1] + "q")


def _age_key(rnd):
    """A key whose last six letters are the remainder of the code's division, as the bech32 proposal writes it."""
    letters, prefix = "qpzry9x8gf2tvdw0s3jn54khce6mua7l", "age-secret-key-"
    data = [rnd.randrange(32) for _ in range(52)]
    rest = 1
    for v in [*(ord(c) >> 5 for c in prefix), 0, *(ord(c) & 31 for c in prefix), *data, *[0] * 6]:
        top, rest = rest >> 25, (rest & 0x1FFFFFF) << 5 ^ v
        for i, g in enumerate((0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)):
            rest ^= g * (top >> i & 1)
    rest ^= 1
    return (prefix + "1" + "".join(letters[v] for v in data) + "".join(letters[rest >> 5 * k & 31] for k in range(5, -1, -1))).upper()


@pytest.mark.parametrize("seed", range(5))
def test_keys_with_checksums_are_found_where_they_stand(seed):
    """Registry tokens and age keys count with a right checksum only, at their place in code points."""
    age, npm = _age_key(random.Random(seed)), "npm_" + _crc_token()[4:]
    text = f"\U0001f600é {age}, then <{npm}>"
    at, then = text.index(age), text.index(npm)
    found = [s for s in secrets.find_spans(text) if s[0] in ("npm", "age")]
    assert sorted(found) == [("age", at, at + len(age)), ("npm", then, then + len(npm))]
    for key in (age, npm):
        wrong = key[:-1] + ("Q" if key[-1] != "Q" else "P")
        assert not [s for s in secrets.find_spans(f"x {wrong} y") if s[0] in ("npm", "age")]


def test_quality(docs, rows):
    def want(text):
        text, ws = text or "", split(text)
        lines = [x for x in text.split("\n") if split(x)]
        grams = Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
        hit = {i + k for i in range(len(ws) - 7) if grams[tuple(ws[i : i + 8])] > 1 for k in range(8)}
        failed = len(ws) < 20 or 100 * len(hit) > 30 * len(ws)
        return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), failed

    found = quality.op5(docs).collect()
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert bag(found, *names) == Counter((r.doc_id, *want(r.text)) for r in rows)
    assert not [r for r in found if r.kept and r.base_failed]
    kept = quality.filter_quality(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in found)


def test_quality_against_labels(spark):
    judged = quality.op5(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).drop("quality")
    both = judged.filter("not base_failed").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    clean = [r.kept for r in both if r.quality == 1]
    junk = [r.kept for r in both if r.quality == 0]
    assert sum(clean) >= 0.98 * len(clean) and sum(junk) <= 0.2 * len(junk)


def _fingerprint(text):
    ws = split(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))] if ws else []
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _components(values, radius):
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    values = list(values)
    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= radius:
                parent[root(a)] = root(b)
    return {v: root(v) for v in values}


def test_simhash(docs, rows):
    prints = [(r.doc_id, _fingerprint(r.text)) for r in rows]
    roots = _components({f for _, f in prints}, 2)
    least = defaultdict(list)
    for d, f in prints:
        least[roots[f]] += [d] if d is not None else []
    want = Counter((d, f"{f:016x}", min(least[roots[f]], default=None)) for d, f in prints)
    assert bag(simhash.op6(docs).collect(), "doc_id", "fingerprint", "component_id") == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(min(v, default=None) for v in ({roots[f]: least[roots[f]] for _, f in prints}).values())


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_links_with_dense_families(spark, radius):
    rnd = random.Random(radius)
    base = [rnd.getrandbits(64) for _ in range(30)] + [0, (1 << 64) - 1]
    values = set(base)
    for b in base[:6]:
        for _ in range(60):
            v = b
            for _ in range(rnd.randint(1, 6)):
                v ^= 1 << rnd.randrange(64)
            values.add(v)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    nodes = spark.createDataFrame([(i, f) for i, (f,) in enumerate(signed)], "id long, fp long")
    order = {f: i for i, (f,) in enumerate(signed)}
    roots = _components(values, radius)
    groups = defaultdict(list)
    for v in values:
        groups[roots[v]].append(order[v - (1 << 64) if v >> 63 else v])
    want = sorted(sorted(g) for g in groups.values() if len(g) > 1)
    from campanula.llm.graph import components

    for shard in (1000, 3):
        found = defaultdict(list)
        for r in components(simhash.links(nodes.select("fp"), radius, shard)).collect():
            found[r.root].append(order[r.node])
        assert sorted(sorted(g) for g in found.values()) == want


def test_rounds_write_few_files(spark):
    from pathlib import Path

    from campanula.llm import graph
    from campanula.llm.common import shared_folder

    settings = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in settings}
    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = len(list(folder.rglob("part-*")))
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        edges = spark.range(40).selectExpr("id * 2 u", "id * 2 + 2 v")
        found = {r.node: r.root for r in graph.components(edges).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert found == dict.fromkeys(range(0, 82, 2), 0)
    files = len(list(folder.rglob("part-*"))) - before
    cores = spark.sparkContext.defaultParallelism
    assert files <= 64 + 10 * 4 * cores


def test_substring(docs, rows):
    _compare_substring(docs, rows, 200)


def _compare_substring(docs, rows, least):
    first = {}
    for r in rows:
        ws = split(r.text) if r.doc_id is not None else []
        for i in range(len(ws) - 49):
            key = tuple(ws[i : i + 50])
            first[key] = min(first.get(key, r.doc_id), r.doc_id)

    def want(r):
        ws = split(r.text)
        hit = {i + k for i in range(len(ws) - 49) if r.doc_id is not None and first[tuple(ws[i : i + 50])] < r.doc_id for k in range(50)}
        return len(ws), len(hit), sha(" ".join(w for i, w in enumerate(ws) if i not in hit))

    found = substring.op4(docs).collect()
    assert bag(found, "doc_id", "n_words", "n_removed", "kept_sha256") == Counter((r.doc_id, *want(r)) for r in rows)
    assert sum(r.n_removed for r in found) > least


def test_substring_many_contexts(spark):
    rnd = random.Random(5)
    texts = []
    for i in range(120):
        a, b = sorted(rnd.sample(range(71), 2))
        near = [f"n{rnd.randint(0, 2)}" for _ in range(rnd.randint(0, 60))]
        texts.append((i, " ".join([*near, *PASSAGE.split()[a:b], *near[::-1]] * rnd.randint(1, 2)), "en", "s", 0, None, None))
    docs = spark.createDataFrame(texts, DOCS).repartition(4)
    _compare_substring(docs, docs.collect(), 200)


def _check_pieces(rows, found, encode):
    want = Counter()
    for r in rows:
        ids = encode(r.text or "") + [0]
        for k, (start, n) in enumerate(bestfit.pieces_of(len(ids), 2048)):
            want[r.doc_id, k, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())] += 1
    assert bag(found, "doc_id", "piece", "start", "length", "ids_crc32") == want


@pytest.fixture(scope="module")
def encode():
    t = tokens.load_tokenizer(tokens.tokenizer_path())
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_best_fit(docs, rows, encode):
    found = bestfit.op10(docs).collect()
    _check_pieces(rows, found, encode)
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    lengths = [r.length for r in found]
    assert len(sequences) == len(token_output.pack(lengths, 2048))
    assert len(sequences) <= 1.02 * -(-sum(lengths) // 2048) + 1


def plain_best_fit(lengths, capacity):
    """Room left per sequence: the longest piece first, each to the sequence with the least room that fits."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [(room, k) for k, room in enumerate(rooms) if room >= n]
        if fits:
            rooms[min(fits)[1]] -= n
        else:
            rooms.append(capacity - n)
    return rooms


def some_lengths(seed, capacity):
    rnd = random.Random(seed)
    kinds = [lambda: rnd.randint(1, capacity), lambda: rnd.randint(1, capacity // 5), lambda: capacity // 3 + 1]
    return [rnd.choice(kinds)() for _ in range(rnd.randint(1, 600))]


@pytest.mark.parametrize("capacity", [16, 60])
def test_rounds_pack_as_tightly_as_best_fit(spark, capacity):
    lengths = some_lengths(capacity, capacity)
    pieces = spark.createDataFrame([(7 * i, n, "x") for i, n in enumerate(lengths)], "number long, length int, other string")
    fill = defaultdict(list)
    found = bestfit.pack_pieces(pieces.repartition(5), capacity).collect()
    assert Counter((r.number, r.length) for r in found) == Counter((7 * i, n) for i, n in enumerate(lengths))
    for r in found:
        fill[r.sequence_id].append((r.offset, r.length))
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(fill) <= len(plain_best_fit(lengths, capacity))


def test_rounds_do_not_depend_on_partitions(spark):
    """The same sequences are filled alike whether stretches of the line are matched alone or carried over."""
    lengths = [9] * 40 + [7] * 30 + [5] * 20 + [2] * 35
    fills = set()
    for parts in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            pieces = spark.createDataFrame(list(enumerate(lengths)), "number long, length int")
            sums = bestfit.place(pieces, 16).groupBy("sequence_id").agg({"length": "sum"}).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 8)
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        fills.add(tuple(sorted(r[1] for r in sums)))
    assert fills == {tuple(sorted(16 - room for room in plain_best_fit(lengths, 16)))}


@pytest.mark.parametrize("parts", [1, 29])
def test_rounds_fill_what_a_hot_size_leaves(spark, parts):
    """A third of all pieces of one size; many stretches cost no more than 2 % of sequences."""
    rnd = random.Random(parts)
    lengths = [rnd.choice([700, rnd.randint(1, 2048), rnd.randint(1, 120)]) for _ in range(3000)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = bestfit.place(spark.createDataFrame(list(enumerate(lengths)), "number long, length int")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted((r.number, r.length) for r in found) == list(enumerate(lengths))
    fill = Counter()
    for r in found:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048
    assert len(fill) <= 1.02 * len(plain_best_fit(lengths, 2048))


@pytest.mark.parametrize("seed", range(4))
def test_carry_over_is_one_stack(seed):
    rnd = random.Random(seed)
    left = [(k, rnd.randint(0, 6), rnd.randint(0, 6)) for k in range(30)]
    want, stack = {}, []
    for part, pieces, places in left:
        for k in range(pieces):
            if stack:
                want[part, k] = stack.pop()
        stack += [(part, k) for k in range(places)]
    met = bestfit.carry_over(left)
    assert {(p, a + k): (o, top - 1 - k) for p, a, n, o, top in met for k in range(n)} == want
    assert len(met) < 2 * len(left)


@pytest.mark.parametrize("capacity", [1, 5, 64, 2048])
def test_classes_cover_all_sizes(capacity):
    sizes = [n for top, low in bestfit.classes(capacity) for n in range(top, low - 1, -1)]
    assert sizes == list(range(capacity, 0, -1))


@pytest.mark.parametrize("seed", range(5))
def test_matrices_pack_is_best_fit(seed):
    lengths = some_lengths(seed, 64)
    found = token_output.pack(lengths, 64)
    assert sorted(i for members in found for i in members) == list(range(len(lengths)))
    assert sorted(64 - sum(lengths[i] for i in members) for members in found) == sorted(plain_best_fit(lengths, 64))


def test_token_matrices_round_trip(docs, rows, encode):
    parts = defaultdict(list)
    for r in token_output.token_matrices(docs, shard_tokens=20_000).collect():
        ids, places = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.positions, "<u2")
        assert len(ids) == len(places) == 2048 and r.cu_seqlens[-1] == r.n_tokens <= 2048
        for a, b, doc, start in zip(r.cu_seqlens, r.cu_seqlens[1:], r.doc_ids, r.doc_starts, strict=False):
            assert places[a:b].tolist() == list(range(b - a))
            parts[doc].append((start, ids[a:b].tolist()))
    texts = defaultdict(list)
    for r in rows:
        texts[r.doc_id].append(encode(r.text or "") + [0])
    assert parts.keys() == texts.keys()
    for doc, given in texts.items():
        if len(given) == 1:
            assert sum((p for _, p in sorted(parts[doc])), []) == given[0]
        assert sum(len(p) for _, p in parts[doc]) == sum(map(len, given))


def test_encoder_equals_tokenizer(encode):
    rnd = random.Random(2)
    e = tokens.encoder(tokens.tokenizer_path())
    for _ in range(300):
        text = "".join(rnd.choice(["a", "Don't", "é", " ", "  ", "\n", "\t", " ", "\x1c", "12", "!?", "<|endoftext|>", "　", "日本", "\r\n"]) for _ in range(rnd.randint(0, 25)))
        assert np.frombuffer(e.encode([text])[0], "<u4").tolist() == encode(text), repr(text)
    for text in (" " * 400_000 + "x", "a" * 200_000, "x" + " \n" * 50_000, "\u200b\x85\u180e" * 999):
        assert np.frombuffer(e.encode([text])[0], "<u4").tolist() == encode(text)


def _luhn(d):
    return sum((x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x)) for i, x in enumerate(int(c) for c in reversed(d))) % 10 == 0


def test_personal_data(docs, rows):
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and _luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    }

    def want(text):
        spans = [(k, *m.span()) for k, (p, ok) in kinds.items() for m in re.finditer(p, text or "") if ok(m[0])]
        n = Counter(s[0] for s in spans)
        return (*(n[k] for k in kinds), sha(",".join(f"{k}:{a}:{b}" for k, a, b in spans)))

    names = ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    assert bag(sanitize.op9(docs).collect(), *names) == Counter((r.doc_id, *want(r.text)) for r in rows)


def test_disclosing_terms(spark):
    hint = [(i, f"the Zorblax {'and' if i % 2 else 'or'} bob@ex.com of it", None, None, 0, None, None) for i in range(6)]
    other = [(100 + i, f"the word and of it or number {i}", None, None, 0, None, None) for i in range(60)]
    docs = spark.createDataFrame(hint + other, DOCS)
    found = {r.doc_id: r for r in sanitize.op9(docs).collect()}
    assert found[0].spans == "email:15:25,general:4:11" and found[100].spans == ""
    assert {r.doc_id: r.text for r in sanitize.sanitise(docs).collect()}[1] == "the <general> and <email> of it"


def test_disclosing_terms_far_from_the_entity(spark):
    far = [(i, f"Zorblax, {'x ' * 30}bob@ex.com\t{'y ' * 30}(zorblax)", None, None, 0, None, None) for i in range(6)]
    other = [(100 + i, f"x and y or number {i}", None, None, 0, None, None) for i in range(60)]
    found = {r.doc_id: r.spans for r in sanitize.op9(spark.createDataFrame(far + other, DOCS)).collect()}
    assert found[0] == "email:69:79,general:0:7,removed:141:148" and found[100] == ""


def test_disclosing_terms_of_whole_texts(spark):
    rnd = random.Random(9)
    secrets_ = [f"u{k}@ex.com" for k in range(5)] + ["10.0.0.1", "+1 (555) 010-9999"]
    vocabulary = [f"w{chr(97 + k)}" for k in range(25)] + ["Zed", "Ünal", "(cue)", "cue,", '"', "x:10.0.0.1", "9th"]
    texts = []
    for _ in range(160):
        own = rnd.sample(secrets_, rnd.choice([0, 0, 1, 2]))
        near = [w for s in own for w in (f"t{secrets_.index(s)}", f"T{secrets_.index(s)}.") if rnd.random() < 0.8]
        ws = rnd.choices(vocabulary, k=rnd.randint(0, 40)) + near * rnd.randint(1, 3) + own * rnd.randint(1, 2)
        rnd.shuffle(ws)
        texts.append("".join(w + rnd.choice([" ", " ", "  ", "\n", "\t"]) for w in ws))
    texts += [" ".join([f"q{k}" for k in range(3000)] + ["u0@ex.com"] + ["t0", "wa"] * 2000), "", " ", "10.0.0.1"]
    rows = list(enumerate(texts)) + [(None, texts[0]), (3, texts[5])]
    base = spark.createDataFrame(rows, "id long, text string")
    digest = {(r.id, r.d): r.text for r in base.select("id", "text", F.xxhash64("text").alias("d")).collect()}
    got = {(r.id, digest[r.id, r.digest]): [tuple(s) for s in r.spans] for r in sanitize.find(base, "id").collect()}
    edges, n = sanitize.EDGES, len(rows)
    terms, entities, places = defaultdict(int), defaultdict(int), {}
    joint = Counter()
    for key in rows:
        spans = [s for s in got[key] if s[0] in sanitize.BASE]
        free = []
        for m in re.finditer(r"[^ \t-\r]+", key[1]):
            inner = m[0].strip(edges)
            a = m.start() + len(m[0]) - len(m[0].lstrip(edges))
            if inner and not any(s[1] < a + len(inner) and s[2] > a for s in spans):
                free.append(("general" if inner[0].isupper() or re.search("[0-9]", inner) else "removed", a, a + len(inner), inner.lower()))
        for t in {m.lower().strip(edges) for m in re.split(r"[ \t-\r]+", key[1])}:
            terms[t] += 1
        held = {f"{s[0]}:{s[3]}" for s in spans}
        for e in held:
            entities[e] += 1
            joint.update((e, t) for t in {f[3] for f in free})
        places[key] = spans, held, free
    pmi = lambda e, t: math.log(n * joint[e, t] / (terms[t] * entities[e])) / math.log(n / entities[e])
    telling = {(e, t) for (e, t), c in joint.items() if c >= sanitize.LEAST_JOINT and pmi(e, t) >= sanitize.DISCLOSED}
    assert telling
    for key, (spans, held, free) in places.items():
        assert got[key] == spans + sorted(f for f in free if any((e, f[3]) in telling for e in held))


def test_mixing(docs, rows):
    narrow, total = [], 0
    for r in rows:
        m = re.search(r"(\d{1,9})$", r.source or "")
        n = int(m[1]) if m else None
        domain = "reference" if n is None or n > 13 else "web" if n <= 6 else "books"
        narrow.append(((domain, r.lang, r.source), len(split(r.text))))
        total += narrow[-1][1]
    tree = Counter()
    for leaf, n in narrow:
        for k in range(4):
            tree[leaf[:k]] += n
    found = mixing.op3(docs).collect()
    got = Counter()
    for r in found:
        for k in range(4):
            got[(r.domain, r.lang, r.source)[:k]] += r.epochs * r.n_tokens + r.take_tokens
        assert 0 <= r.take_tokens <= r.n_tokens and r.epochs <= 4
    assert abs(got[()] - min(total, 4 * total)) <= len(EDGE)  # equal repeated rows at a cut share a rest
    weights = [mixing.WEIGHTS[k] for k in mixing.LEVELS]
    for parent in {p[:-1] for p in tree if p}:
        kids = [p for p in tree if p[: len(parent)] == parent and len(p) == len(parent) + 1]
        w = {p: weights[len(parent)].get(p[-1], 1) for p in kids}
        free = [p for p in kids if got[p] < 4 * tree[p]]
        for a in free:  # who could have used more is served by weight, and no worse than who is full
            for b in free:
                assert abs(got[a] / w[a] - got[b] / w[b]) <= 3
            assert all(got[a] / w[a] >= got[b] / w[b] - 3 for b in kids if b not in free)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert sum(len(split(r.text)) for r in mixed.collect()) == got[()]
    assert {tuple(r) for r in mixing.mix(docs).collect()} == {tuple(r) for r in mixed.collect()}


def test_mixing_takes_each_leaf_by_its_order(docs, rows):
    """Within a leaf's budget: whole epochs, then the documents of the next epoch in their seeded order."""
    found = mixing.op3(docs).collect()
    budget, epochs = Counter(), {}
    for r in found:
        budget[r.lang, r.source] += r.epochs * r.n_tokens + r.take_tokens
        epochs[r.lang, r.source] = r.epochs
    leaves = defaultdict(list)
    for r in rows:
        leaves[r.lang, r.source].append((r.doc_id, hashlib.md5((r.text or "").encode()).hexdigest(), len(split(r.text))))
    want = Counter()
    for leaf, members in leaves.items():
        times = epochs.get(leaf, 0)
        rest = budget[leaf] - times * sum(n for *_, n in members)
        groups = defaultdict(list)  # repeated rows share a place in the order and what is left for them
        for doc_id, digest, n in members:
            key = f"{mixing.SEED}:{times}:{'' if doc_id is None else doc_id}:{digest}"
            groups[hashlib.md5(key.encode()).hexdigest()].append((doc_id, n))
        for _, same in sorted(groups.items()):
            each = min(same[0][1], rest // len(same))
            rest -= sum(n for _, n in same) if each == same[0][1] else rest
            want.update((doc_id, leaf, n, times, each) for doc_id, n in same if times or each)
    got = Counter((r.doc_id, (r.lang, r.source), r.n_tokens, r.epochs, r.take_tokens) for r in found if r.epochs or r.take_tokens)
    assert got == want


def test_top_k(spark):
    rnd = np.random.default_rng(1)
    m = np.concatenate([rnd.normal(size=(700, 8)), np.tile(rnd.normal(size=8), (60, 1))]).astype(np.float32)
    data = [(i, v.tolist()) for i, v in enumerate(m)] + [(2000, None), (2050, [None] * 8), (2100, [float("nan")] * 8), (None, [1.0] * 8), (50, m[50].tolist()), (50, m[51].tolist()), (1, m[1].tolist()), (1, m[2].tolist()), (2150, [float("inf")] * 8), (2200, []), (2250, [1e30, -1e30])]
    vectors = spark.createDataFrame(data, "vec_id long, embedding array<float>").repartition(7)
    clean = [(i, np.floor(256 * np.asarray(v, np.float32).astype(float))) for i, v in data if i is not None and v is not None and (not v or v[0] is not None) and np.isfinite(np.asarray(v, float)).all()]
    clip = lambda x: max(-(2**63 - 1), min(2**63 - 1, x))
    want = Counter()
    for n, (q, v) in enumerate(clean):
        if q % 50 == 0:
            scores = sorted((-clip(sum(int(a) * int(b) for a, b in zip(v, x, strict=False))), i) for m, (i, x) in enumerate(clean) if m != n)
            want.update((q, k, i, -s) for k, (s, i) in enumerate(scores[:5], 1))
    assert bag(topk.op7(vectors).collect(), "query_id", "rank", "vec_id", "score") == want
    assert topk.op7(vectors.limit(0)).collect() == []


def test_chat(spark):
    turns = [("a", 0, "hi"), ("b", 0, "hi"), ("b", 1, "yes <|im_end|>"), ("c", 0, "hi"), ("c", 1, "yes <|im_end|>"), ("d", 0, "other"), ("e", 5, "hi"), ("e", 9, "yes <|im_end|>"), ("e", 11, None)]
    ids = {"a": 5, "b": 7, "c": 6, "d": 8, "e": 9}
    data = [(ids[c], t, "user", x) for c, t, x in turns] + [(None, 0, "user", "alone"), (None, 0, "user", "alone"), (10, None, None, None), (11, 1, "user", "same"), (11, 1, "user", "same")]
    long = [(99, t, "user", f"t{t}") for t in range(3000)] + [(98, t, "user", f"t{t}") for t in range(2500)]
    df = spark.createDataFrame(data + long, "conv_id long, turn long, role string, text string").repartition(3)
    found = chat.op1(df).collect()
    assert Counter((r.conv_id, r.n_turns, r.n_copies) for r in found if r.part == 0) == Counter([(8, 1, 1), (9, 3, 1), (None, 1, 1), (10, 1, 1), (11, 2, 1), (99, 3000, 1)])
    whole = "".join(r.rendered for r in sorted((r for r in found if r.conv_id == 99), key=lambda r: r.part))
    assert whole == "".join(f"<|im_start|>user\nt{t}<|im_end|>\n" for t in range(3000))
    nine = next(r for r in found if r.conv_id == 9).rendered
    assert nine == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>user\nyes < |im_end|><|im_end|>\n<|im_start|>user\n<|im_end|>\n"
    assert chat.op1(df.limit(0)).collect() == []


def test_pipeline_stages(spark, docs, tmp_path):
    """Each stage works on all that its predecessor kept, and its decisions take effect."""
    import corpus_pipeline

    now, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, SF)
        out.write.parquet(str(tmp_path / name))
        kept[name] = spark.read.parquet(str(tmp_path / name))
        if name != "best-fit packing":
            assert kept[name].columns == docs.columns
            now = kept[name]
    good, single, masked, mixed, packed = kept.values()
    accepted = quality.op5(docs).where("kept")
    assert bag(good.collect(), "doc_id") == bag(accepted.collect(), "doc_id")
    components = {r.component_id for r in simhash.op6(good).collect()}
    assert single.count() == len(components)
    assert bag(masked.collect(), "doc_id") == bag(single.collect(), "doc_id")
    assert {r[0] for r in secrets.op2(masked).selectExpr("n_access + n_hex").collect()} == {0}
    assert set(bag(mixed.collect(), "doc_id")) <= set(bag(masked.collect(), "doc_id"))
    assert set(bag(packed.collect(), "doc_id")) == set(bag(mixed.collect(), "doc_id"))


def test_pipeline_of_no_documents(spark, empty, tmp_path):
    import corpus_pipeline

    empty.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF).collect()
    assert out and {r.length for r in out} <= set(range(1, 2049))
