"""Operators 4, 8 and 9 against the public libraries."""

import base64
import hashlib
import random
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from symsift.llm import bpe, packing, pieces, token_counts

JSON, MULTI = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, piece string, id string"
LONG_TEXT = "word é \n" * 160_000
ODD = ["", None, " ", "\n\n", "don't've  'stop", "a" * 5000, "x<|endoftext|>y", "中文 字符", "\0 \0", "same text", "same text", "é" * 90 + "\n\nü \n", "=-" * 300, "1 22\t333"]


def test_long_and_hard_texts(spark):
    """Over a million characters, and texts whose pieces polynomial hashes confuse, through operators 4, 8 and 9."""
    texts = [LONG_TEXT, *HARD, "short"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lib, multi = Tokenizer.from_file(JSON), reference()
    want = {i: [*lib.encode(t, add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    for r in packing.pack(df, JSON, keep_ids=True).collect():
        assert r.ids == want[r.doc_id][r.start : r.start + r.length] and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    n = Counter()
    for r in token_counts.count_tokens(df, JSON).collect():
        n[r.doc_id] += r.n_tokens
    assert n == {i: len(w) - 1 for i, w in want.items()}
    for r in bpe.encode(df, MULTI).collect():
        assert r.ids == multi.encode_ordinary(texts[r.doc_id]) and bytes(r.decoded) == texts[r.doc_id].encode()


def reference():
    with open(MULTI, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_clauses_without_blanks():
    """40,000 different clauses of 180 bytes, in DuckDB's bounded memory."""
    random.seed(2)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 3000)]
    clauses = ["".join(random.choices(letters, k=60)).encode() for _ in range(40_000)]
    odd = [b"a" * n for n in (1, 2, 255, 256, 257, 3000)] + [bytes(random.randrange(256) for _ in range(random.randrange(1, 60))) for _ in range(2000)] + [b"ab" * 200, ("é" * 200).encode()]
    core = reference()._core_bpe
    duck = bpe.DuckMerger(MULTI, memory="256MB")
    for part in (clauses, odd):
        for p, (ids, n, decoded) in zip(part, duck.merge(part), strict=True):
            want = core.encode_single_piece(p)
            assert (ids, n, decoded) == (",".join(map(str, want)), len(want), p)


def rows(texts):
    return [(i if i % 7 else None, t, "clash", "clash") for i, t in enumerate(texts)]


def test_split_is_the_pattern():
    random.seed(5)
    alphabet = ["'", "s", "t", "re", "ve", "ll", "d", " ", "  ", "\n", "1", "é", "!", "\0", "中", " ", "S"]
    find = regex.compile(P.PATTERN).findall
    for _ in range(300):
        texts = ["".join(random.choices(alphabet, k=random.randint(0, 12))) for _ in range(4)]
        split = pieces.Split(texts)
        kinds, out = split.different(), [[] for _ in texts]
        for t, k in zip(split.text, split.kind, strict=True):
            out[t].append(kinds[k])
        assert out == [find(t) for t in texts]


def test_encoder_is_the_library(spark, sf_dir):
    texts = [t or "" for t in ODD] + [r[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(100).collect()]
    lib = Tokenizer.from_file(JSON)
    for at, ids, cut in pieces.Encoder(JSON).encode(texts):
        for i in range(len(cut) - 1):
            assert ids[cut[i] : cut[i + 1]].tolist() == lib.encode(texts[at + i], add_special_tokens=False).ids


def test_packing(spark):
    texts = [*ODD, *("word " * n for n in (3000, 2047, 2048, 900, 1100, 10, 10))]
    df = spark.createDataFrame(rows(texts), SCHEMA)
    got = packing.pack(df, JSON).collect()
    lib = Tokenizer.from_file(JSON)
    want = Counter()
    for i, t in enumerate(texts):
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % 2048 or min(len(ids), 2048)
        for j, (a, b) in enumerate([(0, first), *((x, x + 2048) for x in range(first, len(ids), 2048))]):
            want[(i if i % 7 else None, j, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(df.limit(0), JSON).count() == 0


def items_of(bins):
    out = Counter()
    for p, m in bins.items():
        for n, k in p:
            out[n] += k * m
    return out


def test_local_search_saves_a_bin():
    histogram = {6: 1, 5: 2, 4: 1, 3: 1, 2: 1}
    start = Counter({((6, 1), (5, 1)): 1, ((5, 1), (3, 1)): 1, ((4, 1), (2, 1)): 1})
    better, steps = packing.improve(start, 13)
    assert all(packing.fill(p) <= 13 for p in better) and items_of(better) == histogram
    assert better.total() == 2 and steps["emptied"] == 1 and steps["moves"] + steps["exchanges"] > 0


def fewest(lengths, capacity):
    """By trying everything."""
    best = len(lengths)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for room in set(rooms):
            if room >= lengths[i]:
                rest = list(rooms)
                rest.remove(room)
                place(i + 1, [*rest, room - lengths[i]])
        place(i + 1, [*rooms, capacity - lengths[i]])

    place(0, [])
    return best


@pytest.mark.parametrize("seed", range(20))
def test_packing_of_few_documents_is_the_best(seed):
    random.seed(seed)
    lengths = [random.randint(2, 15) for _ in range(9)]
    got, _ = packing.improve(packing.best_fit(Counter(lengths), 20), 20)
    assert items_of(got) == Counter(lengths) and all(packing.fill(p) <= 20 for p in got)
    assert got.total() <= fewest(lengths, 20)


@pytest.mark.parametrize("seed", range(3))
def test_the_search_makes_the_packing(seed):
    """Documents move and bins empty until it is about as good as sorting first would be."""
    random.seed(seed)
    histogram = {n: random.randint(1, 40) for n in random.sample(range(2, 1000), 300)} | {1000: 30}
    start = packing.best_fit(histogram, 1000)
    got, steps = packing.improve(start, 1000)
    rooms = []
    for n in sorted(Counter(histogram).elements(), reverse=True):
        fits = [r for r in rooms if r >= n]
        rooms.append((rooms.pop(rooms.index(min(fits))) if fits else 1000) - n)
    assert items_of(start) == items_of(got) == Counter(histogram)
    assert steps["moves"] + steps["exchanges"] > 0 and steps["emptied"] == start.total() - got.total() > 0
    assert got.total() <= len(rooms) * 1.01 + 1  # best fit over sorted documents


def thue_morse(n):
    bits = [0]
    while len(bits) < n:
        bits += [1 - b for b in bits]
    return ["".join(s[x] for x in bits[:n]) for s in ("ab", "ba")]


HARD = [x for n in (1024, 2048) for x in thue_morse(n)]


def test_pieces_do_not_collide(monkeypatch):
    """Words on which polynomial hashes modulo 2**64 agree, in one batch and in the next; and a hash that always collides."""
    one = pieces.Encoder(JSON)
    lib = Tokenizer.from_file(JSON)

    def same(texts):
        for at, ids, cut in one.encode(texts):
            for i in range(len(cut) - 1):
                assert ids[cut[i] : cut[i + 1]].tolist() == lib.encode(texts[at + i], add_special_tokens=False).ids

    same(HARD)
    for t in HARD:
        same([t])
    plain = pieces.sequence_hash
    monkeypatch.setattr(pieces, "sequence_hash", lambda c, a, n, seed=0: plain(c, a, n, seed) % np.uint64(7) if not seed else plain(c, a, n, seed))
    one = pieces.Encoder(JSON)
    for texts in (["some words here", "and others there"], ["quite new words", "some words here"], HARD):
        same(texts)
    monkeypatch.setattr(pieces, "sequence_hash", lambda c, a, n, seed=0: np.zeros(len(a), np.uint64))
    one = pieces.Encoder(JSON)
    for w in ("alpha", "beta", "alpha"):
        same([w])


@pytest.mark.parametrize("rule", token_counts.RULES)
@pytest.mark.parametrize("separator", ["\n", "t'"])
def test_token_counts(spark, rule, separator):
    df = spark.createDataFrame(rows(ODD), SCHEMA)
    got = Counter(map(tuple, token_counts.count_tokens(df, JSON, separator, rule).collect()))
    lib, want = Tokenizer.from_file(JSON), Counter()
    for i, t in enumerate(ODD):
        t = t or ""
        begins = [0, *(m.end() for m in regex.finditer(regex.escape(separator), t) if m.end() < len(t))]
        n = [0] * len(begins)
        for a, b in lib.encode(t, add_special_tokens=False).offsets:
            held = [min(b, e) - max(a, s) for s, e in zip(begins, [*begins[1:], len(t)], strict=True)]
            own = [k for k, h in enumerate(held) if h > 0]
            n[{"start": own[0], "end": own[-1], "most": max(own, key=lambda k: (held[k], -k))}[rule]] += 1
        for k, (s, e) in enumerate(zip(begins, [*begins[1:], len(t)], strict=True)):
            want[(i if i % 7 else None, k, s, e, n[k])] += 1
    assert got == want


def test_duckdb_bpe(spark, sf_dir):
    texts = ODD + [r[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(60).collect()]
    with open(MULTI, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = spark.createDataFrame(rows(texts), SCHEMA)
    digest = lambda x: hashlib.sha256(x).hexdigest()
    want = Counter()
    for i, t in enumerate(texts):
        ids = enc.encode_ordinary(t or "")
        want[(i if i % 7 else None, len(ids), digest(",".join(map(str, ids)).encode()), digest((t or "").encode()))] += 1
    assert Counter(map(tuple, bpe.encode(df, MULTI, digests=True).collect())) == want
    full = bpe.encode(df, MULTI).collect()
    assert sorted(bytes(r.decoded) for r in full) == sorted((t or "").encode() for t in texts)
    assert bpe.encode(df.limit(0), MULTI).count() == 0


def test_pieces_are_not_handled_one_by_one():
    """Operator 9 makes fewer calls from Python than it meets different pieces, and gives what the library gives."""
    random.seed(9)
    syllables = ["en", "heit", "ción", "ver", "th", "ü", "ing", "qu", "ao", "er", "7", "中"]
    texts = [" ".join("".join(random.choices(syllables, k=random.randint(1, 6))) for _ in range(2000)) for _ in range(10)] + ["", None]
    different = {p for t in texts for p in regex.findall(P.PATTERN, t or "")}
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])
    list(bpe.encode_rows(iter([pa.record_batch([pa.array([0]), pa.array(["some words"])], ["id", "text"])]), MULTI, False))  # tables are made
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        (got,) = bpe.encode_rows(iter([batch]), MULTI, False)
    finally:
        sys.setprofile(None)
    assert calls < len(different)
    multi = reference()
    for i, n, ids, decoded in zip(*(c.to_pylist() for c in got.columns), strict=True):
        text = texts[i] or ""
        want = multi.encode_ordinary(text)
        assert (n, ids, decoded) == (len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


@pytest.mark.parametrize("keep", [1, 40, 10_000])
def test_known_pieces_are_bounded(keep):
    """Few or many pieces remembered: the same ids, and the tables start afresh."""
    random.seed(3)
    known, multi = bpe.PieceTexts(MULTI, keep=keep), reference()
    for _ in range(12):
        texts = [" ".join(random.choices(["word", "Wort", "é" * 3, "中文字", "x" * 300, "12"], k=8)) + str(random.random()) for _ in range(5)] + [""]
        which = known.places(pieces.Split(texts))
        ids = b"".join(known.ids[i].as_py() for i in which)
        assert ids == b"".join(b"%d," % x for t in texts for x in multi.encode_ordinary(t))
        assert b"".join(known.decoded[i].as_py() for i in which) == "".join(texts).encode()
        assert len(known.ids) == len(known.decoded) == len(known.count) <= keep + 200
