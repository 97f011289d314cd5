"""Operators 1, 2, 3, 5, 6, 7, 10 and the pipeline against brute force, with odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from symsift.llm import chat, language, media, near_dups, neighbours, repeats, secrets

SCHEMA = "doc_id long, text string, k1 string, tid string, label string, anchor string"


def table(spark, texts):
    return spark.createDataFrame([(i if i % 9 else None, t, "x", "y", "z", "w") for i, t in enumerate(texts)], SCHEMA)


def words(rng, n, some=300):
    return " ".join(f"w{rng.randrange(some)}" for _ in range(n))


# 1
def brute_secrets(text):
    text = text or ""
    a = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found = [(m.start(), 0, m.end()) for m in a.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found)


def test_secrets(spark):
    hexa = "0123456789abcdef" * 2
    texts = [None, "", "é😀 token=" + "a" * 12, "Secret: 'abcdefghijkl' x", "token=secret:abcdefghijklmnop", "token=secret=abcdefghijklmnop", "AKIA" + "B" * 14, "AKIA" + "B" * 13, hexa + " " + hexa,
             "api_key = " + hexa, "API_KEY=" + hexa, "passſword=" + hexa, hexa, hexa, "no", "x" * 5000 + " passwd:  " + "q" * 40]
    found, ledger = secrets.scan(table(spark, texts))
    got = Counter((r.doc_id, tuple((s.start, s.rule, s.stop) for s in r.spans)) for r in found.collect())
    assert got == Counter((i if i % 9 else None, tuple(brute_secrets(t))) for i, t in enumerate(texts))
    again, new = secrets.scan(table(spark, [*texts, "token=" + "z" * 20]), ledger)
    assert new.count() == 1 and again.where(F.size("spans") > 0).count() == sum(map(bool, map(brute_secrets, texts))) + 1
    other = (*secrets.RULES, secrets.Rule("pem", "-----BEGIN [A-Z ]+-----"))
    assert secrets.scan(table(spark, texts), ledger, other)[1].count() == len({t or "" for t in texts})
    assert secrets.scan(table(spark, texts).limit(0))[0].count() == 0


def test_secrets_in_very_long_texts(spark):
    """Tens of thousands of matches in a text of over a million characters; overlapping spans are replaced once."""
    rng = random.Random(4)
    hexa = lambda: f"{rng.getrandbits(80):020x}"
    texts = [" ".join(hexa() for _ in range(60_000)), "token=" + hexa() + " x " + "AKIA" + "B" * 30 + "é" * 100 + hexa(), "api_key='" + "a1" * 20 + "' y", "é" * (1 << 20)]
    df = table(spark, texts)
    found, _ = secrets.scan(df)
    assert Counter((r.doc_id, tuple((s.start, s.rule, s.stop) for s in r.spans)) for r in found.collect()) == Counter((i or None, tuple(brute_secrets(t))) for i, t in enumerate(texts))
    marked = df.select("doc_id", secrets.redacted(F.col("text"), secrets.all_spans(F.col("text"), secrets.RULES)).alias("t")).collect()
    for i, t in enumerate(texts):
        out, at = "", 0
        for a, _, b in brute_secrets(t):
            if a >= at:
                out += t[at:a] + "[SECRET]"
            at = max(at, b)
        assert {r.doc_id: r.t for r in marked}[i or None] == out + t[at:]


# 2
def brute_repeats(texts, width):
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + width] for d in data for i in range(len(d) - width + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - width + 1):
            if count[d[i : i + width]] > 1:
                gone[i : i + width] = True
        edge = np.diff(np.concatenate([[0], gone.astype(int)]))
        out.append((len(d), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(bytes(np.frombuffer(d, np.uint8)[~gone])).hexdigest()))
    return out


@pytest.mark.parametrize("seed", range(40))
def test_two_stage_sorts(seed):
    rng = np.random.default_rng(seed)
    buf = rng.integers(97, 97 + rng.integers(1, 4), rng.integers(1, 300)).astype(np.uint8)
    data = buf.tobytes()
    assert repeats.two_stage(buf, 320).tolist() == sorted(range(len(data)), key=lambda i: data[i:])


@pytest.mark.parametrize("block", [2, 2048])
def test_repeats(spark, block):
    rng = random.Random(3)
    shared = words(rng, 60)
    texts = [None, "", "short", "short", "a" * 900, "ab" * 300, shared, shared, *(words(rng, rng.randrange(150)) + shared[rng.randrange(40) :] + "é" + words(rng, 30) for _ in range(12)), "ü" * 250 + shared[:199], words(rng, 400)]
    got = repeats.remove_repeats(table(spark, texts), block_contexts=block).selectExpr("doc_id", "n_bytes", "n_removed", "n_spans", "sha2(kept, 256)").collect()
    assert Counter(map(tuple, got)) == Counter((i if i % 9 else None, *b) for i, b in enumerate(brute_repeats(texts, 200)))
    assert repeats.remove_repeats(table(spark, texts).limit(0)).count() == 0


@pytest.mark.parametrize(("copies", "block"), [(300, 16), (2400, 300)])
def test_repeats_of_a_common_passage(spark, copies, block):
    """Groups far above a block: their edges differ in every text, on one side or on both."""
    rng = random.Random(5)
    passage = words(rng, 45, 10_000)
    assert len(passage) > 220
    texts = [words(rng, rng.randrange(3, 30), 10**6) + passage[rng.choice((0, 0, 7)) : rng.choice((None, None, -9))] + words(rng, rng.randrange(3, 30), 10**6) for _ in range(copies)]
    got = repeats.remove_repeats(table(spark, texts), block_contexts=block).selectExpr("doc_id", "n_bytes", "n_removed", "n_spans", "sha2(kept, 256)").collect()
    assert Counter(map(tuple, got)) == Counter((i if i % 9 else None, *b) for i, b in enumerate(brute_repeats(texts, 200)))


def test_repeats_in_very_long_texts(spark):
    """Passages across the place where a long text is cut, and inside one text."""
    rng = random.Random(6)
    long = words(rng, 190_000, 10**6)
    assert len(long) > 1 << 20
    edge = 1 << 20
    texts = [long, "x " + long[edge - 400 : edge + 300], long[5000:5300] + words(rng, 50) + long[edge - 100 : edge + 250] + "é", words(rng, 100)]
    got = repeats.remove_repeats(table(spark, texts)).selectExpr("doc_id", "n_bytes", "n_removed", "n_spans", "sha2(kept, 256)").collect()
    assert Counter(map(tuple, got)) == Counter((i if i % 9 else None, *b) for i, b in enumerate(brute_repeats(texts, 200)))


# 3
@pytest.mark.parametrize("leaf_rows", [512, 30])
def test_neighbours(spark, leaf_rows):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 12))
    x[100:140] = x[100]  # equal vectors
    rows = [(i, [float(v) for v in x[i]], 1, 2) for i in range(600)]
    rows += [(150, [float(v) for v in x[150]], 1, 2)] * 2  # repeated rows
    rows += [(1000, None, 1, 2), (1050, [0.0] * 12, 1, 2), (1100, [float("nan")] * 12, 1, 2), (1150, [None] + [1.0] * 11, 1, 2), (None, [1.0] * 12, 1, 2), (1200, [1.0] * 3, 1, 2), (1250, [float("inf")] * 12, 1, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, h1 int, ids int")
    got = defaultdict(list)
    for r in sorted(neighbours.nearest(df, F.col("vec_id") % 50 == 0, leaf_rows=leaf_rows).collect()):
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 600, 50))
    hits = 0
    for q, found in got.items():
        score = neighbours.cosines(np.repeat(x[q][None], 600, 0), x)
        order = [i for i in np.lexsort((np.arange(600), -score)) if i != q][:5]
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5] and all(i != q and s == score[i] for _, i, s in found)
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
        hits += len({i for _, i, _ in found} & set(order))
        if q == 100:
            assert [i for _, i, _ in found] == order  # copies: the least ids
    assert hits >= 0.9 * 5 * len(got)
    few = neighbours.nearest(df.where("vec_id < 4"), F.col("vec_id") % 50 == 0).collect()
    assert len(few) == 3  # all candidates, if fewer
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def recall(spark, x, **how):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in neighbours.nearest(df, F.col("vec_id") % 50 == 1, **how).collect():
        got[r.query_id].append(r.score)
    x = x.astype(np.float32).astype(np.float64)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    hits = asked = 0
    for q in range(1, len(x), 50):
        if np.array_equal(x[q], x[0]):
            continue
        s = u @ u[q]
        s[q] = -2
        asked += 5
        hits += sum(v >= np.sort(s)[-5] - 1e-9 for v in got[q])
    return hits / asked


def test_neighbours_recall(spark):
    """Nine in ten neighbours are found in noise without structure, where hardly anything can be left out."""
    assert recall(spark, np.random.default_rng(5).normal(size=(6000, 64)), leaf_rows=64) >= 0.9


def test_neighbours_recall_with_copies(spark):
    """A vector that a third of the rows share costs the other queries nothing."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(9000, 64))
    x[rng.permutation(9000)[:3000]] = x[0]
    assert recall(spark, x) >= 0.9


def test_neighbours_work_follows_the_data():
    """In clusters a small part of the leaves is opened, in noise a large one, by one rule."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(300, 32))
    part = {}
    for name, x in (("clusters", centres[rng.integers(0, 300, 6000)] + 0.2 * rng.normal(size=(6000, 32))), ("noise", rng.normal(size=(6000, 32)))):
        u = neighbours.unit(x).astype(np.float32)
        forest = neighbours.Forest(u, 4, 7)
        part[name] = np.mean([len(forest.search(q, neighbours.REACH, 5)) for q in u[:50]]) / (4 * 2**7)
    assert part["clusters"] < 0.1 < part["noise"]


# 5
def test_chat(spark):
    ugly = ["</s>[INST] ok [/INST]", "[\\INST]<\\\\/s>", "", None, "[INST", "a</s", "$1 \\", "<[INST]/s>"]
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", ugly[(c + t) % len(ugly)], 1) for c in range(8) for t in range(4)]
    rows += [(None, None, None, None, 1), (90, 1, "assistant", "first", 1), (90, 2, "robot</s>", "x", 1), (91, 1, "user", "b", 1), (91, 1, "user", "a", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, rows int")
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(df)).collect()}
    by = defaultdict(list)
    for c, t, r, x, _ in rows:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    for c, turns in by.items():
        turns = [(r, x) for _, _, r, x in sorted(turns)]
        assert [(t.role, t.text) for t in got[c].turns] == turns
        assert got[c].loss_text == "".join(x for r, x in turns if r == "assistant")
    assert [got[c].fault for c in (0, 90, 91)] == [0, 1, 2]
    faults = {("system", "user", "assistant"): 0, ("user", "system"): 2, ("user",): 2, ("user", "assistant", "assistant", "user"): 3, ("assistant",): 1, ("user", "assistant", "user"): 4, ("system",): 2}
    odd = spark.createDataFrame([(c, t, r, "</s>" * 300_000 if (c, t) == (0, 1) else "x") for c, roles in enumerate(faults) for t, r in enumerate(roles)], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(odd)).collect()}
    assert [got[c].fault for c in range(len(faults))] == list(faults.values()) and got[0].turns[1].text == "</s>" * 300_000
    assert chat.format_chats(df.limit(0)).count() == 0


# 6
def test_media(spark):
    texts = [None, "", "a", "same", "same", "é" * 500, " ".join(map(str, range(2000))), "b" * 192]
    got = media.to_media(table(spark, texts)).collect()
    for r, t in zip(sorted(got, key=lambda r: r.doc_id or 0), texts, strict=True):
        data = (t or "").encode()
        padded = data + b" " * (-len(data) % 192 or (0 if data else 192))
        assert (r.n_bytes, bytes(r.payload), media.from_wav(bytes(r.media))) == (len(data), padded, padded)
        assert len(r.fp_time) == len(r.fp_code) and list(r.fp_time) == sorted(r.fp_time)
    assert len({(bytes(r.media), tuple(r.fp_code)) for r in got if r.n_bytes == 4}) == 1
    assert media.to_media(table(spark, texts).limit(0)).count() == 0


# 7
def test_language_learns_different_texts(spark):
    """Copies take no places of the sample; long texts are cut, not left out."""
    few = [f"text {chr(97 + i)} of few" for i in range(20)]
    rows = [("many copies", "aa")] * 5000 + [(t, "aa") for t in few] + [("1" * 7000 + "lang " * 2000, "bb")] * 2 + [("kurz " * 2000, "cc"), ("klein", "cc")]
    model = language.learn(spark.createDataFrame(rows, "text string, lang string"))
    assert set(model) == {"aa", "bb", "cc"}
    assert sorted(model["aa"].decode().split("\n")[:-1]) == sorted([*few, "many copies"])
    assert model["bb"] == ("lang " * 1200).encode() + b"\n"
    assert len(model["cc"]) == 6000 + 1 + len("klein") + 1


def test_language_loses_no_label(spark):
    """Copies, however many, and long texts cost no label its place; nor do many labels."""
    many = spark.range(200_000).select(F.concat(F.lit("guten tag wie geht es "), F.pmod("id", F.lit(5)).cast("string")).alias("text"), F.lit("de").alias("lang"))
    few = spark.range(400).select(F.concat(F.lit("good day how are you "), F.col("id").cast("string")), F.lit("en"))
    long = spark.createDataFrame([("la vie est belle " * 1000 + str(i), "fr") for i in range(3)], "text string, lang string")
    model = language.learn(many.union(few).union(long))
    assert set(model) == {"de", "en", "fr"} and model["de"].count(b"\n") == 5
    labels = spark.range(700).select(F.concat(F.lit("some words of "), "id").alias("text"), F.concat(F.lit("l"), "id").alias("lang"))
    got = language.learn(labels, model_bytes=700 * 20)
    assert len(got) == 700 and max(map(len, got.values())) <= 20


def test_language_query(spark, tmp_path):
    """Clashing columns, repeated rows, a very long text; the query tells what it rejects."""
    texts = [("the quick brown fox and the dog " * 10, "en"), ("der schnelle braune fuchs und der hund " * 10, "de")] * 40 + [(None, "en"), ("12", None), ("the dog and the fox " * 60_000, None), ("the dog", None)]
    df = spark.createDataFrame([(i, t, la, "x", 0, "y", "z", 1.0) for i, (t, la) in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long, k0 string, _ok string, score double")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in language.query(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts) and all(got[i].lang_pred == texts[i][1] for i in range(80))
    assert [(got[i].lang_pred, got[i].rejected) for i in (80, 81, 82)] == [("und", True), ("und", True), ("en", False)]
    assert len({(got[i].lang_pred, got[i].score) for i in range(0, 80, 2)}) == 1


def test_language_rejects_noise(spark, sf_dir):
    """Random letters and digits go, short ones on ties; held-out documents stay."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language.learn(language.train_rows(docs))
    rng = random.Random(11)
    noise = ["".join(rng.choice(a) for _ in range(n)) for a in ("abcdefghijklmnopqrstuvwxyz", "0123456789abcdef") for n in (60, 1500) for _ in range(50)]
    gone = [r.rejected for r in language.identify(table(spark, noise), model, {"doc_id": F.col("doc_id")}).collect()]
    assert sum(gone) >= 0.95 * len(gone)
    held = language.identify(docs.where(language.held_out(F.col("doc_id")) & (F.length("text") >= 256)), model, {"doc_id": F.col("doc_id")}).collect()
    assert sum(r.rejected for r in held) <= 0.02 * len(held)


def test_language(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language.learn(language.train_rows(docs))
    out = language.identify(docs, model, {"lang": F.col("lang"), "held": language.held_out(F.col("doc_id")), "doc_id": F.col("doc_id")}).collect()
    held = [r for r in out if r.held]
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) >= 0.95 and all(0 <= r.score <= 1 for r in out)
    odd = language.identify(table(spark, [None, "", "123 !", "the and of"]), model, {"doc_id": F.col("doc_id")}).collect()
    assert [r.lang_pred == "und" and r.score == 0 and r.rejected for r in odd] == [True, True, True, False]
    assert language.learn(docs.limit(0)) == {}
    assert {r.lang_pred for r in language.identify(docs, {}, {"doc_id": F.col("doc_id")}).collect()} == {"und"}


# 10
def brute_classes(texts):
    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1 if w else 0))}

    sets, n = [shingles(t) for t in texts], len(texts)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if (texts[i] or "") == (texts[j] or "") or union and len(sets[i] & sets[j]) / union >= 0.8:
                root[find(i)] = find(j)
    return Counter(frozenset(x for x in range(n) if find(x) == find(i)) for i in range(n))


@pytest.mark.parametrize("block", [4096, 7])
def test_near_duplicates(spark, block, monkeypatch):
    monkeypatch.setattr(near_dups, "BLOCK", block)
    rng = random.Random(8)
    base = words(rng, 90, 5000).split()
    passage = words(rng, 40, 5000)
    texts = [None, "", " ", "one two", "One  two", "one two three", words(rng, 200), words(rng, 200)]
    for _ in range(40):  # a chain of edits: neighbours are alike, far ones aren't
        base = base[:]
        base[rng.randrange(len(base))] = f"n{rng.random()}"
        texts += [" ".join(base)] * rng.choice((1, 1, 3))
    texts += [passage + " " + words(rng, 12, 5000) for _ in range(25)]
    long = words(rng, 150_000, 90_000)  # over a million characters
    texts += [long, long + " more", words(rng, 150_000, 90_000)]
    ids = [None if i % 11 == 3 else i // 2 if i % 5 else 7 for i in range(len(texts))]  # null and repeated ids
    df = spark.createDataFrame([(d, t, "x", "y", str(i), "w") for i, (d, t) in enumerate(zip(ids, texts, strict=True))], SCHEMA)
    by = defaultdict(list)
    got = near_dups.near_duplicates(df).collect()
    for r in got:
        by[r.class_key].append(r)
    want = Counter()
    for c in set(brute_classes(texts)):
        mine = [ids[i] for i in c]
        want[tuple(sorted(mine, key=str)), min((x for x in mine if x is not None), default=None), len(mine), len({texts[i] or "" for i in c})] += 1
    assert Counter((tuple(sorted((r.doc_id for r in v), key=str)), v[0].class_id, v[0].class_size, v[0].n_texts) for v in by.values()) == want
    assert near_dups.near_duplicates(df.limit(0)).count() == 0


def test_near_duplicates_keys_are_unique(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "g h i j k l"), (2, "g h i j k l"), (None, "m"), (None, "n")], "doc_id long, text string")
    assert len({r.class_key for r in near_dups.near_duplicates(df).collect()}) == 4


@pytest.mark.parametrize("block", [4096, 16])
def test_prefix_filter_spares_families(spark, block, monkeypatch):
    """A family that shares half of its words brings few candidates, and none of the links is lost."""
    monkeypatch.setattr(near_dups, "BLOCK", block)
    rng = random.Random(9)
    half = words(rng, 110, 5000)
    texts = [half + " " + words(rng, 50, 9000) for _ in range(400)]
    twin = [t.rsplit(" ", 2)[0] + f" x{i} y{i}" for i, t in enumerate(texts[:20])]
    pack = near_dups.zstandard.ZstdCompressor()
    rows = [(i.to_bytes(16, "big"), i.to_bytes(16, "big"), pack.compress(t.encode())) for i, t in enumerate(texts + twin)]
    open_ = spark.createDataFrame(rows, "tid binary, label binary, z binary")
    got = {tuple(int.from_bytes(x) for x in r) for r in near_dups.prefix_pairs(open_, 5, False, 0.8).collect()}
    assert {(i, 400 + i) for i in range(20)} <= got
    assert len(got) <= 200  # of 87,990 pairs


def test_words_do_not_collide():
    """Words on which polynomial hashes modulo 2**64 agree."""
    bits = [0]
    while len(bits) < 2048:
        bits += [1 - b for b in bits]
    for n in (1024, 2048):
        a, b = ("".join(s[x] for x in bits[:n]) for s in ("ab", "ba"))
        _, h = near_dups.shingles([a, b], 5)
        assert h[0] != h[1]


def test_dart_agreement_is_jaccard():
    rng = np.random.default_rng(2)
    pool_ = rng.integers(1, 1 << 62, 900).astype(np.uint64)
    a, b = pool_[:600], pool_[100:700]
    text = np.repeat([0, 1], [600, 600])
    sig = near_dups.dart_minhash(text, np.concatenate([a, b]), 2, 4000)
    assert abs((sig[0] == sig[1]).mean() - 500 / 700) < 0.04


# pipeline
def test_pipeline(spark, sf_dir, tmp_path):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = docs.limit(3).union(spark.sql("SELECT CAST(NULL AS BIGINT), CAST(NULL AS STRING), 'en', 's', CAST(0 AS BIGINT)").toDF(*docs.columns)).withColumn("label", F.lit(1))
    df = docs.withColumn("label", F.lit(0)).unionByName(extra)
    columns = df.columns
    for name, stage in C.STAGES:
        out = stage(spark, df, sf_dir)
        assert name == C.STAGES[-1][0] or out.columns == columns
        out.write.parquet(str(tmp_path / name))
        before, df = df, spark.read.parquet(str(tmp_path / name))
        if name == "minhash_dedup":
            texts = [r.text for r in df.collect()]
            assert len(set(texts)) == len(texts) < before.count()
        if name == "suffix_array_dedup":
            want = Counter(b[3] for b in brute_repeats([r.text for r in before.collect()], 200))
            got = Counter(hashlib.sha256((r.text or "").encode()).hexdigest() for r in df.collect())
            assert sum((want & got).values()) >= 0.95 * sum(want.values())  # a cut may leave part of a character, which goes
        if name == "secret_scan":
            assert not any(brute_secrets(r.text) for r in df.collect())
    for name, stage in C.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_pipeline_run(spark, sf_dir):
    """The registered query gives what the stages give, and leaves no table but its result."""
    import corpus_pipeline as C

    got = C.run(spark, sf_dir)
    assert {"doc_id", "piece", "start", "length", "sequence_id", "offset"} <= set(got.columns)
    per = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.min("offset").alias("first"), F.max(F.col("offset") + F.col("length")).alias("last"))
    assert per.where("n > 2048 OR first <> 0 OR last <> n").count() == 0 and per.count() > 10


def test_pipeline_ties(spark):
    """Rows of one id that differ elsewhere: the same one stays however they are dealt."""
    import corpus_pipeline as C

    text = "one two three four five six seven"
    rows = [(5, text, "en", "b", 1), (5, text, "en", "a", 1), (5, text, None, "c", 1), (None, text, "en", "a", 1), (7, None, "en", "a", None), (8, "", "en", "a", 0), (9, "x", None, None, None), (9, "x", None, None, None)]
    kept = []
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
        kept.append(sorted(C.minhash_dedup(spark, df, "").collect(), key=str))
    assert kept[0] == kept[1] and sorted(tuple(r)[:4] for r in kept[0]) == [(5, text, "en", "a"), (7, None, "en", "a"), (9, "x", None, None)]


def test_stages_leave_little_on_disk(spark, sf_dir):
    """Before its result is written a stage has only those tables left that the result is read from."""
    import corpus_pipeline as C
    from symsift.llm import common

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for stage, names in ((C.minhash_dedup, ["labels", "links"]), (C.suffix_array_dedup, ["spans"])):
        at = len(common._saved)
        with common.tidy(spark):
            assert stage(spark, docs, sf_dir).count()
            assert [path.rpartition("/")[2] for path in common._saved[at:]] == names
        assert len(common._saved) == at


def test_stages_work_in_bounded_memory():
    """Very many short texts, one large group of candidates, and many texts of a batch."""
    import tracemalloc

    import pyarrow as pa

    n = 8000
    short = pa.record_batch([pa.array([i.to_bytes(16, "big") for i in range(n)]), pa.array([f"w{i}" for i in range(n)])], ["tid", "text"])
    texts = pa.record_batch([pa.array(range(400)), pa.array(range(400)), pa.array([words(random.Random(i), 1000) for i in range(400)])], ["k1", "k2", "text"])
    most = []
    for rows in (near_dups.band_rows(iter([short]), 5, False, 24, 4), repeats.emit_runs(iter([texts]), 200, 64)):
        tracemalloc.start()
        for _ in rows:
            pass
        most.append(tracemalloc.get_traced_memory()[1] >> 20)
        tracemalloc.stop()
    assert most[0] < 100 and most[1] < 64, most
    group = [(1, 0, 0, 0, i.to_bytes(16, "big"), i.to_bytes(16, "big"), 0, 10) for i in range(500)]
    sizes = [b.num_rows for b in near_dups.candidate_pairs(iter([pa.record_batch([pa.array(c) for c in zip(*group, strict=True)], list("sijotlpn"))]), 0.8)]
    assert sum(sizes) == 500 * 499 // 2 and max(sizes) <= near_dups.PAIRS + 500


@pytest.mark.parametrize("name", ["op1_secret_scan", "op5_chat_formatting"])
def test_sql_twins(spark, sf_dir, name):
    import duckdb

    from symsift.llm import queries

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf_dir)
    res = con.execute(queries.ORACLES[name])
    names = [c[0] for c in res.description]
    want = Counter(tuple(r[names.index(c)] for c in df.columns) for r in res.fetchall())
    assert Counter(map(tuple, df.collect())) == want
