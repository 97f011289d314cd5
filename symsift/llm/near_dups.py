"""Near-duplicate classes by DartMinHash and banding (operator 10).

*Signatures.*  Each distinct shingle of ``words`` words (or with ``weighted``
each unit of its count) is a region of unit weight; hashed darts fall on it as
a Poisson process along the rank axis, each with a coordinate.  Only darts
below a rank that a text's total weight sets are thrown, so the work follows
the number of darts kept, not shingles times coordinates; the earliest dart of
each coordinate is the signature, whose agreement is the (weighted) Jaccard
similarity.

*Candidates.*  ``rows`` coordinates make a band; texts that share a band are
linked to one member of its bucket, never to all.  After each round of exact
checks and connected components only buckets whose members are still in
different classes go on, with other members to link to.  What is left after
``rounds`` rounds are texts that share a bucket across classes, most of them
less alike than ``threshold``.  They are joined exactly by prefix filtering: in
any one order of all shingles, two sets that are similar enough share a shingle
among the first ``n - ceil(threshold * n) + 1`` of each, and the places of the
first one they share bound their overlap.  The order here is by a count-min
sketch of the texts (of fixed size, whatever the corpus), rarest first, so that
boilerplate, however common, stands last and brings no candidates; a wrong
estimate costs time, never a link.  Rows of the prefixes are narrow (no text),
a shingle that very many texts share is cut into blocks, and only pairs that
pass the bounds are checked.  So a group of n copies costs about n checks, a
family that shares half of its words next to none, and no link inside a bucket
is lost.

*Checks* compare the shingle sets themselves: ``threshold`` or more is a link.
A class is a connected component of links.  With 24 bands of 4 a pair at 0.8
shares no band with probability 3e-6.

Equal texts are one entry.  Words are what blanks separate, in lower case; a
text of fewer than ``words`` words has one shingle of all of them, and texts
without a word (null ones too) are alike only if equal, null and '' being
equal.  Repeated rows each get a row; ids may be null.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MASK64, U64, mix, ranges, released, save, sequence_hash, tidy
from .pieces import SPACE, char_classes, char_codes, chunks

WORDS, THRESHOLD, BANDS, ROWS, ROUNDS = 5, 0.8, 24, 4, 1
BLOCK = 4096
CELLS = 1 << 17  # of each of the sketch's two tables
TEXTS, PAIRS = 1000, 50_000  # signed, and sent on, at once
_STEP = U64(0x9E3779B97F4A7C15)


def shingles(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of all shingles, repeats included, in order of text."""
    joined = "\0".join(t.lower() for t in texts) + "\0"
    chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t.lower()) for t in texts], np.int64)
    ends = np.cumsum(sizes + 1) - 1
    blank = char_classes()[chars] == SPACE
    blank[ends] = True
    edge = np.diff(np.concatenate([[1], blank.astype(np.int8)]))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    end = end[: len(start)]
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, U64)
    word = sequence_hash(char_codes()[chars], start, end - start)
    owner = np.searchsorted(ends, start)
    count = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(count) - count
    number = np.maximum(count - words + 1, np.minimum(count, 1))
    text = np.repeat(np.arange(len(texts)), number)
    at = first[text] + ranges(number)
    size = np.minimum(words, count[text])
    return text, sequence_hash(word, at, size)


def elements(texts: list[str], words: int, weighted: bool) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, or with ``weighted`` one element per unit of their counts."""
    text, sh = shingles(texts, words)
    order = np.lexsort((sh, text))
    text, sh = text[order], sh[order]
    new = np.ones(len(sh), bool)
    new[1:] = (sh[1:] != sh[:-1]) | (text[1:] != text[:-1])
    if not weighted:
        return text[new], sh[new]
    begin = np.maximum.accumulate(np.where(new, np.arange(len(sh)), 0))
    return text, mix(sh + (np.arange(len(sh)) - begin).astype(U64) * _STEP)


def dart_minhash(text: np.ndarray, element: np.ndarray, n_texts: int, k: int) -> np.ndarray:
    """(texts, k) signatures of texts with at least one element."""
    weight = np.bincount(text, minlength=n_texts)
    out = np.zeros((n_texts, k), U64)
    todo = np.flatnonzero(weight)
    extra = 2.0
    while len(todo):
        reach = np.zeros(n_texts)
        reach[todo] = (math.log(k) + extra) / weight[todo]  # about log k + extra darts for each coordinate
        live = np.flatnonzero(reach[text] > 0)
        seed, owner = element[live], text[live]
        rank = np.zeros(len(live))
        ranks, owners, darts = [], [], []
        j = 1
        while len(seed):  # the next dart of each element, while it falls in reach
            h = mix(seed + U64(j * int(_STEP) & MASK64))
            u = ((h >> U64(11)).astype(np.float64) + 0.5) / float(1 << 53)
            rank = rank - np.log(u) / k
            ok = rank < reach[owner]
            seed, owner, rank, h = seed[ok], owner[ok], rank[ok], h[ok]
            ranks.append(rank)
            owners.append(owner)
            darts.append(mix(h ^ U64(0x5851F42D4C957F2D)))
            j += 1
        rank, owner, dart = np.concatenate(ranks), np.concatenate(owners), np.concatenate(darts)
        cell = owner * k + (dart % U64(k)).astype(np.int64)
        order = np.lexsort((dart, rank, cell))
        cell, dart = cell[order], dart[order]
        first = np.ones(len(cell), bool)
        first[1:] = cell[1:] != cell[:-1]
        out.ravel()[cell[first]] = dart[first]
        filled = np.bincount(cell[first] // k, minlength=n_texts)
        todo = todo[filled[todo] < k]
        extra *= 2
    return out


def distinct_of(batch: pa.RecordBatch) -> tuple[list[bytes], list[str]]:
    seen: dict[bytes, str] = {}
    for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        seen.setdefault(key, text)
    return list(seen), list(seen.values())


def band_rows(batches: Iterator[pa.RecordBatch], words: int, weighted: bool, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    """(tid, text) -> (tid, bands); texts without a word have none."""
    for batch in batches:
        keys, texts = distinct_of(batch)
        for at, part in chunks(texts, most=TEXTS):  # a text has about as many darts however short it is
            text, element = elements(part, words, weighted)
            sig = dart_minhash(text, element, len(part), bands * rows).reshape(len(part), bands, rows)
            h = np.zeros((len(part), bands), U64)
            for r in range(rows):
                h = mix(h * _STEP + sig[:, :, r])
            h = mix(h + np.arange(bands).astype(U64) * _STEP).view(np.int64)
            some = np.flatnonzero(np.bincount(text, minlength=len(part)))
            yield pa.record_batch([pa.array([keys[at + i] for i in some], pa.binary()), pa.array(list(h[some]), pa.list_(pa.int64()))], ["tid", "bands"])


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        keys, texts = distinct_of(batch)
        for lo in range(0, len(keys), 2000):
            yield pa.record_batch([pa.array(keys[lo : lo + 2000], pa.binary()), pa.array([pack.compress(t.encode("utf-8", "surrogatepass")) for t in texts[lo : lo + 2000]], pa.binary())], ["tid", "z"])


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Jaccard similarity of two element sets."""
    same = len(np.intersect1d(a, b, assume_unique=True))
    return same / (len(a) + len(b) - same)


def check_pairs(batches: Iterator[pa.RecordBatch], words: int, weighted: bool, threshold: float) -> Iterator[pa.RecordBatch]:
    """(a, b, za, zb) -> (a, b) that are similar enough."""
    unpack = zstandard.ZstdDecompressor()

    @functools.lru_cache(maxsize=512)
    def set_of(z: bytes) -> np.ndarray:
        return elements([unpack.decompress(z).decode("utf-8", "surrogatepass")], words, weighted)[1]

    for batch in batches:
        a, b = [], []
        for x, y, zx, zy in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if similarity(set_of(zx), set_of(zy)) >= threshold:
                a.append(x)
                b.append(y)
        yield pa.record_batch([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])


def sketch_rows(batches: Iterator[pa.RecordBatch], words: int, weighted: bool) -> Iterator[pa.RecordBatch]:
    """(z) -> (cell, n): how many texts of a partition have a shingle of that cell, in two tables."""
    unpack = zstandard.ZstdDecompressor()
    total = np.zeros(2 * CELLS, np.int64)
    for batch in batches:
        texts = [unpack.decompress(z.as_py()).decode("utf-8", "surrogatepass") for z in batch.column(0)]
        for _, part in chunks(texts):
            total += np.bincount(cells(elements(part, words, weighted)[1]).ravel(), minlength=2 * CELLS)
    some = np.flatnonzero(total)
    yield pa.record_batch([pa.array(some), pa.array(total[some])], ["cell", "n"])


def cells(shingle: np.ndarray) -> np.ndarray:
    """The cells of each shingle in the two tables of the sketch."""
    return np.stack([shingle % U64(CELLS), (shingle >> U64(32)) % U64(CELLS) + U64(CELLS)]).astype(np.int64)


def prefix_rows(batches: Iterator[pa.RecordBatch], counts: np.ndarray, words: int, weighted: bool, threshold: float) -> Iterator[pa.RecordBatch]:
    """(tid, label, z) -> (s, tid, label, place, size) for the shingles that stand first."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        texts = [unpack.decompress(z.as_py()).decode("utf-8", "surrogatepass") for z in batch.column(2)]
        for at, part in chunks(texts):
            text, shingle = elements(part, words, weighted)
            common = counts[cells(shingle)].min(axis=0)
            order = np.lexsort((shingle, common, text))
            text, shingle = text[order], shingle[order]
            size = np.bincount(text, minlength=len(part))
            place = np.arange(len(text)) - (np.cumsum(size) - size)[text]
            first = place <= (size - np.ceil(threshold * size - 1e-6))[text]
            text, shingle, place = text[first], shingle[first], place[first]
            row = pa.array(at + text)
            columns = [pa.array(shingle.view(np.int64)), batch.column(0).take(row), batch.column(1).take(row), pa.array(place.astype(np.int32)), pa.array(size[text].astype(np.int32))]
            yield pa.record_batch(columns, ["s", "tid", "label", "place", "size"])


def candidate_pairs(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows (s, i, j, own, tid, label, place, size), those of one (s, i, j) together -> pairs (a, b) that may be similar enough."""

    def pairs(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        rows.sort(key=lambda r: r[7])
        _, label = np.unique([r[5] for r in rows], return_inverse=True)
        own, place, size = (np.array([r[k] for r in rows], np.int64) for k in (3, 6, 7))
        apart = rows[0][1] != rows[0][2]
        to = np.searchsorted(size, size / threshold + 1e-6, side="right")
        a, b = [], []
        for x in range(len(rows)):
            y = np.arange(x + 1, to[x])
            most = np.minimum(size[x] - place[x], size[y] - place[y])  # if this shingle is the first they share
            ok = (most >= threshold / (1 + threshold) * (size[x] + size[y]) - 1e-6) & (label[y] != label[x])
            if apart:
                ok &= own[y] != own[x]
            for k in y[ok].tolist():
                p, q = sorted((rows[x][4], rows[k][4]))
                a.append(p)
                b.append(q)
            if len(a) >= PAIRS or x == len(rows) - 1:
                yield pa.record_batch([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])
                a, b = [], []

    rows: list[tuple] = []
    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and rows[-1][:3] != r[:3]:
                yield from pairs(rows)
                rows = []
            rows.append(r)
    if rows:
        yield from pairs(rows)


def prefix_pairs(open_: DataFrame, words: int, weighted: bool, threshold: float) -> DataFrame:
    """(a, b): all pairs among texts (tid, label, z) of different labels that prefix filtering leaves."""
    counts = np.zeros(2 * CELLS, np.int64)
    sums = open_.select("z").mapInArrow(lambda b: released(sketch_rows(b, words, weighted)), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    got = sums.toArrow()  # 2 * CELLS rows at most
    counts[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    rows = open_.select("tid", "label", "z").mapInArrow(lambda b: released(prefix_rows(b, counts, words, weighted, threshold)), "s long, tid binary, label binary, place int, size int")
    rows = save(rows, "prefixes")
    mixed = rows.groupBy("s").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("low != high")
    cut = rows.join(mixed.select("s", "blocks"), "s").withColumn("own", F.pmod(F.xxhash64("tid"), F.col("blocks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = cut.select("s", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "tid", "label", "place", "size")
    cut = cut.repartition("s", "i", "j").sortWithinPartitions("s", "i", "j")
    return cut.mapInArrow(lambda b: released(candidate_pairs(b, threshold)), "a binary, b binary").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(tid, label) for every end of an edge (a, b): label is the least tid of the component."""
    both = save(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = save(both.groupBy(F.col("a").alias("tid")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["tid"]).groupBy("a").agg(F.min("label").alias("other"))
        step = labels.join(near, labels["tid"] == near["a"]).select("tid", "label", F.least("label", "other").alias("next"))
        up = labels.select(F.col("tid").alias("next"), F.col("label").alias("jump"))
        step = save(step.join(up, "next").select("tid", "label", "jump"), "labels")
        changed = step.where("jump != label").limit(1).count()
        labels = step.select("tid", F.col("jump").alias("label"))
        if not changed:
            return labels


def classes(docs: DataFrame, text: str = "text", id_col: str = "doc_id", words: int = WORDS, threshold: float = THRESHOLD, weighted: bool = False, bands: int = BANDS, rows: int = ROWS, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """((tid, label) of the texts that have a link, (a, b) the links found); tid is ``text_id`` of a text."""
    with tidy(docs.sparkSession) as keep:
        labels, links = _linked(docs, text, words, threshold, weighted, bands, rows, rounds)
        return keep(labels, "labels"), keep(links, "links")


def _linked(docs: DataFrame, text: str, words: int, threshold: float, weighted: bool, bands: int, rows: int, rounds: int) -> tuple[DataFrame, DataFrame]:
    """What ``classes`` gives, read from tables among those on the way."""
    src = docs.select(text_id(text).alias("tid"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    signed = src.mapInArrow(lambda b: released(band_rows(b, words, weighted, bands, rows)), "tid binary, bands array<long>").dropDuplicates(["tid"])
    with tidy(docs.sparkSession) as keep:
        members = save(signed.select("tid", F.explode("bands").alias("h")), "bands")
        shared = members.groupBy("h").agg(F.count("*").alias("n"), F.min("tid").alias("rep")).where("n > 1")
        members = keep(members.join(shared, "h").select("h", "tid", "rep"), "buckets")
    wanted = members.select("tid").distinct()
    texts = save(src.mapInArrow(packed, "tid binary, z binary").join(wanted, "tid", "left_semi").dropDuplicates(["tid"]), "texts")

    def checked(pairs: DataFrame) -> DataFrame:
        za, zb = texts.toDF("a", "za"), texts.toDF("b", "zb")
        both = pairs.join(za, "a").join(zb, "b").select("a", "b", "za", "zb")
        return both.mapInArrow(lambda x: released(check_pairs(x, words, weighted, threshold)), "a binary, b binary")

    tried = save(members.where("tid != rep").select(F.col("tid").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
    links = save(checked(tried), "links")
    for number in range(rounds + 1):
        labels = components(links)
        held = members.join(labels, "tid", "left").select("h", "tid", F.coalesce("label", "tid").alias("label"))
        mixed = held.groupBy("h").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high")
        open_ = save(held.join(mixed.select("h"), "h"), "open")
        if open_.limit(1).count() == 0:
            return labels, links
        if number < rounds:  # another member of each bucket, by a hash
            salt = F.struct(F.xxhash64("tid", "h", F.lit(number)).alias("o"), "tid", "label")
            reps = open_.groupBy("h").agg(F.min(salt).alias("r"))
            new = open_.join(reps, "h").where(F.col("label") != F.col("r.label")).select(F.col("tid").alias("a"), F.col("r.tid").alias("b"))
            new = new.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
            done = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            new = save(new.join(done, ["a", "b"], "left_anti"), "pairs")
            found = save(checked(new), "links")
            tried = save(tried.union(new), "pairs")
        else:  # all that is left across classes
            left = texts.join(open_.select("tid", "label").distinct(), "tid").select("tid", "label", "z")
            done = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            with tidy(docs.sparkSession) as keep:
                new = keep(prefix_pairs(save(left, "left"), words, weighted, threshold).join(done, ["a", "b"], "left_anti"), "pairs")
            found = save(checked(new), "links")
            if found.limit(1).count() == 0:
                return labels, links
        links = save(links.union(found), "links")
    return components(links), links


def text_id(text: str):
    """A text's 128-bit content key; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit(""))))


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", **how) -> DataFrame:
    """id_col, class_id, class_size (rows), n_texts (different texts) and class_key for every row of docs.

    class_key names the class (content key of one of its texts) and is unique;
    class_id is the least id among its rows, so it names the class only where
    ids are unique and not null.
    """
    labels, _ = classes(docs, text, id_col, **how)
    rows = docs.select(F.col(id_col).alias("id"), text_id(text).alias("tid")).join(labels, "tid", "left").select("id", "tid", F.coalesce("label", "tid").alias("label"))
    rows = save(rows, "rows")
    by_text = rows.groupBy("label", "tid").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    sums = save(by_text.groupBy("label").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_size"), F.count("*").alias("n_texts")), "classes")
    return rows.join(sums, "label").select(F.col("id").alias(id_col), "class_id", "class_size", "n_texts", F.lower(F.hex("label")).alias("class_key"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
