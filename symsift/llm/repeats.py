"""Suffix-array removal of repeated byte strings (operator 2).

A byte goes if a ``width``-byte string that covers it also starts anywhere else
in the corpus, in the same text included.

1. *Anchors.*  Every window of ``width`` bytes picks the leftmost smallest hash
   among its ``gram``-byte strings.  The choice depends on the window's bytes
   alone, so equal windows pick equal anchors at equal places.  Consecutive
   windows with one anchor form a run; the bytes a run covers are its context.
   One row per run (about one per 69 bytes) is all that is shuffled.
2. *Whole contexts.*  Runs are counted by (anchor, context), then contexts by
   anchor, both with partial aggregation, so a hot passage arrives as one row
   per map task.  Equal contexts are one string with its multiplicity: seen
   twice it is repeated in full; an anchor seen with one context needs no text.
3. *Suffix arrays.*  One copy of each context whose anchor has several contexts
   is fetched, and blocks of whole anchor groups are sorted by two-stage suffix
   sorting: suffixes smaller than their successor are sorted directly, the rest
   are induced by bucket scans; neighbours with a common prefix of ``width``
   bytes are repeats.  A group of more than ``block_contexts`` contexts (the edge
   of a very common passage) is split first: the range of places that the anchor
   can have in a window is halved, and windows of one half agree in the bytes
   that all of them hold beside the anchor, so contexts are grouped by those and
   clipped to the half.  Halving goes on where a group is still too large; at a
   single place equal windows are one string, so it ends, after about
   log2(width) steps, with every block sorted in the same way.
4. *Removal.*  Spans go back to their texts by content key and are cut out.

Null texts count as empty; empty and short texts lose nothing; repeated rows
are copies of each other, so a repeated text of ``width`` bytes or more loses
every byte.  Identity is the text's 128-bit content hash, so doc_id may be null
or repeated, and other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, Rolling, mix, released, save, tidy

WIDTH, GRAM, BLOCK_CONTEXTS = 200, 64, 2048
SEGMENT = 1 << 20  # anchors' places take 20 bits
TOGETHER = 1 << 18  # bytes of texts handled at once; a longer piece stands alone
_rng = np.random.default_rng(20240229)
TABLE = _rng.integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
BASE = 0x9E3779B97F4A7C15


def text_keys(text: Column) -> list[Column]:
    """A text's 128-bit content key, computed by Spark."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("second"), text).alias("k2")]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, by block prefix and suffix minima."""
    n = len(x)
    pad = -n % w
    y = np.concatenate([x, np.full(pad, np.iinfo(U64).max, U64)]).reshape(-1, w)
    pre = np.minimum.accumulate(y, axis=1).ravel()
    suf = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(suf[: n - w + 1], pre[w - 1 : n])


def runs_of(buf: np.ndarray, ends: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of one buffer of whole texts: first window, windows, anchor hash, anchor's place in the context, context hash, text number.

    ends: for every text its end in the buffer.
    """
    n = len(buf)
    none = np.zeros(0, np.int64)
    if n < width:
        return none, none, none, none, none, none
    roll = Rolling(TABLE[buf], BASE)
    at = np.arange(n - gram + 1)
    h = mix((roll.prefix[gram:] - roll.prefix[:-gram]) * roll.inverse[: n - gram + 1])
    packed = (h & ~U64(SEGMENT - 1)) | at.astype(U64)
    anchor = (sliding_min(packed, width - gram + 1) & U64(SEGMENT - 1)).astype(np.int64)
    doc = np.searchsorted(ends, np.arange(n - width + 1), side="right")
    valid = np.arange(n - width + 1) + width <= ends[doc]
    change = np.empty(len(anchor), bool)
    change[0] = True
    change[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | (valid[1:] != valid[:-1])
    first = np.flatnonzero(change)
    count = np.diff(np.append(first, len(anchor)))
    keep = valid[first]
    first, count = first[keep], count[keep]
    a = anchor[first]
    place = a - first
    ctx = context_ids(buf.tobytes(), first, first + count - 1 + width, place)
    return first, count, h[a].view(np.int64), place, ctx, doc[first]


def context_ids(data: bytes, begin: np.ndarray, end: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A hash of each stretch and of the anchor's place in it."""
    view, digest = memoryview(data), xxhash.xxh3_64_intdigest
    return np.array([digest(view[a:b], p) for a, b, p in zip(begin.tolist(), end.tolist(), place.tolist(), strict=True)], U64).view(np.int64)


RUN_SCHEMA = "anchor long, ctx long, k1 long, k2 long, start int, n int, copies int, place int"


def distinct_texts(batch: pa.RecordBatch, width: int) -> Iterator[tuple[tuple[int, int], bytes, int]]:
    """The batch's different texts of ``width`` bytes or more, with how often they are there."""
    keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
    times = Counter(keys)
    for key, text in zip(keys, batch.column(2), strict=True):
        if times[key]:
            data = text.as_py().encode("utf-8", "surrogatepass")
            if len(data) >= width:
                yield key, data, times[key]
            times[key] = 0


def emit_runs(batches: Iterator[pa.RecordBatch], width: int, gram: int) -> Iterator[pa.RecordBatch]:
    """(k1, k2, text) -> runs; copies inside a batch are one row with their number."""
    step = SEGMENT - width + 1
    for batch in batches:
        parts: list[bytes] = []
        meta: list[tuple[int, int, int, int]] = []
        size = 0

        def flush():
            buf = np.frombuffer(b"".join(parts), np.uint8)
            sizes = np.array([len(p) for p in parts])
            ends = np.cumsum(sizes)
            first, count, anchor, place, ctx, doc = runs_of(buf, ends, width, gram)
            m = np.array(meta, np.int64).reshape(-1, 4)[doc]
            start = first - (ends - sizes)[doc] + m[:, 3]
            return pa.record_batch(
                [pa.array(x) for x in (anchor, ctx, m[:, 0], m[:, 1], start.astype(np.int32), count.astype(np.int32), m[:, 2].astype(np.int32), place.astype(np.int32))],
                ["anchor", "ctx", "k1", "k2", "start", "n", "copies", "place"],
            )

        for key, data, times in distinct_texts(batch, width):
            for at in range(0, len(data) - width + 1, step):
                piece = data[at : at + SEGMENT]
                if size and size + len(piece) > TOGETHER:
                    yield flush()
                    parts, meta, size = [], [], 0
                parts.append(piece)
                meta.append((*key, times, at))
                size += len(piece)
        if parts:
            yield flush()


def words_at(buf: np.ndarray, k: int) -> np.ndarray:
    """The 8 bytes from each place, as big-endian numbers."""
    padded = np.concatenate([buf, np.zeros(8 * k + 8, np.uint8)])
    out = np.zeros(len(buf) + 8 * k, U64)
    for i in range(8):
        out |= padded[i : i + len(out)].astype(U64) << U64(56 - 8 * i)
    return out


def two_stage(buf: np.ndarray, depth: int) -> np.ndarray:
    """Suffix array of ``buf``, in order by the first ``depth`` bytes.

    Suffixes smaller than their successor are sorted directly; each other one
    starts with a byte not below the next, so a scan of the buckets in byte
    order meets its successor first and appends it to its bucket.
    """
    n = len(buf)
    if n == 0:
        return np.zeros(0, np.int64)
    steps = -(-depth // 8)
    # smaller[i]: suffix i < suffix i+1; runs of one byte take the type of their end, the last suffix is larger than the empty one
    diff = np.zeros(n, np.int8)
    diff[:-1] = np.sign(buf[1:].astype(np.int16) - buf[:-1])
    diff[-1] = -1
    last = np.where(diff != 0, np.arange(n), n)
    nxt = np.minimum.accumulate(last[::-1])[::-1]
    smaller = diff[nxt] > 0
    direct = np.flatnonzero(smaller)
    word = words_at(buf, steps)
    order = direct[np.argsort(word[direct], kind="stable")]
    group = np.cumsum(np.concatenate([[0], word[order][1:] != word[order][:-1]])) if len(order) else np.zeros(0, np.int64)
    # refine only the members of ties, eight bytes at a time
    for s in range(1, steps):
        if not len(order):
            break
        tied = np.zeros(len(order), bool)
        same = group[1:] == group[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        t = np.flatnonzero(tied)
        if not len(t):
            break
        key = word[order[t] + 8 * s]
        by = np.lexsort((key, group[t]))
        order[t] = order[t][by]
        new = np.ones(len(order), bool)
        new[1:] = ~same
        g, k = group[t][by], key[by]
        new[t[1:]] |= (g[1:] == g[:-1]) & (k[1:] != k[:-1])
        group = np.cumsum(new) - 1
    direct_at = np.searchsorted(buf[order], np.arange(257))
    size = np.bincount(buf, minlength=256)
    sa = np.empty(n, np.int64)
    pushed: list[list[np.ndarray]] = [[] for _ in range(256)]
    pushed[buf[-1]].append(np.array([n - 1]))
    at = 0
    for c in np.flatnonzero(size):
        level = np.concatenate(pushed[c]) if pushed[c] else np.zeros(0, np.int64)
        bucket = []
        while len(level):  # each level is induced by the one before, inside the bucket
            bucket.append(level)
            prev = level[level > 0] - 1
            level = prev[buf[prev] == c]
        bucket.append(order[direct_at[c] : direct_at[c + 1]])
        whole = np.concatenate(bucket)
        sa[at : at + len(whole)] = whole
        at += len(whole)
        prev = whole[whole > 0] - 1
        prev = prev[buf[prev] > c]
        by = np.argsort(buf[prev], kind="stable")
        prev = prev[by]
        cut = np.flatnonzero(np.diff(buf[prev])) + 1
        for part in np.split(prev, cut):
            if len(part):
                pushed[buf[part[0]]].append(part)
        pushed[c] = []
    return sa


def common_prefixes(buf: np.ndarray, sa: np.ndarray, depth: int) -> np.ndarray:
    """For each neighbour pair of ``sa`` whether they agree on ``depth`` bytes (multiple of 8)."""
    word = words_at(buf, -(-depth // 8))
    i, j = sa[:-1], sa[1:]
    live = np.arange(len(i))
    for s in range(0, depth, 8):
        live = live[word[i[live] + s] == word[j[live] + s]]
    out = np.zeros(len(i), bool)
    out[live] = True
    return out


def repeated_starts(contexts: list[bytes], width: int) -> list[np.ndarray]:
    """For each context whether each window in it occurs again in this block."""
    buf = np.frombuffer(b"".join(contexts), np.uint8)
    sizes = np.array([len(c) for c in contexts])
    ends = np.cumsum(sizes)
    valid = np.zeros(len(buf), bool)
    for e, n in zip(ends, sizes, strict=True):
        valid[e - n : e - width + 1] = True
    sa = two_stage(buf, width)
    sa = sa[valid[sa]]
    same = common_prefixes(buf, sa, width)
    mark = np.zeros(len(buf), bool)
    mark[sa[:-1][same]] = True
    mark[sa[1:][same]] = True
    return [mark[e - n : e - width + 1] for e, n in zip(ends, sizes, strict=True)]


def mask_spans(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the runs of True."""
    d = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


SPAN_SCHEMA = "g long, clip long, spans array<struct<a:int,b:int>>"
SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def sort_blocks(batches: Iterator[pa.RecordBatch], width: int, block_bytes: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    """Rows (g, clip, bytes) in order of g; whole groups together."""
    rows: list[tuple[int, int, bytes]] = []
    size = 0

    def flush():
        out = []
        for (a, c, _), mask in zip(rows, repeated_starts([r[2] for r in rows], width), strict=True):
            b, e = mask_spans(mask)
            if len(b):
                out.append((a, c, [{"a": int(x), "b": int(y)} for x, y in zip(b, e, strict=True)]))
        return pa.record_batch([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], SPANS)], ["g", "clip", "spans"])

    for batch in batches:
        for a, c, d in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if size >= block_bytes and rows[-1][0] != a:
                yield flush()
                rows, size = [], 0
            rows.append((a, c, d))
            size += len(d)
    if rows:
        yield flush()


HALF_SCHEMA = "g long, clip long, lo int, hi int, place int, bytes binary, from_g long, from_clip long, shift int"


def halves(batches: Iterator[pa.RecordBatch], width: int, gram: int) -> Iterator[pa.RecordBatch]:
    """(g, clip, lo, hi, place, bytes) -> the same for both halves of lo..hi, with where they come from.

    lo, hi: the places of the anchor in the windows meant; place: that in the
    bytes.  g stands for the group's anchor, range and the bytes that all its
    windows hold beside the anchor.
    """
    most = width - gram
    digest = xxhash.xxh3_64_intdigest
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int32())
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            out = []
            for g, clip, lo, hi, place, data in zip(*(c.to_pylist() for c in batch.slice(at, 2000).columns), strict=True):
                right = len(data) - place - gram
                mid = (lo + hi) // 2
                for a, b in ((lo, mid), (mid + 1, hi)):
                    if a > b or place < a or right < most - b:
                        continue  # no window of this half
                    begin, end = place - min(place, b), place + gram + min(right, most - a)
                    own = data[place - a : place + gram + most - b]
                    key = digest(own, (g * 1_000_003 + a * 1009 + b) & ((1 << 64) - 1))
                    part = data[begin:end]
                    out.append((signed(key), signed(digest(part, place - begin)), a, b, place - begin, part, g, clip, begin))
            yield pa.record_batch([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["g", "clip", "lo", "hi", "place", "bytes", "from_g", "from_clip", "shift"])


def span(a, b) -> Column:
    return F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))


def sorted_spans(cut: DataFrame, width: int, gram: int, block_contexts: int) -> DataFrame:
    """(g, clip, spans of windows that occur again) of distinct (g, clip, lo, hi, place, bytes, contexts)."""
    cols = ["g", "clip", "lo", "hi", "place", "bytes"]
    found, origins = [], []
    while True:
        small = cut.where((F.col("contexts") > 1) & (F.col("contexts") <= block_contexts)).select("g", "clip", "bytes")
        level = small.repartition("g").sortWithinPartitions("g").mapInArrow(lambda b: released(sort_blocks(b, width)), SPAN_SCHEMA)
        large = cut.where(F.col("contexts") > block_contexts).select(*cols)
        if large.limit(1).count() == 0:
            found.append(level)
            break
        found.append(save(level, "spans"))
        split = save(large.mapInArrow(lambda b: released(halves(b, width, gram)), HALF_SCHEMA), "halves")
        origins.append(split.select("g", "clip", "from_g", "from_clip", "shift"))
        one = split.groupBy("g", "clip").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("lo", "hi", "place", "bytes")))  # equal rows but for their origin
        one = save(one, "clips")
        # equal windows of different strings are one string here: each of its windows occurs again
        found[-1] = found[-1].unionByName(_as_origin(one.where("n > 1").select("g", "clip", F.array(span(F.lit(0), F.length("bytes") - width + 1)).alias("spans")), origins[-1]))
        sizes = one.groupBy("g").agg(F.count("*").alias("contexts"))
        cut = save(one.where("n = 1 OR lo < hi").join(sizes, "g").select(*cols, "contexts"), "context_bytes")
    out = found.pop()
    while origins:
        out = found.pop().unionByName(_as_origin(out, origins.pop()))
    return out


def _as_origin(spans: DataFrame, origin: DataFrame) -> DataFrame:
    """Spans of clipped strings as spans of what they were clipped from."""
    moved = F.transform("spans", lambda s: span(s["a"] + F.col("shift"), s["b"] + F.col("shift")))
    return spans.join(origin, ["g", "clip"]).select(F.col("from_g").alias("g"), F.col("from_clip").alias("clip"), moved.alias("spans"))


def packed_texts(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The different long-enough texts of each batch, compressed for the shuffle."""
    pack = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        rows = [(*key, pack.compress(data)) for key, data, _ in distinct_texts(batch, width)]
        for lo in range(0, len(rows), 2000):
            yield pa.record_batch([pa.array([r[i] for r in rows[lo : lo + 2000]], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["k1", "k2", "z"])


def packed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, k1, k2, text) -> (id, k1, k2, z)"""
    pack = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        z = pa.array([pack.compress(t.as_py().encode("utf-8", "surrogatepass")) for t in batch.column(3)], pa.binary())
        yield pa.record_batch([*batch.columns[:3], z], ["doc_id", "k1", "k2", "z"])


def cut_contexts(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(z, wants) -> (g, clip, place, contexts, bytes): the asked-for contexts of a text."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        rows: list[tuple] = []

        def made():
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
            return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["g", "clip", "place", "contexts", "bytes"])

        for z, wants in zip(batch.column(0), batch.column(1), strict=True):
            data = unpack.decompress(z.as_py())
            for w in wants.as_py():
                rows.append((w["anchor"], w["ctx"], w["place"], w["contexts"], data[w["start"] : w["start"] + w["n"] - 1 + width]))
                if len(rows) >= 20_000:
                    yield made()
                    rows = []
        yield made()


CUT_SCHEMA = "n_bytes long, n_removed long, n_spans long, kept {}, removed array<struct<a:int,b:int>>"


def union_of(spans: list[dict] | None) -> list[list[int]]:
    out: list[list[int]] = []
    for s in sorted((s["a"], s["b"]) for s in spans or []):
        if out and s[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s[1])
        else:
            out.append([s[0], s[1]])
    return out


def cut_texts(batches: Iterator[pa.RecordBatch], as_text: bool) -> Iterator[pa.RecordBatch]:
    """(doc_id, z, spans) -> kept bytes, or the whole characters among them, and counts."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            rows = []
            for z, spans in zip(part.column(1), part.column(2), strict=True):
                data = unpack.decompress(z.as_py())
                gone = union_of(spans.as_py())
                kept, at = [], 0
                for a, b in gone:
                    kept.append(data[at:a])
                    at = b
                kept.append(data[at:])
                rows.append((len(data), sum(b - a for a, b in gone), len(gone), b"".join(kept).decode("utf-8", "ignore") if as_text else b"".join(kept), [{"a": a, "b": b} for a, b in gone]))
            yield pa.record_batch(
                [part.column(0), *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string() if as_text else pa.binary(), SPANS)))],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "removed"],
            )


def remove_repeats(docs: DataFrame, text: str = "text", id_col: str = "doc_id", width: int = WIDTH, gram: int = GRAM, block_contexts: int = BLOCK_CONTEXTS, as_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: id_col, n_bytes, n_removed, n_spans, kept (bytes, or text), removed (spans)."""
    if width % 8 or gram >= width:
        raise ValueError("width: a multiple of 8, above gram")
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    src = src.select("doc_id", *text_keys(F.col("text")), "text")
    id_type = src.schema["doc_id"].dataType.simpleString()
    texts = src.select("k1", "k2", "text")
    with tidy(docs.sparkSession) as keep_spans:
        runs = save(texts.mapInArrow(lambda b: released(emit_runs(b, width, gram)), RUN_SCHEMA), "runs")
        with tidy(docs.sparkSession) as keep_found:
            # what is repeated as a whole, and which anchors need their text
            first = [F.first(c).alias(c) for c in ("k1", "k2", "start", "n", "place")]  # of one row: all are merged in the same order
            by_ctx = save(runs.groupBy("anchor", "ctx").agg(F.sum("copies").alias("copies"), *first), "contexts")
            several = by_ctx.groupBy("anchor").agg(F.count("*").alias("contexts")).where("contexts > 1")
            whole = by_ctx.where("copies > 1").select(F.col("anchor").alias("g"), F.col("ctx").alias("clip"), F.array(span(F.lit(0), F.col("n"))).alias("spans"))
            asks = by_ctx.join(several, "anchor").groupBy("k1", "k2").agg(F.collect_list(F.struct("anchor", "ctx", "start", "n", "place", "contexts")).alias("wants"))
            packed = texts.mapInArrow(lambda b: released(packed_texts(b, width)), "k1 long, k2 long, z binary").dropDuplicates(["k1", "k2"])
            cut = packed.join(asks, ["k1", "k2"]).select("z", "wants").mapInArrow(lambda b: released(cut_contexts(b, width)), "g long, clip long, place int, contexts long, bytes binary")
            cut = save(cut.withColumns({"lo": F.lit(0), "hi": F.lit(width - gram)}), "context_bytes")
            blocks = sorted_spans(cut, width, gram, block_contexts)
            found = keep_found(whole.unionByName(blocks).select(F.col("g").alias("anchor"), F.col("clip").alias("ctx"), "spans"), "found")

        moved = F.transform("spans", lambda s: span(F.col("start") + s["a"], F.col("start") + s["b"] - 1 + width))
        spans = runs.join(found, ["anchor", "ctx"]).select("k1", "k2", F.explode(moved).alias("s"))
        spans = keep_spans(spans.groupBy("k1", "k2").agg(F.collect_set("s").alias("spans")), "spans")
    rows = src.mapInArrow(packed_rows, f"doc_id {id_type}, k1 long, k2 long, z binary").join(spans, ["k1", "k2"], "left")
    return rows.select("doc_id", "z", "spans").mapInArrow(lambda b: released(cut_texts(b, as_text)), f"doc_id {id_type}, {CUT_SCHEMA.format('string' if as_text else 'binary')}").withColumnRenamed("doc_id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
