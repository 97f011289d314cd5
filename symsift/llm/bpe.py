"""Byte-level BPE encoding and decoding inside DuckDB (operator 9).

Each partition splits its texts with the public pattern and hands the pieces it
has not met to an in-process DuckDB.  A piece is first cut wherever no
vocabulary entry that occurs in it reaches across: no merge can cross such a
place, so the parts are merged by themselves and equal parts once (a clause
without blanks falls into words or characters).  A recursive query then holds
one row for each token position of a part, joins neighbours with the merge
table, contracts the leftmost pair of least rank of every part and goes on until
no pair is left; ordered aggregation makes the ids and, through the vocabulary,
the decoded bytes.  The merge table has every way to cut a vocabulary entry in
two, so the result is that of the tiktoken library for any rank file.

The recursion keeps the last step only; a batch of parts is bounded by their
summed squared lengths, which is what its steps cost.  That sum bounds time, so
a part of more than ``LONG`` bytes (a run of one character, say, all of which
entries cover) is merged by the same rule with a heap instead.

Null texts count as empty: no ids, and the digest of nothing.  doc_id may be
null or repeated; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, ranges
from .pieces import Merged, Split, chunks, read_ranks

LONG = 256
BATCH = 4_000_000  # summed squared bytes

# k: piece * 1024 + position, kept dense; best: rank * 1024 + position of a piece's next pair
ENCODE = """
WITH RECURSIVE step(k, id, n) USING KEY (k) AS (
    SELECT k, id, 0 FROM init
  UNION ALL
    SELECT CASE WHEN k & 1023 > best & 1023 THEN k - 1 ELSE k END, CASE WHEN k & 1023 = best & 1023 THEN best >> 10 ELSE id END, n + 1
    FROM step JOIN (
        SELECT s.k >> 10 AS w, min(m.r * 1024 + (s.k & 1023)) AS best
        FROM step s JOIN step t ON t.k = s.k + 1 JOIN merges m ON m.ab = (s.id << 20) | t.id
        GROUP BY s.k >> 10
    ) ON w = k >> 10
    WHERE k & 1023 <> (best & 1023) + 1
)
SELECT w, string_agg(v.decimal, ',' ORDER BY k) AS ids, count(*) AS n, string_agg(v.hex, '' ORDER BY k) AS decoded
FROM step JOIN (SELECT k >> 10 AS w, max(n) AS n FROM step GROUP BY k >> 10) last ON w = k >> 10 AND last.n = step.n
JOIN vocabulary v ON v.id = step.id
GROUP BY w
"""  # a place that a contraction freed keeps an earlier step's number


def local_folder() -> str:
    """A folder in Spark's local directories, for what DuckDB spills."""
    at = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or tempfile.gettempdir()
    return os.path.join(at, f"duckdb-{os.getpid()}")


class Cuts:
    """Where a text can be cut so that no occurrence of a vocabulary entry is.

    An entry of more than eight bytes counts as occurring where its first eight
    do, which can only leave out cuts.
    """

    def __init__(self, tokens: list[bytes]):
        reach: list[dict[int, int]] = [{} for _ in range(9)]
        for t in tokens:
            n = min(len(t), 8)
            key = int.from_bytes(t[:n], "big")
            reach[n][key] = max(reach[n].get(key, 0), len(t))
        self.tables = []
        for n in range(2, 9):
            keys = np.array(sorted(reach[n]), U64)
            self.tables.append((n, keys, np.array([reach[n][k] for k in keys.tolist()], np.int64)))

    def of(self, flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For the bytes of some pieces one after another, their ends: whether each place may be the first of a part."""
        n = len(flat)
        far = np.arange(n) + 1  # how far the entries that begin here reach
        left = ends[np.searchsorted(ends, np.arange(n), side="right")] - np.arange(n)
        padded = np.concatenate([flat, np.zeros(8, np.uint8)]).astype(U64)
        key = flat.astype(U64)
        for size, keys, reach in self.tables:
            key = (key << U64(8)) | padded[size - 1 : size - 1 + n]
            if len(keys):
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                hit = np.flatnonzero((keys[at] == key) & (left >= size))
                far[hit] = np.maximum(far[hit], hit + np.minimum(reach[at[hit]], left[hit]))
        free = np.ones(n, bool)
        free[1:] = np.maximum.accumulate(far)[:-1] <= np.arange(1, n)
        return free


Spelled = tuple[pa.LargeBinaryArray, np.ndarray, pa.LargeBinaryArray]  # ids as decimals, a comma after each; their number; decoded bytes
NOTHING = pa.array([], pa.large_binary())


def stretches(data: bytes | memoryview, edges: np.ndarray) -> pa.LargeBinaryArray:
    """data[edges[0] : edges[1]], data[edges[1] : edges[2]] and so on, without a copy."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(np.ascontiguousarray(edges, np.int64)), pa.py_buffer(data)])


def edges_of(array: pa.LargeBinaryArray) -> np.ndarray:
    return np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int64)


def values_of(array: pa.LargeBinaryArray) -> memoryview:
    """All bytes of an array that does not share them with others."""
    edges = edges_of(array)
    return memoryview(array.buffers()[2] or b"")[edges[0] : edges[-1]]


def views(array: pa.LargeBinaryArray, less: int = 0) -> Iterator[memoryview]:
    """Each value, without its last ``less`` bytes."""
    edges, data = edges_of(array).tolist(), memoryview(array.buffers()[2] or b"")
    return (data[a : max(a, b - less)] for a, b in zip(edges, edges[1:], strict=False))


def grouped(array: pa.LargeBinaryArray, cut: np.ndarray) -> pa.LargeBinaryArray:
    """The values cut[0] to cut[1], cut[1] to cut[2] and so on, each group joined."""
    edges = edges_of(array)
    return stretches(values_of(array), edges[cut] - edges[0])


class DuckMerger:
    """Merges pieces of text by one rank file."""

    def __init__(self, path: str, memory: str = "256MB"):
        import duckdb

        self.ranks = read_ranks(path)
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        a, b, r = [], [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    a.append(left)
                    b.append(right)
                    r.append(rank)
        self.cuts = Cuts(list(self.ranks))
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": memory, "temp_directory": local_folder()})
        self._table("merges", ab=pa.array((np.array(a, np.int64) << 20) | np.array(b, np.int64)), r=pa.array(r, pa.int64()))
        self._table("vocabulary", id=pa.array(list(self.bytes_of), pa.int64()), decimal=pa.array(list(map(str, self.bytes_of))), hex=pa.array([x.hex() for x in self.bytes_of.values()]))

    def _table(self, name: str, **columns: pa.Array) -> None:
        self.db.register("incoming", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM incoming")
        self.db.unregister("incoming")

    def merge(self, pieces: list[bytes]) -> list[tuple[str, int, bytes]]:
        """(ids as decimals joined by commas, their number, decoded bytes) of each piece."""
        if not pieces:
            return []
        ids, n, decoded = self.spell(b"".join(pieces), np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces))))
        return [(x[:-1].decode(), k, y) for x, k, y in zip(ids.to_pylist(), n.tolist(), decoded.to_pylist(), strict=True)]

    def spell(self, data: bytes, ends: np.ndarray) -> Spelled:
        """The same for pieces that lie one after another, by their ends, as arrays; a comma after every id."""
        begin = np.flatnonzero(self.cuts.of(np.frombuffer(data, np.uint8), ends))
        parts = stretches(data, np.append(begin, len(data))).dictionary_encode()
        ids, n, decoded = self._parts(parts.dictionary)
        cut = np.concatenate([[0], np.searchsorted(begin, ends)])
        total = np.concatenate([[0], np.cumsum(n[parts.indices.to_numpy()])])[cut]
        return grouped(ids.take(parts.indices), cut), np.diff(total), grouped(decoded.take(parts.indices), cut)

    def _parts(self, parts: pa.LargeBinaryArray) -> Spelled:
        sizes = np.diff(edges_of(parts))
        order = np.argsort(sizes, kind="stable")
        done = []
        short = int(np.searchsorted(sizes[order], LONG, side="right"))
        cost = np.cumsum(sizes[order[:short]] ** 2)
        at = 0
        while at < short:
            stop = int(np.searchsorted(cost, (cost[at - 1] if at else 0) + BATCH, side="right"))
            done.append(self._recurse(parts.take(pa.array(order[at:stop]))))
            at = stop
        for p in parts.take(pa.array(order[short:])).to_pylist():
            ids = self._heap(p)
            done.append((pa.array([("%d," * len(ids) % tuple(ids)).encode()], pa.large_binary()), np.array([len(ids)]), pa.array([b"".join([self.bytes_of[x] for x in ids])], pa.large_binary())))
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        ids, n, decoded = zip(*done, strict=True) if done else ([NOTHING], [np.zeros(0, np.int64)], [NOTHING])
        return pa.concat_arrays(ids).take(pa.array(back)), np.concatenate(n)[back], pa.concat_arrays(decoded).take(pa.array(back))

    def _recurse(self, batch: pa.LargeBinaryArray) -> Spelled:
        edges = edges_of(batch)
        flat = np.frombuffer(values_of(batch), np.uint8)
        sizes = np.diff(edges)
        self._table("init", k=pa.array(np.repeat(np.arange(len(batch)) * 1024, sizes) + ranges(sizes)), id=pa.array(self.single[flat]))
        w, ids, n, decoded = (c.combine_chunks() for c in self.db.sql(ENCODE).to_arrow_table().columns)
        order = pa.array(np.argsort(w.to_numpy()))
        if len(order) != len(batch):
            raise RuntimeError("a part came back without ids")
        digits = decoded.cast(pa.large_binary()).take(order)
        none, comma = (pa.scalar(x, pa.large_string()) for x in ("", ","))
        ids = pc.binary_join_element_wise(ids.cast(pa.large_string()).take(order), none, comma).cast(pa.large_binary())
        return ids, n.to_numpy()[order.to_numpy()], stretches(bytes.fromhex(str(values_of(digits), "ascii")), edges_of(digits) // 2)

    def _heap(self, piece: bytes) -> list[int]:
        """Leftmost pair of least rank first, with a heap over a linked list."""
        ids = [int(self.single[b]) for b in piece]
        n = len(ids)
        data = [self.bytes_of[i] for i in ids]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap: list[tuple[int, int, int, int]] = []

        def push(i: int) -> None:
            j = after[i]
            if j < n:
                r = self.ranks.get(data[i] + data[j])
                if r is not None:
                    heapq.heappush(heap, (r, i, len(data[i]), len(data[j])))

        for i in range(n):
            push(i)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or len(data[i]) != a or len(data[j]) != b:
                continue
            data[i] += data[j]
            ids[i] = r
            alive[j] = False
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return [ids[i] for i in range(n) if alive[i]]


class PieceTexts(Merged):
    """Decimal ids and decoded bytes of the pieces met so far; bounded by their number and by their characters."""

    def __init__(self, path: str, keep: int = 500_000):
        self.duck = DuckMerger(path)
        super().__init__(self.duck.merge, keep)

    def clear(self) -> None:
        super().clear()
        self.ids = self.decoded = NOTHING
        self.count = np.zeros(0, np.int64)

    def made(self, split: Split, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ids, count and decoded instead of ids."""
        chars, size = split.flat(new)
        data = chars.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
        width = 1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000)
        ids, n, decoded = self.duck.spell(data, np.cumsum(width)[np.cumsum(size) - 1])
        at = len(self.ids)
        self.ids, self.decoded = pa.concat_arrays([self.ids, ids]), pa.concat_arrays([self.decoded, decoded])
        self.count = np.concatenate([self.count, n])
        return np.arange(at, len(self.ids)), np.ones(len(new), np.int64)

    def places(self, split: Split) -> np.ndarray:
        """Of every piece of the texts, in ids, count and decoded."""
        if len(self.chars) > 16 * self.keep:
            self.clear()
        first, _ = self.of(split)
        return self.flat[first][split.kind]


@functools.cache
def piece_texts(path: str) -> PieceTexts:
    return PieceTexts(path)


def encode_rows(batches: Iterator[pa.RecordBatch], path: str, full: bool) -> Iterator[pa.RecordBatch]:
    known = piece_texts(path)
    for batch in batches:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        for at, part in chunks(texts):
            split = Split(part)
            which = known.places(split)
            cut = split.bounds()
            n = np.diff(np.concatenate([[0], np.cumsum(known.count[which])])[cut])
            which = pa.array(which)
            joined, back = grouped(known.ids.take(which), cut), grouped(known.decoded.take(which), cut)
            if full:
                tail = [pa.array([[int(x) for x in j.split(b",")[:-1]] for j in joined.to_pylist()], pa.list_(pa.int32())), back.cast(pa.binary())]
            else:
                tail = [pa.array([hashlib.sha256(x).hexdigest() for x in y]) for y in (views(joined, 1), views(back))]
            yield pa.record_batch([batch.column(0).slice(at, len(part)), pa.array(n, pa.int64()), *tail], ["id", "n", "x", "y"])


def encode(docs: DataFrame, ranks: str, text: str = "text", id_col: str = "doc_id", digests: bool = False) -> DataFrame:
    """id_col, n_tokens, then ids and decoded (bytes), or with ``digests`` ids_sha256 and decoded_sha256.

    ranks: path of a rank file that every executor can read.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    tail = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded binary"
    out = src.mapInArrow(lambda b: encode_rows(b, ranks, not digests), f"id {kind}, n_tokens long, {tail}")
    return out.withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), digests=True)
