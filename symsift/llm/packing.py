"""Best-fit packing of tokenised documents into fixed sequences (operator 4).

Only piece lengths matter for a packing and there are at most ``capacity`` of
them, so the driver packs the histogram of lengths (at most ``capacity`` rows,
however large the corpus).  The start is best fit in a hashed order of the
documents, which leaves bins underfull; the packing is made by a local search that moves
documents to the fullest bin with room (best fit) or exchanges one for one or
two for one between underfull bins, each step increasing the summed squared fill,
so that the emptiest bins empty; it ends at the least possible number of bins,
when no step is left, or after ``EFFORT`` comparisons of bins for an exchange.  A
bin pattern carries its multiplicity, so the search doesn't depend on the number
of documents.  Pieces then find their place by rank among pieces of their length,
from counts per partition and length, which meet the pieces in a join on both; no
piece is collected, nothing that grows with the corpus is broadcast, and no
length, however common, meets in one task.

Null texts count as empty: one piece that is the separator alone.  Repeated
rows are packed each; doc_id may be null.  An empty table packs to no rows.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import released, save
from .pieces import encoder

Pattern = tuple[tuple[int, int], ...]  # (length, copies), longest first


EFFORT = 60_000_000


def best_fit(histogram: dict[int, int], capacity: int) -> Counter[Pattern]:
    """Every document in turn to the fullest bin with room, in a hashed order: each pattern of bins with its number.

    A count is cut into powers of two, each of which is one turn: so many
    documents of one length go to so many bins.
    """
    open_: dict[int, list[list]] = {}  # room -> [pattern, bins]
    rooms: list[int] = []
    done: Counter[Pattern] = Counter()
    turns = [(n, bit) for n, m in histogram.items() for bit in range(m.bit_length()) if m >> bit & 1]
    for n, bit in sorted(turns, key=lambda t: (-t[1], zlib.crc32(t[0].to_bytes(4, "little")))):
        left = 1 << bit
        while left:
            i = bisect.bisect_left(rooms, n)
            if i == len(rooms):
                pattern, room, bins = (), capacity, left
            else:
                room = rooms[i]
                pattern, bins = open_[room].pop()
                if bins > left:
                    open_[room].append([pattern, bins - left])
                if not open_[room]:
                    del open_[room], rooms[i]
            times = min(bins, left)
            left -= times
            new, room = with_items(pattern, (), (n,)), room - n
            if not room:
                done[new] += times
            else:
                if room not in open_:
                    open_[room] = []
                    bisect.insort(rooms, room)
                open_[room].append([new, times])
    for own in open_.values():
        for pattern, bins in own:
            done[pattern] += bins
    return done


def fill(p: Pattern) -> int:
    return sum(n * k for n, k in p)


def with_items(p: Pattern, less: tuple[int, ...], more: tuple[int, ...]) -> Pattern:
    c = Counter(dict(p))
    c.subtract(less)
    c.update(more)
    return tuple(sorted(((n, k) for n, k in c.items() if k), reverse=True))


class Search:
    """Underfull bins by their room, and the steps between them."""

    def __init__(self, bins: Counter[Pattern], capacity: int):
        self.capacity = capacity
        self.least = -(-sum(fill(p) * m for p, m in bins.items()) // capacity)
        self.number = sum(bins.values())
        self.steps: Counter[str] = Counter()
        self.full: Counter[Pattern] = Counter()
        self.at: dict[int, dict[Pattern, int]] = {}  # room -> pattern -> bins
        self.rooms: list[int] = []
        for p, m in bins.items():
            self._put(p, m)
        self._list()

    def _put(self, p: Pattern, m: int) -> None:
        room = self.capacity - fill(p)
        if not p:
            self.number -= m
            self.steps["emptied"] += m
        elif not room:
            self.full[p] += m
        else:
            if room not in self.at:
                self.at[room] = {}
                bisect.insort(self.rooms, room)
            self.at[room][p] = self.at[room].get(p, 0) + m

    def _take(self, p: Pattern, m: int) -> None:
        room = self.capacity - fill(p)
        own = self.at[room]
        own[p] -= m
        if not own[p]:
            del own[p]
            if p in self.index:
                self.alive[self.index[p]] = False
                self.changes += 1
            if not own:
                del self.at[room]
                self.rooms.pop(bisect.bisect_left(self.rooms, room))

    def _step(self, kind: str, donor: Pattern, taker: Pattern, gives: tuple[int, ...], gets: tuple[int, ...]) -> None:
        have = self.at[self.capacity - fill(donor)][donor]
        times = have // 2 if donor == taker else min(have, self.at[self.capacity - fill(taker)][taker])
        self._take(donor, times)
        self._take(taker, times)
        self._put(with_items(donor, gives, gets), times)
        self._put(with_items(taker, gets, gives), times)
        self.steps[kind] += times

    def move(self, donor: Pattern) -> bool:
        """The longest document that fits goes to the fullest bin with room for it, which is no emptier than the donor."""
        own = self.capacity - fill(donor)
        for n, _ in donor:
            i = bisect.bisect_left(self.rooms, n)
            if i < len(self.rooms) and (room := self.rooms[i]) <= own:
                taker = next((p for p in self.at[room] if p != donor), donor)
                if taker != donor or self.at[room][donor] > 1:
                    self._step("moves", donor, taker, (n,), ())
                    return True
        return False

    def _list(self) -> None:
        """What every underfull bin could give back: nothing, one document, or two."""
        self.bins = [p for own in self.at.values() for p in own]
        self.index = {p: i for i, p in enumerate(self.bins)}
        rows: list[tuple[int, int, int, int]] = []
        for i, p in enumerate(self.bins):
            rows.append((i, 0, 0, 0))
            for k, (x, m) in enumerate(p):
                rows.append((i, x, x, 0))
                rows += [(i, x + y, x, y) for y, m2 in p[k:] if x != y or m > 1]
        self.owner, self.back, self.one, self.two = np.array(rows, np.int64).reshape(-1, 4).T
        self.alive = np.ones(len(self.bins), bool)
        self.room = np.array([self.capacity - fill(p) for p in self.bins], np.int64)
        self.changes = 0

    def exchange(self, donor: Pattern) -> bool:
        """The step with a bin no emptier than the donor that increases the squared fill most: one or two documents for none or one, or one for two."""
        if self.changes > len(self.bins) // 20:
            self._list()
        own = self.capacity - fill(donor)
        ones = [n for n, _ in donor]
        pairs = [(n + k, n, k) for i, (n, m) in enumerate(donor) for k, _ in donor[i:] if n != k or m > 1]
        gives = sorted({g[0]: g for g in [*pairs, *((n, n, 0) for n in ones)]}.values())
        total = np.array([g[0] for g in gives])
        single = np.array([0, *sorted(ones)])
        room = self.room[self.owner]
        most = room + self.back
        at = np.searchsorted(total, most, side="right") - 1
        out = np.where(self.two > 0, single[np.searchsorted(single, most, side="right") - 1], total[at])
        gain = np.where((self.two > 0) | (at >= 0), out, 0) - self.back
        ok = (gain > 0) & self.alive[self.owner] & (room <= own)
        if (mine := self.index.get(donor)) is not None and self.at[own][donor] < 2:
            ok &= self.owner != mine
        better = np.where(ok, 2 * gain * (own - room + gain), 0)
        self.steps["compared"] += len(self.bins)
        best = int(better.argmax())
        if not better[best]:
            return False
        n = int(out[best])
        give = (n,) if self.two[best] else next(g[1:] if g[2] else g[1:2] for g in gives if g[0] == n)
        self._step("exchanges", donor, self.bins[self.owner[best]], give, tuple(int(x) for x in (self.one[best], self.two[best]) if x))
        return True

    def run(self, effort: int) -> Counter[Pattern]:
        moved = True
        while moved and self.number > self.least and self.steps["compared"] < effort:
            moved = False
            for step in (self.move, self.exchange):
                self._list()
                for room in reversed(self.rooms[:]):
                    for donor in list(self.at.get(room, ())):
                        while self.number > self.least and self.steps["compared"] < effort and donor in self.at.get(room, ()) and step(donor):
                            moved = True
                if moved:
                    break
        out = Counter(self.full)
        for own in self.at.values():
            out.update(own)
        return out


def improve(bins: Counter[Pattern], capacity: int, effort: int = EFFORT) -> tuple[Counter[Pattern], Counter[str]]:
    """(packing, steps taken): local search from the emptiest bins to fuller ones."""
    search = Search(bins, capacity)
    return search.run(effort), search.steps


def places(bins: Counter[Pattern]) -> dict[int, list[np.ndarray]]:
    """length -> arrays (first rank, first bin, offset in the bin, copies per bin)."""
    rows: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    used: Counter[int] = Counter()
    base = 0
    for pattern, m in sorted(bins.items(), reverse=True):
        at = 0
        for n, k in pattern:
            rows[n].append((used[n], base, at, k))
            used[n] += k * m
            at += n * k
        base += m
    return {n: list(np.array(r, np.int64).T) for n, r in rows.items()}


PIECES = "piece int, start long, length long, ids_crc32 long, part int, local_rank long"


def tokenise(batches: Iterator[pa.RecordBatch], path: str, end_id: int, capacity: int, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    enc = encoder(path)
    part = TaskContext.get().partitionId()
    seen = np.zeros(capacity + 1, np.int64)
    for batch in batches:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        for at, ids, cut in enc.encode(texts):
            row, piece, start, length, crc, rank, all_ids = [], [], [], [], [], [], []
            for i in range(len(cut) - 1):
                own = np.append(ids[cut[i] : cut[i + 1]], end_id).astype("<u4")
                n = len(own)
                first = n % capacity or min(n, capacity)
                for j, a in enumerate([0, *range(first, n, capacity)]):
                    b = first if a == 0 else a + capacity
                    row.append(at + i)
                    piece.append(j)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(own[a:b].tobytes()))
                    rank.append(seen[b - a])
                    seen[b - a] += 1
                    if keep_ids:
                        all_ids.append(own[a:b].astype(np.int32))
            cols = [
                batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                pa.array(np.full(len(row), part, np.int32)), pa.array(np.array(rank, np.int64)), *([pa.array(all_ids, pa.list_(pa.int32()))] if keep_ids else []),
            ]
            yield pa.record_batch(cols, ["id", "piece", "start", "length", "ids_crc32", "part", "local_rank", *(["ids"] if keep_ids else [])])


def place(batches: Iterator[pa.RecordBatch], table: dict[int, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        length = batch.column(batch.schema.get_field_index("length")).to_numpy()
        rank = batch.column(batch.schema.get_field_index("rank")).to_numpy()
        seq, off = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for n in np.unique(length):
            own = np.flatnonzero(length == n)
            first, base, at, copies = table[int(n)]
            i = np.searchsorted(first, rank[own], side="right") - 1
            t = rank[own] - first[i]
            seq[own] = base[i] + t // copies[i]
            off[own] = at[i] + t % copies[i] * n
        keep = [i for i, f in enumerate(batch.schema.names) if f not in ("rank",)]
        yield pa.record_batch([*(batch.column(i) for i in keep), pa.array(seq), pa.array(off)], [*(batch.schema.names[i] for i in keep), "sequence_id", "offset"])


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, text: str = "text", id_col: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """One row per piece: id_col, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    ids = ", ids array<int>" if keep_ids else ""
    pieces = save(src.mapInArrow(lambda b: released(tokenise(b, tokenizer, end_id, capacity, keep_ids)), f"id {kind}, {PIECES}{ids}"), "pieces")
    counts = save(pieces.groupBy("part", "length").agg((F.max("local_rank") + 1).alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    table = places(improve(best_fit(histogram, capacity), capacity)[0])
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = pieces.join(counts.select("part", "length", before.alias("before")).hint("merge"), ["part", "length"])  # counts grow with the partitions: no broadcast
    cols = ["id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    ranked = ranked.select(*cols, (F.col("before") + F.col("local_rank")).alias("rank"))
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long{ids}, sequence_id long, offset long"
    return ranked.mapInArrow(lambda b: place(b, table), schema).withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
