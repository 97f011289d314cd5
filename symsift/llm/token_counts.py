"""Token counts per section by offset mapping (operator 8).

A document is encoded once, as a whole; the tokens' character spans are then
joined with the sections' spans.  A token that lies across a boundary is
allocated by ``rule``: ``start`` gives it to the section of its first
character, ``end`` to that of its last, ``most`` to the one that holds most of
its characters (ties: the earlier), so counts always add up to the document's.
A token that begins inside a character counts as beginning with it.

Sections are stretches that end after ``separator``, which together cover the
text.  Null and empty texts have one empty section with no token.  doc_id may
be null or repeated; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import encoder, read_ranks, special_tokens

RULES = ("start", "end", "most")


def token_sizes(path: str) -> np.ndarray:
    """Bytes of each id."""
    sizes = {i: len(b) for b, i in read_ranks(path).items()} | {i: len(s.encode()) for s, i in special_tokens(path).items()}
    out = np.zeros(max(sizes) + 1, np.int64)
    out[list(sizes)] = list(sizes.values())
    return out


def allocate(first: np.ndarray, last: np.ndarray, begins: np.ndarray, rule: str) -> np.ndarray:
    """Section of each token; first, last: its characters, last inclusive; begins: first characters of the sections."""
    a = np.searchsorted(begins, first, side="right") - 1
    if rule == "start":
        return a
    b = np.searchsorted(begins, last, side="right") - 1
    if rule == "end":
        return b
    best, most = a.copy(), np.zeros(len(a), np.int64)
    ends = np.append(begins[1:], np.iinfo(np.int64).max)
    for s in range(int((b - a).max(initial=0)) + 1):
        at = np.minimum(a + s, b)
        share = np.minimum(last + 1, ends[at]) - np.maximum(first, begins[at])
        better = share > most
        best[better], most[better] = at[better], share[better]
    return best


def count_rows(batches: Iterator[pa.RecordBatch], path: str, separator: str, rule: str) -> Iterator[pa.RecordBatch]:
    enc, size_of = encoder(path), token_sizes(path)
    mark = np.frombuffer(separator.encode("utf-32-le"), np.uint32)
    for batch in batches:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        for at, ids, cut in enc.encode(texts):
            part = texts[at : at + len(cut) - 1]
            data = np.frombuffer("".join(part).encode("utf-8", "surrogatepass"), np.uint8)
            chars = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32)
            lens = np.array([len(t) for t in part], np.int64)
            marks = np.cumsum(lens) - lens
            char_of = np.cumsum((data & 0xC0) != 0x80) - 1
            stop = np.cumsum(size_of[ids])
            first, last = (char_of[stop - size_of[ids]], char_of[stop - 1]) if len(ids) else (stop, stop)
            hit = np.ones(max(0, len(chars) - len(mark) + 1), bool)
            for i, m in enumerate(mark):
                hit &= chars[i : i + len(hit)] == m
            after = np.flatnonzero(hit) + len(mark)
            owner = np.searchsorted(marks + lens, after, side="left")  # a stretch that ends a text opens no other
            after = after[(owner < len(part)) & (after < (marks + lens)[np.minimum(owner, len(part) - 1)])]
            if len(mark) > 1:  # not across texts, and no overlaps
                own = np.searchsorted(marks, after - len(mark), side="right") == np.searchsorted(marks, after - 1, side="right")
                keep, free = [], 0
                for x in after[own].tolist():
                    if x - len(mark) >= free:
                        keep.append(x)
                        free = x
                after = np.array(keep, np.int64)
            begins = np.sort(np.concatenate([marks, after]))  # an empty text's section sorts before the next text's
            place = np.arange(len(marks))
            fresh = np.concatenate([[True], marks[1:] != marks[:-1]])
            doc = np.searchsorted(begins, marks, side="left") + place - np.maximum.accumulate(np.where(fresh, place, 0))
            section = allocate(first, last, begins, rule)
            n = np.bincount(section, minlength=len(begins))
            of = np.searchsorted(doc, np.arange(len(begins)), side="right") - 1
            ends = np.append(begins[1:], len(chars))
            yield pa.record_batch(
                [batch.column(0).slice(at, len(part)).take(pa.array(of)), pa.array((np.arange(len(begins)) - doc[of]).astype(np.int32)), pa.array(begins - marks[of]), pa.array(ends - marks[of]), pa.array(n.astype(np.int64))],
                ["id", "section", "char_start", "char_end", "n_tokens"],
            )


def count_tokens(docs: DataFrame, tokenizer: str, separator: str = "\n", rule: str = "start", text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per section: id_col, section, char_start, char_end (exclusive), n_tokens."""
    if rule not in RULES or not separator:
        raise ValueError(f"rule: one of {RULES}; separator: not empty")
    src = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    out = src.mapInArrow(lambda b: count_rows(b, tokenizer, separator, rule), f"id {kind}, section int, char_start long, char_end long, n_tokens long")
    return out.withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
