"""Language ID by compression (operator 7).

For each language a raw-content zstandard dictionary is filled with whole
sample texts.  A text, in lower case, is cut into stretches of ``STRETCH``
bytes, all of which are compressed with every dictionary, each by itself, so
that a long text can't feed on its own content; the language with the smallest
sum wins.  The score is ``1 - smallest / second smallest``; a text of at least
``EVIDENCE`` bytes whose score is below ``min_margin`` is rejected, a shorter one
only on an exact tie (a few words compress to too few bytes for their margin to
say more).

Learning takes a bounded sample: at most ``sample_docs`` different texts per
language, in order of a hash, until ``dict_bytes`` are full.  Of a text over
``sample_chars`` characters so many from its first letter on are taken.  Every
label is learned: with so many that their dictionaries would pass ``model_bytes``
each gets an equal part of it.  Shares are taken of different texts, so copies of
one text take no places.

Null texts and texts without a letter are ``und`` with score 0 and rejected.
With one language learned the score is 1, with none every text is ``und``.
Ties go to the language that sorts first.  Repeated rows get equal results.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import released

STRETCH, LEVEL, EVIDENCE = 1024, 6, 256
MIN_MARGIN = 0.015


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", sample_docs: int = 300, sample_chars: int = 6000, dict_bytes: int = 96 << 10, model_bytes: int = 64 << 20) -> dict[str, bytes]:
    """lang -> dictionary content."""
    rows = labelled.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    from_letter = F.regexp_replace("text", r"^\P{L}+", "")  # a cut keeps a letter
    rows = rows.withColumn("text", F.when(F.length("text") > sample_chars, F.substring(from_letter, 1, sample_chars)).otherwise(F.col("text")))
    different = rows.select("lang", F.xxhash64("text").alias("h")).distinct()
    counts = different.groupBy("lang").count().collect()  # a row for each label
    if not counts:
        return {}
    dict_bytes = min(dict_bytes, model_bytes // len(counts))
    sample_docs = min(sample_docs, dict_bytes)  # a text has a byte at least
    place = F.xxhash64("text").bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)
    share = F.create_map(*(x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, 1.3 * sample_docs / r["count"])))))
    found = defaultdict(set)
    for r in rows.select("lang", "text", place.alias("place")).where(F.col("place") < share[F.col("lang")]).distinct().collect():  # about 1.3 * sample_docs each
        found[r["lang"]].add((r["place"], r["text"]))
    out = {}
    for name, texts in found.items():
        data = b""
        for _, t in sorted(texts)[:sample_docs]:
            if len(data) >= dict_bytes:
                break
            data += t.lower().encode("utf-8", "surrogatepass") + b"\n"
        out[name] = data[:dict_bytes]
    return out


@functools.lru_cache(maxsize=4)
def compressors(model: tuple[tuple[str, bytes], ...]) -> list[zstandard.ZstdCompressor]:
    out = []
    for _, data in model:
        content = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        how = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, source_size=STRETCH, dict_size=len(data), min_match=4, strategy=zstandard.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False
        )
        content.precompute_compress(compression_params=how)
        out.append(zstandard.ZstdCompressor(dict_data=content, compression_params=how))
    return out


def predict_rows(batches: Iterator[pa.RecordBatch], model: tuple[tuple[str, bytes], ...], min_margin: float) -> Iterator[pa.RecordBatch]:
    packers = compressors(model)
    names = [n for n, _ in model]
    for batch in batches:
        langs, scores, rejected = [], [], []
        for text, ok in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if not ok or not names:
                langs.append("und")
                scores.append(0.0)
                rejected.append(True)
                continue
            data = text.lower().encode("utf-8", "surrogatepass")
            parts = [data[i : i + STRETCH] for i in range(0, len(data), STRETCH)]
            sizes = [sum(len(pack(p)) for p in parts) for pack in (c.compress for c in packers)]
            order = sorted(range(len(names)), key=lambda i: (sizes[i], names[i]))
            langs.append(names[order[0]])
            scores.append(1 - sizes[order[0]] / sizes[order[1]] if len(order) > 1 else 1.0)
            rejected.append(scores[-1] < min_margin if len(data) >= EVIDENCE else scores[-1] == 0)
        yield pa.record_batch([*(batch.column(i) for i in range(3, batch.num_columns)), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], [*batch.schema.names[3:], "lang_pred", "score", "rejected"])


def identify(docs: DataFrame, model: dict[str, bytes], keep: dict[str, Column], text: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """The columns of ``keep`` with lang_pred, score and rejected, for every row of docs."""
    body = F.col(text).cast("string")
    src = docs.select(F.lit(0).alias("_"), body.alias("_text"), F.coalesce(body.rlike(r"\p{L}"), F.lit(False)).alias("_ok"), *(c.alias(f"k{i}") for i, c in enumerate(keep.values())))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[3:])
    fixed = tuple(sorted(model.items()))
    out = src.mapInArrow(lambda b: released(predict_rows(b, fixed, min_margin)), f"{kinds}, lang_pred string, score double, rejected boolean")
    return out.select(*(F.col(f"k{i}").alias(name) for i, name in enumerate(keep)), "lang_pred", "score", F.col("rejected"))


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves 2 modulo 4; a null id is held in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train_rows(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(train_rows(docs))
    return identify(docs, model, {"doc_id": F.col("doc_id"), "held_out": held_out(F.col("doc_id"))})
