"""Media columns: WAV storage, short-time spectra and peak-pair fingerprints (operator 6).

A text's UTF-8 bytes, filled up with blanks to a positive multiple of ``BLOCK``,
are the 8-bit samples of a mono WAV file written and read by the wave module.
Half-overlapping frames go through a windowed Fourier transform; in each of
three bands the strongest bin is a peak where it stands out over its
neighbours in time; each peak is paired with the next ``FAN`` ones.  A pair's
code holds both bins and their distance; codes and frame numbers are stored as
two arrays in order of time.

Null texts count as empty (one block of blanks).  Everything depends on the
text alone, so equal texts get equal values.  ids may be null or repeated;
other columns are ignored.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK, RATE = 192, 8000
FRAME, HOP = 192, 96
BANDS = ((2, 16), (16, 40), (40, 97))
FAN, REACH, NEAR = 3, 63, 2
FRAMES_AT_ONCE = 8192
_WINDOW = np.hanning(FRAME).astype(np.float32)


def to_wav(data: bytes) -> bytes:
    payload = data + b" " * (-len(data) % BLOCK or (0 if data else BLOCK))
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as w:
        return w.readframes(w.getnframes())


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frame, bin) of the spectral peaks, in order."""
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    n = len(frames)
    bins, height = np.empty((n, len(BANDS)), np.int64), np.empty((n, len(BANDS)), np.float32)
    for lo in range(0, n, FRAMES_AT_ONCE):
        part = (frames[lo : lo + FRAMES_AT_ONCE].astype(np.float32) - 128) * _WINDOW
        spectrum = np.abs(np.fft.rfft(part, axis=1))
        for b, (i, j) in enumerate(BANDS):
            at = spectrum[:, i:j].argmax(axis=1)
            bins[lo : lo + len(part), b] = at + i
            height[lo : lo + len(part), b] = np.take_along_axis(spectrum[:, i:j], at[:, None], 1)[:, 0]
    high = np.ones((n, len(BANDS)), bool)
    for d in range(1, min(NEAR, n - 1) + 1):  # ties: the earlier
        high[d:] &= height[d:] > height[:-d]
        high[:-d] &= height[:-d] >= height[d:]
    t, b = np.nonzero(high)
    return t, bins[t, b]


def fingerprint(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(frame numbers, codes) of the peak pairs, by frame, then code."""
    t, f = peaks(np.frombuffer(payload, np.uint8))
    times, codes = [], []
    for k in range(1, FAN + 1):
        gap = t[k:] - t[:-k]
        ok = gap <= REACH
        times.append(t[:-k][ok])
        codes.append((f[:-k][ok] << 16) | (f[k:][ok] << 8) | gap[ok])
    time, code = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((code, time))
    return time[order].astype(np.int32), code[order].astype(np.int32)


def media_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 200):
            part = batch.slice(lo, 200)
            rows = []
            for t in part.column(1):
                data = (t.as_py() or "").encode("utf-8", "surrogatepass")
                stored = to_wav(data)
                payload = from_wav(stored)
                rows.append((len(data), stored, payload, *fingerprint(payload)))
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.record_batch([part.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], ["id", "n_bytes", "media", "payload", "fp_time", "fp_code"])


def to_media(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id_col, n_bytes, media (WAV file), payload (read back), fp_time, fp_code."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    out = src.mapInArrow(media_rows, f"id {kind}, n_bytes long, media binary, payload binary, fp_time array<int>, fp_code array<int>")
    return out.withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    m = to_media(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return m.select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -16, 16)")).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.size("fp_code"), F.hex(F.xxhash64("fp_time", "fp_code"))).alias("feature"),
    )
