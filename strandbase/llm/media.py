"""Media columns: payloads stored as WAV sound, read back, and fingerprinted by spectral-peak pairs.

A payload is written by the wave module as 8-bit mono samples and read back by it. Short-time Fourier
transforms of the samples give a magnitude picture; a bin is a peak if it is the greatest of its band in its
frame and stands out from the frame's mean. Frames overlap, and the first one begins `LEAD` samples before the
payload, so that every sample stands near the middle of some frame's window. Each peak is paired with the next
`FAN` peaks, those of its own frame first, up to `REACH` frames later; a pair's code holds both bins and the time
between, and its time code is its first peak's frame. The arrays of time codes and codes are columns.

Defined cases: a null text is an empty payload, padded to 64 zero bytes; silent payloads (all samples 128) have
no pairs; of equally high bins the lowest is the peak; equal payloads have equal values, so repeated rows do; a
very long payload is transformed in blocks of frames; an empty table gives no rows; extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

UNIT = 64
RATE = 8000
FRAME, HOP = 512, 128
LEAD = FRAME - HOP
#: Edges of the bands of frequency bins that give one peak each in a frame.
BANDS = (1, 8, 24, 64, 128, 257)
#: Frames behind a peak in which it is paired (1536 samples), and with how many peaks there.
REACH, FAN = 12, 4
#: Frames transformed at once.
BLOCK = 2048


def payload_of(text: bytes | None) -> bytes:
    """The text's bytes with zero bytes up to a positive multiple of UNIT."""
    text = text or b""
    return text + bytes(max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def to_wav(payload: bytes) -> bytes:
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


_WINDOW = np.hanning(FRAME).astype(np.float32)


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames and bins of the spectral peaks, ascending by frame, then bin."""
    n = max(1, -(-(len(samples) + LEAD) // HOP))
    frames_found, bins_found = [], []
    for k in range(0, n, BLOCK):
        m = min(BLOCK, n - k)
        part = np.zeros((m - 1) * HOP + FRAME, np.float32)
        begin = k * HOP - LEAD  # where part stands in samples
        piece = samples[max(0, begin) : begin + len(part)]
        part[max(0, -begin) : max(0, -begin) + len(piece)] = piece.astype(np.float32) - 128.0
        framed = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP]
        size = np.abs(np.fft.rfft(framed * _WINDOW, axis=1)).astype(np.float32)
        limit = 2.0 * size.mean(axis=1)
        best = np.stack([lo + size[:, lo:hi].argmax(axis=1) for lo, hi in zip(BANDS, BANDS[1:], strict=False)], axis=1)
        tall = np.take_along_axis(size, best, axis=1) > limit[:, None]
        rows, cols = np.nonzero(tall)
        frames_found.append(rows + k)
        bins_found.append(best[rows, cols])
    return np.concatenate(frames_found), np.concatenate(bins_found)


def pairs(frames: np.ndarray, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Time codes and codes of all pairs of a peak with the next FAN peaks that are at most REACH frames behind it."""
    at = np.arange(len(frames))
    end = np.minimum(np.searchsorted(frames, frames + REACH, side="right"), at + 1 + FAN)
    n = end - at - 1
    first = np.repeat(at, n)
    second = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first + 1
    codes = (bins[first] << 13) | (bins[second] << 4) | (frames[second] - frames[first])
    return frames[first].astype(np.int32), codes.astype(np.int32)


def _make() -> Callable:
    def one(text: bytes | None) -> tuple:
        stored = to_wav(payload_of(text))
        payload = from_wav(stored)
        times, codes = pairs(*peaks(np.frombuffer(payload, np.uint8)))
        return len(text or b""), stored, payload, times, codes

    return lambda texts: (one(t) for t in texts)  # one text's arrays at a time


def _columns(full: bool) -> Callable:
    def make() -> Callable:
        one = _make()

        def f(texts: list[bytes | None]) -> list[list]:
            out = []
            for n, stored, payload, times, codes in one(texts):
                digest = hashlib.sha1(times.astype("<i4").tobytes() + codes.astype("<i4").tobytes()).hexdigest()
                row = (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(stored), hashlib.sha256(stored).hexdigest(), f"{len(codes)}:{digest}")
                out.append((*row, times, codes, stored) if full else (*row, times, codes))
            return [list(c) for c in zip(*out, strict=True)]

        return f

    return make


DIGESTS = [
    ("n_bytes", T.LongType()), ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()),
    ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType()),
]
ARRAYS = [("times", T.ArrayType(T.IntegerType())), ("codes", T.ArrayType(T.IntegerType()))]
MEDIA = [("media", T.BinaryType())]


def media_columns(df: DataFrame, keep: list[str], text: str = "text", full: bool = True) -> DataFrame:
    """Columns `keep`, digests, the time-coded arrays and with `full` the WAV bytes of every row."""
    return common.per_row(df, _columns(full), DIGESTS + ARRAYS + MEDIA * full, keep, text)


def query(spark, sf_dir: str) -> DataFrame:
    return media_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"], full=False)
