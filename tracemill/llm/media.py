"""Media columns: texts or bytes as WAV files with spectral fingerprints.

A payload is stored as mono 8-bit samples by the wave module and read back from the stored file. The samples go through
a short-time Fourier transform (Hann window, half overlap); in each frame the strongest bins that exceed their
neighbours are peaks, and each peak is paired with the peaks of the next frames. A pair is one integer that holds its
two bins, their distance and the frame where it begins, so the array is ordered in time.

Cases: a null text is an empty one, whose payload is 64 zero bytes; equal texts give equal values; for the transform alone
a payload is padded with silence until whole frames cover it; a very long text is transformed in runs of frames; of bins of
equal strength the lower one is the peak; repeated rows have equal results; an empty table has no rows; all columns but the
text stay, those with the name of an output are replaced.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

RATE, UNIT, WINDOW, HOP, PEAKS, AHEAD, RUN = 8000, 64, 256, 128, 2, 2, 4096

#: What one row of the media table holds.
MEDIA = T.StructType().add("n_bytes", "long").add("payload_bytes", "long").add("payload_sha256", "string").add("tail_crc32", "long").add("media_bytes", "long").add("media_sha256", "string").add("n_frames", "long").add("fingerprint", T.ArrayType(T.LongType()))


def pad(data: bytes) -> bytes:
    """Zeros up to a positive multiple of UNIT."""
    return data + bytes(-len(data) % UNIT if data else UNIT)


def store(payload: bytes) -> bytes:
    """A WAV file whose 8-bit samples are the payload."""
    with wave.open(out := io.BytesIO(), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def load(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the PEAKS strongest local maxima of each frame (-1: none), and the number of frames."""
    x = samples.astype(np.float32) - 128
    x = np.pad(x, (0, max(WINDOW - len(x), 0) or -(len(x) - WINDOW) % HOP))
    frames = np.lib.stride_tricks.sliding_window_view(x, WINDOW)[::HOP]
    hann, found = np.hanning(WINDOW).astype(np.float32), []
    for at in range(0, len(frames), RUN):
        spectrum = np.abs(np.fft.rfft(frames[at : at + RUN] * hann, axis=1)).round(2)
        mid = spectrum[:, 1:-1]
        top = np.where((mid > spectrum[:, :-2]) & (mid >= spectrum[:, 2:]), mid, 0)
        best = []
        for _ in range(PEAKS):
            k = top.argmax(axis=1)
            best.append(np.where(top[np.arange(len(top)), k] > 0, k + 1, -1))
            top[np.arange(len(top)), k] = 0
        found.append(np.sort(np.stack(best, axis=1), axis=1))
    return np.concatenate(found), np.arange(len(frames))


def fingerprint(samples: np.ndarray) -> tuple[int, np.ndarray]:
    """The number of frames and the time-coded peak pairs: frame << 24 | first bin << 14 | second bin << 4 | distance."""
    bins, frame = peaks(samples)
    pairs = []
    for ahead in range(1, min(AHEAD, len(bins) - 1) + 1):
        a, b, t = bins[:-ahead], bins[ahead:], frame[:-ahead]
        for i in range(PEAKS):
            for j in range(PEAKS):
                ok = (a[:, i] >= 0) & (b[:, j] >= 0)
                pairs.append(t[ok] << 24 | a[ok, i] << 14 | b[ok, j] << 4 | ahead)
    return len(bins), np.unique(np.concatenate(pairs)).astype(np.int64) if pairs else np.zeros(0, np.int64)


def describe(data: bytes) -> tuple:
    media = store(pad(data))
    payload = load(media)
    frames, prints = fingerprint(np.frombuffer(payload, np.uint8))
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return len(data), len(payload), sha(payload), zlib.crc32(payload[-UNIT:]), len(media), sha(media), frames, prints


def media(docs: DataFrame, text: str = "text", drop_text: bool = True, keep_file: bool = False) -> DataFrame:
    """Add the columns of MEDIA, and with keep_file the WAV file itself as `media`."""

    def f(texts):
        rows = [describe(x.as_buffer().to_pybytes()) for x in texts.cast(pa.binary())]
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(MEDIA)
        out = [pa.array(c, pa.string() if isinstance(k.dataType, T.StringType) else pa.int64()) for c, k in zip(columns[:-1], MEDIA, strict=False)]
        at = np.cumsum([0, *map(len, columns[-1])]).astype(np.int32)
        out.append(pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(columns[-1]) if rows else [], pa.int64())))
        if keep_file:
            out.append(pa.array([store(pad(x.as_buffer().to_pybytes())) for x in texts.cast(pa.binary())], pa.binary()))
        return out

    added = T.StructType(list(MEDIA) + ([T.StructField("media", T.BinaryType())] if keep_file else []))
    return common.map_texts(docs, lambda: f, added, text, drop_text)


def feature(prints: str = "fingerprint", frames: str = "n_frames"):
    """A digest of the transform: frames, pairs, and a hash of the time-coded array."""
    return F.concat_ws(":", F.col(frames).cast("string"), F.size(prints).cast("string"), F.hex(F.xxhash64(prints)))
