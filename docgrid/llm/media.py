"""Media columns: texts as WAV audio, short-time Fourier transforms and spectral-peak pair fingerprints.

A payload is stored as mono 8-bit samples by the ``wave`` module and read back by it.  Frames of the samples are
transformed, each frame keeps its strongest peaks, and every peak is paired with peaks of the next frames.  A
fingerprint is two parallel arrays: the anchor's frame number and the packed pair (bin, later bin, frames between).
"""

from __future__ import annotations

import hashlib
import io
import struct
import wave
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

UNIT = 192
RATE = 8000
PEAKS = 2
FAN = 3
FRAMES = 4096


def padded(data: bytes) -> bytes:
    """The bytes and as many spaces as make a positive multiple of 192."""
    return data + b" " * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("not mono 8-bit audio")
        return w.readframes(w.getnframes())


WINDOW = np.hanning(UNIT).astype(np.float32)


def peaks(samples: bytes, block: int = FRAMES) -> np.ndarray:
    """Bins of the ``PEAKS`` strongest spectral lines of each frame, by bin number; frames are taken in blocks."""
    x = np.frombuffer(samples, np.uint8).reshape(-1, UNIT)
    out = np.empty((len(x), PEAKS), np.int64)
    for s in range(0, len(x), block):
        frames = x[s : s + block].astype(np.float32)
        frames -= frames.mean(axis=1, keepdims=True)
        power = np.abs(np.fft.rfft(frames * WINDOW, axis=1))[:, 1:]
        # whole steps make equal texts give equal peaks on any machine, ties going to the lower bin
        level = np.round(power).astype(np.int64) * 128 + np.arange(power.shape[1] - 1, -1, -1)
        top = np.argpartition(level, -PEAKS, axis=1)[:, -PEAKS:]
        out[s : s + block] = np.sort(top, axis=1) + 1
    return out


def fingerprint(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers and packed peak pairs, ordered by time then pair."""
    top = peaks(samples)
    n = len(top)
    times, pairs = [], []
    for gap in range(1, FAN + 1):
        if n <= gap:
            break
        a, b = top[:-gap], top[gap:]
        packed = (a[:, :, None] << 16 | b[:, None, :] << 8 | gap).reshape(n - gap, -1)
        times.append(np.repeat(np.arange(n - gap), packed.shape[1]))
        pairs.append(packed.ravel())
    if not times:
        return np.empty(0, np.int32), np.empty(0, np.int32)
    t, p = np.concatenate(times), np.concatenate(pairs)
    order = np.lexsort((p, t))
    return t[order].astype(np.int32), p[order].astype(np.int32)


def media_row(text: str | None) -> dict:
    """Everything about one text: the media bytes, what was read back from them, and the fingerprint arrays."""
    data = (text or "").encode()
    media = to_wav(padded(data))
    back = from_wav(media)
    t, p = fingerprint(back)
    return {"n_bytes": len(data), "media": media, "payload": back, "times": t, "pairs": p}


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, media (WAV), fp_time array<int>, fp_pair array<int>.

    Null and empty texts are one frame of spaces, whose fingerprint is empty; repeated rows stay; an empty table gives
    an empty result; other columns are ignored.
    """

    def make():
        def apply(c):
            rows = [media_row(t) for t in c["text"]]
            return {"doc_id": c["doc_id"], "n_bytes": [r["n_bytes"] for r in rows], "media": [r["media"] for r in rows], "fp_time": [r["times"] for r in rows], "fp_pair": [r["pairs"] for r in rows]}

        return apply

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(rows, make, f"doc_id {kind}, n_bytes long, media binary, fp_time array<int>, fp_pair array<int>")


def media_digest(media: DataFrame) -> DataFrame:
    """The digest columns of a media table: what the stored bytes decode to, and a hash of the fingerprint arrays."""

    def make():
        def apply(c):
            back = [from_wav(m) for m in c["media"]]
            arrays = [(t.values.to_numpy(), p.values.to_numpy()) for t, p in zip(c["fp_time"], c["fp_pair"], strict=True)]
            told = [hashlib.sha256(struct.pack("<q", len(t)) + t.astype("<i4").tobytes() + p.astype("<i4").tobytes()).hexdigest() for t, p in arrays]
            return {
                "doc_id": c["doc_id"],
                "n_bytes": c["n_bytes"],
                "payload_bytes": [len(b) for b in back],
                "payload_sha256": [hashlib.sha256(b).hexdigest() for b in back],
                "tail_crc32": [zlib.crc32(b[-16:]) for b in back],
                "media_bytes": [len(m) for m in c["media"]],
                "media_sha256": [hashlib.sha256(m).hexdigest() for m in c["media"]],
                "feature": [f"{len(t)}:{h}" for (t, _), h in zip(arrays, told, strict=True)],
            }

        return apply

    kind = media.schema["doc_id"].dataType.simpleString()
    return map_rows(media, make, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", raw=("fp_time", "fp_pair"))
