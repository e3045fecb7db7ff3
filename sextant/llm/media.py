"""Media columns: payloads kept as WAV, short-time Fourier transforms, spectral-peak pair fingerprints."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Payloads are padded to a multiple of BLOCK; FRAME and HOP are those of the Fourier transform.
BLOCK = 576
FRAME = 288
HOP = 144
RATE = 8000
#: Bins of a frame's spectrum (0 to 144) in which one peak each is sought.
BANDS = ((1, 12), (12, 48), (48, 144))
#: Frames after an anchor in which its partners lie.
REACH = 2
#: Frames transformed at once, so that a long payload needs bounded memory.
CHUNK = 4096


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """``payload`` as the 8-bit mono samples of a WAV file."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        if w.getnchannels() != 1 or w.getsampwidth() != 1:
            raise ValueError("8-bit mono samples are expected")
        return w.readframes(w.getnframes())


def padded(raw: bytes, block: int = BLOCK) -> bytes:
    """``raw`` with bytes 255 after it, up to a positive multiple of ``block``."""
    return raw + b"\xff" * (max(1, -(-len(raw) // block)) * block - len(raw))


def peaks(samples: np.ndarray) -> np.ndarray:
    """For each frame the strongest bin of each band, -1 where the band is silent: (frames, bands)."""
    window = np.hanning(FRAME)
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    found = []
    for i in range(0, len(frames), CHUNK):
        power = np.abs(np.fft.rfft(frames[i : i + CHUNK] * window, axis=1))
        best = []
        for low, high in BANDS:
            part = power[:, low:high]
            top = part.argmax(axis=1)
            loud = part[np.arange(len(part)), top] > 1e-6
            best.append(np.where(loud, top + low, -1))
        found.append(np.stack(best, axis=1))
    return np.concatenate(found)


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """Time-coded pair hashes, ``frame << 32 | anchor bin << 20 | partner bin << 8 | distance``, in order."""
    top = peaks(samples)
    pairs = []
    for d in range(1, REACH + 1):
        if len(top) > d:
            a, b = top[:-d], top[d:]
            code = (np.arange(len(a), dtype=np.int64)[:, None] << 32) | (a.astype(np.int64) << 20) | (b.astype(np.int64) << 8) | d
            pairs.append(code[(a >= 0) & (b >= 0)])
    return np.sort(np.concatenate(pairs)) if pairs else np.empty(0, np.int64)


def media_column(df: DataFrame, key: str = "doc_id", text: str = "text", out: str = "media") -> DataFrame:
    """(key, n_bytes, ``out``): each text's UTF-8 bytes, padded, as a WAV file. A null text is empty."""
    small_batches(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [(x or "").encode() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array([to_wav(padded(x)) for x in raw], pa.binary())], [key, "n_bytes", out])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_bytes long, `{out}` binary")


def read_media(df: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """Reads stored WAV files back: (key, payload_bytes, payload_sha256, tail_crc32, peaks array<long>).

    ``peaks`` holds the time-coded fingerprint, empty where all frames are silent. A null medium gives nulls.
    """
    small_batches(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, sha, crc, print_ = [], [], [], []
            for x in b.column(1).to_pylist():
                if x is None:
                    for y in (size, sha, crc, print_):
                        y.append(None)
                    continue
                payload = from_wav(x)
                size.append(len(payload))
                sha.append(hashlib.sha256(payload).hexdigest())
                crc.append(zlib.crc32(payload[-32:]))
                print_.append(fingerprint(np.frombuffer(payload, np.uint8).astype(np.float32) - 128))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(sha, pa.string()), pa.array(crc, pa.int64()), pa.array(print_, pa.list_(pa.int64()))], [key, "payload_bytes", "payload_sha256", "tail_crc32", "peaks"])

    return df.select(key, media).mapInArrow(run, f"`{key}` {kind}, payload_bytes long, payload_sha256 string, tail_crc32 long, peaks array<long>")


def media_features(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Stores every text as a medium, reads it back and fingerprints it; one row for each row of ``df``.

    Null texts count as empty ones, very long texts are stored and transformed whole, in chunks of frames; rows that repeat,
    and rows with a null key, stay; an empty table gives an empty result; other columns are not read, whatever their names.
    """
    small_batches(df.sparkSession)
    stored = media_column(df, key, text)
    carried = stored.withColumn("_id", F.struct(key, "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256")))
    back = read_media(carried, "_id", "media")
    return back.select("_id.*", "payload_bytes", "payload_sha256", "tail_crc32", "peaks")
