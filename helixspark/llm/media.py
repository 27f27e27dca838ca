"""Media columns: WAV payloads, short-time Fourier transforms and spectral-peak pair fingerprints."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from helixspark.llm._common import as_bytes, id_text, pieces, stored, table

#: Bounds of the frequency bands, as bins; each band has at most one peak in a frame.
BANDS = ((1, 16), (16, 48), (48, 129))
FRAME, HOP, BLOCK = 256, 128, 1 << 12
#: Bytes of texts or WAVs that a step takes at once; a longer one stands alone.
CHUNK = 4_000_000


def pad(payload: bytes, unit: int = 64) -> bytes:
    """Bytes 0 are appended up to a positive multiple of the unit."""
    return payload + bytes(unit - len(payload) if len(payload) < unit else -len(payload) % unit)


def to_wav(samples: bytes, rate: int = 8000) -> bytes:
    """A mono WAV of unsigned 8-bit samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(samples)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


_WINDOW = np.hanning(FRAME).astype(np.float32)


def stft(samples: bytes) -> Iterator[np.ndarray]:
    """Magnitudes (frames x bins) of overlapping windows, a block of frames at a time, so that memory stays bounded."""
    x = np.frombuffer(samples, np.uint8)
    frames = max(1, -(-(len(x) - FRAME) // HOP) + 1)
    for a in range(0, frames, BLOCK):
        n = min(BLOCK, frames - a)
        part = x[a * HOP : (a + n - 1) * HOP + FRAME].astype(np.float32) - 128
        part = np.pad(part, (0, (n - 1) * HOP + FRAME - len(part)))
        yield np.abs(np.fft.rfft(np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP] * _WINDOW, axis=1)).astype(np.float32)


def peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Per frame and band the bin of the largest magnitude, and whether it stands over twice the frame's mean."""
    bins, strong = [], []
    for m in stft(samples):
        at = np.stack([m[:, a:b].argmax(axis=1) + a for a, b in BANDS], axis=1)
        bins.append(at)
        strong.append(np.take_along_axis(m, at, 1) > 2 * m.mean(axis=1, keepdims=True))
    return np.concatenate(bins), np.concatenate(strong)


def fingerprint(samples: bytes, reach: int = 3) -> np.ndarray:
    """Pairs of a peak and the same band's peaks up to ``reach`` frames later: time << 32 | bin << 16 | bin << 8 | distance."""
    bins, strong = peaks(samples)
    out = []
    for d in range(1, reach + 1):
        t, band = np.nonzero(strong[:-d] & strong[d:])
        out.append(t << 32 | bins[t, band] << 16 | bins[t + d, band] << 8 | d)
    return np.sort(np.concatenate(out)).astype(np.int64)


def wav_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, media``: each text's UTF-8, padded, as a WAV, and its length before that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(1))
            for a, b in pieces(map(len, texts), CHUNK):
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array([len(x) for x in texts[a:b]], pa.int64()), pa.array([to_wav(pad(x)) for x in texts[a:b]], pa.binary())], ["doc_id", "n_bytes", "media"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, n_bytes bigint, media binary")


def features(media: DataFrame, keep: tuple[str, ...] = ("media", "fingerprint")) -> DataFrame:
    """Digests of stored WAVs (``doc_id, n_bytes, media``), and of ``keep`` the WAV itself and its time-coded pairs."""
    more = {"media": "binary", "fingerprint": "array<bigint>"}
    schema = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, n_pairs bigint" + "".join(f", {k} {more[k]}" for k in keep)
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), *({"media": pa.binary(), "fingerprint": pa.list_(pa.int64())}[k] for k in keep)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.binary_length(batch.column(2)).to_pylist()
            for a, b in pieces(sizes, CHUNK):
                rows = []
                for wav in batch.column(2)[a:b].to_pylist():
                    got = from_wav(wav)
                    pairs = fingerprint(got)
                    code = hashlib.sha256(pairs.astype("<i8").tobytes()).hexdigest()
                    rows.append((len(got), hashlib.sha256(got).hexdigest(), zlib.crc32(got[-64:]), len(wav), hashlib.sha256(wav).hexdigest(), f"{len(pairs)}:{code}", len(pairs), *({"media": wav, "fingerprint": pairs}[k] for k in keep)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], *(pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], [x.split()[0] for x in schema.split(", ")])

    return media.mapInArrow(run, schema)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ("media", "fingerprint")) -> DataFrame:
    """A row per input row: digests, and of ``keep`` the WAV itself and its time-coded pairs.

    The WAVs are written to the shared folder as a column of a table; all else is computed from what is read back. A null text
    counts as empty and gives 64 bytes 0; a null id stays null; repeated rows give repeated results; a text of any length is
    read whole (frames go by in blocks). Ties between peaks go to the lower bin. An empty table gives none.
    """
    return features(stored(wav_column(docs, id_col, text_col), "media"), keep)


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"), keep=())


QUERIES = {"op1_media_columns": op1_media_columns}
SQL: dict[str, str] = {}
