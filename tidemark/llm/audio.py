"""Media columns: audio features as fixed-shape tensors with time spans.

8-bit mono WAV in, features out: polyphase resampling by a windowed-sinc filter, overlapped frames, log-mel
filterbanks, and energy segments by hysteresis (a segment holds every frame above the low threshold that touches
one above the high threshold).  The log-mel matrix is cut into windows of a fixed number of frames and stored as
one Arrow fixed-shape-tensor column with the time span of each window, in Arrow's IPC format.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import map_batches

RATE_IN, RATE_OUT = 16_000, 8_000
FRAME, HOP, N_FFT, MELS = 200, 80, 256, 40
WINDOW_FRAMES = 64
HIGH_DB, LOW_DB = 6.0, 3.0
PAD_TO, PAD_BYTE = 576, b"\xff"
_BLOCK = 4096


def to_wav(payload: bytes, rate: int = RATE_IN) -> bytes:
    """The payload as unsigned 8-bit mono PCM, one sample a byte: lossless."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(1), w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> tuple[bytes, int]:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes()), w.getframerate()


@lru_cache(maxsize=8)
def _sinc(up: int, down: int, half: int = 10) -> np.ndarray:
    cut = max(up, down)
    n = np.arange(-half * cut, half * cut + 1)
    return (np.sinc(n / cut) * np.hamming(len(n)) * up / cut).astype(np.float32)


def resample(x: np.ndarray, up: int, down: int) -> np.ndarray:
    """Polyphase resampling by up/down: only the filter taps that meet a sample are applied, phase by phase."""
    h = _sinc(up, down)
    centre = len(h) // 2
    n_out = -(-len(x) * up // down)
    reach = centre // up + 2
    padded = np.concatenate([np.zeros(reach, np.float32), x, np.zeros(reach + down, np.float32)])
    y = np.zeros(n_out, np.float32)
    for first in range(min(up, n_out)):  # outputs first, first + up, ... share one phase and step `down` samples
        at = first * down + centre
        count = len(range(first, n_out, up))
        phase, top = at % up, at // up
        mine = np.zeros(count, np.float32)
        for k, tap in enumerate(h[phase::up]):
            lo = top - k + reach
            mine += tap * padded[max(lo, 0) :: down][:count] if lo >= 0 else 0
        y[first::up] = mine
    return y


@lru_cache(maxsize=4)
def _mel(rate: int) -> np.ndarray:
    """Triangular filters, evenly spaced on the mel scale: (bins, MELS)."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, MELS + 2) / 2595) - 1)
    f = np.linspace(0, rate / 2, N_FFT // 2 + 1)[:, None]
    up, down = (f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


def log_mel(x: np.ndarray, rate: int = RATE_OUT) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel frames (n, MELS) as float16 and the energy of each frame in dB; blocks bound the memory."""
    if len(x) < FRAME:
        x = np.concatenate([x, np.zeros(FRAME - len(x), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    hann = np.hanning(FRAME).astype(np.float32)
    mel, db = [], []
    for lo in range(0, len(frames), _BLOCK):
        part = frames[lo : lo + _BLOCK] * hann
        spec = np.fft.rfft(part, N_FFT, axis=1)
        power = spec.real**2 + spec.imag**2
        mel.append(np.log(power.astype(np.float32) @ _mel(rate) + 1e-6).astype(np.float16))
        db.append(10 * np.log10((part * part).mean(1) + 1e-9))
    return np.concatenate(mel), np.concatenate(db)


def segments(db: np.ndarray, high: float = HIGH_DB, low: float = LOW_DB) -> list[tuple[int, int]]:
    """Runs [start, end) of frames above floor + low that hold one above floor + high; floor: 10th percentile."""
    floor = np.percentile(db, 10)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], db > floor + low, [False]]).astype(np.int8)))
    loud = np.concatenate([[0], np.cumsum(db > floor + high)])
    return [(int(a), int(b)) for a, b in edge.reshape(-1, 2) if loud[b] > loud[a]]


ROW = "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 n_frames segments tensors media".split()
_TENSOR = pa.fixed_shape_tensor(pa.float16(), [WINDOW_FRAMES, MELS])


def tensor_bytes(mel: np.ndarray) -> bytes:
    """Windows of WINDOW_FRAMES frames (the last one filled with zeros) with their time spans, as Arrow IPC."""
    windows = -(-len(mel) // WINDOW_FRAMES)
    full = np.zeros((windows * WINDOW_FRAMES, MELS), np.float16)
    full[: len(mel)] = mel
    cells = pa.array(full.ravel())
    tensors = pa.ExtensionArray.from_storage(_TENSOR, pa.FixedSizeListArray.from_arrays(cells, WINDOW_FRAMES * MELS))
    start = np.arange(windows) * WINDOW_FRAMES * HOP / RATE_OUT
    end = (np.minimum(np.arange(1, windows + 1) * WINDOW_FRAMES, len(mel)) - 1) * HOP / RATE_OUT + FRAME / RATE_OUT
    batch = pa.RecordBatch.from_arrays([pa.array(start), pa.array(end), tensors], names=["start_s", "end_s", "log_mel"])
    out = io.BytesIO()
    with pa.ipc.new_stream(out, batch.schema) as w:
        w.write_batch(batch)
    return out.getvalue()


def read_tensors(stored: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The inverse of tensor_bytes: time spans (windows, 2) and tensors (windows, WINDOW_FRAMES, MELS)."""
    with pa.ipc.open_stream(stored) as r:
        t = r.read_all().combine_chunks()
    spans = np.stack([t["start_s"].to_numpy(), t["end_s"].to_numpy()], 1)
    return spans, t["log_mel"].chunk(0).to_numpy_ndarray()


def features(media: bytes) -> tuple[bytes, list[tuple[float, float]], int]:
    """Tensor column, energy segments in seconds and number of frames of one 8-bit mono WAV."""
    payload, rate = from_wav(media)
    x = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128
    common = np.gcd(rate, RATE_OUT)
    mel, db = log_mel(resample(x, RATE_OUT // common, rate // common))
    return tensor_bytes(mel), [(a * HOP / RATE_OUT, ((b - 1) * HOP + FRAME) / RATE_OUT) for a, b in segments(db)], len(mel)


def pack_text(text: str | None) -> tuple[int, bytes]:
    """UTF-8 length, and the bytes filled with 255 up to a positive multiple of 576."""
    raw = (text or "").encode()
    return len(raw), raw + PAD_BYTE * (max(PAD_TO, -(-len(raw) // PAD_TO) * PAD_TO) - len(raw))


def media_columns(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", media: bool = True) -> DataFrame:
    """Store every whole text as a WAV, read it back and compute its features.  One pass, no shuffle.

    Rows ``doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, n_frames,
    segments (array of start and end in s), tensors (Arrow IPC)`` and, if asked for, ``media``.  A null text counts
    as empty.  Everything is computed from the single text, so equal texts give equal values; null ids and repeated
    rows pass through; no other columns are read.
    """
    schema = (
        "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, "
        "media_sha256 string, n_frames bigint, segments array<struct<start_s: double, end_s: double>>, tensors binary"
    ) + ", media binary" * media

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {c: [] for c in ROW}
        for text in batch.column(1).to_pylist():
            n, payload = pack_text(text)
            stored = to_wav(payload)
            back, _ = from_wav(stored)
            tensors, spans, frames = features(stored)
            row = {
                "n_bytes": n, "payload_bytes": len(back), "payload_sha256": hashlib.sha256(back).hexdigest(), "tail_crc32": zlib.crc32(back[-32:]), "media_bytes": len(stored),
                "media_sha256": hashlib.sha256(stored).hexdigest(), "n_frames": frames, "segments": [{"start_s": a, "end_s": b} for a, b in spans], "tensors": tensors,
            }
            for k, v in row.items():
                out[k].append(v)
            if media:
                out["media"].append(stored)
        span = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
        kinds = {"segments": span, "tensors": pa.binary(), "media": pa.binary()} | {k: pa.int64() for k in ("n_bytes", "payload_bytes", "tail_crc32", "media_bytes", "n_frames")}
        return {k: batch.column(0) if k == "doc_id" else pa.array(v, kinds.get(k, pa.string())) for k, v in out.items() if media or k != "media"}

    names = [c for c in ROW if c != "media" or media]
    return map_batches(docs.selectExpr(f"cast(`{id_col}` as bigint) id", f"`{text_col}` text"), run, schema, names)
