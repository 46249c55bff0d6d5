"""Audio columns: lossless 8-bit PCM, and log-mel features stored as fixed-shape Arrow tensors with time spans."""

from __future__ import annotations

import hashlib
import io
import struct
import wave
import zlib
from collections.abc import Iterator
from functools import lru_cache
from math import gcd

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from babelshelf.llm.common import cut, shared_path

STORED_RATE = 16_000
RATE = 8_000
FRAME, HOP, FFT = 256, 160, 256
MELS = 16
#: Frames in one tensor.
SPAN_FRAMES = 16
TAPS = 16
#: Segments open above the median energy by ON decibels and close below it by OFF.
ON_DB, OFF_DB = 1.5, 1.5
UNIT = 64
#: Frames transformed at once, which bounds the memory for very long payloads.
BLOCK_FRAMES = 4096
TENSOR = pa.fixed_shape_tensor(pa.float16(), (SPAN_FRAMES, MELS))
_FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, spans array<struct<start_s:double,end_s:double>>, tensor_file string, first_tensor long, n_tensors long, tensor_crc32 long"


def encode_wav(raw: bytes, rate: int = STORED_RATE) -> bytes:
    """The bytes, with zeros up to a positive multiple of 64, as the samples of a mono 8-bit PCM file."""
    payload = raw + bytes(-len(raw) % UNIT or (UNIT if not raw else 0))
    n = len(payload)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", n) + payload


def decode_wav(media: bytes) -> tuple[bytes, int]:
    """Samples and rate of a mono 8-bit file."""
    with wave.open(io.BytesIO(media)) as f:
        if (f.getnchannels(), f.getsampwidth()) != (1, 1):
            raise ValueError("mono 8-bit samples expected")
        return f.readframes(f.getnframes()), f.getframerate()


@lru_cache(8)
def polyphase_filter(up: int, down: int, taps: int = TAPS) -> np.ndarray:
    """(up, taps): a windowed sinc at the lower of both Nyquist rates, one row for each phase."""
    n = up * taps
    t = np.arange(n) - (n - 1) / 2
    cutoff = 1 / max(up, down)
    h = cutoff * np.sinc(cutoff * t) * np.hamming(n)
    h *= up / h.sum()
    return np.ascontiguousarray(h.reshape(taps, up).T[:, ::-1], dtype=np.float32)


def resample(x: np.ndarray, source: int, target: int, taps: int = TAPS) -> np.ndarray:
    """Rational resampling: each output is one phase of the filter over the last ``taps`` inputs."""
    g = gcd(source, target)
    up, down = target // g, source // g
    if up == down:
        return x
    n_out = -(-len(x) * up // down)
    half = taps // 2
    padded = np.concatenate([np.zeros(taps - 1 - half, np.float32), x, np.zeros(half + down, np.float32)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, taps)
    y = np.empty(n_out, dtype=np.float32)
    for m in range(min(up, n_out)):
        rows = windows[m * down // up :: down][: len(y[m::up])]
        y[m::up] = rows @ polyphase_filter(up, down, taps)[m * down % up]
    return y


@lru_cache(4)
def mel_bank(rate: int = RATE, n_fft: int = FFT, mels: int = MELS) -> np.ndarray:
    """(bins, mels): triangles of equal width on the mel scale, each over half of its neighbours."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, mels + 2) / 2595) - 1)
    bins = np.fft.rfftfreq(n_fft, 1 / rate)[:, None]
    low, mid, high = edges[:-2], edges[1:-1], edges[2:]
    return np.maximum(0, np.minimum((bins - low) / (mid - low), (high - bins) / (high - mid))).astype(np.float32)


def log_mel(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frames, MELS) log energies of overlapped frames, and each frame's energy in decibels; one frame at least.

    The last frame is filled up with zeros, so that each sample is in a frame.
    """
    short = max(FRAME - len(x), (FRAME - len(x)) % HOP)
    if short:
        x = np.concatenate([x, np.zeros(short, np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    mel, energy = np.empty((len(frames), MELS), np.float32), np.empty(len(frames), np.float32)
    window = np.hanning(FRAME).astype(np.float32)
    for a in range(0, len(frames), BLOCK_FRAMES):
        part = frames[a : a + BLOCK_FRAMES] * window
        power = np.abs(np.fft.rfft(part, FFT, axis=1)).astype(np.float32) ** 2
        mel[a : a + BLOCK_FRAMES] = np.log(power @ mel_bank() + 1e-6)
        energy[a : a + BLOCK_FRAMES] = 10 * np.log10((part * part).mean(axis=1) + 1e-10)
    return mel, energy


def segments(energy: np.ndarray, on: float = ON_DB, off: float = OFF_DB) -> list[tuple[float, float]]:
    """(start, end) in seconds of the stretches that rise above ``on`` and have not yet fallen below ``off``."""
    middle = float(np.median(energy))
    event = np.where(energy > middle + on, 1, np.where(energy < middle - off, -1, 0))
    last = np.maximum.accumulate(np.where(event != 0, np.arange(len(event)), -1))
    active = np.concatenate([[0], np.where(last >= 0, event[last] > 0, False).astype(np.int8), [0]])
    change = np.diff(active)
    return [(a * HOP / RATE, b * HOP / RATE) for a, b in zip(np.flatnonzero(change == 1).tolist(), np.flatnonzero(change == -1).tolist(), strict=True)]


def tensors(mel: np.ndarray) -> np.ndarray:
    """(windows, SPAN_FRAMES, MELS) in half precision; the last is filled up with the floor's value."""
    short = -len(mel) % SPAN_FRAMES
    return np.concatenate([mel, np.full((short, MELS), np.log(1e-6), np.float32)]).astype(np.float16).reshape(-1, SPAN_FRAMES, MELS)


def media_column(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text's UTF-8 bytes as a sound file; null is empty.

    Rows are independent: repeated ones and null ids give a row each, other columns are ignored, an empty table gives an
    empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                raw = [x or b"" for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, raw), pa.int64()), pa.array(map(encode_wav, raw), pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("raw")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def audio_features(media: DataFrame, folder: str) -> DataFrame:
    """Features of stored ``media`` (doc_id, n_bytes, media), with the tensors in Arrow files below ``folder``.

    A file holds rows of doc_id, start_s, end_s and a tensor of ``SPAN_FRAMES`` x ``MELS``; a document's tensors lie
    together from ``first_tensor`` on. ``tensor_crc32`` is that of the tensors as read back from the file. ``spans``
    are the loud segments. Equal media have equal features, also of repeated rows, which each have tensors of their own;
    null ids stay null. An empty table gives no files and an empty result, other columns are ignored. A task that runs
    again writes the same file again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(folder)
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        own, final = f"{base}/.mel-{part:06d}-{attempt}", f"{base}/mel-{part:06d}.arrow"
        schema = pa.schema([("doc_id", pa.int64()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("mel", TENSOR)])
        rows, held, n_held, at = [], [], 0, 0
        store.create_dir(base, recursive=True)
        with store.open_output_stream(own) as out, pa.ipc.new_file(out, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            for batch in batches:
                for doc_id, n_bytes, sound in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                    payload, rate = decode_wav(sound)
                    x = (np.frombuffer(payload, dtype=np.uint8).astype(np.float32) - 128) / 128
                    mel, energy = log_mel(resample(x, rate, RATE))
                    made = tensors(mel)
                    rows.append((doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(sound), hashlib.sha256(sound).hexdigest(), segments(energy), at, len(made)))
                    at += len(made)
                    held.append((doc_id, made))
                    n_held += len(made)
                    if n_held >= 4096:
                        writer.write_batch(_tensor_rows(held, schema))
                        held, n_held = [], 0
            if held:
                writer.write_batch(_tensor_rows(held, schema))
        store.move(own, final)
        if not rows:
            store.delete_file(final)
            return
        with store.open_input_file(final) as source:
            yield from _read_back(pa.ipc.open_file(source), rows, folder.rstrip("/") + f"/mel-{part:06d}.arrow")

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, _FEATURES)


def _tensor_rows(held: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    flat = np.ascontiguousarray(np.concatenate([x for _, x in held]))
    k = np.concatenate([np.arange(len(x)) for _, x in held])
    seconds = SPAN_FRAMES * HOP / RATE
    ids = [doc_id for doc_id, x in held for _ in range(len(x))]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(k * seconds), pa.array((k + 1) * seconds), pa.FixedShapeTensorArray.from_numpy_ndarray(flat)], schema=schema)


def _read_back(reader: pa.ipc.RecordBatchFileReader, rows: list[tuple], uri: str) -> Iterator[pa.RecordBatch]:
    """Rows of ``_FEATURES`` as the file's batches are read; a document's tensors lie in one batch."""
    done = at = 0
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())])), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    for k in range(reader.num_record_batches):
        mel = reader.get_batch(k).column(3).to_numpy_ndarray()
        out = []
        while done < len(rows) and rows[done][8] + rows[done][9] <= at + len(mel):
            *head, spans, first, n = rows[done]
            crc = zlib.crc32(np.ascontiguousarray(mel[first - at : first - at + n]).tobytes())
            out.append((*head, [{"start_s": a, "end_s": b} for a, b in spans], uri, first, n, crc))
            done += 1
        at += len(mel)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split(" ")[0] for x in _FEATURES.split(", ")])


def op9_log_mel(spark, sf_dir: str) -> DataFrame:
    """Stored sound and features of each document."""
    stored = cut(media_column(spark.read.parquet(f"{sf_dir}/documents.parquet")), "media")
    found = audio_features(stored, shared_path(spark, "mel"))
    loud = F.aggregate("spans", F.lit(0.0), lambda total, x: total + x.end_s - x.start_s)
    feature = F.concat_ws(":", F.col("n_tensors"), F.size("spans"), F.format_number(loud, 3), F.lower(F.hex("tensor_crc32")))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
