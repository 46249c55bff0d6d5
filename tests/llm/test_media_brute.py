"""Features against their definitions, in double precision and one frame at a time."""

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyarrow import fs as pafs

from babelshelf.llm import media, quality
from babelshelf.llm.common import cut, shared_path


def brute_resampled(x, taps=media.TAPS):
    """Half the rate: a windowed sinc of ``taps`` points around every other sample."""
    t = np.arange(taps) - (taps - 1) / 2
    h = np.sinc(t / 2) / 2 * (0.54 - 0.46 * np.cos(2 * np.pi * np.arange(taps) / (taps - 1)))
    h /= h.sum()
    at = lambda k: x[k] if 0 <= k < len(x) else 0.0
    return np.array([sum(h[taps - 1 - k] * at(2 * m + k - (taps - 1 - taps // 2)) for k in range(taps)) for m in range(-(-len(x) // 2))])


def brute_log_mel(x):
    n, hop, rate, mels = media.FRAME, media.HOP, media.RATE, media.MELS
    n_frames = 1 + max(0, math.ceil((len(x) - n) / hop))
    x = np.concatenate([x, np.zeros((n_frames - 1) * hop + n - len(x))])
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / (n - 1))
    waves = np.exp(-2j * np.pi * np.outer(np.arange(n // 2 + 1), np.arange(n)) / n)
    to_mel, to_hz = lambda f: 2595 * math.log10(1 + f / 700), lambda m: 700 * (10 ** (m / 2595) - 1)
    edges = [to_hz(to_mel(rate / 2) * k / (mels + 1)) for k in range(mels + 2)]
    out, energy = np.empty((n_frames, mels)), []
    for i in range(n_frames):
        part = x[i * hop : i * hop + n] * window
        power = abs(waves @ part) ** 2
        for m, (low, mid, high) in enumerate(zip(edges, edges[1:], edges[2:])):
            total = 0.0
            for b, p in enumerate(power):
                f = b * rate / n
                if low < f < high:
                    total += p * ((f - low) / (mid - low) if f <= mid else (high - f) / (high - mid))
            out[i, m] = math.log(total + 1e-6)
        energy.append(10 * math.log10((part**2).mean() + 1e-10))
    return out, energy


def brute_segments(energy):
    middle, active, found = float(np.median(np.float32(energy))), False, []
    for i, e in enumerate(energy):
        if not active and e > middle + media.ON_DB:
            active, begin = True, i
        elif active and e < middle - media.OFF_DB:
            active = False
            found.append((begin, i))
    return found + ([(begin, len(energy))] if active else [])


@pytest.mark.parametrize("table", ["odd", "documents"])
def test_stored_tensors_and_spans(request, spark, table):
    """Of each document, what the tensor files hold and the spans are those of the definition."""
    df = request.getfixturevalue(table)
    df = df.where("length(text) < 6000 OR text IS NULL") if table == "odd" else df.where("doc_id % 4 = 0")
    found = media.audio_features(cut(media.media_column(df), "test-media"), shared_path(spark, "test-mel")).collect()
    by_id, files, close = defaultdict(list), {}, 0
    for r in df.collect():
        by_id[r.doc_id].append((r.text or "").encode())
    for r in found:
        if len(by_id[r.doc_id]) > 1:
            continue
        raw = by_id[r.doc_id][0]
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        x = brute_resampled((np.frombuffer(payload, np.uint8).astype(float) - 128) / 128)
        mel, energy = brute_log_mel(x)
        if r.tensor_file not in files:
            store, path = pafs.FileSystem.from_uri(r.tensor_file)
            with store.open_input_file(path) as source:
                files[r.tensor_file] = pa.ipc.open_file(source).read_all()
        own = files[r.tensor_file].slice(r.first_tensor, r.n_tensors).column("mel").combine_chunks()
        got = own.to_numpy_ndarray().astype(float).reshape(-1, media.MELS)
        assert len(got) == -(-len(mel) // media.SPAN_FRAMES) * media.SPAN_FRAMES
        assert np.abs(got[: len(mel)] - mel).max() < 0.02 and np.abs(got[len(mel) :] - math.log(1e-6)).max(initial=0) < 0.02
        # Energies within rounding of a threshold may fall on either side.
        middle = float(np.median(energy))
        if min(min(abs(e - middle - media.ON_DB), abs(e - middle + media.OFF_DB)) for e in energy) > 1e-3:
            close += 1
            seconds = media.HOP / media.RATE
            assert [(round(s.start_s / seconds), round(s.end_s / seconds)) for s in r.spans] == brute_segments(energy)
    assert close > len(found) // 2


def test_strength_matches_its_definition(spark):
    rng = np.random.default_rng(9)
    groups = [rng.beta(2, 3, n) for n in (1, 2, 5, 40, 7, 100)]
    rows = [(len(g), float(g.sum()), float((g * g).sum())) for g in groups]
    center, many = 0.4, [g for g in groups if len(g) > 1]
    n = sum(map(len, many))
    between, within = sum(len(g) * (g.mean() - center) ** 2 for g in many), sum(g.var(ddof=1) for g in many)
    want = center * (1 - center) / ((between - within) / n) - 1 if between > within else 1e4
    got = quality.strength(spark.createDataFrame(rows, "n long, s double, ss double"), quality.F.lit(center))
    assert got == pytest.approx(min(max(want, 1.0), 1e4), rel=1e-6)
