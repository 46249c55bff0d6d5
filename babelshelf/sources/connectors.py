"""Task-side hooks for models and lookup services: a factory is called once per worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import floor, isfinite

import pandas as pd
from pyspark.sql import DataFrame

from babelshelf.functions.means import TRIM
from babelshelf.operators.prediction import Thresholds, scannable

#: Share by which a memory error shortens segments.
SHRINK = 0.075
#: Files held as objects at once.
FILES = 50
Scores = list[tuple[str, float]]


def inferred(segments: DataFrame, load: Callable[[], Callable[[list[bytes]], list[list[float]]]], labels: list[str], batch: int = 16) -> DataFrame:
    """(file_id, segment, language, p, ord) of segments (file_id, segment, audio) by a model loaded in the worker.

    A batch that runs out of memory is halved until single segments fail. These have no rows, by which
    ``prediction.prefix_best`` knows that they failed, and with them their file.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()

        def scored(audio: list[bytes]) -> list[list[float] | None]:
            try:
                return model(audio)
            except MemoryError:
                half = len(audio) // 2
                return scored(audio[:half]) + scored(audio[half:]) if half else [None]

        for part in parts:
            for at in range(0, len(part), batch):
                some = part.iloc[at : at + batch]
                rows = [(f, s, label, p, k) for f, s, ps in zip(some["file_id"], some["segment"], scored(list(some["audio"])), strict=True) if ps is not None for k, (label, p) in enumerate(zip(labels, ps, strict=True))]
                yield pd.DataFrame(rows, columns=["file_id", "segment", "language", "p", "ord"])

    return segments.mapInPandas(run, "file_id long, segment int, language string, p double, ord long")


class Tries:
    """What a worker remembers of its model's memory errors from file to file: their number, the device, the segment length.

    Each error is counted and shrinks the length, that of files to come included; a success starts the count anew, but the
    length stays. An error after ``fall_back_at`` others moves the model to the processor for good, one after
    ``limit`` others is the last: ``exhausted``, which holds for all that follows if ``lasting``, else until ``rested``.
    """

    def __init__(self, load: Callable[[str], Callable[[object], Scores]], length: float = 0.0, limit: int = 10, fall_back_at: int = 5, shrink: float = SHRINK, lasting: bool = False):
        self.load, self.length, self.limit, self.fall_back_at, self.shrink, self.lasting = load, length, limit, fall_back_at, shrink, lasting
        self.device, self.errors, self.exhausted = "gpu", 0, False
        self.model = load(self.device)

    def once(self, audio: object) -> Scores | None:
        """The scores of one try, None if memory ran out."""
        try:
            scores = self.model(audio)
        except MemoryError:
            self.failed()
            return None
        self.errors = 0
        return scores

    def failed(self) -> None:
        if self.errors >= self.limit:
            self.exhausted = True
            return
        if self.errors >= self.fall_back_at and self.device != "cpu":
            self.device, self.model = "cpu", self.load("cpu")
        self.errors += 1
        self.length *= 1 - self.shrink

    def rested(self) -> None:
        """Before another file."""
        if not self.lasting:
            self.exhausted, self.errors = False, 0 if self.exhausted else self.errors


def best_of(seen: dict[str, list[float]], digits: int = 9) -> tuple[str, float] | None:
    """The label with the highest truncated mean, the first one seen of equals."""
    best = None
    for label, ps in seen.items():
        cut, ordered = len(ps) // TRIM, sorted(ps)
        mean = round(sum(ordered[cut : len(ps) - cut]) / (len(ps) - 2 * cut), digits)
        if best is None or mean > best[1]:
            best = label, mean
    return best


def classified(files: DataFrame, read: Callable[[dict, int, float, float | None], object], load: Callable[[str], Callable[[object], Scores]], length: float, t: Thresholds, limit: int = 10, fall_back_at: int = 5, legacy: bool = False) -> DataFrame:
    """(file_id, segment, scanned, language, accuracy, failed_too_often) where scanning stops, for files (file_id, runtime, ...).

    Segments are read and scored one by one, only as far as the rules ask, so that what is never needed is never read.
    ``read`` gives the sound of (file, segment, start, end), None if that fails; ``load`` a model for a device, which
    gives (label, probability) pairs. Without memory errors the result is that of ``prediction.stopping_point`` over all
    segments scored; files whose runtime is null, negative or not finite have no row in either form, and a maximum below
    the minimum reads nothing.

    A memory error shrinks the segments of the worker (``Tries``). What is left of the file is then read again in shorter
    segments, numbered on; scores that came before count. A file that fails too often has no language, and the next one
    starts with a fresh count. With ``legacy`` the same sound is tried again, a file keeps the length with which it began,
    and once one has failed too often, so do all others of the task.
    """

    def scan(file: dict, model: Tries) -> tuple:
        runtime, seen, best = file["runtime"], {}, None
        model.rested()
        if model.exhausted:
            return file["file_id"], None, None, None, None, True
        segment, scanned, base, at, step = 0, None, 0.0, 0, model.length
        while at <= floor((runtime - base) / step):
            start, end = base + at * step, base + (at + 1) * step
            scanned = (end if end <= runtime else runtime) / runtime if runtime else None
            sound = read(file, segment, start, end if end <= runtime else None)
            scores = model.once(sound) if sound is not None else []
            while scores is None and legacy and not model.exhausted:
                scores = model.once(sound)
            if model.exhausted:
                return file["file_id"], segment, scanned, None, None, True
            if scores is None:
                base, at, step = start, 0, model.length
                continue
            if not scores:
                return file["file_id"], segment, scanned, None, None, False
            for label, p in scores:
                seen.setdefault(label, []).append(p)
            best = None
            if scanned is not None and scanned >= t.minimum:
                if t.maximum is not None and scanned >= t.maximum:
                    break
                best = best_of(seen)
                if best[0] != t.default_language and best[1] >= t.normal:
                    break
            segment, at = segment + 1, at + 1
        else:
            segment -= 1
        return file["file_id"], segment, scanned, *(best or best_of(seen)), False

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Tries(load, length, limit, fall_back_at, lasting=legacy)
        for part in parts:
            rows = []
            # Few files at a time as objects, so that what ``read`` keeps in them goes with them.
            for file in (x for at in range(0, len(part), FILES) for x in part.iloc[at : at + FILES].to_dict("records")):
                if t.scans_nothing:
                    rows.append((file["file_id"], None, None, None, None, False))
                else:
                    rows.append(scan(file, model))
            found = pd.DataFrame(rows, columns=["file_id", "segment", "scanned", "language", "accuracy", "failed_too_often"])
            yield found.astype({"segment": "Int32", "scanned": "Float64", "accuracy": "Float64"})

    known = files.where(scannable("runtime")) if length > 0 and isfinite(length) else files.limit(0)
    return known.mapInPandas(run, "file_id long, segment int, scanned double, language string, accuracy double, failed_too_often boolean")


def looked_up(keys: DataFrame, connect: Callable[[], Callable[[dict], dict | None]], schema: str) -> DataFrame:
    """One call of a service for each distinct row of ``keys``; rows without a hit are left out."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = connect()
        for part in parts:
            found = [key | hit for key in part.to_dict("records") if (hit := client(key)) is not None]
            if found:
                yield pd.DataFrame(found)

    return keys.distinct().mapInPandas(run, schema)
