"""Numeric kernels on frame curves, as functions of arrays for use in grouped pandas functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def spectral_flux(frames: np.ndarray) -> np.ndarray:
    """Half-wave rectified difference of magnitude spectra (rows: frames), summed over bands; the first is 0."""
    return np.maximum(np.diff(frames, axis=0, prepend=frames[:1]), 0).sum(1)


def magnitudes(x: np.ndarray, size: int = 1024, hop: int = 512) -> np.ndarray:
    """Magnitude spectra of Hann-windowed frames."""
    n = max(0, 1 + (len(x) - size) // hop)
    at = np.arange(size) + hop * np.arange(n)[:, None]
    return np.abs(np.fft.rfft(x[at] * np.hanning(size), axis=1)) if n else np.zeros((0, size // 2 + 1))


def window_rms(x: np.ndarray, size: int) -> np.ndarray:
    """Root mean squares of consecutive windows; the last may be short."""
    if not len(x):
        return np.zeros(0)
    edge = np.arange(0, len(x), size)
    return np.sqrt(np.add.reduceat(x.astype(float) ** 2, edge) / np.diff(np.append(edge, len(x))))


def near_empty(x: np.ndarray, size: int = 2048) -> bool:
    """A signal whose peak is under 0.025 and whose 99th percentile of window RMS is under 0.004."""
    return not len(x) or bool(np.abs(x).max() < 0.025 and np.percentile(window_rms(x, size), 99) < 0.004)


def tiles(x: np.ndarray, bins: int) -> np.ndarray:
    """(least, most, RMS) of `bins` tiles with edges floor(k n / bins); empty tiles are 0."""
    edge = np.arange(bins + 1) * len(x) // bins
    out = np.zeros((bins, 3))
    for k in range(bins):
        part = x[edge[k] : edge[k + 1]]
        if len(part):
            out[k] = part.min(), part.max(), np.sqrt(np.mean(part.astype(float) ** 2))
    return out


def pick_peaks(x: np.ndarray, height: float, distance: int) -> np.ndarray:
    """Places of local maxima of at least `height`; of two nearer than `distance` the higher stays (ties: the earlier)."""
    at = np.flatnonzero((x[1:-1] > x[:-2]) & (x[1:-1] >= x[2:]) & (x[1:-1] >= height)) + 1
    kept: list[int] = []
    for i in at[np.lexsort((at, -x[at]))]:
        if all(abs(i - j) >= distance for j in kept):
            kept.append(int(i))
    return np.array(sorted(kept), int)


def refine_attack(x: np.ndarray, at: int, back: int, share: float = 0.2) -> int:
    """From the loudest sample near `at`, back to where the level falls to `share` of it, then to the zero crossing before."""
    low = max(0, at - back)
    part = np.abs(x[low : at + back + 1])
    if not len(part) or not part.max():
        return at
    peak = int(part.argmax())
    quiet = np.flatnonzero(part[: peak + 1] <= share * part[peak])
    place = low + (int(quiet[-1]) if len(quiet) else 0)
    crossing = np.flatnonzero(np.diff(np.signbit(x[low : place + 1])))
    return low + int(crossing[-1]) + 1 if len(crossing) else place


def fingerprints(spectra: np.ndarray, per_frame: int = 3, fan: int = 5, reach: int = 30) -> list[tuple[int, int, int, int]]:
    """(frame, band, later band, frames between) of pairs of the strongest local maxima, at most `fan` later ones each."""
    peaks = []
    for t, row in enumerate(spectra):
        top = np.flatnonzero((row[1:-1] > row[:-2]) & (row[1:-1] >= row[2:])) + 1
        peaks += [(t, int(b)) for b in top[np.lexsort((top, -row[top]))][:per_frame]]
    out = []
    for i, (t, b) in enumerate(peaks):
        later = [(u, c) for u, c in peaks[i + 1 :] if 0 < u - t <= reach][:fan]
        out += [(t, b, c, u - t) for u, c in later]
    return out


def frame_table(samples: DataFrame, key: str, column: str, size: int = 1024, hop: int = 512) -> DataFrame:
    """key, frame, rms, flux of each row's samples (array<float>); one Arrow batch at a time."""

    def frames(batches):
        for batch in batches:
            out = []
            for k, x in zip(batch[key], batch[column], strict=True):
                m = magnitudes(np.asarray(x, float), size, hop)
                rms = [float(np.sqrt(np.mean(np.asarray(x[i * hop : i * hop + size], float) ** 2))) for i in range(len(m))]
                out += [(k, i, r, f) for i, (r, f) in enumerate(zip(rms, spectral_flux(m) if len(m) else [], strict=True))]
            yield pd.DataFrame(out, columns=[key, "frame", "rms", "flux"])

    return samples.select(key, column).mapInPandas(frames, f"{key} {samples.schema[key].dataType.simpleString()}, frame long, rms double, flux double")
