"""Pixels as numpy arrays (height, width, channels), and the protocols that codecs and metrics follow."""

from __future__ import annotations

import math
from typing import Protocol

import numpy as np

from quern.schemas import DIFF_AMPLIFICATION, DIFF_DIM, LEAST_SCORED_SIDE, MOST_SCORED_PIXELS
from quern.sources import containers


class Codec(Protocol):
    """Encodes pixels at a quality; `qualities` is None for a lossless one."""

    name: str
    format: str
    qualities: tuple[int, int] | None

    def encode(self, pixels: np.ndarray, quality: int | None) -> bytes: ...

    def decode(self, data: bytes) -> np.ndarray: ...


class Metric(Protocol):
    """Scores RGB pixels against a reference: 100 for identical ones, less the more they differ."""

    def __call__(self, reference: np.ndarray, distorted: np.ndarray) -> float: ...


class PngCodec:
    """Lossless PNG, the one codec that needs no native library."""

    name, format, qualities = "png lossless", "png", None

    def encode(self, pixels: np.ndarray, quality: int | None = None) -> bytes:
        return containers.png_of(pixels[..., :3] if is_opaque(pixels) else pixels)

    def decode(self, data: bytes) -> np.ndarray:
        return containers.pixels_of(data)


def is_opaque(pixels: np.ndarray) -> bool:
    return pixels.shape[2] < 4 or bool((pixels[..., 3] == 255).all())


def flatten(pixels: np.ndarray, background: int) -> np.ndarray:
    """RGB over a grey background, rounded half up."""
    if pixels.shape[2] < 4:
        return pixels[..., :3]
    alpha = pixels[..., 3:].astype(np.float64)
    return np.floor((pixels[..., :3] * alpha + background * (255 - alpha)) / 255 + 0.5).astype(np.uint8)


def _taps(old: int, new: int) -> np.ndarray:
    """A matrix that resamples a line of `old` values to `new` with a three-lobed Lanczos kernel."""
    scale = max(1.0, old / new)
    centre = (np.arange(new) + 0.5) * old / new - 0.5
    x = (np.arange(old)[None, :] - centre[:, None]) / scale
    taps = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)
    return taps / taps.sum(axis=1, keepdims=True)


def resized(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    out = np.einsum("yh,hwc->ywc", _taps(pixels.shape[0], height), pixels.astype(np.float64))
    out = np.einsum("xw,ywc->yxc", _taps(pixels.shape[1], width), out)
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8)


def fit_to_width(pixels: np.ndarray, cap: int | None) -> np.ndarray:
    """At most `cap` wide, with its shape kept; smaller images stay as they are."""
    height, width = pixels.shape[:2]
    return pixels if cap is None or width <= cap else resized(pixels, cap, max(1, math.floor(height * cap / width + 0.5)))


def fit_for_scoring(pixels: np.ndarray) -> np.ndarray:
    height, width = pixels.shape[:2]
    if width * height <= MOST_SCORED_PIXELS:
        return pixels
    factor = math.sqrt(MOST_SCORED_PIXELS / (width * height))
    return resized(pixels, *(max(LEAST_SCORED_SIDE, math.floor(s * factor)) for s in (width, height)))


def score(reference: np.ndarray, distorted: np.ndarray, metric: Metric) -> float:
    """The lower score over black and white, at most 100; one background is enough where both are opaque."""
    if reference.shape[:2] != distorted.shape[:2]:
        raise ValueError("E_DIMENSIONS_MISMATCH")
    backgrounds = (0,) if is_opaque(reference) and is_opaque(distorted) else (0, 255)
    worst = 100.0
    for background in backgrounds:
        a, b = flatten(reference, background), flatten(distorted, background)
        if np.array_equal(a, b):
            continue
        if min(reference.shape[:2]) < LEAST_SCORED_SIDE:
            raise ValueError("E_TOO_SMALL_TO_SCORE")
        worst = min(worst, float(metric(fit_for_scoring(a), fit_for_scoring(b))))
    return worst


def difference_map(reference: np.ndarray, distorted: np.ndarray) -> np.ndarray:
    """RGB pixels: dim grey where nothing differs, hot where much does, by the larger difference over black and white."""
    weights = np.array([0.2126, 0.7152, 0.0722])
    backgrounds = (255,) if is_opaque(reference) and is_opaque(distorted) else (0, 255)
    gaps = [np.abs(flatten(reference, b).astype(int) - flatten(distorted, b)).max(axis=2) for b in backgrounds]
    heat = np.minimum(1.0, np.max(gaps, axis=0) * DIFF_AMPLIFICATION / 255)
    grey = flatten(reference, 255) @ weights * DIFF_DIM * (1 - heat)
    return np.clip(np.floor(np.stack([grey + 255 * heat, grey + 255 * heat**2, grey], axis=2) + 0.5), 0, 255).astype(np.uint8)


def peak_signal_score(reference: np.ndarray, distorted: np.ndarray) -> float:
    """A plain stand-in for a perceptual metric, made of the peak signal-to-noise ratio: 50 dB is 100, 10 dB is 0."""
    error = np.mean((reference.astype(float) - distorted) ** 2)
    return 100.0 if error == 0 else min(100.0, (10 * math.log10(255**2 / error) - 10) * 2.5)
