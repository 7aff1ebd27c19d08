"""Pixel kernels over binary images of a known shape, as Arrow-batched UDFs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def levels(curve: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """A curve over brightness in [0, 1] as a table of 256 whole output levels, rounded down; what leaves the range is held at its ends."""
    brightness = np.linspace(0, 1, 256)
    return np.floor(255 * np.minimum(np.maximum(curve(brightness), 0), 1) + 1e-4).astype(np.uint8)


def exposure_lut(ev: float) -> np.ndarray:
    """Levels after a change by ev stops.

    Darker is a straight line. Brighter is the curve through black and white
    whose slope decays as e^(-gain x), so that highlights roll off: the integral
    of that decay, over its integral up to white.
    """
    gain = 2.0**ev
    return levels(lambda x: np.expm1(-gain * x) / np.expm1(-gain) if gain > 1 else gain * x)


@dataclass(frozen=True)
class Ramp:
    """Where a tone control acts: not at all up to level `off`, fully from level `full`, by a power in between; in levels for a unit of the control."""

    off: float
    full: float
    power: float
    unit: float

    def moved(self, x: np.ndarray, amount: float) -> np.ndarray:
        up = np.interp(255 * x, sorted((self.off, self.full)), (0, 1))
        return amount * self.unit / 255 * (up if self.full > self.off else 1 - up) ** self.power


#: Fixed values of the tone controls, in the order in which they act, and the level below which shadows fade out.
TONE = {"shadows": Ramp(100, 0, 1.8, 0.32), "highlights": Ramp(128, 255, 1.35, 0.42), "whites": Ramp(175, 255, 1.0, 0.28), "blacks": Ramp(60, 0, 1.0, 0.22)}
DEEPEST, MIDDLE, DEAD_ZONE = 8, 128, 0.1


def tone_lut(contrast: float = 0.0, **controls: float) -> np.ndarray:
    """Levels after the controls of TONE, each on what the ones before left, and then contrast about the middle. Amounts within DEAD_ZONE do nothing."""
    acting = [(name, ramp, controls[name]) for name, ramp in TONE.items() if abs(controls.get(name, 0.0)) > DEAD_ZONE]
    slope = 1 + contrast / 100 if abs(contrast) > DEAD_ZONE else 1.0

    def curve(x: np.ndarray) -> np.ndarray:
        for name, ramp, amount in acting:
            fade = np.interp(255 * x, (0, DEEPEST), (0, 1)) if name == "shadows" else 1
            x = x + fade * ramp.moved(x, amount)
        return slope * x + (1 - slope) * MIDDLE / 255

    return levels(curve)


def blend_weights(size: int, overlap: int, first: bool = False, last: bool = False) -> np.ndarray:
    """Weights along one side of a tile by the distance to its nearer end: half a cosine over the overlap, 1 beyond. An end of the image is no end of the tile."""
    place = np.arange(size, dtype=float)
    inward = np.minimum(np.where(first, np.inf, place), np.where(last, np.inf, place[::-1]))
    return np.sin(np.pi / 2 * np.minimum(inward / overlap, 1)) ** 2 if overlap else np.ones(size)


def with_exposure(pixels: Column, ev: float) -> Column:
    """8-bit pixels brightened or darkened by ev stops. Null stays null."""
    return with_levels(pixels, exposure_lut(ev))


def with_levels(pixels: Column, lut: np.ndarray) -> Column:
    """8-bit pixels through a table of 256 levels. Null stays null."""
    table = lut.tobytes()

    @F.pandas_udf("binary")
    def apply(images: pd.Series) -> pd.Series:
        return images.map(lambda b: None if b is None else bytes(b).translate(table))

    return apply(pixels)


def difference_hash(grey: Column) -> Column:
    """64 bits of an 8 x 9 grey image (bytes, row by row): each pixel against its right neighbour, as a long."""

    @F.pandas_udf("long")
    def apply(images: pd.Series) -> pd.Series:
        def one(b: bytes | None) -> int | None:
            if b is None or len(b) != 72:
                return None
            g = np.frombuffer(b, np.uint8).reshape(8, 9)
            return int(np.packbits(g[:, 1:] > g[:, :-1]).view(">i8")[0])

        return images.map(one).astype("Int64")

    return apply(grey)
