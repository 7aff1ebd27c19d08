"""Filters over arrays that are wider by a halo than what they return: each reads only what a tile brings along."""

from __future__ import annotations

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view


def gaussian_radius(sigma: float) -> int:
    """Four deviations to each side, as an odd window."""
    return (int(np.rint(8 * sigma + 1)) | 1) // 2


def gaussian_weights(sigma: float) -> np.ndarray:
    reach = np.arange(-gaussian_radius(sigma), gaussian_radius(sigma) + 1)
    w = np.exp(-(reach**2) / (2 * sigma**2))
    return w / w.sum()


def along(a: np.ndarray, weights: np.ndarray, axis: int) -> np.ndarray:
    """Weighted sums of neighbours along one axis; shorter by the window there."""
    return sliding_window_view(a, len(weights), axis) @ weights


def blur(a: np.ndarray, sigma: float) -> np.ndarray:
    w = gaussian_weights(sigma)
    return along(along(a, w, 0), w, 1)


def masked_blur(a: np.ndarray, mask: np.ndarray, sigma: float, least: float = 1e-4) -> np.ndarray:
    """The blur of what the mask shows, over the mask's own blur."""
    return blur(a * mask, sigma) / np.maximum(blur(mask, sigma), least)


def box(a: np.ndarray, radius: int) -> np.ndarray:
    """Means of squares by a summed-area table, whatever the radius."""
    k = 2 * radius + 1
    s = np.zeros((a.shape[0] + 1, a.shape[1] + 1))
    np.cumsum(np.cumsum(a, 0), 1, out=s[1:, 1:])
    return (s[k:, k:] - s[:-k, k:] - s[k:, :-k] + s[:-k, :-k]) / k**2


def laplacian(a: np.ndarray) -> np.ndarray:
    """Four neighbours less four times the pixel."""
    return a[:-2, 1:-1] + a[2:, 1:-1] + a[1:-1, :-2] + a[1:-1, 2:] - 4 * a[1:-1, 1:-1]


def edge_strength(a: np.ndarray) -> np.ndarray:
    """Length of the gradient by 3 x 3 differences that are smoothed across."""
    smooth, step = np.array([1.0, 2.0, 1.0]), np.array([-1.0, 0.0, 1.0])
    return np.hypot(along(along(a, step, 1), smooth, 0), along(along(a, smooth, 1), step, 0))


def inner(a: np.ndarray, by: int) -> np.ndarray:
    return a[by : a.shape[0] - by, by : a.shape[1] - by] if by else a


def guided(guide: np.ndarray, source: np.ndarray, radius: int, eps: float) -> np.ndarray:
    """The guided filter: in each window the source as a line over the guide, the lines averaged. Reads 2 * radius around."""
    mean_g, mean_s = box(guide, radius), box(source, radius)
    slope = (box(guide * source, radius) - mean_g * mean_s) / (box(guide * guide, radius) - mean_g**2 + eps)
    return box(slope, radius) * inner(guide, 2 * radius) + box(mean_s - slope * mean_g, radius)
