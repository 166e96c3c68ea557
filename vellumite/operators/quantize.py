"""Colour quantizing: buckets, median cut, a few rounds of k-means on buckets. Work follows the buckets, not the pixels."""

from __future__ import annotations

import numpy as np


def buckets(rgba: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean colour, pixels) of each bucket, 5 bits a channel and 4 of alpha, and each pixel's bucket."""
    flat = rgba.reshape(-1, 4).astype(np.int64)
    key = (flat[:, 0] >> 3 << 14) | (flat[:, 1] >> 3 << 9) | (flat[:, 2] >> 3 << 4) | (flat[:, 3] >> 4)
    key = np.where(flat[:, 3] == 0, -1, key)
    _, index, count = np.unique(key, return_inverse=True, return_counts=True)
    means = np.stack([np.bincount(index, flat[:, c]) for c in range(4)], 1) / count[:, None]
    return means, count, index


def median_cut(points: np.ndarray, weight: np.ndarray, colors: int) -> np.ndarray:
    """Label of each point: the box of most squared error is cut at the weighted median of its widest channel."""
    label = np.zeros(len(points), int)

    def error(at: np.ndarray) -> float:
        p, w = points[at], weight[at]
        return float((w[:, None] * (p - np.average(p, axis=0, weights=w)) ** 2).sum()) if len(p) > 1 else 0.0

    errors = [error(np.arange(len(points)))]
    while len(errors) < colors and max(errors) > 0:
        k = int(np.argmax(errors))
        at = np.flatnonzero(label == k)
        channel = int(np.argmax(np.ptp(points[at], axis=0)))
        at = at[np.argsort(points[at, channel], kind="stable")]
        run = np.cumsum(weight[at])
        cut = min(len(at) - 1, max(1, int(np.searchsorted(run, run[-1] / 2)) + 1))
        label[at[cut:]] = len(errors)
        errors[k] = error(at[:cut])
        errors.append(error(at[cut:]))
    return label


def refine(points: np.ndarray, weight: np.ndarray, label: np.ndarray, rounds: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(centers, labels) after rounds of k-means from the given labels; empty clusters keep their center."""
    k = label.max() + 1
    centers = np.stack([np.average(points[label == j], axis=0, weights=weight[label == j]) for j in range(k)])
    for _ in range(rounds):
        distance = (points**2).sum(1)[:, None] - 2 * points @ centers.T + (centers**2).sum(1)
        label = distance.argmin(1)
        mass = np.bincount(label, weight, minlength=k)
        sums = np.stack([np.bincount(label, weight * points[:, c], minlength=k) for c in range(points.shape[1])], 1)
        centers = np.where(mass[:, None] > 0, sums / np.maximum(mass, 1e-12)[:, None], centers)
    return centers, label


def quantize(rgba: np.ndarray, colors: int) -> tuple[np.ndarray, np.ndarray]:
    """(palette, index of each pixel). Alpha weighs the colours, so that what is clear decides little."""
    means, count, index = buckets(rgba)
    weighed = np.hstack([means[:, :3] * (means[:, 3:] / 255), means[:, 3:]])
    label = median_cut(weighed, count.astype(float), colors)
    rounds = 1 if len(weighed) * colors > 40_000_000 else 3
    centers, label = refine(weighed, count.astype(float), label, rounds)
    alpha = centers[:, 3:]
    color = np.where(alpha > 0, centers[:, :3] * 255 / np.maximum(alpha, 1e-9), 0)
    palette = np.clip(np.floor(np.hstack([color, alpha]) + 0.5), 0, 255).astype(np.uint8)
    return palette, label[index].reshape(rgba.shape[:2])
