"""Planes and label planes as pictures: arrays in, uint8 RGB out."""

from __future__ import annotations

import numpy as np

from ..functions import kernels

#: Colours of outlines, of positive and of negative objects.
OUTLINE, POSITIVE, NEGATIVE = (255, 235, 59), (242, 193, 78), (110, 128, 148)


def display_rgb(image: np.ndarray) -> np.ndarray:
    """Gray or colour to RGB bytes. Alpha is dropped; colour bytes stay as they are, other values above 1 are divided by the greatest."""
    rgb = image[..., :3] if image.ndim == 3 and image.shape[2] >= 3 else np.repeat(image.reshape(*image.shape[:2], -1)[..., :1], 3, axis=2)
    if rgb.dtype == np.uint8 and image.ndim == 3:
        return rgb.copy()
    peak = float(rgb.max(initial=0))
    return (np.clip(rgb.astype(np.float32) / (peak if peak > 1 else 1), 0, 1) * 255).astype(np.uint8)


def outlined(image: np.ndarray, labels: np.ndarray, colour=OUTLINE) -> np.ndarray:
    out = display_rgb(image)
    out[kernels.outlines(labels)] = colour
    return out


def mask_picture(labels: np.ndarray) -> np.ndarray:
    return (labels > 0).astype(np.uint8) * 255


def label_colours(labels: np.ndarray) -> np.ndarray:
    """A colour a label, black background: hues by the golden ratio, so that neighbours in number differ."""
    n = int(labels.max(initial=0))
    hue = np.arange(1, n + 1) * 0.618034 % 1.0
    wheel = np.clip(np.abs((hue[:, None] * 6 + np.array([0, 4, 2])) % 6 - 3) - 1, 0, 1)
    table = np.concatenate([np.zeros((1, 3)), 0.35 + 0.65 * wheel])
    return np.round(table * 255).astype(np.uint8)[labels]


def marker_picture(image: np.ndarray, labels: np.ndarray, positive_ids) -> np.ndarray:
    """Outlines in one colour for positive objects, in another for the rest, by one table lookup."""
    out = display_rgb(image)
    edge = kernels.outlines(labels)
    owner = kernels.dilate(labels.astype(np.float64), kernels.SQUARE).astype(int)
    table = np.tile(np.array(NEGATIVE, np.uint8), (int(labels.max(initial=0)) + 1, 1))
    table[list(positive_ids)] = POSITIVE
    out[edge] = table[owner[edge]]
    return out
