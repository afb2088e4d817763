"""Colour spaces and stain separation as column expressions over r, g, b."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

LMS = np.array([[0.3811, 0.5783, 0.0402], [0.1967, 0.7244, 0.0782], [0.0241, 0.1288, 0.8444]])
LAB = np.diag([1 / 3**0.5, 1 / 6**0.5, 1 / 2**0.5]) @ np.array([[1.0, 1, 1], [1, 1, -2], [1, -1, 0]])
LMS_INV, LAB_INV = np.linalg.inv(LMS), np.linalg.inv(LAB)
TINY = 2.0**-52
HEMATOXYLIN, EOSIN = (0.65, 0.70, 0.29), (0.07, 0.99, 0.11)


def linear(m: np.ndarray, v: list[Column]) -> list[Column]:
    return [sum((F.lit(float(w)) * c for w, c in zip(row[1:], v[1:], strict=True)), F.lit(float(row[0])) * v[0]) for row in m]


def sql_linear(m: np.ndarray, v: list[str]) -> list[str]:
    return ["(" + " + ".join(f"{float(w)!r}::DOUBLE * {c}" for w, c in zip(row, v, strict=True)) + ")" for row in m]


def hsi(r: Column, g: Column, b: Column, top: float = 255.0) -> tuple[Column, Column, Column]:
    """Hue in [0, 1), saturation, intensity."""
    r, g, b = (c / F.lit(top) for c in (r, g, b))
    turn = F.atan2(F.lit(3**0.5) * (g - b), 2 * r - g - b) / F.lit(2 * math.pi)
    mean = (r + g + b) / 3
    return turn - F.floor(turn), F.when(mean > 0, 1 - F.least(r, g, b) / F.greatest(mean, F.lit(1e-10))).otherwise(0.0), mean


def lab(r: Column, g: Column, b: Column) -> list[Column]:
    """Ruderman's l, alpha, beta; a zero response counts as 2 ** -52."""
    lms = linear(LMS, [c.cast("double") for c in (r, g, b)])
    return linear(LAB, [F.ln(F.when(x == 0, F.lit(TINY)).otherwise(x)) for x in lms])


def lab_to_rgb(l: Column, a: Column, b: Column) -> list[Column]:  # noqa: E741
    return linear(LMS_INV, [F.exp(x) for x in linear(LAB_INV, [l, a, b])])


def sda(v: Column, white: float | None = 255.0, negatives: bool = False) -> Column:
    """Scaled optical density; ``white=None`` adds one to the value and takes 256."""
    v, white = (v.cast("double") + 1, 256.0) if white is None else (v.cast("double"), white)
    out = -F.ln(F.greatest(v, F.lit(1e-10)) / F.lit(white)) * 255 / F.lit(math.log(white))
    return out if negatives else F.greatest(out, F.lit(0.0))


def sda_to_rgb(s: Column, white: float | None = 255.0) -> Column:
    return F.pow(F.lit(256.0 if white is None else white), 1 - s / 255) - (1 if white is None else 0)


def stain_matrix(first=HEMATOXYLIN, second=EOSIN) -> np.ndarray:
    """Unit columns, the third one complementary to the others."""
    w = np.array([first, second], float).T
    w /= np.linalg.norm(w, axis=0)
    third = np.cross(w[:, 0], w[:, 1])
    return np.column_stack([w, third / np.linalg.norm(third)])


def unmix(r: Column, g: Column, b: Column, w: np.ndarray, white: float = 255.0) -> list[Column]:
    """Amounts of the stains, as 0 to 255 with white for none."""
    return [sda_to_rgb(x, white) for x in linear(np.linalg.inv(w), [sda(c, white) for c in (r, g, b)])]


def remix(stains: list[Column], w: np.ndarray, white: float = 255.0) -> list[Column]:
    return [sda_to_rgb(x, white) for x in linear(w, [sda(c, white, True) for c in stains])]


def to_byte(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(255.0)).cast("int")


#: Unit vectors of known stains.
STAINS = {"hematoxylin": (0.65, 0.70, 0.29), "eosin": (0.07, 0.99, 0.11), "dab": (0.27, 0.57, 0.78), "null": (0.0, 0.0, 0.0)}


def complement(w: np.ndarray) -> np.ndarray:
    """Unit columns with the third one perpendicular to the others where it is missing or null."""
    w = np.asarray(w, float)
    if w.shape[1] < 3 or np.linalg.norm(w[:, 2]) <= 1e-16:
        w = np.column_stack([w[:, :2], np.cross(w[:, 0], w[:, 1])])
    size = np.linalg.norm(w, axis=0)
    return w / np.where(size > 0, size, 1)


def stain_index(reference, w: np.ndarray) -> int:
    """The column that is nearest to the reference in direction, either way."""
    w = np.asarray(w, float)
    return int(np.argmax(np.abs(np.asarray(reference, float) @ w) / np.maximum(np.linalg.norm(w, axis=0), 1e-300)))


def reorder(w: np.ndarray, first: str = "hematoxylin", second: str = "eosin") -> np.ndarray:
    """Columns in the order of the named stains, the other one last."""
    i = stain_index(STAINS[first], w[:, :2])
    return w[:, [i, 1 - i, 2]]


def stains_of(names, custom=None) -> np.ndarray:
    """Columns by name; ``custom`` gives a vector for names that are not known."""
    found = [STAINS[n] if n in STAINS else (custom or {})[n] for n in names]
    return complement(np.array(found, float).T)


def perturbed(stains: list[Column], w: np.ndarray, alpha: list[float], beta: list[float], white: float = 255.0) -> list[Column]:
    """Stain amounts scaled by ``alpha`` and moved by ``beta`` in optical density, and mixed again."""
    od = [F.lit(float(a)) * sda(c, white, True) + F.lit(float(b)) for c, a, b in zip(stains, alpha, beta, strict=True)]
    return [sda_to_rgb(x, white) for x in linear(w, od)]


def draw(seed: int, spread: float, shift: float, n: int = 3) -> tuple[list[float], list[float]]:
    """Factors from 1 +- spread and offsets from +- shift."""
    r = np.random.default_rng(seed)
    return r.uniform(1 - spread, 1 + spread, n).tolist(), r.uniform(-shift, shift, n).tolist()


def distinct(n: int, start: float = 0.0) -> list[tuple[float, float, float]]:
    """Fully saturated colours whose hues step by the golden ratio."""
    import colorsys

    return [colorsys.hsv_to_rgb((start + i * (5**0.5 - 1) / 2) % 1, 1.0, 1.0) for i in range(n)]


def hue_to_rgb(h: Column) -> list[Column]:
    """Red, green and blue of a fully saturated hue in [0, 1)."""
    at = h * 6
    r = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.abs(at - 3) - 1))
    g = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 - F.abs(at - 2)))
    b = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 - F.abs(at - 4)))
    return [r, g, b]


def gray(r: Column, g: Column, b: Column, swapped: bool = False) -> Column:
    """Luma; ``swapped`` exchanges the weights of red and blue."""
    a, c = (b, r) if swapped else (r, b)
    return 0.299 * a + 0.587 * g + 0.114 * c
