"""Uniform fuzzy partition of [0, 1] shared by every scaled feature.

n triangles with centres k/(n-1); the first and last reach outside [0, 1].
Crisp labels come from n-1 cut points half way between centres, with two
sentinels (-0.1 and 1.1) so training values always get a label in 1..n.
Labels are right-closed: a value equal to a cut point takes the lower label.
"""

from __future__ import annotations

# Fixed values (must match the original job): sentinel cut points.
LOW_SENTINEL = -0.1
HIGH_SENTINEL = 1.1


def width(n: int) -> float:
    """Half-width of every triangle (= distance between centres)."""
    if n < 2:
        raise ValueError("a fuzzy partition needs at least 2 labels")
    return 1.0 / (n - 1)


def cut_points(n: int) -> list[float]:
    """[-0.1, 1/(2(n-1)), 3/(2(n-1)), ..., 1.1] — n + 1 values."""
    width(n)
    inner = [(2 * k - 1) / (2.0 * (n - 1)) for k in range(1, n)]
    return [LOW_SENTINEL] + inner + [HIGH_SENTINEL]


def triangle(label: int, n: int) -> tuple[float, float, float]:
    """(a, b, c) of the triangle of a 1-based label."""
    h = width(n)
    return ((label - 2) * h, (label - 1) * h, label * h)


def triangles(n: int) -> list[tuple[float, float, float]]:
    return [triangle(k, n) for k in range(1, n + 1)]


def centre(label: int, n: int) -> float:
    return triangle(label, n)[1]
