"""Parameter grids, as exact decimal steps."""

from __future__ import annotations


def steps(low: float, high: float, step: float) -> list[float]:
    """low, low+step, ..., high with each value rounded to the decimal it stands for."""
    count = int((high - low) / step + 0.5) + 1
    return [round(low + i * step, 6) for i in range(count)]


def simplex(step: float) -> list[tuple[float, float, float]]:
    """Weight triples that sum to one, first weight outermost."""
    n = int(1.0 / step + 0.5)
    return [
        (round(a * step, 6), round(b * step, 6), round((n - a - b) * step, 6))
        for a in range(n + 1)
        for b in range(n + 1 - a)
    ]


def file_safe(value: float) -> str:
    return str(value).replace(".", "p")
