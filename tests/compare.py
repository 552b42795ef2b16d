"""Rows of a Spark query and of SQL, in one form."""

from __future__ import annotations

import math


def cell(value) -> str:
    if value is None or str(value) in ("<NA>", "NaT") or value != value:
        return "~"
    if isinstance(value, float):
        return str(int(value)) if value == int(value) and abs(value) < 1e15 else f"{round(value, 6):.6f}"
    if isinstance(value, bool):
        return str(value)
    return str(value)


def rows(frame) -> list[tuple[str, ...]]:
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(cell(v.item() if hasattr(v, "item") else v) for v in row) for row in frame.itertuples(index=False))


def same(a, b, places: float = 1e-5) -> bool:
    if len(a) != len(b):
        return False
    for x, y in zip(a, b):
        for p, q in zip(x, y):
            if p != q:
                try:
                    if not math.isclose(float(p), float(q), abs_tol=places):
                        return False
                except ValueError:
                    return False
    return True
