"""Index arithmetic on small sequences, shared by kernels and column expressions."""

from __future__ import annotations


def int_linspace(lo: int, hi: int, k: int) -> list[int]:
    """k integers from lo to hi, evenly spaced and cut to integers; the step is computed once in double precision."""
    if k <= 0:
        return []
    if k == 1:
        return [lo]
    step = (hi - lo) / (k - 1)
    return [hi if i == k - 1 else int(lo + i * step) for i in range(k)]
