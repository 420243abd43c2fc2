"""Rows of Python functions in DataFrames of bounded size."""

from __future__ import annotations

import pandas as pd

#: Rows and bytes of a DataFrame about; one row may be larger.
ROWS = 1000
BYTES = 1 << 24


def _size(x) -> int:
    if isinstance(x, (bytes, str)):
        return len(x)
    return sum(map(_size, x.values() if isinstance(x, dict) else x)) if isinstance(x, (dict, list)) else 0


def batched(rows, columns):
    """DataFrames of all rows, in order, cut by number and by the length of the binaries and texts in them."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += sum(map(_size, r))
        if len(held) >= ROWS or size >= BYTES:
            yield pd.DataFrame(held, columns=columns)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=columns)
