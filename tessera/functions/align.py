"""Alignment of two texts by their longest common subsequence, in bit-parallel form (published bit-vector LCS), as an Arrow UDF."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from .spans import merged_pairs

Block = tuple[int, int, int]


def common_blocks(a: str, b: str) -> list[Block]:
    """(start in a, start in b, length) of the maximal runs of a longest common subsequence, in order."""
    lead = 0
    while lead < min(len(a), len(b)) and a[lead] == b[lead]:
        lead += 1
    tail = 0
    while tail < min(len(a), len(b)) - lead and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[lead : len(a) - tail], b[lead : len(b) - tail]
    places: dict[str, int] = {}
    for i, c in enumerate(x):
        places[c] = places.get(c, 0) | 1 << i
    # rows[j] has a zero at i where the LCS of x[:i + 1] and y[:j] is longer than that of x[:i] and y[:j].
    ones = (1 << len(x)) - 1
    row, rows = ones, [ones]
    for c in y:
        met = row & places.get(c, 0)
        row = (row + met | row - met) & ones
        rows.append(row)
    i, j = len(x), len(y)
    steps: list[tuple[int, int]] = []
    while i and j:
        if rows[j] >> i - 1 & 1:
            i -= 1
        elif not rows[j - 1] >> i - 1 & 1:
            j -= 1
        else:
            i, j = i - 1, j - 1
            steps.append((i + lead, j + lead))
    steps.reverse()
    points = [(k, k) for k in range(lead)] + steps + [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]
    out: list[Block] = []
    for p, q in points:
        if out and (p, q) == (out[-1][0] + out[-1][2], out[-1][1] + out[-1][2]):
            out[-1] = (*out[-1][:2], out[-1][2] + 1)
        else:
            out.append((p, q, 1))
    return out


@F.pandas_udf(ArrayType(StructType([StructField(n, IntegerType()) for n in ("a0", "a1", "b0", "b1")])))
def blocks(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.Series:
    """Span pairs of equal text of ``least`` characters or more; none if a side is null or empty."""
    return pd.Series([[{"a0": p, "a1": p + n, "b0": q, "b1": q + n} for p, q, n in (common_blocks(x, y) if x and y else ()) if n >= m] for x, y, m in zip(a, b, least, strict=True)], dtype=object)


def tiles(a: Column, b: Column, least: int = 20, gap: int = 10) -> Column:
    """Span pairs of equal text of ``least`` characters or more, near ones joined; none if a side is null or empty."""
    return merged_pairs(blocks(a, b, F.lit(least)), gap)
