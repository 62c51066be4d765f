"""Column functions of the graph operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pair_code(a: Column, b: Column, wide: bool = False) -> Column:
    """Cantor's code of an unordered pair: (s (s + 1)) / 2 + larger, s = a + b.

    Exact for LONG while s stays below about 3.03e9; ``wide`` computes in
    DECIMAL(38, 0) for larger ids.
    """
    kind = "decimal(19,0)" if wide else "long"
    low, high = F.least(a, b).cast(kind), F.greatest(a, b).cast(kind)
    s = low + high
    if wide:
        return F.floor(s * (s + 1) / 2 + high).cast("decimal(38,0)")
    return F.shiftright(s * (s + 1), 1) + high


def ordered(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)
