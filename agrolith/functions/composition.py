"""Log-ratio transforms of parts that make up a whole."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def clr(parts: Sequence[Column], least: Column | None = None) -> list[Column]:
    """Centred log-ratios; a part of zero counts as 0.65 of the least positive part, by default that of its row."""
    least = F.least(*[F.when(p > 0, p) for p in parts]) if least is None else least
    filled = [F.when(p > 0, p).otherwise(0.65 * least) for p in parts]
    mean = sum((F.ln(p) for p in filled[1:]), F.ln(filled[0])) / len(parts)
    return [F.ln(p) - mean for p in filled]


def ilr(parts: Sequence[Column], least: Column | None = None) -> list[Column]:
    """Isometric log-ratios on the Helmert-type basis: each part in turn against the mean of those before it."""
    c = clr(parts, least)
    return [math.sqrt(i / (i + 1)) * (sum(c[1:i], c[0]) / i - c[i]) for i in range(1, len(c))]
