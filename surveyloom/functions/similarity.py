"""String similarity.

The sequence ratio (longest matching blocks, applied recursively) has no built-in
counterpart, so it is the one Arrow UDF of the package. Callers narrow the pairs in
the JVM first and send only the survivors to it.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _ratio_udf():
    # Defined locally, so it travels by value and executors need not have the package installed.
    @F.pandas_udf(DoubleType())
    def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right)], dtype="float64")

    return ratio


# sequence_ratio(left, right): order matters, ratio(a, b) may differ from ratio(b, a).
sequence_ratio = _ratio_udf()


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance; pairs whose lengths differ by more than three give that difference."""
    gap = F.abs(F.length(a) - F.length(b))
    empty = (F.length(a) == 0) | (F.length(b) == 0)
    return F.when((gap > 3) & ~empty, gap).otherwise(F.levenshtein(a, b))


def may_reach(a: Column, b: Column, cutoff: float) -> Column:
    """Necessary condition for a sequence ratio of at least ``cutoff``.

    Matching blocks form a common subsequence, so a ratio of c needs at most
    (1 - c)(|a| + |b|) insertions and deletions, which bounds the edit distance.
    """
    return F.levenshtein(a, b) <= F.lit(1.0 - cutoff + 1e-9) * (F.length(a) + F.length(b))


def reachable_lengths(size: int, cutoff: float) -> range:
    """Lengths of partners that can reach ``cutoff`` with a word of ``size`` letters."""
    low = max(1, int(size * cutoff / (2 - cutoff) - 1e-9))
    high = int(size * (2 - cutoff) / cutoff + 1e-9) + 1
    return range(low, high + 1)
