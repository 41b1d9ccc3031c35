"""Checks of rows that are counted in the pass that writes them, not by a scan of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def watched(df: DataFrame, **faults: Column) -> tuple[DataFrame, Observation]:
    """The table, and what counts its rows and the faulty ones, by kind of fault, while an action runs over it."""
    seen = Observation()
    return df.observe(seen, F.count("*").alias("rows"), *(F.count(F.when(c, 1)).alias(name) for name, c in faults.items())), seen


def refuse(seen: Observation, **most: float) -> dict[str, int]:
    """The counts, once an action has run; an error where faults are more than the stated share of the rows (0 if none is stated)."""
    counts = seen.get
    over = [f"{k}: {n} of {counts['rows']} rows" for k, n in counts.items() if k != "rows" and n > most.get(k, 0.0) * counts["rows"]]
    if over:
        raise ValueError("; ".join(over))
    return counts
