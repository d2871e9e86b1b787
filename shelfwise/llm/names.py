"""Names for helper columns that a table does not have itself."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spare(df: DataFrame, *names: str) -> list[str]:
    """Each name, with as many `_` behind it as no column of `df` needs (upper and lower case are one)."""
    taken = {c.lower() for c in df.columns}
    longest = max((len(c) for c in taken), default=0)
    return [name if name.lower() not in taken else name + "_" * (longest + 1) for name in names]
