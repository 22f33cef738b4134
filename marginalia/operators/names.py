"""Names of columns that would clash."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame


def cleared(df: DataFrame, new: Iterable[str], used: Iterable[str], prefix: str = "") -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """df with nothing in the way of an operator's columns, and what gives its own columns their names back.

    A column that has the name of one of the operator's new columns gives way: the operator's takes its
    place. Columns whose names begin with the prefix of the operator's working columns are kept under
    others meanwhile. Names count without regard to case, as Spark has them. The columns that the operator
    reads must have neither kind of name; that is an error at once.
    """
    new, used = {c.lower() for c in new}, {c.lower() for c in used}
    taken = lambda c: bool(prefix) and c.lower().startswith(prefix)
    if wrong := sorted(c for c in used if c in new or taken(c)):
        raise ValueError(f"columns that are read must not have the names of new or working columns: {wrong}")
    df = df.drop(*[c for c in df.columns if c.lower() in new])
    away = {c: f"own{k}_{c}" for k, c in enumerate(df.columns) if taken(c)}
    while set(map(str.lower, away.values())) & {c.lower() for c in df.columns}:
        away = {c: f"own_{x}" for c, x in away.items()}
    return df.withColumnsRenamed(away), lambda out: out.withColumnsRenamed({x: c for c, x in away.items()})
