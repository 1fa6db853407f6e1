"""Finding the two columns of a pair table."""

from __future__ import annotations


def resolve_pair_columns(columns: list[str]) -> tuple[str, str, str]:
    """(enroll column, test column, 'path' or 'id'): the single column with 'enroll' and the single one
    with 'test' in its name (any case) that end in 'path', else those that end in 'id'. Anything else
    is an error, as a wrong guess would score the wrong pairs."""
    for ending in ("path", "id"):
        found = [[c for c in columns if side in c.lower() and c.lower().endswith(ending)] for side in ("enroll", "test")]
        if all(len(x) == 1 for x in found):
            return found[0][0], found[1][0], ending
    raise ValueError(f"no single pair of enroll and test columns among {columns}")
