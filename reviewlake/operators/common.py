"""Shared plan pieces: skew-safe ordered concatenation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rows per first-level group of an ordered concatenation.
DEFAULT_BUCKET_ROWS = 1024


def keys_list(keys: Sequence[str] | str) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def pos_bucket(pos: Column | str, rows: int = DEFAULT_BUCKET_ROWS) -> Column:
    """Order-preserving salt for data ordered by an integer position."""
    p = F.col(pos) if isinstance(pos, str) else pos
    return F.floor(p / F.lit(rows)).cast("bigint")


def sorted_items(order: list[Column], fields: dict[str, Column]) -> Column:
    """``array_sort(collect_list(struct(order..., fields...)))`` for one group."""
    parts = [c.alias(f"_o{i}") for i, c in enumerate(order)]
    parts += [c.alias(n) for n, c in fields.items()]
    return F.array_sort(F.collect_list(F.struct(*parts)))


def join_field(items: Column, field: str, sep: str) -> Column:
    return F.array_join(F.transform(items, lambda x: x[field]), sep)
