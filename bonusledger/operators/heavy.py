"""Joins on keys of which a few hold much of the rows.

The frequent keys are found by a sketch (Misra-Gries, one pass over the landed rows,
partial sketches merged): it holds every key above the share ``SUPPORT`` and at most
1 / SUPPORT others, whatever the number of keys.  Rows of those keys are spread over
``SALTS`` parts by a hash of further columns, the other side's rows of those keys are
repeated once per part, and one join on key and part does both the hot keys and the
rest.  A side that fits the broadcast threshold is still broadcast by the optimiser.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUPPORT = 0.005  # share of all rows from which on a key is hot
SALTS = 32


@dataclass(frozen=True)
class HotKeys:
    """Hashes of the frequent keys of some columns."""

    columns: tuple[str, ...]
    hashes: tuple[int, ...]

    def is_hot(self) -> Column:
        return F.xxhash64(*self.columns).isin(list(self.hashes)) if self.hashes else F.lit(False)


def hot_keys(rows: DataFrame, columns: Sequence[str], support: float = SUPPORT) -> HotKeys:
    """The keys above ``support`` of all rows (a job; its result has 1 / support
    numbers at most)."""
    found = rows.select(F.xxhash64(*columns).alias("h")).stat.freqItems(["h"], support).first()
    return HotKeys(tuple(columns), tuple(sorted(found[0] or [])))


def join(many: DataFrame, few: DataFrame, on: Sequence[str], hot: HotKeys | None, spread: Sequence[str],
         how: str = "left", salts: int = SALTS) -> DataFrame:
    """``many`` joined with ``few`` on columns that include the hot keys' columns;
    rows of hot keys are spread by the columns ``spread``."""
    if hot is None or not hot.hashes:
        return many.join(few, list(on), how)
    if how not in ("left", "inner"):
        raise ValueError("only left and inner joins can be spread")
    part = F.when(hot.is_hot(), F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    parts = F.when(hot.is_hot(), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return many.withColumn("_part", part).join(few.withColumn("_part", F.explode(parts)), [*on, "_part"], how).drop("_part")
