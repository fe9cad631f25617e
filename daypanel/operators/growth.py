"""A panel that grows: a new window is merged into the stored one inside each entity's row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daypanel.sources.spine import day_count


def merge_panels(
    old: DataFrame,
    new: DataFrame,
    id: str,
    cols: Sequence[str],
    old_window: tuple[str, str],
    new_window: tuple[str, str],
    carried: Sequence[str] = (),
) -> DataFrame:
    """One panel over both windows: the old one's days before the new window, then the new one's.

    The windows adjoin or overlap, and the new one ends last; days that both
    have are taken from the new one, which knows what was reported late. The new
    panel must be built from all lines whose intervals reach into its window.
    Arrays in `carried` are running maxima: the new days start from the last
    old maximum. Entities of one panel only have zeros on the other's days, as
    in a panel that is built anew. The panels meet in one join by id, without
    an exchange where both are stored bucketed by it; columns other than `id`
    and `cols` are left out.
    """
    (old_start, old_end), (new_start, new_end) = old_window, new_window
    if not (old_start <= new_start and day_count(old_start, new_start) - 1 <= day_count(old_start, old_end) and old_end <= new_end):
        raise ValueError("the windows must adjoin or overlap, and the new one must end last")
    before, days = day_count(old_start, new_start) - 1, day_count(new_start, new_end)
    types = {f.name: f.dataType.elementType for f in new.select(*cols).schema.fields}
    one = old.select(F.col(id).alias("_old_id"), *[F.col(c).alias(f"_old_{i}") for i, c in enumerate(cols)])
    two = new.select(F.col(id).alias("_new_id"), *[F.col(c).alias(f"_new_{i}") for i, c in enumerate(cols)])
    met = one.join(two, F.col("_old_id") == F.col("_new_id"), "full_outer")

    def joined(i: int, c: str) -> Column:
        zero = F.lit(0).cast(types[c])
        head = F.slice(F.coalesce(F.col(f"_old_{i}"), F.array_repeat(zero, before)), 1, before)
        tail = F.coalesce(F.col(f"_new_{i}"), F.array_repeat(zero, days))
        if c in carried and before:
            last = F.coalesce(F.get(F.col(f"_old_{i}"), F.lit(before - 1)), zero)
            tail = F.transform(tail, lambda x: F.greatest(x, last))
        return F.concat(head, tail).alias(c)

    return met.select(F.coalesce("_old_id", "_new_id").alias(id), *[joined(i, c) for i, c in enumerate(cols)])
