"""Row numbers within groups of any size: no group is one task's work."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspan.sources.scratch import stored


def numbered(rows: DataFrame, by: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """rows + name: row_number() over (partition by ``by`` order by ``order``), for groups of any size.

    Rows are dealt by ranges of both and sorted within them. A row's number is its place in its partition, from its group's first
    row there, after the group's rows in the partitions before: of each group and partition one row is summed. The
    partitions are stored, for all readings must see the same ranges; null keys are a group.
    """
    place = F.monotonically_increasing_id()  # the partition's number above 33 bits, the row's below
    ranges = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    ranges = stored(ranges.withColumns({"_part": F.shiftright(place, 33), "_at": place.bitwiseAND(F.lit((1 << 33) - 1))}))
    per = ranges.groupBy(*by, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*by, "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    same = [F.col("r._part") == F.col("p._part"), *(F.col("r." + c).eqNullSafe(F.col("p." + c)) for c in by)]
    on = same[0]
    for c in same[1:]:
        on = on & c
    out = ranges.alias("r").join(per.alias("p"), on)
    return out.select(*["r." + c for c in rows.columns], (F.col("_at") - F.col("_first") + F.col("_before") + 1).alias(name))
