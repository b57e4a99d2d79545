"""Making intervals of unequal length comparable."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_comparable(minutes: Column, target: Column, stretch: Column) -> Column:
    """Within a factor `stretch` of the expected cadence, both ends inclusive.

    Rescaling assumes steady use inside the interval. That is fair for a late reading and
    wrong for a gap of hours, so such intervals are kept as history but never judged.
    """
    factor = minutes / target
    usable = (minutes > 0) & (target > 0)
    return F.when(usable, (factor >= 1.0 / stretch) & (factor <= stretch)).otherwise(False)


def normalize(consumed: Column, minutes: Column, target: Column) -> Column:
    return F.when(minutes > 0, consumed * (target / minutes)).otherwise(consumed)
