"""Running values along rows that are cut into ranges.

A file (or log, or song) whose rows do not fit a task is many ranges: groups of
consecutive rows that fit one. A running value is then found in two levels: within each
range by a window over (key, range), and across ranges by a window over one summary row a range,
which gives what each range starts from. Rows are dealt by (key, range), so no task has more than a range,
and the summaries of a key are as many as its ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def along(df: DataFrame, keys: Sequence[str], part: str | None, order: str, **running: tuple[str, Column | str]) -> DataFrame:
    """Add running values: ``name=(kind, column)``.

    Kinds: ``last`` and ``last_before``, the last value that is not null up to the row or before it;
    ``sum`` and ``sum_before``; ``min``, ``min_before``, ``max``, ``max_before``; ``lag``, the value of the row before; ``lead``, that of the row behind.
    Without ``part`` a key is one window partition.
    """
    value = {n: F.col(c) if isinstance(c, str) else c for n, (_, c) in running.items()}
    kind = {n: k for n, (k, _) in running.items()}
    fold = {"last": lambda c: F.last(c, ignorenulls=True), "sum": F.sum, "min": F.min, "max": F.max}
    base = lambda n: kind[n].removesuffix("_before")
    inner = W.partitionBy(*keys, part).orderBy(order) if part else W.partitionBy(*keys).orderBy(order)

    def local(n: str) -> Column:
        if kind[n] in ("lag", "lead"):
            return (F.lag if kind[n] == "lag" else F.lead)(value[n]).over(inner)
        return fold[base(n)](value[n]).over(inner.rowsBetween(W.unboundedPreceding, -1 if kind[n].endswith("_before") else 0))

    if part is None:
        return df.withColumns({n: local(n) for n in running})
    own = df.select("*", *(v.alias(f"_v_{n}") for n, v in value.items()))
    col = lambda n: F.col(f"_v_{n}")
    at = F.col(order)

    def summary(n: str) -> Column:
        if kind[n] in ("lag", "lead"):
            return (F.max_by if kind[n] == "lag" else F.min_by)(F.struct(col(n).alias("x")), at)
        if base(n) == "last":
            return F.max_by(F.when(col(n).isNotNull(), col(n)), F.when(col(n).isNotNull(), at))
        return fold[base(n)](col(n))

    ranges = own.groupBy(*keys, part).agg(*(summary(n).alias(f"_s_{n}") for n in running), F.min(order).alias("_first"), F.max(order).alias("_last"))
    outer = W.partitionBy(*keys).orderBy("_first")
    before = outer.rowsBetween(W.unboundedPreceding, -1)

    def carried(n: str) -> Column:
        s = F.col(f"_s_{n}")
        if kind[n] == "lag":
            return F.lag(s).over(outer)
        if kind[n] == "lead":
            return F.lead(s).over(outer)
        return fold[base(n)](s).over(before)

    ranges = ranges.select(*keys, part, "_first", "_last", *(carried(n).alias(f"_c_{n}") for n in running))
    ranges = ranges.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate([*keys, part])), "_first", "_last", *(f"_c_{n}" for n in running))
    met = own.withColumns({f"_l_{n}": local(n) for n in running})
    on = [met[k].eqNullSafe(ranges[f"_k{i}"]) for i, k in enumerate([*keys, part])]
    met = met.join(ranges, on)

    def whole(n: str) -> Column:
        here, carry = F.col(f"_l_{n}"), F.col(f"_c_{n}")
        if kind[n] == "lag":
            return F.when(at == F.col("_first"), carry["x"]).otherwise(here)
        if kind[n] == "lead":
            return F.when(at == F.col("_last"), carry["x"]).otherwise(here)
        if base(n) == "last":
            return F.coalesce(here, carry)
        if base(n) == "sum":
            return F.when(here.isNotNull() | carry.isNotNull(), F.coalesce(here, F.lit(0)) + F.coalesce(carry, F.lit(0)))
        return (F.least if base(n) == "min" else F.greatest)(here, carry)

    return met.select(*df.columns, *(whole(n).alias(n) for n in running))
