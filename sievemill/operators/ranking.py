"""Running sums and ranks over a whole table, without one task that holds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a range, about; ranges at most; rows looked at for each range's border.
ROWS, RANGES, LOOKS = 1_000_000, 1000, 100


def running_sums(df: DataFrame, order: list[Column | str], values: dict[str, Column], keys: tuple[str, ...] = ()) -> DataFrame:
    """`df` with, for each of `values`, the sum of the rows up to and with each row, by `order` (nulls first) within `keys`.

    The order is cut into ranges at borders from a sample; any borders give the
    same sums.  Each range is sorted by itself and starts from the total of the
    ranges before it, of which there is one row a key and range.
    """
    names = [f"__o{i}" for i in range(len(order))]
    rows = df.withColumns(dict(zip(names, [F.col(c) if isinstance(c, str) else c for c in order], strict=True)))
    n = rows.count()
    ranges = min(RANGES, n // ROWS + 1)
    place = None
    if ranges > 1:
        seen = sorted({tuple(r) for r in rows.select(names).na.drop().sample(min(1.0, LOOKS * ranges / n), 1).collect()})
        kinds = [rows.schema[c].dataType for c in names]
        borders = [seen[i * len(seen) // ranges] for i in range(1, ranges)] if seen else []
        made = [F.struct(*[F.lit(v).cast(k).alias(c) for v, k, c in zip(b, kinds, names, strict=True)]) for b in borders]
        place = F.size(F.filter(F.array(*made), lambda b: b < F.struct(*names))) if made else None
    if place is None:  # one range, which begins at nothing
        upto = W.partitionBy(*keys, F.lit(1)).orderBy(*names).rowsBetween(W.unboundedPreceding, 0)
        return rows.withColumns({k: F.sum(v).over(upto) for k, v in values.items()}).drop(*names)
    rows = rows.withColumn("__range", place).withColumns({f"__v_{k}": v for k, v in values.items()})
    total = rows.groupBy(*keys, "__range").agg(*[F.sum(f"__v_{k}").alias(f"__t_{k}") for k in values])
    before = W.partitionBy(*keys, F.lit(1)).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    total = total.select(F.struct(*[F.col(k) for k in keys], "__range").alias("__at"), *[F.coalesce(F.sum(f"__t_{k}").over(before), F.lit(0)).alias(f"__b_{k}") for k in values])
    own = W.partitionBy(*keys, "__range").orderBy(*names).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({f"__s_{k}": F.sum(f"__v_{k}").over(own) for k in values})
    rows = rows.join(total, F.struct(*[F.col(k) for k in keys], "__range").eqNullSafe(F.col("__at")))
    return rows.select(*df.columns, *[(F.col(f"__s_{k}") + F.col(f"__b_{k}")).alias(k) for k in values])


def ranked(df: DataFrame, order: list[Column | str], name: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """`df` with the 0-based place of each row by a unique `order` within `keys`."""
    return running_sums(df, order, {"__place": F.lit(1)}, keys).withColumn(name, F.col("__place") - 1).drop("__place")
