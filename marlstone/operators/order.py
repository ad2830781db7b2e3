"""Running sums over all rows by the order of a key, without a task that sees all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Keys drawn to find the ranges' bounds, and ranges at most.
DRAWN, RANGES = 4096, 256


def sums_before(rows: DataFrame, key: str, n: str, keys: DataFrame | None = None) -> DataFrame:
    """key, before: the sum of n over all rows with a smaller key, for distinct keys; rows without a key are left out.

    The keys with the smallest hashes, of `keys` if given, bound ranges of about as many rows each. A row's range follows from its
    key alone, so it is the same whenever it is computed; bounds decide how work is dealt, never the result.
    """
    rows = rows.where(F.col(key).isNotNull())
    drawn = (rows if keys is None else keys).select(key).where(F.col(key).isNotNull()).orderBy(F.xxhash64(key)).limit(DRAWN).collect()
    bounds = sorted(r[0] for r in drawn)[:: max(1, len(drawn) // RANGES)]
    place = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(key))) if bounds else F.lit(0)
    dealt = rows.select(key, n, place.alias("place"))
    # As many rows as ranges.
    whole = dealt.groupBy("place").agg(F.sum(n).alias("s"))
    base = whole.select("place", F.coalesce(F.sum("s").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    own = F.coalesce(F.sum(n).over(Window.partitionBy("place").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn("own", own).join(F.broadcast(base), "place").select(key, (F.col("base") + F.col("own")).alias("before"))
