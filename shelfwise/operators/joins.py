"""Salted equi-join for hot keys, the explicit fallback when AQE's skew-join
split does not apply (AQE off, or a plan shape it does not cover).

1. Hot keys are those with more than ``total / max_hot`` rows on the big side,
   found with a counting aggregate (combined map-side), so there are at most
   ``max_hot`` of them: a proven bound, broadcast.
2. Rows of the big side on a hot key get a salt ``pmod(xxhash64(row), n)``,
   deterministic under retries; other rows get salt 0.
3. Rows of the small side on a hot key are replicated ``n`` times (one per
   salt); other rows once with salt 0.
4. The join runs on ``(key, salt)``: a hot key's rows go to ``n`` tasks.

Inner and left joins (big side on the left) keep their meaning: every big
row meets exactly the small rows of its key, once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SALT = "_salt"


def hot_keys(df: DataFrame, key: str, max_hot: int = 1000) -> DataFrame:
    """Keys holding more than ``1 / max_hot`` of ``df``'s rows (at most
    ``max_hot`` keys)."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).withColumn("_c", F.lit(1))
    total = df.agg(F.count(F.lit(1)).alias("_t")).withColumn("_c", F.lit(1))   # one row
    return (counts.join(F.broadcast(total), "_c")
            .filter(F.col("_n") * F.lit(max_hot) > F.col("_t"))
            .select(key))


def salted_join(big: DataFrame, small: DataFrame, key: str, how: str = "inner",
                salts: int = 32, max_hot: int = 1000) -> DataFrame:
    """Join ``big`` to ``small`` on ``key`` with hot keys spread over
    ``salts`` tasks.  ``how`` is ``inner`` or ``left``."""
    if how not in ("inner", "left"):
        raise ValueError("salted_join supports inner and left joins (big side left)")
    hot = F.broadcast(hot_keys(big, key, max_hot).withColumn("_hot", F.lit(True)))
    row_hash = F.xxhash64(*[F.col(c) for c in big.columns])
    b = (big.join(hot, key, "left")
         # a NULL key meets nothing, so its rows may go anywhere
         .withColumn(_SALT, F.when(F.col("_hot") | F.col(key).isNull(), F.pmod(row_hash, F.lit(salts))).otherwise(F.lit(0)))
         .drop("_hot"))
    s = (small.join(hot, key, "left")
         .withColumn(_SALT, F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1)))
                                      .otherwise(F.array(F.lit(0)))))
         .drop("_hot"))
    return b.join(s, [key, _SALT], how).drop(_SALT)
