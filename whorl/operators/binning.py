"""Quantization bins from subband variances, with a trace of the rounds (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Subbands, first ones of the second and third region, least variance, weights from the 52nd on.
SUBBANDS, SECOND, THIRD, LEAST_VARIANCE = 60, 4, 51, 1.01
WEIGHTS = (1.32, 1.08, 1.42, 1.08, 1.32, 1.42, 1.08, 1.08)
_ROUND = "struct<round:int,n_active:int,area:double,product:double,scale:double,removed:array<int>>"


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def shares() -> Column:
    """The share of each subband: one over 1024, 256 or 16 by region."""
    return F.array(*(F.lit(1 / (1024 if i < SECOND else 256 if i < THIRD else 16)) for i in range(SUBBANDS)))


def bins(images: DataFrame, rate: float = 2.25, variances: str = "variances") -> DataFrame:
    """image_id, ``q`` and ``z`` (bin and zero bin of each of the 60 subbands) and ``rounds``.

    Subbands below the least variance have bins of 0 and take no part. The
    others start from a bin of 1 (first region) or 10 / (weight * ln variance);
    a common scale spreads the bit rate over the active ones. Those whose scaled
    bin is five deviations or more leave, and the next round starts, until none
    leaves; then the bins of all that took part are scaled. If all have left,
    bins are 0 and the last scale is null. Null variances count as 0.
    """
    weight = F.array(*(F.lit(1.0) for _ in range(SUBBANDS - len(WEIGHTS))), *(F.lit(w) for w in WEIGHTS))
    taken = lambda v: F.coalesce(v, F.lit(0.0)) >= LEAST_VARIANCE
    start = lambda v, i: F.when(i < SECOND, 1.0).otherwise(10 / (F.get(weight, i) * F.ln(v)))
    band = lambda v, i: F.struct(i.alias("i"), F.when(taken(v), F.sqrt(v)).alias("sigma"), F.when(taken(v), start(v, i)).alias("q"), F.get(shares(), i).alias("share"))
    rows = images.select("image_id", F.transform(F.col(variances).cast("array<double>"), band).alias("bands"))
    of = lambda i: F.get("bands", i)

    def step(state: Column, turn: Column) -> Column:
        area = F.aggregate(state.active, F.lit(0.0), lambda total, i: total + of(i).share)
        product = F.aggregate(state.active, F.lit(1.0), lambda total, i: total * F.pow(of(i).sigma / of(i).q, of(i).share))

        def scaled(found: Column) -> Column:
            scale = F.pow(F.lit(2.0), rate / found.area - 1) / 2.5 / F.pow(found.product, 1 / found.area)
            return F.when(found.area > 0, scale)

        def after(found: Column) -> Column:
            removed = F.filter(state.active, lambda i: of(i).q / found.scale >= 5 * of(i).sigma)
            left = F.array_except(state.active, removed)
            row = F.struct(turn.alias("round"), F.size(state.active).alias("n_active"), found.area.alias("area"), found.product.alias("product"), found.scale.alias("scale"), F.coalesce(removed, F.array().cast("array<int>")).alias("removed"))
            done = found.scale.isNull() | (F.size(removed) == 0)
            return F.struct(left.alias("active"), done.alias("done"), F.array_append(state.rounds, row).alias("rounds"))

        once = _bound(F.struct(area.alias("area"), product.alias("product")), lambda f: F.struct(f.area.alias("area"), f.product.alias("product"), scaled(f).alias("scale")))
        return F.when(state.done, state).otherwise(_bound(once, after))

    first = F.transform(F.filter("bands", lambda b: b.q.isNotNull()), lambda b: b.i)
    begin = F.struct(first.alias("active"), (F.size(first) == 0).alias("done"), F.array().cast(f"array<{_ROUND}>").alias("rounds"))
    settled = rows.withColumn("rounds", F.aggregate(F.sequence(F.lit(0), F.lit(SUBBANDS)), begin, step, lambda s: s.rounds))
    settled = settled.withColumn("scale", F.element_at(F.when(F.size("rounds") > 0, F.col("rounds")), -1).scale)
    q = F.transform("bands", lambda b: F.coalesce(b.q / F.col("scale"), F.lit(0.0)))
    return settled.select("image_id", q.alias("q"), F.transform(q, lambda v: 1.2 * v).alias("z"), "rounds")
