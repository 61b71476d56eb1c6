"""Comparison of two runs: grouped statistics, change scores and tests."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPSILON = 1e-9
#: Samples up to this size get an exact U test.
SMALL = 8


def side_stats(rows: DataFrame, keys: list[str], side: Column, cycle: str, beta: str, mu: str) -> DataFrame:
    """for sides 1 and 2 mean and sample deviation of beta, mu and ln(1 + mu) and the number of cycles; 0 for a missing side."""
    mu_col = F.coalesce(F.col(mu).cast("double"), F.lit(0.0))
    rows = rows.select(*keys, side.alias("_side"), F.col(cycle).alias("_cycle"), F.col(beta).alias("beta"), mu_col.alias("mu"), F.log1p(mu_col).alias("log_mu"))
    names = ("beta", "mu", "log_mu")
    aggs = []
    for k in (1, 2):
        for v in names:
            mine = F.when(F.col("_side") == k, F.col(v))
            aggs += [F.coalesce(F.avg(mine), F.lit(0.0)).alias(f"{v}_mean{k}"), F.coalesce(F.stddev_samp(mine), F.lit(0.0)).alias(f"{v}_sd{k}")]
    # cycles are counted from distinct ones, so that no row is written once for each distinct count
    per = rows.where("_cycle is not null").select(*keys, "_side", "_cycle").distinct()
    counts = per.groupBy(*keys).agg(*(F.count_if(F.col("_side") == k).alias(f"cycles{k}") for k in (1, 2))).select(*(F.col(c).alias(f"_of_{c}") for c in keys), "cycles1", "cycles2")
    on = F.lit(True)
    for c in keys:
        on = on & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return rows.groupBy(*keys).agg(*aggs).join(counts, on, "left").drop(*(f"_of_{c}" for c in keys)).fillna(0, ["cycles1", "cycles2"])


def z(name: str) -> Column:
    """shift of the mean in deviations of the baseline, 0 without spread."""
    sd = F.col(f"{name}_sd1")
    return F.when(sd > EPSILON, (F.col(f"{name}_mean2") - F.col(f"{name}_mean1")) / sd).otherwise(0.0)


def scored(stats: DataFrame) -> DataFrame:
    """adds delta_beta, delta_mu, z_beta, z_mu, z_log_mu, suspicion."""
    rows = stats.withColumns({"delta_beta": F.col("beta_mean2") - F.col("beta_mean1"), "delta_mu": F.col("mu_mean2") - F.col("mu_mean1"), "z_beta": z("beta"), "z_mu": z("mu"), "z_log_mu": z("log_mu")})
    return rows.withColumn("suspicion", F.abs("delta_beta") * (F.abs("z_beta") + F.abs("z_log_mu")))


def welch(name: str) -> tuple[Column, Column]:
    """t and degrees of freedom, null where a side has one cycle or neither spreads."""
    v1, v2 = (F.pow(F.col(f"{name}_sd{k}"), 2) / F.nullif(F.col(f"cycles{k}"), F.lit(0)) for k in (1, 2))
    enough = (F.col("cycles1") > 1) & (F.col("cycles2") > 1) & (v1 + v2 > 0)
    t = (F.col(f"{name}_mean1") - F.col(f"{name}_mean2")) / F.sqrt(v1 + v2)
    df = F.pow(v1 + v2, 2) / (F.try_divide(F.pow(v1, 2), F.col("cycles1") - 1) + F.try_divide(F.pow(v2, 2), F.col("cycles2") - 1))
    return F.when(enough, t), F.when(enough, df)


def _beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d, out = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1), 1.0
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / (c if abs(c) > tiny else tiny)
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * out


def _t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([_beta_inc(n / 2, 0.5, n / (n + x * x)) if x == x and n == n else 1.0 for x, n in zip(t, df, strict=True)])


def rank_sums(rows: DataFrame, keys: list[str], side: Column, value: str) -> DataFrame:
    """Mann-Whitney U of side 1 by average ranks, the sizes, the tie term, and the two-sided p of the normal
    approximation with continuity correction (1 where a side has fewer than two)."""
    rows = rows.select(*keys, side.alias("_side"), F.col(value).alias("_v"))
    # equal values first become one row, so ranks are windows over distinct values
    per = rows.groupBy(*keys, "_v").agg(F.count("*").alias("n"), F.count_if(F.col("_side") == 1).alias("n1"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.withColumn("_rank", below + (F.col("n") + 1) / 2)
    out = per.groupBy(*keys).agg(F.sum("n1").alias("size1"), F.sum(F.col("n") - F.col("n1")).alias("size2"), F.sum(F.col("_rank") * F.col("n1")).alias("_r"), F.sum(F.pow("n", F.lit(3)) - F.col("n")).alias("ties"))
    n1, n2 = F.col("size1"), F.col("size2")
    n = n1 + n2
    u = F.col("_r") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12.0 * ((n + 1) - F.try_divide(F.col("ties"), n * (n - 1))))
    score = F.try_divide(F.greatest(u, n1 * n2 - u) - n1 * n2 / 2.0 - 0.5, sd)
    return out.withColumn("u", u).withColumn("z", F.when((n1 > 1) & (n2 > 1), score)).drop("_r")


def _normal_p(score: pd.Series) -> pd.Series:
    return pd.Series([min(1.0, math.erfc(max(x, 0.0) / math.sqrt(2))) if x == x else 1.0 for x in score])


def t_p_value(t: Column, df: Column) -> Column:
    """two-sided p of Student's t; 1 where t is missing."""
    return F.pandas_udf(_t_p, T.DoubleType())(t, df)


def normal_p_value(score: Column) -> Column:
    """Two-sided p of a normal score, 1 where it is missing."""
    return F.pandas_udf(_normal_p, T.DoubleType())(score)


def exact_u_p(n1: int, n2: int, u: float) -> float:
    """Two-sided p of U without ties by counting arrangements, for small samples (product of sizes)."""
    ways = np.zeros((n1 + 1, n1 * n2 + 1))
    ways[0, 0] = 1
    for rank in range(1, n1 + n2 + 1):  # each rank may fall to sample one; the sum of its ranks decides U
        for k in range(min(rank, n1), 0, -1):
            shift = rank - k
            if shift <= n1 * n2:
                ways[k, shift:] += ways[k - 1, : n1 * n2 + 1 - shift]
    low = int(min(u, n1 * n2 - u))
    return float(min(1.0, 2 * ways[n1, : low + 1].sum() / ways[n1].sum()))


def _u_p(n1: pd.Series, n2: pd.Series, u: pd.Series, ties: pd.Series, score: pd.Series) -> pd.Series:
    def one(a, b, x, t, s):
        if a < 2 or b < 2:
            return 1.0
        return exact_u_p(int(a), int(b), x) if t == 0 and min(a, b) <= SMALL and max(a, b) <= 50 * SMALL else _normal_p([s])[0]

    return pd.Series([one(*x) for x in zip(n1, n2, u, ties, score, strict=True)], dtype=float)


def u_p_value() -> Column:
    """two-sided p of a rank_sums() row: exact by counting where a side has at most SMALL values and none are tied (and the other at
    most 50 times that, beyond which both agree), else by the normal approximation; 1 where a side has fewer than two."""
    return F.pandas_udf(_u_p, T.DoubleType())("size1", "size2", "u", F.col("ties").cast("double"), "z")


def overview(cycles: DataFrame, side: Column, cycle: str, dur: str) -> DataFrame:
    """distinct cycles and mean duration of both sides, their difference and change."""
    rows = cycles.select(side.alias("_side"), F.col(cycle).alias("_c"), F.col(dur).alias("_d")).dropDuplicates()
    out = rows.agg(*(f for k in (1, 2) for f in (F.count_if(F.col("_side") == k).alias(f"cycles{k}"), F.coalesce(F.avg(F.when(F.col("_side") == k, F.col("_d"))), F.lit(0.0)).alias(f"mean{k}"))))
    delta = F.col("mean2") - F.col("mean1")
    return out.withColumn("delta", delta).withColumn("change_pct", F.when(F.col("mean1") > 0, delta / F.col("mean1") * 100).otherwise(F.lit(float("inf"))))


def clusters(scores: dict[tuple[int, int], float], n: int, threshold: float | None = None) -> list[int]:
    """Groups of n roles by pair scores; a pair at or below the threshold joins its groups. Without a threshold the
    largest jump (over five times the median jump) between sorted log scores sets it. Roles are few: this is driver work."""
    if threshold is None:
        logs = sorted(math.log1p(s) for s in scores.values())
        steps = [b - a for a, b in zip(logs, logs[1:])]
        usual = sorted(steps)[len(steps) // 2] if steps else 0
        jump = max(range(len(steps)), key=steps.__getitem__, default=None)
        threshold = math.expm1(logs[jump]) if jump is not None and n > 10 and steps[jump] > 5 * max(usual, EPSILON) else 0.0
    group = list(range(n))
    for i, j in combinations(range(n), 2):
        if scores.get((i, j), math.inf) <= threshold and group[i] != group[j]:
            low, high = sorted((group[i], group[j]))
            group = [low if g == high else g for g in group]
    return group


def labels(paths: list[str]) -> list[str]:
    """The shortest ends of the paths that tell them apart."""
    parts = [p.strip("/").split("/") for p in paths]
    take = [1] * len(paths)
    while True:
        names = ["/".join(p[-k:]) for p, k in zip(parts, take, strict=True)]
        again = [i for i, x in enumerate(names) if names.count(x) > 1 and take[i] < len(parts[i])]
        if not again:
            return names
        for i in again:
            take[i] += 1


def ranked_pairs(first: DataFrame, second: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys, rank, x, y, delta, change_pct: the values of both runs in falling order, side by side; the longer run has the rest alone."""
    def places(df, name):
        w = Window.partitionBy(*keys).orderBy(F.desc(value)) if keys else Window.orderBy(F.desc(value))  # cycles of one run
        return df.select(*keys, F.col(value).alias(name), F.row_number().over(w).alias("rank"))

    x, y = F.col("x"), F.col("y")
    rows = places(first, "x").join(places(second, "y"), [*keys, "rank"], "full_outer")
    return rows.withColumn("delta", y - x).withColumn("change_pct", F.when(x > 0, (y - x) / x * 100).when(y.isNotNull() & x.isNotNull(), F.lit(float("inf"))))


def process_pairs(first: DataFrame, second: DataFrame) -> DataFrame:
    """pid1, pid2, how: processes that both runs have ("strict"), and each that only the first has with each that only the second
    has ("cross"). The few distinct pids alone are crossed."""
    a, b = first.select("pid").distinct(), second.select("pid").distinct()
    same = a.intersect(b).select(F.col("pid").alias("pid1"), F.col("pid").alias("pid2"), F.lit("strict").alias("how"))
    rest = a.exceptAll(b).withColumnRenamed("pid", "pid1").crossJoin(b.exceptAll(a).withColumnRenamed("pid", "pid2"))
    return same.unionByName(rest.select("pid1", "pid2", F.lit("cross").alias("how")))


def paired(normal: DataFrame, abnormal: DataFrame) -> DataFrame:
    """Files (stem, suffix) of two runs by stem: the same suffix, else decode with the plain one or the reverse."""
    a = normal.select("stem", F.col("suffix").alias("suffix1"), F.col("path").alias("path1"))
    b = abnormal.select("stem", F.col("suffix").alias("suffix2"), F.col("path").alias("path2"))
    rank = F.when(F.col("suffix1") == F.col("suffix2"), 0).when(F.col("suffix1").isin("decode", "") & F.col("suffix2").isin("decode", ""), 1)
    rows = a.join(b, "stem").withColumn("_r", rank).where("_r is not null")
    best = F.row_number().over(Window.partitionBy("stem", "suffix1").orderBy("_r", "suffix2"))
    return rows.withColumn("_k", best).where("_k = 1").drop("_r", "_k")
