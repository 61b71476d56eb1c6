"""Latency monitoring: cleaning, regression quality, control limits, alarms, splits and trials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Parts that the rows of a pool are numbered in.
PARTS = 1024


def iqr_bounds(rows: DataFrame, keys: list[str], value: str, k: float = 1.5, least: int = 4) -> DataFrame:
    """F27 fit: keys, low, high of groups with at least `least` rows."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.75)))
    per = rows.groupBy(*keys).agg(q.alias("q"), F.count("*").alias("n")).where(F.col("n") >= least)
    spread = F.col("q")[1] - F.col("q")[0]
    return per.select(*keys, (F.col("q")[0] - k * spread).alias("low"), (F.col("q")[1] + k * spread).alias("high"))


def iqr_clean(rows: DataFrame, bounds: DataFrame, keys: list[str], value: str) -> DataFrame:
    """F27 transform: rows inside the bounds of their group; groups without bounds pass."""
    b = bounds.select(*(F.col(c).alias(f"_of_{c}") for c in keys), F.col("low").alias("_low"), F.col("high").alias("_high"))
    on = F.lit(True)
    for c in keys:
        on = on & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return rows.join(b, on, "left").where(F.col("_low").isNull() | F.col(value).between(F.col("_low"), F.col("_high"))).select(*rows.columns)


def regression_quality(rows: DataFrame, truth: str, predicted: str, features: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """quality of a prediction, clipped at 0; null for fewer than two rows."""
    y, p = F.col(truth).cast("double"), F.greatest(F.coalesce(F.col(predicted).cast("double"), F.lit(0.0)), F.lit(0.0))
    rows = rows.select(*keys, y.alias("y"), p.alias("p")).withColumn("e", F.col("y") - F.col("p")).withColumn("pe", F.col("e") / (F.col("y") + 1e-9)).withColumn("ape", F.abs("pe"))
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(F.col("e") * F.col("e")).alias("_sse"), F.var_pop("y").alias("_var"), F.avg("e").alias("resid_mean"), F.stddev_pop("e").alias("resid_sd"), F.avg("pe").alias("mpe"), F.avg("ape").alias("mape"),
        F.median("ape").alias("mdape"), F.stddev_pop("ape").alias("mape_sd"), F.percentile("ape", 0.95).alias("p95"), F.avg((F.col("ape") <= 0.1).cast("double")).alias("in_10"), F.avg((F.col("ape") <= 0.25).cast("double")).alias("in_25"),
    ).where("n >= 2")
    out = out.withColumn("r2", 1 - F.try_divide(F.col("_sse"), F.col("_var") * F.col("n"))).withColumn("rmse", F.sqrt(F.col("_sse") / F.col("n")))
    return out.withColumn("adj_r2", F.when(F.col("n") > features + 1, 1 - (1 - F.col("r2")) * (F.col("n") - 1) / (F.col("n") - features - 1))).drop("_sse", "_var")


def volatility(rows: DataFrame, keys: list[str], value: str, least: int = 30) -> DataFrame:
    """spread of groups with at least `least` rows: n, cv, score, ratio."""
    per = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"), F.min(value).alias("_a"), F.max(value).alias("_b")).where(F.col("n") >= least)
    cv = F.when(F.col("_m") > 0, F.col("_s") / F.col("_m")).otherwise(0.0)
    return per.select(*keys, "n", cv.alias("cv"), (cv * F.ln("n")).alias("score"), F.when(F.col("_a") > 0, F.col("_b") / F.col("_a")).otherwise(F.lit(float("inf"))).alias("ratio"))


def positive_error(truth: Column, predicted: Column) -> Column:
    """How far the truth exceeds the prediction, as a share of the truth."""
    return F.greatest((truth - F.greatest(predicted, F.lit(0.0))) / (truth + 1e-9), F.lit(0.0))


def rolling(value: str, keys: list[str], order: list[str], width: int = 10) -> Column:
    """Mean of the last `width` rows, null until there are as many."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - width, 0)
    return F.when(F.count(F.lit(1)).over(w) == width, F.avg(value).over(w))


def limits(rows: DataFrame, error: str, smooth: str, coefficient: float = 3.0, cap: float = 0.5, keys: tuple[str, ...] = ()) -> DataFrame:
    """Control limits of single errors (population deviation) and of their rolling means (sample deviation)."""
    return rows.groupBy(*keys).agg(F.least(F.avg(error) + coefficient * F.stddev_pop(error), F.lit(cap)).alias("point_limit"), F.least(F.avg(smooth) + coefficient * F.stddev_samp(smooth), F.lit(cap)).alias("window_limit"))


def alarm(value: Column, limit: Column) -> Column:
    """1 above the limit, else (unknown too) 0."""
    return F.coalesce(value > limit, F.lit(False)).cast("int")


def confusion(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """counts of both with margins (null: all)."""
    return rows.cube(truth, predicted).agg(F.count("*").alias("n"))


def class_report(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """precision, recall, F1 and support of each class."""
    both = rows.select(F.explode(F.array_distinct(F.array(truth, predicted))).alias("label"), F.col(truth).alias("_t"), F.col(predicted).alias("_p"))
    per = both.groupBy("label").agg(F.count_if((F.col("_t") == F.col("label")) & (F.col("_p") == F.col("label"))).alias("tp"), F.count_if(F.col("_p") == F.col("label")).alias("pred"), F.count_if(F.col("_t") == F.col("label")).alias("support"))
    p, r = F.coalesce(F.try_divide(F.col("tp"), F.col("pred")), F.lit(0.0)), F.coalesce(F.try_divide(F.col("tp"), F.col("support")), F.lit(0.0))
    return per.select("label", "support", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"))


def class_summary(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """one row: accuracy, and precision, recall and F1 averaged over classes, plainly (macro_) and by support (weighted_)."""
    per = class_report(rows, truth, predicted)
    n = F.sum("support")
    averages = [f.alias(f"{kind}_{c}") for c in ("precision", "recall", "f1") for kind, f in (("macro", F.avg(c)), ("weighted", F.sum(F.col(c) * F.col("support")) / n))]
    # a class's recall is its share of hits, so recall by support is the accuracy
    return per.agg((F.sum(F.col("recall") * F.col("support")) / n).alias("accuracy"), *averages)


def smoothed(value: str, keys: list[str], order: list[str], reach: int = 2) -> Column:
    """Mean of the row and up to `reach` on both sides."""
    return F.avg(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(-reach, reach))


def aligned_trials(rows: DataFrame, trial: str, order: list[str], value: str, at: int, names: list, reach: int = 100) -> DataFrame:
    """Place, t<name> for each trial: the values of the trials from `reach` rows before row number `at` of each to as many behind."""
    place = (F.row_number().over(Window.partitionBy(trial).orderBy(*order)).cast("bigint") - at).alias("place")
    near = rows.select(F.col(trial).alias("_trial"), F.col(value).alias("_value"), place).where(F.abs("place") <= reach)
    return near.groupBy("place").pivot("_trial", names).agg(F.max("_value")).toDF("place", *(f"t{n}" for n in names))


def trial_starts(rows: DataFrame, keys: list[str], order: list[str], mark: str) -> DataFrame:
    """Rows where `mark` differs from the row before."""
    return rows.withColumn("_was", F.lag(mark).over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(mark) != F.col("_was")).drop("_was")


def histogram(rows: DataFrame, value: str, bins: int = 50, keys: tuple[str, ...] = ()) -> DataFrame:
    """Keys, bin, n: rows in bins of equal width between the least and the greatest value; the greatest alone is bin number `bins`."""
    ends = rows.groupBy(*keys).agg(F.min(value).alias("_lo"), ((F.max(value) - F.min(value)) / bins).alias("_w"))
    rows = rows.join(ends, list(keys)) if keys else rows.join(F.broadcast(ends), F.lit(True))  # one row
    return rows.groupBy(*keys, F.coalesce(F.floor(F.try_divide(F.col(value) - F.col("_lo"), F.col("_w"))), F.lit(0)).alias("bin")).agg(F.count("*").alias("n"))


def axis_range(rows: DataFrame, value: str, pad: float = 0.05) -> DataFrame:
    """Low, high of an axis with some room on both sides; a constant gets one of its own size."""
    spread = F.max(value) - F.min(value)
    room = F.when(spread > 0, spread * pad).otherwise(F.greatest(F.abs(F.max(value)) * pad, F.lit(1.0)))
    return rows.agg((F.min(value) - room).alias("low"), (F.max(value) + room).alias("high"))


def heat(rows: DataFrame, x: str, y: str, value: str) -> DataFrame:
    """X, y, n, mean of a heat map."""
    return rows.groupBy(x, y).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def trial_metrics(rows: DataFrame, trial: str, index: str, anomaly: str, predicted: str) -> DataFrame:
    """F32: precision, recall, F1, false positive rate, lag (rows from the first anomaly to its first alarm) and detected."""
    a, p = F.col(anomaly) == 1, F.col(predicted) == 1
    per = rows.groupBy(trial).agg(F.count_if(a & p).alias("tp"), F.count_if(~a & p).alias("fp"), F.count_if(a & ~p).alias("fn"), F.count_if(~a).alias("normal"), F.min(F.when(a, F.col(index))).alias("_from"), F.min(F.when(a & p, F.col(index))).alias("_hit"))
    ratio = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    pr, rc = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return per.select(trial, pr.alias("precision"), rc.alias("recall"), ratio(2 * pr * rc, pr + rc).alias("f1"), ratio(F.col("fp"), F.col("normal")).alias("fpr"), (F.col("_hit") - F.col("_from")).alias("lag"), F.col("_hit").isNotNull().cast("int").alias("detected"))


def boundary_split(rows: DataFrame, keys: list[str], test: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds is_train. Groups that hold the least or greatest value of a key go to training; then groups in hash order
    until training has its share. Decided on distinct groups; a group is never cut."""
    clean = rows.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in keys})
    groups = clean.select(*keys).distinct()
    ends = groups.agg(*(f(c).alias(f"_{n}_{c}") for c in keys for n, f in (("lo", F.min), ("hi", F.max))), F.count("*").alias("_groups"))
    edge = F.lit(False)
    for c in keys:
        edge = edge | (F.col(c) == F.col(f"_lo_{c}")) | (F.col(c) == F.col(f"_hi_{c}"))
    held = groups.join(F.broadcast(ends), F.lit(True)).withColumn("_edge", edge)  # one row
    # the order is that of a number in 0 ... 2**62; its quantile comes from counts of its leading bits, so no task sorts all groups
    held = held.withColumn("_h", F.when(F.col("_edge"), F.lit(-1).cast("long")).otherwise(F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 2)))
    want = held.agg((F.count("*") - F.floor(F.count("*") * test)).alias("n")).first().n
    bins = held.groupBy(F.shiftright("_h", 46).alias("b")).agg(F.count("*").alias("n")).orderBy("b").collect()  # 65,537 at most
    seen, last = 0, -1
    for r in bins:
        last = r.b
        if seen + r.n >= want:
            break
        seen += r.n
    inside = held.where((F.shiftright("_h", 46) == last) & ~F.col("_edge")).withColumn("_k", F.row_number().over(Window.orderBy("_h", *keys))).where(F.col("_k") <= max(0, want - seen)).select(*(F.col(c).alias(f"_of_{c}") for c in keys), F.lit(True).alias("_in"))
    on = F.lit(True)
    for c in keys:
        on = on & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    held = held.join(inside, on, "left").withColumn("is_train", F.col("_edge") | (F.shiftright("_h", 46) < last) | F.coalesce("_in", F.lit(False)))
    return clean.join(held.select(*keys, "is_train"), keys)


def group_split(rows: DataFrame, keys: list[str], train: int = 8, of: int = 10) -> DataFrame:
    """Adds is_train by a hash of the group, so equal groups stay together without a shuffle."""
    return rows.withColumn("is_train", F.pmod(F.xxhash64(*keys), F.lit(of)) < train)


def trials(normal: DataFrame, abnormal: DataFrame, count: int = 20, n_normal: int = 1000, n_abnormal: int = 200, seed: int = 1) -> DataFrame:
    """`count` streams of normal rows and then abnormal ones, drawn with replacement: adds trial, idx, is_anomaly.
    Draws are hashed row numbers, so a trial is the same in each run; the number of draws is fixed. Rows are numbered in parts by a
    hash of their values, and parts by the counts of those before."""
    out = None
    for flag, pool, n, shift in ((0, normal, n_normal, 0), (1, abnormal, n_abnormal, n_normal)):
        rows = pool.withColumn("_h", F.xxhash64(*pool.columns)).withColumn("_p", F.pmod("_h", F.lit(PARTS)))
        counts = rows.groupBy("_p").agg(F.count("*").alias("_n"))  # PARTS rows at most
        offset = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
        place = F.row_number().over(Window.partitionBy("_p").orderBy("_h", *pool.columns)) - 1
        rows = rows.withColumn("_row", place).join(F.broadcast(offset), "_p").withColumn("_row", F.col("_row") + F.col("_before")).drop("_p", "_h", "_before")
        size = pool.agg(F.count("*").alias("_size"))
        draws = pool.sparkSession.range(count * n).select((F.col("id") / n).cast("int").alias("trial"), (F.col("id") % n + shift).cast("int").alias("idx"), F.xxhash64(F.lit(seed + flag), "id").alias("_h"))
        draws = draws.join(F.broadcast(size), F.lit(True)).where("_size > 0").withColumn("_pick", F.pmod("_h", "_size"))  # one row
        got = draws.join(rows, F.col("_pick") == F.col("_row")).drop("_h", "_size", "_pick", "_row").withColumn("is_anomaly", F.lit(flag))
        out = got if out is None else out.unionByName(got)
    return out
