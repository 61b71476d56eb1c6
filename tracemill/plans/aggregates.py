"""Queries over aggregations, comparison, monitoring and diagnosis (F, H17 to H19, I, L)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import compare, detect, diagnose, metrics, profile
from .registry import SPANS, TRACE, query, spans, table, trace


@query(f"WITH {TRACE} SELECT name, CAST(count(*) AS BIGINT) AS n, CAST(sum(dur) AS BIGINT) AS total, CAST(count(DISTINCT pid) AS BIGINT) AS files FROM trace WHERE dur > 10 GROUP BY name")
def F1_F2_function_stats(spark, sf):
    part = trace(spark, sf).where("dur > 10").groupBy("pid", "name").agg(F.count("*").alias("n"), F.sum("dur").alias("total"))  # the first of two phases, as by file
    return part.groupBy("name").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.count("*").alias("files"))


@query(f"""WITH {SPANS}, w AS (SELECT pid, max(end_ts) - min(ts) AS cycle FROM spans GROUP BY pid) SELECT pid, name, tid % 4 AS device, round(100.0 * sum(dur) / max(cycle), 6) AS beta, CAST(count(*) AS BIGINT) AS n FROM spans JOIN w USING (pid) GROUP BY pid, name, tid % 4""")
def F6_beta(spark, sf):
    rows = spans(spark, sf)
    w = rows.groupBy("pid").agg((F.max("end_ts") - F.min("ts")).alias("cycle"))
    rows = rows.join(w, "pid").select(F.col("pid").alias("cycle"), F.lit("oncpu").alias("func_type"), "name", "pid", (F.col("tid") % 4).alias("device"), F.col("dur").alias("work_dur"), F.col("cycle").alias("cycle_dur"))
    return metrics.beta(rows).select("pid", "name", "device", F.round("beta_pct", 6).alias("beta"), "n")


@query(f"""WITH {TRACE}, p AS (SELECT pid, tid, ceil(max(value) / 100) AS c FROM trace GROUP BY pid, tid), h AS (SELECT pid, CAST(sum(c) AS BIGINT) AS cores FROM p GROUP BY pid),
 t AS (SELECT unnest([8, 16, 24, 32, 48, 64, 96, 128]) AS x) SELECT pid, cores, arg_min(x, (abs(x - cores), x)) AS estimate FROM h, t GROUP BY pid, cores""")
def F9_core_estimate(spark, sf):
    from ..functions import scalar as S
    from ..functions import vocabulary as V

    h = trace(spark, sf).groupBy("pid", "tid").agg(F.ceil(F.max("value") / 100).alias("c")).groupBy("pid").agg(F.sum("c").alias("cores"))
    return h.select("pid", "cores", S.nearest(F.col("cores"), V.CORE_COUNTS).alias("estimate"))


@query(f"""WITH {TRACE}, x AS (SELECT *, CASE WHEN pid % 2 = 0 THEN 'h' || pid END AS host FROM trace) SELECT CAST(count(DISTINCT COALESCE(host, '')) AS BIGINT) AS hosts, CAST(count(DISTINCT pid) FILTER (WHERE ph = 'X') AS BIGINT) AS pids, CAST(count(DISTINCT tid) FILTER (WHERE ph = 'X') AS BIGINT) AS threads,
 min(ts) FILTER (WHERE ph = 'X' AND dur > 0) AS first_ts, max(end_ts) FILTER (WHERE ph = 'X' AND dur > 0) AS last_ts, CAST(count(*) FILTER (WHERE ph = 'X') AS BIGINT) AS spans FROM x""")
def F10_overview(spark, sf):
    host = F.when(F.col("pid") % 2 == 0, F.concat(F.lit("h"), F.col("pid").cast("string")))
    return profile.overview(trace(spark, sf).withColumn("host", host))


@query(f"""WITH {SPANS} SELECT tid, name, CAST(sum(dur) AS BIGINT) AS total, CAST(count(*) AS BIGINT) AS n, round(avg(dur), 4) AS mean, round(median(dur), 4) AS middle, min(dur) AS low, max(dur) AS high, round(stddev_pop(dur), 4) AS sd, round(100.0 * sum(dur) / sum(sum(dur)) OVER (PARTITION BY tid), 6) AS share FROM spans GROUP BY tid, name""")
def F11_duration_summary(spark, sf):
    per = spans(spark, sf).groupBy("tid", "name").agg(F.sum("dur").alias("total"), F.count("*").alias("n"), F.round(F.avg("dur"), 4).alias("mean"), F.round(F.median("dur"), 4).alias("middle"), F.min("dur").alias("low"), F.max("dur").alias("high"), F.round(F.stddev_pop("dur"), 4).alias("sd"))
    return per.withColumn("share", F.round(F.lit(100.0) * F.col("total") / F.sum("total").over(Window.partitionBy("tid")), 6))


@query(f"WITH {SPANS} SELECT tid, CAST(sum(dur) AS BIGINT) AS total, round(100.0 * sum(dur) / (max(end_ts) - min(ts)), 6) AS active FROM spans GROUP BY tid")
def F14_stream_totals(spark, sf):
    return spans(spark, sf).groupBy("tid").agg(F.sum("dur").alias("total"), F.round(F.lit(100.0) * F.sum("dur") / (F.max("end_ts") - F.min("ts")), 6).alias("active"))


#: Lines of finished and open orders as the two runs; discount as beta, tax as mu.
_AB = """rows AS (SELECT l_returnflag AS fn, l_suppkey % 10 AS device, CASE l_linestatus WHEN 'F' THEN 1 ELSE 2 END AS side, l_orderkey AS cycle, l_discount AS beta, CASE WHEN l_linenumber = 7 THEN 0.0 ELSE l_tax END AS mu FROM lineitem),
 st AS (SELECT fn, device, COALESCE(avg(beta) FILTER (WHERE side = 1), 0) AS b1, COALESCE(avg(beta) FILTER (WHERE side = 2), 0) AS b2, COALESCE(stddev_samp(beta) FILTER (WHERE side = 1), 0) AS bs1, COALESCE(stddev_samp(beta) FILTER (WHERE side = 2), 0) AS bs2,
 COALESCE(avg(mu) FILTER (WHERE side = 1), 0) AS m1, COALESCE(avg(mu) FILTER (WHERE side = 2), 0) AS m2, COALESCE(stddev_samp(mu) FILTER (WHERE side = 1), 0) AS ms1, COALESCE(avg(ln(1 + mu)) FILTER (WHERE side = 1), 0) AS g1, COALESCE(avg(ln(1 + mu)) FILTER (WHERE side = 2), 0) AS g2, COALESCE(stddev_samp(ln(1 + mu)) FILTER (WHERE side = 1), 0) AS gs1,
 count(DISTINCT cycle) FILTER (WHERE side = 1) AS n1, count(DISTINCT cycle) FILTER (WHERE side = 2) AS n2 FROM rows GROUP BY fn, device)"""


def _sides(spark, sf):
    mu = F.when(F.col("l_linenumber") != 7, F.col("l_tax"))
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("fn"), (F.col("l_suppkey") % 10).alias("device"), F.when(F.col("l_linestatus") == "F", 1).otherwise(2).alias("side"), F.col("l_orderkey").alias("cycle"), F.col("l_discount").alias("beta"), mu.alias("mu"))
    return rows


@query(f"""WITH {_AB} SELECT fn, device, round(b2 - b1, 6) AS delta_beta, round(CASE WHEN bs1 > 1e-9 THEN (b2 - b1) / bs1 ELSE 0 END, 6) AS z_beta, round(CASE WHEN ms1 > 1e-9 THEN (m2 - m1) / ms1 ELSE 0 END, 6) AS z_mu,
 round(abs(b2 - b1) * (abs(CASE WHEN bs1 > 1e-9 THEN (b2 - b1) / bs1 ELSE 0 END) + abs(CASE WHEN gs1 > 1e-9 THEN (g2 - g1) / gs1 ELSE 0 END)), 6) AS suspicion, CAST(n1 AS BIGINT) AS cycles1, CAST(n2 AS BIGINT) AS cycles2 FROM st""")
def F19_F20_F21_change_scores(spark, sf):
    out = compare.scored(compare.side_stats(_sides(spark, sf), ["fn", "device"], F.col("side"), "cycle", "beta", "mu"))
    return out.select("fn", "device", *(F.round(c, 6).alias(c) for c in ("delta_beta", "z_beta", "z_mu", "suspicion")), "cycles1", "cycles2")


@query(f"""WITH {_AB} SELECT fn, device, round((b1 - b2) / sqrt(bs1 * bs1 / n1 + bs2 * bs2 / n2), 4) AS t, round(pow(bs1 * bs1 / n1 + bs2 * bs2 / n2, 2) / (pow(bs1 * bs1 / n1, 2) / (n1 - 1) + pow(bs2 * bs2 / n2, 2) / (n2 - 1)), 3) AS df FROM st WHERE n1 > 1 AND n2 > 1""")
def F22_welch(spark, sf):
    st = compare.side_stats(_sides(spark, sf), ["fn", "device"], F.col("side"), "cycle", "beta", "mu")
    t, df = compare.welch("beta")
    return st.select("fn", "device", F.round(t, 4).alias("t"), F.round(df, 3).alias("df")).where("t is not null")


@query()
def F22_welch_p_values(spark, sf):
    st = compare.side_stats(_sides(spark, sf), ["fn", "device"], F.col("side"), "cycle", "beta", "mu")
    t, df = compare.welch("beta")
    return st.select("fn", "device", compare.t_p_value(t, df).alias("p"))


@query("""WITH r AS (SELECT l_returnflag AS fn, CASE l_linestatus WHEN 'F' THEN 1 ELSE 2 END AS side, l_quantity AS v FROM lineitem), k AS (SELECT *, rank() OVER (PARTITION BY fn ORDER BY v) + (count(*) OVER (PARTITION BY fn, v) - 1) / 2.0 AS rk FROM r)
 SELECT fn, CAST(count(*) FILTER (WHERE side = 1) AS BIGINT) AS size1, CAST(count(*) FILTER (WHERE side = 2) AS BIGINT) AS size2, CAST(sum(CASE WHEN side = 1 THEN rk ELSE 0 END) - count(*) FILTER (WHERE side = 1) * (count(*) FILTER (WHERE side = 1) + 1) / 2.0 AS DOUBLE) AS u FROM k GROUP BY fn""")
def F23_mann_whitney(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("fn"), F.when(F.col("l_linestatus") == "F", 1).otherwise(2).alias("side"), "l_quantity")
    return compare.rank_sums(rows, ["fn"], F.col("side"), "l_quantity").select("fn", "size1", "size2", "u")


@query()
def F23_mann_whitney_p_values(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("fn"), F.when(F.col("l_linestatus") == "F", 1).otherwise(2).alias("side"), "l_quantity")
    return compare.rank_sums(rows, ["fn"], F.col("side"), "l_quantity").select("fn", "u", compare.u_p_value().alias("p"))


@query("""WITH c AS (SELECT DISTINCT CASE o_orderstatus WHEN 'F' THEN 1 ELSE 2 END AS side, o_orderkey, o_totalprice FROM orders), a AS (SELECT CAST(count(*) FILTER (WHERE side = 1) AS BIGINT) AS cycles1, avg(o_totalprice) FILTER (WHERE side = 1) AS m1, CAST(count(*) FILTER (WHERE side = 2) AS BIGINT) AS cycles2, avg(o_totalprice) FILTER (WHERE side = 2) AS m2 FROM c)
 SELECT cycles1, cycles2, round(m1, 4) AS mean1, round(m2, 4) AS mean2, round(m2 - m1, 4) AS delta, round((m2 - m1) / m1 * 100, 4) AS change_pct FROM a""")
def F24_overview_of_runs(spark, sf):
    out = compare.overview(table(spark, sf, "orders"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(2), "o_orderkey", "o_totalprice")
    return out.select("cycles1", "cycles2", *(F.round(c, 4).alias(c) for c in ("mean1", "mean2", "delta", "change_pct")))


@query("SELECT o_orderpriority AS role, CAST(count(DISTINCT o_custkey) AS BIGINT) AS pids, CAST(count(*) AS BIGINT) AS cycles, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1")
def F25_role_overview(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("role")).agg(F.countDistinct("o_custkey").alias("pids"), F.count("*").alias("cycles"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


@query("SELECT o_custkey, o_orderstatus AS most, n, round(100.0 * n / total, 4) AS share FROM (SELECT o_custkey, o_orderstatus, CAST(count(*) AS BIGINT) AS n, sum(count(*)) OVER (PARTITION BY o_custkey) AS total, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderstatus) AS r FROM orders GROUP BY 1, 2) WHERE r = 1")
def F26_bottleneck_histogram(spark, sf):
    per = table(spark, sf, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n"))
    w = Window.partitionBy("o_custkey")
    rows = per.withColumn("total", F.sum("n").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc("n"), "o_orderstatus"))).where("r = 1")
    return rows.select("o_custkey", F.col("o_orderstatus").alias("most"), "n", F.round(F.lit(100.0) * F.col("n") / F.col("total"), 4).alias("share"))


@query("""WITH b AS (SELECT l_returnflag, l_suppkey, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 4)
 SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem LEFT JOIN b USING (l_returnflag, l_suppkey) WHERE q1 IS NULL OR l_extendedprice BETWEEN q1 - 0.5 * (q3 - q1) AND q3 + 0.5 * (q3 - q1)""")
def F27_iqr_cleaning(spark, sf):
    rows, keys = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_suppkey", "l_extendedprice"), ["l_returnflag", "l_suppkey"]
    return detect.iqr_clean(rows, detect.iqr_bounds(rows, keys, "l_extendedprice", 0.5), keys, "l_extendedprice").select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("""WITH p AS (SELECT l_returnflag, l_extendedprice AS y, greatest(l_quantity * 1500 - 200, 0) AS p FROM lineitem), e AS (SELECT *, y - p AS e, (y - p) / (y + 1e-9) AS pe, abs((y - p) / (y + 1e-9)) AS ape FROM p)
 SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n, round(1 - sum(e * e) / (var_pop(y) * count(*)), 4) AS r2, round(sqrt(avg(e * e)), 4) AS rmse, round(avg(pe), 4) AS mpe, round(avg(ape), 4) AS mape, round(median(ape), 4) AS mdape, round(quantile_cont(ape, 0.95), 4) AS p95, round(avg(CASE WHEN ape <= 0.1 THEN 1 ELSE 0 END), 4) AS in_10 FROM e GROUP BY 1""")
def F28_regression_quality(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("predicted", F.col("l_quantity") * 1500 - 200)
    out = detect.regression_quality(rows, "l_extendedprice", "predicted", 1, ("l_returnflag",))
    return out.select("l_returnflag", "n", *(F.round(c, 4).alias(c) for c in ("r2", "rmse", "mpe", "mape", "mdape", "p95", "in_10")))


@query("""WITH v AS (SELECT l_linenumber, l_suppkey % 20 AS c, CAST(count(*) AS BIGINT) AS n, stddev_samp(l_extendedprice) / avg(l_extendedprice) AS cv, max(l_extendedprice) / min(l_extendedprice) AS ratio FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 30)
 SELECT l_linenumber, n, round(cv, 6) AS cv, round(cv * ln(n), 6) AS score, round(ratio, 4) AS ratio FROM (SELECT *, row_number() OVER (PARTITION BY l_linenumber ORDER BY cv * ln(n) DESC) AS r FROM v) WHERE r = 1""")
def F29_F30_volatility(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("c", F.col("l_suppkey") % 20)
    v = detect.volatility(rows, ["l_linenumber", "c"], "l_extendedprice")
    top = v.withColumn("r", F.row_number().over(Window.partitionBy("l_linenumber").orderBy(F.desc("score")))).where("r = 1")
    return top.select("l_linenumber", "n", F.round("cv", 6).alias("cv"), F.round("score", 6).alias("score"), F.round("ratio", 4).alias("ratio"))


_CLASSES = "c AS (SELECT CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS truth, CASE WHEN l_extendedprice > 40000 THEN 1 ELSE 0 END AS predicted FROM lineitem)"


def _classes(spark, sf):
    return table(spark, sf, "lineitem").select((F.col("l_quantity") > 25).cast("int").alias("truth"), (F.col("l_extendedprice") > 40000).cast("int").alias("predicted"))


@query(f"WITH {_CLASSES} SELECT truth, predicted, CAST(count(*) AS BIGINT) AS n FROM c GROUP BY CUBE (truth, predicted)")
def F31_confusion(spark, sf):
    return detect.confusion(_classes(spark, sf), "truth", "predicted")


@query(f"""WITH {_CLASSES}, l AS (SELECT unnest([0, 1]) AS label), s AS (SELECT label, CAST(count(*) FILTER (WHERE truth = label AND predicted = label) AS DOUBLE) AS tp, count(*) FILTER (WHERE predicted = label) AS pr, CAST(count(*) FILTER (WHERE truth = label) AS BIGINT) AS support FROM c, l GROUP BY label)
 SELECT label, support, round(tp / pr, 6) AS precision, round(tp / support, 6) AS recall, round(2 * tp / (pr + support), 6) AS f1 FROM s""")
def F31_class_report(spark, sf):
    return detect.class_report(_classes(spark, sf), "truth", "predicted").select("label", "support", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


_TRIALS = """t AS (SELECT l_suppkey % 20 AS trial, l_orderkey * 10 + l_linenumber AS idx, CASE WHEN l_orderkey > (SELECT max(l_orderkey) * 0.8 FROM lineitem) THEN 1 ELSE 0 END AS anomaly, CASE WHEN l_discount > 0.08 THEN 1 ELSE 0 END AS alarm FROM lineitem),
 m AS (SELECT trial, count(*) FILTER (WHERE anomaly = 1 AND alarm = 1) AS tp, count(*) FILTER (WHERE anomaly = 0 AND alarm = 1) AS fp, count(*) FILTER (WHERE anomaly = 1 AND alarm = 0) AS fn, count(*) FILTER (WHERE anomaly = 0) AS normal, min(idx) FILTER (WHERE anomaly = 1 AND alarm = 1) - min(idx) FILTER (WHERE anomaly = 1) AS lag FROM t GROUP BY trial)"""


def _trial_rows(spark, sf):
    l = table(spark, sf, "lineitem")
    top = l.agg((F.max("l_orderkey") * 0.8).alias("cut"))
    rows = l.join(F.broadcast(top), F.lit(True))  # one row
    return rows.select((F.col("l_suppkey") % 20).alias("trial"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("idx"), (F.col("l_orderkey") > F.col("cut")).cast("int").alias("anomaly"), (F.col("l_discount") > 0.08).cast("int").alias("alarm"))


@query(f"WITH {_TRIALS} SELECT trial, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(fp / normal, 6) AS fpr, lag, CASE WHEN lag IS NULL THEN 0 ELSE 1 END AS detected FROM m")
def F32_trial_metrics(spark, sf):
    out = detect.trial_metrics(_trial_rows(spark, sf), "trial", "idx", "anomaly", "alarm")
    return out.select("trial", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "fpr")), "lag", "detected")


@query(f"WITH {_TRIALS} SELECT round(avg(tp / (tp + fn)), 6) AS mean_recall, round(stddev_samp(tp / (tp + fn)), 6) AS sd_recall, round(avg(lag), 4) AS mean_lag FROM m")
def F33_across_trials(spark, sf):
    out = detect.trial_metrics(_trial_rows(spark, sf), "trial", "idx", "anomaly", "alarm")
    return out.agg(F.round(F.avg("recall"), 6).alias("mean_recall"), F.round(F.stddev_samp("recall"), 6).alias("sd_recall"), F.round(F.avg("lag"), 4).alias("mean_lag"))


@query("SELECT o_orderstatus AS cluster, arg_min(o_custkey, (s, o_custkey)) AS member FROM (SELECT o_orderstatus, o_custkey, round(stddev_samp(o_totalprice), 4) AS s FROM orders GROUP BY 1, 2) WHERE s IS NOT NULL GROUP BY 1")
def F34_best_member(spark, sf):
    per = table(spark, sf, "orders").groupBy("o_orderstatus", "o_custkey").agg(F.round(F.stddev_samp("o_totalprice"), 4).alias("s")).where("s is not null")
    return per.groupBy(F.col("o_orderstatus").alias("cluster")).agg(F.min_by("o_custkey", F.struct("s", "o_custkey")).alias("member"))


@query("SELECT l_orderkey, arg_max(l_returnflag, (CASE l_returnflag WHEN 'R' THEN 4 WHEN 'A' THEN 3 ELSE 2 END, l_linenumber)) AS chosen FROM lineitem GROUP BY l_orderkey")
def F36_priority_merge(spark, sf):
    p = F.when(F.col("l_returnflag") == "R", 4).when(F.col("l_returnflag") == "A", 3).otherwise(2)
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max_by("l_returnflag", F.struct(p, "l_linenumber")).alias("chosen"))


@query("SELECT n_regionkey AS category, CAST(count(*) AS BIGINT) AS n, string_agg(n_name, ',' ORDER BY n_name) AS items FROM nation GROUP BY 1")
def F37_hardware_groups(spark, sf):
    from ..operators import topology

    out = topology.by_category(table(spark, sf, "nation").select(F.col("n_regionkey").alias("category"), F.col("n_name").alias("component")))
    return out.select("category", "n", F.array_join("components", ",").alias("items"))


@query("SELECT comm, rank, node, device FROM (SELECT l_suppkey % 50 AS comm, l_linenumber AS rank, arg_max(l_partkey, (l_orderkey, l_partkey, l_linenumber)) AS node, arg_max(l_linenumber, (l_orderkey, l_partkey, l_linenumber)) AS device FROM lineitem GROUP BY 1, 2)")
def F39_topology_maps(spark, sf):
    from ..operators import topology

    l = table(spark, sf, "lineitem")
    return topology.maps(l.select(F.col("l_orderkey").alias("seq"), (F.col("l_suppkey") % 50).alias("comm"), F.col("l_linenumber").alias("rank"), F.col("l_partkey").alias("node"), F.col("l_linenumber").alias("device"), F.lit("h").alias("host")))[0]


@query("SELECT l_orderkey, l_linenumber, CASE WHEN hosts > 1 THEN l_returnflag END AS host FROM lineitem JOIN (SELECT l_orderkey, count(DISTINCT l_returnflag) AS hosts FROM lineitem GROUP BY 1) USING (l_orderkey)")
def F40_single_host_switch(spark, sf):
    w = Window.partitionBy("l_orderkey")
    several = F.size(F.collect_set("l_returnflag").over(w)) > 1
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when(several, F.col("l_returnflag")).alias("host"))


@query(f"""WITH {TRACE}, e AS (SELECT tid, ts, seq, greatest((value - 200) / (value + 1e-9), 0) AS err FROM trace), r AS (SELECT *, CASE WHEN count(*) OVER w = 10 THEN avg(err) OVER w END AS smooth FROM e WINDOW w AS (PARTITION BY tid ORDER BY ts, seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
 l AS (SELECT tid, least(avg(err) + 3 * stddev_pop(err), 0.5) AS p, least(avg(smooth) + 1.5 * stddev_samp(smooth), 0.5) AS w FROM r GROUP BY tid)
 SELECT seq, round(err, 6) AS err, CASE WHEN err > p THEN 1 ELSE 0 END AS point_alarm, CASE WHEN round(smooth, 9) > round(w, 9) THEN 1 ELSE 0 END AS window_alarm, CASE WHEN smooth > 0.15 THEN 1 ELSE 0 END AS fixed_alarm FROM r JOIN l USING (tid)""")
def H17_H18_L12_control_chart(spark, sf):
    rows = trace(spark, sf).select("tid", "ts", "seq", detect.positive_error(F.col("value"), F.lit(200.0)).alias("err"))
    rows = rows.withColumn("smooth", detect.rolling("err", ["tid"], ["ts", "seq"]))
    lim = detect.limits(rows, "err", "smooth", keys=("tid",)).select("tid", "point_limit")
    win = detect.limits(rows, "err", "smooth", 1.5, keys=("tid",)).select("tid", "window_limit")
    both = rows.join(lim, "tid").join(win, "tid")
    return both.select("seq", F.round("err", 6).alias("err"), detect.alarm(F.col("err"), F.col("point_limit")).alias("point_alarm"), detect.alarm(F.round("smooth", 9), F.round("window_limit", 9)).alias("window_alarm"), detect.alarm(F.col("smooth"), F.lit(0.15)).alias("fixed_alarm"))


@query("""WITH n AS (SELECT l_suppkey % 3 AS trial, l_discount, row_number() OVER (PARTITION BY l_suppkey % 3 ORDER BY l_orderkey, l_linenumber, l_discount) - 1000 AS place FROM lineitem)
 SELECT place, max(l_discount) FILTER (WHERE trial = 0) AS t0, max(l_discount) FILTER (WHERE trial = 1) AS t1, max(l_discount) FILTER (WHERE trial = 2) AS t2 FROM n WHERE place BETWEEN -100 AND 100 GROUP BY place""")
def H19_aligned_trials(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("trial", F.col("l_suppkey") % 3)
    return detect.aligned_trials(rows, "trial", ["l_orderkey", "l_linenumber", "l_discount"], "l_discount", 1000, [0, 1, 2])


#: Hosts of a cycle from days of the events table, with counters scaled to the units of the health checks.
_HEALTH = """c AS (SELECT epoch_us(ts) // 86400000000 AS cycle, 'h' || (user_id % 4) AS host, user_id % 8 AS kind, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events),
 h AS (SELECT cycle, host, avg(CASE WHEN kind < 8 THEN 1000 + 30 * k END) AS freq, avg(k) + 40 AS temp, max(k) AS gpu_freq, avg(k * 1e8) AS mem FROM c GROUP BY 1, 2)"""


def _host_rows(spark, sf):
    c = trace(spark, sf).select(F.expr("ts div 86400000000").alias("cycle"), F.concat(F.lit("h"), (F.col("tid") % 4).cast("string")).alias("host"), F.col("k").cast("double").alias("k"))
    values = F.expr("stack(4, 'cpu_frequency', 1000 + 30 * k, 'cpu_temp', k + 40, 'gpu_frequency', k, 'host_mem_available', k * 1e8) as (name, value)")
    return c.select("cycle", "host", values)


@query(f"WITH {_HEALTH} SELECT cycle, host, round(freq, 4) AS freq, round(temp, 4) AS temp, gpu_freq, round(mem / 1e6, 4) AS mem FROM h")
def F18_health(spark, sf):
    return diagnose.health(_host_rows(spark, sf)).select("cycle", "host", F.round("freq", 4).alias("freq"), F.round("temp", 4).alias("temp"), "gpu_freq", F.round(F.col("mem") / 1e6, 4).alias("mem"))


@query(f"""WITH {_HEALTH}, w AS (SELECT *, max(freq) OVER (PARTITION BY cycle) AS f, max(gpu_freq) OVER (PARTITION BY cycle) AS g, count(*) OVER (PARTITION BY cycle) > 1 AS many FROM h)
 SELECT cycle, host, 'CPU_FREQ_DROP_RELATIVE' AS issue FROM w WHERE many AND freq < f * 0.7 UNION ALL SELECT cycle, host, 'GPU_FREQ_DROP_RELATIVE' FROM w WHERE many AND gpu_freq < g * 0.85 UNION ALL SELECT cycle, host, 'CPU_THERMAL_THROTTLING' FROM w WHERE temp > 90
 UNION ALL SELECT cycle, host, 'CPU_FREQ_DROP_ABSOLUTE' FROM w WHERE freq < 1200 UNION ALL SELECT cycle, host, 'HOST_MEMORY_PRESSURE' FROM w WHERE mem < 2e9""")
def I2_I3_health_issues(spark, sf):
    return diagnose.issues(diagnose.health(_host_rows(spark, sf))).select("cycle", "host", "issue")


def _perf_rows(spark, sf):
    l = table(spark, sf, "lineitem")
    kind = F.when(F.col("l_linenumber") == 1, "oncpu").when(F.col("l_returnflag") == "A", "gpu_comm").when(F.col("l_returnflag") == "R", "gpu_compute").otherwise("gpu_memcpy_h2d")
    return l.select((F.col("l_orderkey") % 500).alias("cycle"), F.concat(F.lit("h"), (F.col("l_suppkey") % 3).cast("string")).alias("host"), kind.alias("func_type"), F.concat(F.lit("k"), F.col("l_partkey").cast("string")).alias("name"), F.col("l_suppkey").alias("pid"), F.col("l_linenumber").alias("device"), (F.col("l_discount") * 100 + F.col("l_orderkey") / 1e6).alias("beta"), F.col("l_quantity").alias("dur"), F.lit(1000.0).alias("cycle_dur"))


_PERF = """p AS (SELECT l_orderkey % 500 AS cycle, 'h' || (l_suppkey % 3) AS host, CASE WHEN l_linenumber = 1 THEN 'oncpu' WHEN l_returnflag = 'A' THEN 'gpu_comm' WHEN l_returnflag = 'R' THEN 'gpu_compute' ELSE 'gpu_memcpy_h2d' END AS func_type, l_discount * 100 + l_orderkey / 1e6 AS beta, l_quantity AS dur,
 'k' || l_partkey AS name, l_suppkey AS pid, l_linenumber AS device FROM lineitem),
 t AS (SELECT *, row_number() OVER (PARTITION BY cycle ORDER BY beta DESC, func_type DESC, name DESC, pid DESC, host DESC, device DESC) AS r FROM p WHERE func_type <> 'oncpu'), l AS (SELECT cycle, arg_max(host, (load, host)) AS straggler FROM (SELECT cycle, host, sum(dur) AS load FROM p WHERE func_type = 'gpu_compute' GROUP BY 1, 2) GROUP BY 1),
 n AS (SELECT cycle, count(DISTINCT host) AS hosts FROM p GROUP BY 1)"""


@query(f"""WITH {_PERF}, f AS (SELECT cycle, 'h' || (cycle % 3) AS host, 1.0 + cycle % 2 AS priority, 'ISSUE_' || (cycle % 5) AS issue FROM (SELECT DISTINCT cycle FROM p) WHERE cycle % 4 = 0 UNION ALL SELECT cycle, 'h1', 2.0, 'OTHER' FROM (SELECT DISTINCT cycle FROM p) WHERE cycle % 8 = 0),
 m AS (SELECT f.cycle, min(priority) AS pr, count(*) AS n, min(issue) AS issue, array_to_string(list_sort(list_distinct(list(host))), ',') AS at_ FROM f WHERE priority = (SELECT min(priority) FROM f g WHERE g.cycle = f.cycle) GROUP BY f.cycle), c AS (SELECT cycle, arg_max(host, (beta, host)) AS cpu_host FROM p WHERE func_type = 'oncpu' GROUP BY cycle)
 SELECT n.cycle, CASE WHEN n.cycle % 16 = 5 THEN 'DELAYED_START' WHEN m.n > 1 THEN 'MULTIPLE_P' || CAST(m.pr AS INTEGER) || '_ISSUES' WHEN m.n = 1 THEN m.issue WHEN beta IS NULL OR beta < 1 THEN 'CPU_BOTTLENECK' WHEN func_type = 'gpu_comm' AND straggler IS NOT NULL AND hosts > 1 THEN 'LOAD_IMBALANCE_PURE' WHEN func_type = 'gpu_comm' THEN 'COMM_BOTTLENECK' WHEN func_type = 'gpu_compute' THEN 'COMPUTE_BOUND' ELSE 'DATA_TRANSFER_BOUND' END AS fingerprint,
 CASE WHEN n.cycle % 16 = 5 THEN NULL WHEN m.n > 0 THEN m.at_ WHEN beta IS NULL OR beta < 1 THEN COALESCE(cpu_host, 'unknown') WHEN func_type = 'gpu_comm' AND straggler IS NOT NULL AND hosts > 1 THEN straggler WHEN func_type = 'gpu_comm' THEN host ELSE 'PID ' || pid || '@' || host || '/' || device END AS detail
 FROM n LEFT JOIN t ON t.cycle = n.cycle AND r = 1 LEFT JOIN l ON l.cycle = n.cycle LEFT JOIN m ON m.cycle = n.cycle LEFT JOIN c ON c.cycle = n.cycle""")
def I1_I4_I5_bottlenecks(spark, sf):
    perf = _perf_rows(spark, sf)
    cycles = perf.select("cycle").distinct()
    found = cycles.where("cycle % 4 = 0").select("cycle", F.concat(F.lit("h"), (F.col("cycle") % 3).cast("string")).alias("host"), (1.0 + F.col("cycle") % 2).alias("priority"), F.concat(F.lit("ISSUE_"), (F.col("cycle") % 5).cast("string")).alias("issue"))
    found = found.unionByName(cycles.where("cycle % 8 = 0").select("cycle", F.lit("h1").alias("host"), F.lit(2.0).alias("priority"), F.lit("OTHER").alias("issue")))
    return diagnose.bottleneck(perf, found, cycles.where("cycle % 16 = 5"))


@query(f"""WITH {_PERF}, b AS (SELECT n.cycle, CASE WHEN beta IS NULL OR beta < 1 THEN 'CPU_BOTTLENECK' WHEN func_type = 'gpu_comm' AND straggler IS NOT NULL AND hosts > 1 THEN 'LOAD_IMBALANCE_PURE' WHEN func_type = 'gpu_comm' THEN 'COMM_BOTTLENECK' WHEN func_type = 'gpu_compute' THEN 'COMPUTE_BOUND' ELSE 'DATA_TRANSFER_BOUND' END AS fingerprint FROM n LEFT JOIN t ON t.cycle = n.cycle AND r = 1 LEFT JOIN l ON l.cycle = n.cycle),
 h AS (SELECT cycle, host, sum(dur) AS load FROM p WHERE func_type = 'gpu_compute' GROUP BY ALL), k AS (SELECT cycle, list_reverse_sort(list(load)) AS loads FROM h GROUP BY cycle), w AS (SELECT cycle, COALESCE(max(beta) FILTER (WHERE func_type <> 'oncpu'), max(beta)) AS top FROM p GROUP BY cycle),
 s AS (SELECT b.cycle, fingerprint, CASE WHEN fingerprint = 'LOAD_IMBALANCE_PURE' THEN CASE WHEN COALESCE(len(loads), 0) < 2 THEN 1.0 ELSE loads[1] / loads[2] END ELSE top / 100 * 1000.0 END AS score FROM b JOIN w USING (cycle) LEFT JOIN k USING (cycle)),
 z AS (SELECT *, CASE WHEN count(*) OVER f < 2 OR stddev_pop(score) OVER f = 0 THEN 0 ELSE (score - avg(score) OVER f) / stddev_pop(score) OVER f END AS z FROM s WINDOW f AS (PARTITION BY fingerprint))
 SELECT fingerprint, cycle, round(score, 6) AS score, round(z, 4) AS z FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY score DESC, cycle) AS r FROM z) WHERE r <= 2""")
def I6_H22_severity(spark, sf):
    perf = _perf_rows(spark, sf)
    none = perf.where("false").select("cycle", "host", F.lit(1.0).alias("priority"), F.lit("x").alias("issue"))
    out = diagnose.representatives(diagnose.severity(perf, diagnose.bottleneck(perf, none)))
    return out.select("fingerprint", "cycle", F.round("score", 6).alias("score"), F.round("z", 4).alias("z"))


@query(f"""WITH {SPANS}, s AS (SELECT pid, name AS category, 'f' || (k % 20) AS name, CAST(count(*) AS BIGINT) AS n, CAST(sum(dur) AS BIGINT) AS total, round(avg(dur), 4) AS mean FROM spans GROUP BY ALL)
 SELECT * FROM (SELECT *, round(100.0 * total / sum(total) OVER (PARTITION BY pid, category), 6) AS share, CAST(row_number() OVER (PARTITION BY pid, category ORDER BY total DESC, name) AS INTEGER) AS rank FROM s) WHERE rank <= 5""")
def I8_top_events(spark, sf):
    rows = spans(spark, sf).select("pid", F.col("name").alias("category"), F.concat(F.lit("f"), (F.col("k") % 20).cast("string")).alias("name"), "dur")
    return profile.top_events(rows, ["pid"]).withColumns({"mean": F.round("mean", 4), "share": F.round("share", 6)})


@query("""WITH s AS (SELECT l_returnflag AS function, l_linenumber AS device, CAST(l_suppkey % 20 AS VARCHAR) AS metric, round(sum(l_discount) * 10, 4) AS suspicion FROM lineitem GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY function, device ORDER BY suspicion DESC, metric) AS k FROM s WHERE suspicion > 10),
 lead_ AS (SELECT function, device FROM k WHERE k = 1 ORDER BY suspicion DESC, function, device LIMIT 3) SELECT function, device, metric, suspicion FROM k JOIN lead_ USING (function, device) WHERE k <= 3""")
def I10_D11_conclusions(spark, sf):
    s = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("function"), F.col("l_linenumber").alias("device"), (F.col("l_suppkey") % 20).cast("string").alias("metric")).agg(F.round(F.sum("l_discount") * 10, 4).alias("suspicion"))
    return diagnose.conclusions(s).select("function", "device", "metric", "suspicion")


@query()
def L6_group_split(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    return detect.group_split(rows, ["l_suppkey"])


@query()
def L7_boundary_split(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("bigint").alias("q"), F.col("l_suppkey").alias("s"))
    return detect.boundary_split(rows, ["q", "s"])


@query()
def L11_trials(spark, sf):
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_extendedprice")
    return detect.trials(l.where("l_orderkey % 10 > 0"), l.where("l_orderkey % 10 = 0"))


@query("SELECT CAST(floor((l_extendedprice - lo) / w) AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS n FROM lineitem, (SELECT min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 50 AS w FROM lineitem) GROUP BY 1")
def L13_histogram(spark, sf):
    return detect.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 50)


@query(f"WITH {TRACE} SELECT name AS cat, CAST(count(*) AS BIGINT) AS n FROM trace WHERE ph = 'X' GROUP BY name")
def F10_by_category(spark, sf):
    return profile.by_category(trace(spark, sf).withColumn("cat", F.col("name")))


_COUNTERS = f"""{TRACE}, c AS (SELECT ts // 86400000000 AS cycle, 'h' || (tid % 3) AS host, ts // 3600000000 AS hour, k AS value, CASE name WHEN 'error' THEN 'process_cpu_usage_' || pid WHEN 'view' THEN 'process_gpu_usage_' || (k % 4) WHEN 'click' THEN 'process_mem_usage' ELSE name END AS name FROM trace)"""


def _counters(spark, sf):
    n, t = F.col("name"), trace(spark, sf)
    name = F.when(n == "error", F.concat(F.lit("process_cpu_usage_"), F.col("pid").cast("string"))).when(n == "view", F.concat(F.lit("process_gpu_usage_"), (F.col("k") % 4).cast("string"))).when(n == "click", "process_mem_usage").otherwise(n)
    return t.select(F.expr("ts div 86400000000").alias("cycle"), F.concat(F.lit("h"), (F.col("tid") % 3).cast("string")).alias("host"), F.expr("ts div 3600000000").alias("ts"), F.col("k").cast("double").alias("value"), name.alias("name"))


@query(f"""WITH {_COUNTERS}, h AS (SELECT cycle, host, avg(value) FILTER (WHERE name LIKE 'process_cpu_usage%') AS m FROM c GROUP BY ALL), p AS (SELECT cycle, avg(m) / 16 AS cpu FROM h GROUP BY cycle), g AS (SELECT cycle, avg(value) FILTER (WHERE name LIKE 'process_gpu_usage%') AS gpu, avg(value) FILTER (WHERE name = 'process_mem_usage') AS mem FROM c GROUP BY cycle)
 SELECT cycle, round(cpu, 6) AS avg_cpu, round(gpu, 6) AS avg_gpu, round(mem, 6) AS avg_mem FROM p JOIN g USING (cycle)""")
def F16_cycle_counters(spark, sf):
    return profile.cycle_counters(_counters(spark, sf), 16).select("cycle", *(F.round(c, 6).alias(c) for c in ("avg_cpu", "avg_gpu", "avg_mem")))


@query(f"""WITH {_COUNTERS}, s AS (SELECT hour, sum(value) AS v FROM c WHERE name LIKE 'process_cpu_usage%' GROUP BY hour), g AS (SELECT name, avg(value) AS v FROM c WHERE name LIKE 'process_gpu_usage%' GROUP BY name)
 SELECT round((SELECT avg(v) FROM s) / 16, 6) AS avg_cpu, round((SELECT max(v) FROM s) / 16, 6) AS max_cpu, round((SELECT avg(v) FROM g), 6) AS avg_gpu, round((SELECT avg(CASE WHEN value = 0 THEN 100.0 ELSE 0.0 END) FROM c WHERE name LIKE 'process_gpu_usage%'), 6) AS idle_pct""")
def F17_global_counters(spark, sf):
    out = profile.global_counters(_counters(spark, sf), 16)
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


@query(f"WITH {_CLASSES}, s AS (SELECT label, CAST(count(*) FILTER (WHERE truth = label AND predicted = label) AS DOUBLE) AS tp, count(*) FILTER (WHERE predicted = label) AS pr, count(*) FILTER (WHERE truth = label) AS n FROM c, (SELECT unnest([0, 1]) AS label) GROUP BY label), m AS (SELECT n, tp / pr AS p, tp / n AS r, 2 * tp / (pr + n) AS f, tp FROM s) SELECT round(sum(tp) / sum(n), 6) AS accuracy, round(avg(p), 6) AS macro_precision, round(avg(r), 6) AS macro_recall, round(avg(f), 6) AS macro_f1, round(sum(p * n) / sum(n), 6) AS weighted_precision, round(sum(r * n) / sum(n), 6) AS weighted_recall, round(sum(f * n) / sum(n), 6) AS weighted_f1 FROM m")
def F31_class_summary(spark, sf):
    out = detect.class_summary(_classes(spark, sf), "truth", "predicted")
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


@query("SELECT n_regionkey || ': ' || count(*) || chr(10) || string_agg('  - ' || n_name, chr(10) ORDER BY n_name) AS block FROM nation GROUP BY n_regionkey")
def K4_hardware_report(spark, sf):
    from ..operators import topology

    text = topology.hardware_report(table(spark, sf, "nation").select(F.col("n_regionkey").alias("category"), F.col("n_name").alias("component")), True)
    blocks = [b if k == 0 else b for k, b in enumerate(text.replace("\n  - ", "\v").split("\n"))]
    return spark.createDataFrame([(b.replace("\v", "\n  - "),) for b in blocks], "block string")


@query("SELECT n_regionkey AS host, CAST(sum(n_nationkey) AS BIGINT) AS cores, arg_max(n_nationkey * 2, n_nationkey) FILTER (WHERE n_nationkey % 3 > 0) AS memory_gb FROM nation GROUP BY 1")
def C28_host_cores(spark, sf):
    from ..operators import topology

    k = F.col("n_nationkey")
    return topology.cores(table(spark, sf, "nation").select(F.col("n_regionkey").alias("host"), k.alias("seq"), k.alias("cores"), F.when(k % 3 > 0, k * 2).alias("memory_gb")))


@query("SELECT l_returnflag, l_linenumber, CAST(count(*) AS BIGINT) AS n, round(avg(l_discount), 6) AS mean FROM lineitem GROUP BY ALL")
def L13_heat_map(spark, sf):
    return detect.heat(table(spark, sf, "lineitem"), "l_returnflag", "l_linenumber", "l_discount").withColumn("mean", F.round("mean", 6))


@query("SELECT round(lo - 0.05 * (hi - lo), 4) AS low, round(hi + 0.05 * (hi - lo), 4) AS high FROM (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)")
def L13_axis_range(spark, sf):
    return detect.axis_range(table(spark, sf, "orders"), "o_totalprice").select(F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))
