"""Periods of a trace without an anchor: phases, cadence, marker, seeds and periods, alone or aligned over processes
(H4 to H7, H9 to H14, E15)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import folds, interval
from .lineage import checkpoint
from .nest import fold

LEAST_GAP_US, GAP_QUANTILE = 1e6, 0.998
PREFILL, DECODE, OTHER = 1, 2, 3


def phases(events: DataFrame, keys: list[str], least: float = LEAST_GAP_US, quantile: float = GAP_QUANTILE) -> DataFrame:
    """H4: adds phase, which grows behind gaps (between starts) above the quantile of the key's gaps and `least`."""
    w = Window.partitionBy(*keys).orderBy("ts", "seq")
    rows = events.withColumn("_gap", F.col("ts") - F.lag("ts").over(w))
    cut = rows.groupBy(*keys).agg(F.greatest(F.percentile("_gap", quantile), F.lit(float(least))).alias("_cut"))
    rows = rows.join(cut, keys)
    return rows.withColumn("phase", F.sum(F.coalesce(F.col("_gap") > F.col("_cut"), F.lit(False)).cast("bigint")).over(w)).drop("_gap", "_cut")


def marker(events: DataFrame, periods: DataFrame, keys: list[str]) -> DataFrame:
    """H7: keys, marker, n: the name whose count is nearest to the number of periods that fit, if it is within 15 % of it or near its half
    or third (by 2 or 5 %); of names with the same count that with most events in a tenth of a period from its first on.
    events: keys, seq, ts, name; periods: keys, period_us."""
    rows = events.select(*keys, "seq", "ts", "name").join(periods.select(*keys, "period_us"), keys)
    w = Window.partitionBy(*keys).orderBy((F.col("ts") * 10.0 / F.col("period_us")))
    order = Window.partitionBy(*keys).orderBy("ts", "seq")
    # events not after the end of the stretch, without those in front of this one
    dense = F.count("*").over(w.rangeBetween(0, 1)) + F.rank().over(w) - F.row_number().over(order)
    rows = rows.withColumn("_dense", dense)
    ends = rows.groupBy(*keys).agg(((F.max("ts") - F.min("ts")) / F.max("period_us")).alias("want"))
    names = rows.groupBy(*keys, "name").agg(F.count("*").alias("n"), F.min(F.struct("ts", "seq", "_dense")).alias("first")).join(ends, keys)
    names = names.withColumn("_off", F.abs(F.col("n") - F.col("want")))
    best = names.groupBy(*keys).agg(F.min_by("n", F.struct("_off", "first")).alias("_best"))
    near = F.greatest(F.lit(2.0), F.col("want") * 0.05)
    fits = F.col("n").between(F.col("want") * 0.85, F.col("want") * 1.15) | (F.abs(F.col("n") - F.col("want") / 2) < near) | (F.abs(F.col("n") - F.col("want") / 3) < near)
    rows = names.join(best, keys).where((F.col("n") == F.col("_best")) & fits)
    pick = F.max(F.struct(F.col("first._dense").alias("d"), (-F.col("first.ts")).alias("t"), (-F.col("first.seq")).alias("s"), "name", "n"))
    return rows.groupBy(*keys).agg(pick.alias("x")).select(*keys, F.col("x.name").alias("marker"), F.col("x.n").alias("n"))


def expanded(events: DataFrame, keys: list[str]) -> DataFrame:
    """Keys, seq, ts of the beats that go out both ways from the start found in the density of events. events: keys, seq, ts,
    period_us (one for each key)."""
    def run(rows):
        stamps, period = [t for t, _, _ in rows], rows[0][2]
        cycles = (stamps[-1] - stamps[0]) / period
        first = len(stamps) if cycles < 3 else int(max(len(stamps) / cycles * 3, 50))
        for k in folds.beats(stamps, folds.start_index(stamps[:first], period), period):
            yield rows[k][1], float(stamps[k])

    return fold(events, keys, ["ts", "seq", "period_us"], run, "seq long, ts double")


def from_seeds(seeds: DataFrame, starts: DataFrame, keys: list[str], kind: int = OTHER) -> DataFrame:
    """Keys, start_ts, end_ts, type: from seed to seed, the last one a period long, and in front of the first one what is there
    of a period if it is over a fifth. seeds: keys, ts; starts: keys, start_ts (of the phase), period_us."""
    rows = seeds.join(starts.select(*keys, F.col("start_ts").alias("_begin"), "period_us"), keys)
    w = Window.partitionBy(*keys).orderBy("ts")
    nxt, first = F.lead("ts").over(w), F.row_number().over(w) == 1
    rows = rows.withColumn("end_ts", F.coalesce(nxt, F.col("ts") + F.col("period_us"))).withColumn("_first", first).withColumn("_last", nxt.isNull())
    body = rows.where("_last or end_ts - ts > 1").select(*keys, F.col("ts").alias("start_ts"), "end_ts")
    lead = F.greatest("_begin", F.col("ts") - F.col("period_us"))
    prologue = rows.where(F.col("_first") & (F.col("ts") - lead > 0.2 * F.col("period_us"))).select(*keys, lead.alias("start_ts"), F.col("ts").alias("end_ts"))
    return body.unionByName(prologue).withColumn("type", F.lit(kind))


def followers(pacers: DataFrame, seeds: DataFrame, period: float, band: float = 0.4) -> DataFrame:
    """Pid, pacer_seq, follower_seq: of each other process each pacer, in the order of time, takes the nearest seed that none has
    taken, from band periods before to less than band periods behind it. pacers: seq, ts; seeds: pid, seq, ts."""
    reach = band * period
    points = seeds.select("pid", "seq", F.col("ts").cast("double").alias("ts"))
    # a pacer is a row of those processes that have a seed in its stretch of time or in one beside it
    cell = F.floor(F.col("ts") / (2 * reach or 1.0))
    near = points.select("pid", cell.alias("_cell")).distinct().select("pid", F.explode(F.sequence(F.col("_cell") - 1, F.col("_cell") + 1)).alias("_cell")).distinct()
    wide = pacers.select("seq", F.col("ts").cast("double").alias("ts")).withColumn("_cell", cell).join(near, "_cell").select("pid", "seq", "ts")
    pairs = interval.greedy(wide, points, ["pid"], reach, closed=False, cut=max(int(100 * period), 1))
    return pairs.select("pid", F.col("seq").alias("pacer_seq"), F.col("other_seq").alias("follower_seq"))


def aligned(seeds: DataFrame, period: float, begin: float, band: float = 0.4) -> DataFrame:
    """start_ts, end_ts, type of the periods of several processes: the process with most seeds leads (ties: the smallest), others
    follow (E15); a group starts with its earliest seed. What is in front of the first gap of over 1.7 periods is one prefill.
    seeds: pid, seq, ts. begin: where the trace begins. Groups are one narrow row a period."""
    lead = seeds.groupBy("pid").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "pid").first()
    if lead is None:
        return seeds.sparkSession.createDataFrame([], "start_ts double, end_ts double, type int")
    pacers = checkpoint(seeds.where(F.col("pid") == lead.pid).select("seq", F.col("ts").cast("double").alias("ts")))
    match = followers(pacers, seeds.where(F.col("pid") != lead.pid), period, band)
    met = match.join(seeds.select("pid", F.col("seq").alias("follower_seq"), F.col("ts").cast("double").alias("_ts")), ["pid", "follower_seq"]).groupBy("pacer_seq").agg(F.min("_ts").alias("_first"))
    groups = pacers.join(met, F.col("seq") == F.col("pacer_seq"), "left").select("seq", "ts", F.least("ts", F.coalesce("_first", "ts")).alias("start"))
    w = Window.orderBy("ts", "seq")
    gap = pacers.withColumn("k", F.row_number().over(w)).withColumn("gap", F.col("ts") - F.lag("ts").over(w)).where(F.col("gap") > 1.7 * period).agg(F.min("k")).first()[0]
    split = (gap or 1) - 1  # groups in front of the first long gap
    rows = groups.withColumn("k", F.row_number().over(Window.orderBy("start", "seq")) - 1)
    rows = rows.where(F.col("k") >= split)
    nxt = F.lead("start").over(Window.orderBy("k"))
    body = rows.withColumn("end_ts", F.coalesce(nxt, F.col("start") + period)).withColumn("_last", nxt.isNull()).where("_last or end_ts - start > 1").select(F.col("start").alias("start_ts"), "end_ts", F.lit(DECODE).alias("type"))
    body = body.withColumn("_n", F.count("*").over(Window.partitionBy())).where("_n >= 2").drop("_n")
    if split <= 0:
        return body
    pre = rows.agg(F.min("start").alias("end_ts")).select(F.lit(float(begin)).alias("start_ts"), "end_ts", F.lit(PREFILL).alias("type")).where("end_ts > start_ts")
    return body.unionByName(pre)


def found(events: DataFrame, align: bool = False) -> DataFrame:
    """The periods of a trace from end to end: pid, start_ts, end_ts, type. Phases by gaps (H4), the period of each name (H5), of each
    thread (H6) and of the thread with the largest score, seeds by a marker (H7) or by density (H9, H10), periods (H13).
    Without align the smallest process with periods counts; with it the processes are aligned (H14) and pid is -1.
    events: pid, tid, seq, ts, name."""
    keys = ["pid", "phase"]
    rows = checkpoint(phases(events, ["pid"]).select(*keys, "tid", "seq", F.col("ts").cast("double").alias("ts"), "name"))
    threads = folds.consensus_periods(folds.cadences(rows, [*keys, "tid"]), [*keys, "tid"])
    best = checkpoint(threads.groupBy(*keys).agg(F.max_by(F.struct("tid", "period_us", "names"), F.struct("score", "tid")).alias("x")).select(*keys, "x.*"))
    marks = marker(rows, best, keys)
    quick = rows.join(marks.select(*keys, F.col("marker").alias("name")), [*keys, "name"]).select(*keys, "seq", "ts")
    rest = best.join(marks, keys, "left_anti").select(*keys, "tid", "period_us", F.explode("names").alias("name"))
    slow = expanded(rows.join(rest, [*keys, "tid", "name"]), keys)
    seeds = quick.unionByName(slow)
    enough = seeds.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n >= 2")
    seeds = checkpoint(seeds.join(enough.select(*keys), keys, "left_semi"))
    starts = rows.groupBy(*keys).agg(F.min("ts").alias("start_ts")).join(best.select(*keys, "period_us"), keys)
    if align:
        first = rows.agg(F.min("ts")).first()[0]
        lead = seeds.groupBy("pid").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "pid").first()
        period = best.where(F.col("pid") == lead.pid).orderBy("phase").first().period_us if lead else 1.0
        return aligned(seeds.select("pid", "seq", "ts"), period, first or 0.0).select(F.lit(-1).cast("long").alias("pid"), "start_ts", "end_ts", "type")
    out = from_seeds(seeds, starts, keys)
    least = out.agg(F.min("pid").alias("_least"))
    return out.join(F.broadcast(least), F.col("pid") == F.col("_least")).select("pid", "start_ts", "end_ts", "type")  # one row
