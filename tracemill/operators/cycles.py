"""Cycles of repeating work around an anchor function (B.5, E3, E5, E7, E14, E25, E26, G5 to G14, G16, G17)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from . import folds, interval, nest
from .lineage import checkpoint

DECODE, PREFILL, OTHER = 2, 1, 3
MIN_GAP = 50_000


def anchors(events: DataFrame, name: str, cut: int | None = 10_000_000) -> DataFrame:
    """Outermost spans of the anchor function: seq, pid, tid, ts, end_ts, dur. Threads are nested in stretches of `cut` microseconds."""
    python = events.where("cat = 'python' and ph = 'X' and dur > 0")
    tree = nest.nested(python, ["pid", "tid"], cut=cut).select("pid", "tid", "seq", "is_recursive")
    mine = python.where(F.col("name") == name).select("pid", "tid", "seq", "ts", "end_ts", "dur")
    return mine.join(tree, ["pid", "tid", "seq"]).where("not is_recursive").drop("is_recursive")


def owned(marks: DataFrame, events: DataFrame, width: int = 10_000_000) -> DataFrame:
    """seq (of the anchor), name: what runs inside anchors in their threads, themselves among it."""
    inside = interval.contained(marks, events.where("cat = 'python'").select("seq", "name", "ts", "end_ts", "pid", "tid"), ["pid", "tid"], width)
    return inside.select(F.col("o_seq").alias("seq"), F.col("i_name").alias("name"))


def types(marks: DataFrame, names: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Marks (seq, dur, ...) with type: prefill, decode or other. If any anchor holds a name that tells, names decide: prefill words,
    else decode words ("decode" itself only without an "encode" beside it), else other. If none does, durations decide: prefill are
    those above the 80th percentile and three times the median, if the longest is that long and there are three; else all are other.
    names: seq, name of what an anchor holds. keys: what is classified apart."""
    keys, name = keys or [], F.col("name")
    tells = name.rlike("[dD]ecode(?![a-z])")
    words = names.groupBy("seq").agg(F.bool_or(F.lower(name).contains("forward_extend")).alias("_p"), F.bool_or(F.lower(name) == "encode").alias("_e"), F.bool_or(tells).alias("_any"), F.bool_or(tells & (name != "decode")).alias("_other"))
    rows = marks.join(words, "seq", "left")
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    rows = rows.withColumn("_p", no("_p")).withColumn("_d", F.when(no("_e"), no("_other")).otherwise(no("_any"))).drop("_e", "_any", "_other")
    dur = F.when(F.col("dur") > V.MIN_CYCLE_US, F.col("dur"))
    ends = rows.groupBy(*keys).agg(F.bool_or(F.col("_p") | F.col("_d")).alias("_tell"), F.percentile(dur, 0.5).alias("_mid"), F.percentile(dur, V.PREFILL_PERCENTILE).alias("_top"), F.max(dur).alias("_max"), F.count(dur).alias("_n"))
    rows = rows.join(ends, keys) if keys else rows.join(F.broadcast(ends), F.lit(True))  # one row
    apart = (F.col("_n") >= 3) & (F.col("_mid") > 0) & (F.col("_max") > V.PREFILL_DURATION_RATIO * F.col("_mid"))
    long = (F.col("dur") > F.col("_top")) & (F.col("dur") > V.PREFILL_DURATION_RATIO * F.col("_mid"))
    by_name = F.when(F.col("_p"), PREFILL).when(F.col("_d"), DECODE).otherwise(OTHER)
    by_dur = F.when(apart & long, PREFILL).when(apart, DECODE).otherwise(OTHER)
    return rows.withColumn("type", F.when(F.col("_tell"), by_name).otherwise(by_dur)).drop("_p", "_d", "_tell", "_mid", "_top", "_max", "_n")


def corrected(cycles: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Other cycles take a type from their neighbours, from left to right: that of both, else of the one closer in duration (ties: the
    left), else of the only one there is. A type handed on from the left is that of the last typed cycle before; on the right
    only the next cycle itself counts. cycles: type, dur, keys, order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    typed = F.when(F.col("type") != OTHER, F.col("type"))
    rows = cycles.withColumns({"_l": F.last(typed, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), "_r": F.lead(typed).over(w), "_ld": F.abs(F.col("dur") - F.lag("dur").over(w)), "_rd": F.abs(F.col("dur") - F.lead("dur").over(w))})
    both = F.when(F.col("_ld") <= F.col("_rd"), F.col("_l")).otherwise(F.col("_r"))
    new = F.when(F.col("type") != OTHER, F.col("type")).when(F.col("_l").isNotNull() & F.col("_r").isNotNull(), both).otherwise(F.coalesce("_l", "_r", F.lit(OTHER)))
    return rows.withColumn("type", new).drop("_l", "_r", "_ld", "_rd")


def layers(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The layer spans of each key: "layer" in the name in front of the first dot, at the least depth there is for such, with the
    most frequent name (ties: the first seen). Rows keys, seq, ts, name, depth."""
    found = rows.where(F.lower(F.split("name", r"\.")[0]).contains("layer"))
    found = found.withColumn("_least", F.min("depth").over(Window.partitionBy(*keys))).where("depth = _least").drop("_least")
    names = found.groupBy(*keys, "name").agg(F.count("*").alias("n"), F.min(F.struct("ts", "seq")).alias("first"))
    top = names.groupBy(*keys).agg(F.max(F.struct("n", (-F.col("first.ts")).alias("t"), (-F.col("first.seq")).alias("s"), "name")).alias("x")).select(*keys, F.col("x.name").alias("name"))
    return found.join(top, [*keys, "name"])


def starters(rows: DataFrame, keys: list[str], most: int = 5) -> DataFrame:
    """Keys, seq, owner_seq: spans in front of the first anchor that belong to it. The first `most` names at the depth and in the
    thread of each later anchor, among what it owns, are looked for in front of the first anchor in its thread; from the earliest
    hit on all that ends before that anchor is its own. Rows keys, tid, seq, ts, end_ts, name, depth, owner_seq, is_anchor."""
    first = rows.where("is_anchor").groupBy(*keys).agg(F.min(F.struct("ts", "seq", "tid")).alias("x")).select(*keys, F.col("x.ts").alias("_at"), F.col("x.seq").alias("_first"), F.col("x.tid").alias("_tid"))
    later = rows.where("is_anchor").join(first, keys).where("seq <> _first").select(*keys, F.col("seq").alias("owner_seq"), F.col("tid").alias("_atid"), F.col("depth").alias("_adepth"))
    mine = rows.join(later, [*keys, "owner_seq"]).where("tid = _atid and depth = _adepth")
    mine = mine.withColumn("_k", F.row_number().over(Window.partitionBy(*keys, "owner_seq").orderBy("ts", "seq"))).where(F.col("_k") <= most)
    names = mine.select(*keys, "name").distinct()
    before = rows.join(first, keys).where("end_ts <= _at")
    begin = before.where("tid = _tid").join(names, [*keys, "name"], "left_semi").groupBy(*keys).agg(F.min("ts").alias("_from"))
    return before.join(begin, keys).where("ts >= _from").select(*keys, "seq", F.col("_first").alias("owner_seq"))


def groups(rows: DataFrame, keys: list[str], kind: int) -> DataFrame:
    """Preliminary cycles from anchors with a group: keys, group, start_ts, min_end, max_end, anchor (the longest), n, type."""
    return rows.groupBy(*keys, "group").agg(F.min("ts").alias("start_ts"), F.min("end_ts").alias("min_end"), F.max("end_ts").alias("max_end"), F.max_by("seq", F.struct("dur", (-F.col("seq")).alias("s"))).alias("anchor"), F.count("*").alias("n"), F.lit(kind).alias("type"))


def prefill_groups(marks: DataFrame, keys: list[str]) -> DataFrame:
    """Keys, seq, group of prefill anchors."""
    return nest.fold(marks, keys, ["ts", "seq", "dur"], folds.lead_groups, "seq long, group int")


def followers(pacers: DataFrame, others: DataFrame, width: int, band: float = 0.5) -> DataFrame:
    """E14, one round: pacer_seq, pid, seq: of each other process the anchor nearest to the pacer's start, among those that start from
    band durations before to less than band durations behind it (ties: the smaller seq). An anchor may follow several pacers."""
    wide = pacers.select("seq", "pid", F.col("ts").alias("at"), (F.col("ts") - F.col("dur") * band).alias("ts"), (F.col("ts") + F.col("dur") * band).alias("end_ts"))
    points = others.select("seq", "pid", "ts", F.col("ts").alias("end_ts"))
    hits = interval.contained(wide, points, [], width, (F.col("i_ts") < F.col("o_end_ts")) & (F.col("i_pid") != F.col("o_pid")))
    return hits.groupBy(F.col("o_seq").alias("pacer_seq"), F.col("i_pid").alias("pid")).agg(F.min_by("i_seq", F.struct(F.abs(F.col("i_ts") - F.col("o_at")), "i_seq")).alias("seq"))


def pacer_rounds(marks: DataFrame, width: int) -> DataFrame:
    """E14 align mode: round, pacer_seq, seq: groups of decode anchors over processes. In each round the process with most anchors left
    leads (ties: the smallest); what a round has matched is done. A round does away with a process, so there are as many
    rounds as processes at most. marks: seq, pid, ts, dur."""
    left = checkpoint(marks.select("seq", "pid", "ts", "dur"))
    number, out = 0, None
    while (lead := left.groupBy("pid").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "pid").first()) is not None:
        number += 1
        pacers = left.where(F.col("pid") == lead.pid)
        met = followers(pacers, left.where(F.col("pid") != lead.pid), width).select("pacer_seq", "seq")
        met = checkpoint(met.unionByName(pacers.select(F.col("seq").alias("pacer_seq"), "seq")).withColumn("round", F.lit(number)))
        out = met if out is None else out.unionByName(met)
        left = checkpoint(left.join(met.select("seq").distinct(), "seq", "left_anti"))
    return out if out is not None else marks.sparkSession.createDataFrame([], "pacer_seq long, seq long, round int")


def genesis(marks: DataFrame, keys: list[str], total: DataFrame | None = None) -> DataFrame:
    """G9 align, G10: keys, start_ts, end_ts, n, delayed: the first cycle of a chain that all processes take part in: from the earliest to
    the latest end of their first anchors, with all anchors that begin in it and end a tenth of their duration behind it at most.
    It is delayed if a process is missing in it or they differ in number. total: keys, pids (else those of the chain)."""
    first = marks.groupBy(*keys, "pid").agg(F.min(F.struct("ts", "seq", "end_ts")).alias("x"))
    ends = first.groupBy(*keys).agg(F.min("x.ts").alias("start_ts"), F.max("x.end_ts").alias("end_ts"), F.count("*").alias("_here"))
    pids = total if total is not None else marks.groupBy(*keys).agg(F.countDistinct("pid").alias("pids"))
    ends = (ends.join(pids, keys) if keys else ends.join(F.broadcast(pids), F.lit(True))).where("_here = pids")
    e = ends.select(*keys, F.col("start_ts").alias("_a"), F.col("end_ts").alias("_b"), "pids")
    rows = marks.join(e, keys) if keys else marks.join(F.broadcast(e), F.lit(True))
    members = rows.where("ts >= _a and end_ts <= _b + dur * 0.1").groupBy(*keys, "_a", "_b", "pids", "pid").agg(F.count("*").alias("n"))
    return members.groupBy(*keys, F.col("_a").alias("start_ts"), F.col("_b").alias("end_ts"), "pids").agg(F.sum("n").alias("n"), F.count("*").alias("_met"), F.min("n").alias("_lo"), F.max("n").alias("_hi")).withColumn("delayed", (F.col("_met") < F.col("pids")) | (F.col("_lo") != F.col("_hi"))).drop("pids", "_met", "_lo", "_hi")


def chained(cycles: DataFrame, keys: list[str], mode: str = "token", begin: str | None = None) -> DataFrame:
    """Cycles (keys, group, start_ts, min_end, max_end) of a chain with their bounds start_ts, end_ts; empty ones go. "layer": where each
    starts; "token": one behind the end of the cycle before, the first one behind its own start; "align": from the least end of
    the cycle before, the first one from `begin` (a column, such as a genesis' end), else its own least end."""
    w = Window.partitionBy(*keys).orderBy("start_ts", "group")
    if mode == "layer":
        start = F.col("start_ts")
    elif mode == "token":
        start = F.coalesce(F.lag("max_end").over(w), F.col("start_ts")) + 1
    else:
        start = F.coalesce(F.lag("min_end").over(w), F.col(begin) if begin else F.lit(None), F.col("min_end"))
    return cycles.withColumn("_start", start).where("_start < max_end").drop("start_ts").withColumnRenamed("_start", "start_ts").withColumn("end_ts", F.col("max_end"))


def dynamic_bounds(events: DataFrame, keys: list[str], cat: str = "python") -> DataFrame:
    """Keys, start_ts, end_ts of each cycle from its Python spans, else from all its spans; full_start, full_end from all."""
    mine = lambda c: F.when(F.col("cat") == cat, F.col(c))
    return events.where("dur > 0").groupBy(*keys).agg(F.coalesce(F.min(mine("ts")), F.min("ts")).alias("start_ts"), F.coalesce(F.max(mine("end_ts")), F.max("end_ts")).alias("end_ts"), F.min("ts").alias("full_start"), F.max("end_ts").alias("full_end"))


def untied(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Of spans of a key that end together the second, third ... (by start) lose 1, 2 ... microseconds, if they are longer than that."""
    k = F.row_number().over(Window.partitionBy(*keys, "end_ts").orderBy("ts", "seq")) - 1
    return spans.withColumn("_k", k).withColumn("dur", F.when(F.col("dur") > F.col("_k"), F.col("dur") - F.col("_k")).otherwise(F.col("dur"))).drop("_k")


def owned_cycles(spans: DataFrame, members: DataFrame) -> DataFrame:
    """Spans (owner_seq, cat, ...) with cycle: that of their owner, null without one. GPU work waits for its runtime calls, so it is
    left out. members: cycle, seq, start_ts of the anchors of cycles; an anchor of two cycles counts for the later one."""
    of = members.groupBy(F.col("seq").alias("owner_seq")).agg(F.max_by("cycle", F.struct("start_ts", "cycle")).alias("cycle"))
    return spans.where(~F.col("cat").isin("Kernel", "Memcpy", "Memset")).join(of, "owner_seq", "left")


def layer_events(layers: DataFrame, sync: DataFrame, work: DataFrame, keys: list[str], width: int) -> DataFrame:
    """layer_seq, seq, how: spans of a layer's thread inside it ("contained") and GPU work that a call among them started ("correlated").
    layers, sync: keys, seq, ts, end_ts (sync also corr, null if it started nothing); work: keys, seq, corr. Calls are reduced to
    distinct correlation ids first."""
    inside = interval.contained(layers.select(*keys, "seq", "ts", "end_ts"), sync.select(*keys, "seq", "ts", "end_ts", "corr"), keys, width)
    inside = inside.select(*(F.col(f"o_{k}").alias(k) for k in keys), F.col("o_seq").alias("layer_seq"), F.col("i_seq").alias("seq"), F.col("i_corr").alias("corr"))
    calls = inside.where("corr is not null").select(*keys, "layer_seq", "corr").distinct()
    # a piece of work under one key and id meets a layer once, so only work under several is made distinct again, behind the join
    work = work.select(*keys, "seq", "corr").distinct().withColumn("_n", F.count("*").over(Window.partitionBy("seq")))
    started = lambda part: calls.join(part.drop("_n"), [*keys, "corr"]).select("layer_seq", "seq", F.lit("correlated").alias("how"))
    return inside.select("layer_seq", "seq", F.lit("contained").alias("how")).unionByName(started(work.where("_n = 1"))).unionByName(started(work.where("_n > 1")).distinct())


def virtual_kernels(ops: DataFrame, calls: DataFrame, work: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Keys, seq, name, ts, end_ts, n: the span of the GPU work that the runtime calls inside an operator started. Where a key has
    none, one span over all its GPU work, with a null seq. ops: keys, seq, name, ts, end_ts; calls: keys, seq, ts, end_ts, corr;
    work: keys, seq, ts, end_ts, corr."""
    inside = interval.contained(ops.select(*keys, "seq", "name", "ts", "end_ts"), calls.select(*keys, "seq", "ts", "end_ts", "corr"), keys, width)
    ids = inside.select(*(F.col(f"o_{k}").alias(k) for k in keys), F.col("o_seq").alias("seq"), F.col("o_name").alias("name"), F.col("i_corr").alias("corr")).where("corr is not null").distinct()
    kernels = work.select(*keys, "corr", "ts", "end_ts")
    base = F.concat(F.split("name", r"\.")[0], F.lit("_kernels"))
    per = ids.join(kernels, [*keys, "corr"]).groupBy(*keys, "seq", base.alias("name")).agg(F.min("ts").alias("ts"), F.max("end_ts").alias("end_ts"), F.count("*").alias("n"))
    rest = kernels.join(per.select(*keys).distinct(), keys, "left_anti").groupBy(*keys).agg(F.min("ts").alias("ts"), F.max("end_ts").alias("end_ts"), F.count("*").alias("n"))
    return per.unionByName(rest.withColumn("seq", F.lit(None).cast("long")).withColumn("name", F.lit("cycle_kernels")))


def boundaries(marks: DataFrame, least: float = 0.0) -> DataFrame:
    """B.5: cycles of the smallest pid's anchors: cycle, chain, start_ts, end_ts, type. A chain breaks at a gap of five median
    durations or 50 ms; inside it a cycle begins where the one before ended."""
    lowest = marks.agg(F.min("pid").alias("_pid"))
    first = marks.join(F.broadcast(lowest), F.col("pid") == F.col("_pid")).drop("_pid")  # one row
    gap = first.agg(F.greatest(5 * F.median("dur"), F.lit(float(MIN_GAP))).alias("_gap"))
    rows = interval.sessions(first.join(F.broadcast(gap), F.lit(True)), ["pid"], F.col("_gap"), F.col("type") == PREFILL)  # one row
    w = Window.partitionBy("pid", "session").orderBy("ts", "seq")
    start = F.when(F.col("type") == PREFILL, F.col("ts")).otherwise(F.coalesce(F.lag("end_ts").over(w), F.col("ts")) + 1)
    rows = rows.withColumn("start_ts", start).where(F.col("end_ts") - F.col("start_ts") > least)
    return rows.select(F.col("seq").alias("cycle"), F.col("session").alias("chain"), "start_ts", "end_ts", "type")


def assigned(cycles: DataFrame, events: DataFrame, width: int = 1_000_000) -> DataFrame:
    """Events of each cycle, clipped to it: cycle, cycle_dur and the event's columns, with slice_ts, slice_dur,
    is_slice. GPU work goes where the runtime call with its correlation id began."""
    gpu = F.col("cat").isin("Kernel", "Memcpy", "Memset")
    span = cycles.select("cycle", F.col("start_ts").alias("ts"), "end_ts", F.col("cycle").alias("seq"))
    host = interval.overlapping(span, events.where(~gpu & (F.col("ph") == "X")), [], width)
    names = [c for c in events.columns]
    cpu = host.select(F.col("c_cycle").alias("cycle"), (F.col("c_end_ts") - F.col("c_ts")).alias("cycle_dur"), *(F.col(f"e_{c}").alias(c) for c in names), "slice_ts", "slice_dur", "is_slice")
    corr = F.col("args")["correlation"].try_cast("long")
    calls = cpu.where(F.col("cat") == "cuda_runtime").select("cycle", "cycle_dur", F.col("pid").alias("_p"), corr.alias("_c")).where("_c is not null").groupBy("_p", "_c").agg(F.max(F.struct("cycle", "cycle_dur")).alias("_k"))
    work = events.where(gpu).withColumn("_corr", corr).join(calls, (F.col("pid") == F.col("_p")) & (F.col("_corr") == F.col("_c")))
    async_ = work.select(F.col("_k.cycle").alias("cycle"), F.col("_k.cycle_dur").alias("cycle_dur"), *names, F.col("ts").alias("slice_ts"), F.col("dur").alias("slice_dur"), F.lit(False).alias("is_slice"))
    return cpu.unionByName(async_)


def virtual_nccl(events: DataFrame, width: int = 1_000_000) -> DataFrame:
    """GPU work named by the collective call whose span covers its runtime call; the last one that covers it."""
    corr = F.col("args")["correlation"].try_cast("long")
    calls = events.where("cat = 'CAT_APP' and lower(name) like 'nccl%'").select("seq", F.col("name").alias("op"), "ts", "end_ts")
    runtime = events.where("cat = 'cuda_runtime'").select("seq", "pid", "ts", "end_ts", corr.alias("corr")).where("corr is not null")
    cover = interval.contained(calls, runtime, [], width).groupBy(F.col("i_pid").alias("_p"), F.col("i_corr").alias("_c")).agg(F.max_by("o_op", F.struct("o_ts", "o_seq")).alias("op"))
    kernels = events.where("cat = 'Kernel'").withColumn("_corr", corr)
    rows = kernels.join(cover, (F.col("pid") == F.col("_p")) & (F.col("_corr") == F.col("_c")))
    return rows.withColumn("name", F.concat(F.lit("ncclDevKernel_"), F.col("op"), F.lit("_"), F.col("name"))).select(*events.columns)
