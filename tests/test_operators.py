"""Boundary rules of the operators on small frames."""

import collections
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.functions import demangle
from tracemill.functions import scalar as S
from tracemill.operators import compare, cycles, detect, diagnose, folds, interval, learn, metrics, nest, periods, profile
from tracemill.plans import folds as plan_folds
from tracemill.plans import intervals as plan_intervals
from tracemill.plans import registry, systems, workflow
from tracemill.plans.registry import spans, table
from tracemill.sources import logs, sinks
from tracemill.sources import trace as sources

SPAN = "seq long, pid long, tid string, name string, ts double, end_ts double, dur double"


def _metrics(plan, name):
    """The metric of a run plan's nodes, through the stages of adaptive execution."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return _metrics(plan.executedPlan(), name)
    if kind.endswith("QueryStageExec"):
        return _metrics(plan.plan(), name)
    own = plan.metrics().get(name)
    below = plan.children()
    return ([own.get()] if own.isDefined() else []) + [m for k in range(below.size()) for m in _metrics(below.apply(k), name)]


def frame(spark, rows):
    return spark.createDataFrame([(i, 1, "t", n, float(a), float(b), float(b - a)) for i, (n, a, b) in enumerate(rows)], SPAN)


def test_virtual_cycles_of_all_spans(spark, sf):
    want, rows = [], collections.defaultdict(list)
    for r in spans(spark, sf).collect():
        rows[r.tid].append((r.ts, r.seq, "result" if r.name == "purchase" else "run", r.end_ts, 1 if r.name == "view" else 2))
    for tid, part in rows.items():
        want += [(tid, *x) for x in folds.virtual_cycles(sorted(part))]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in plan_folds.G18_virtual_cycles(spark, sf).collect())


def test_merge_keeps_touching_spans_apart(spark):
    got = interval.merged(frame(spark, [("a", 0, 10), ("b", 5, 7), ("c", 10, 12), ("d", 11, 15)]), ["pid"]).orderBy("ts").collect()
    assert [(r.ts, r.end_ts, r.n, r.total_dur) for r in got] == [(0, 10, 2, 12), (10, 15, 2, 6)]


def test_slices_tile_their_event(spark):
    parts = frame(spark, [("c", 0, 10), ("c", 10, 20), ("c", 20, 30)])
    got = interval.overlapping(parts, frame(spark, [("e", 5, 25), ("in", 11, 12)]), ["pid"], 4).collect()
    assert sum(r.slice_dur for r in got if r.e_name == "e") == 20 and {r.is_slice for r in got if r.e_name == "in"} == {False}
    assert len(got) == 4


def test_as_of_takes_the_last_not_after(spark):
    left, right = frame(spark, [("x", 0, 1), ("y", 5, 6)]), frame(spark, [("p", 1, 9), ("q", 5, 9)])
    got = {r.name: r.match and r.match.name for r in interval.as_of(left, right, ["pid"]).collect()}
    assert got == {"x": None, "y": "q"}
    ahead = {r.name: r.match.name for r in interval.as_of(left, right, ["pid"], forward=True).collect()}
    assert ahead == {"x": "p", "y": "q"}


def test_interpolation_clamps(spark):
    points = spark.createDataFrame([(0, 1, 10.0, 1.0), (1, 1, 20.0, 3.0)], "seq long, pid long, ts double, value double")
    got = interval.interpolated(frame(spark, [("a", 5, 6), ("b", 15, 16), ("c", 20, 21), ("d", 25, 26)]), points, ["pid"])
    assert [r.interpolated for r in got.orderBy("ts").collect()] == [1.0, 2.0, 3.0, 3.0]


def test_ticks_round_as_printf_does(spark):
    values = [0.5, 1.5, 904.5, 905.5, 999.5, 1500.0, 2500.0, 12500.0, 1.05e6, 1.15e6, 1.25e6, 1.35e6, 1.75e6, 2.5e6, 1e15 / 3, *(1e6 + 50_000.0 * k for k in range(60)), *(700 + k / 4 for k in range(20))]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", S.ticks(F.col("v")).alias("t")).collect()
    assert {r.v: r.t for r in got} == {v: "%.1fM" % (v / 1e6) if v >= 1e6 else "%.0fk" % (v / 1e3) if v >= 1e3 else "%.0f" % v for v in values}


def plain_greedy(events, others, reach, closed):
    """(ts, seq) lists; pairs of seqs by the rule's own words."""
    free, out = set(others), set()
    for ts, seq in sorted(events):
        near = [(abs(t - ts), t, s) for t, s in free if ts - reach <= t and (t <= ts + reach if closed else t < ts + reach)]
        if near:
            _, t, s = min(near)
            free.remove((t, s))
            out.add((seq, s))
    return out


@pytest.mark.parametrize(("closed", "cut"), [(True, None), (False, None), (True, 7), (False, 7)])
def test_greedy_matching_against_plain_python(spark, closed, cut):
    rng = np.random.default_rng(1)
    draw = lambda n, top: [(float(t), k) for k, t in enumerate(rng.integers(0, top, n))]
    rows = {"dense": (draw(150, 60), draw(120, 60)), "thin": (draw(60, 2000), draw(60, 2000)), "one side": (draw(5, 50), []), "other side": ([], draw(5, 50)), "ties": ([(1.0, 1), (1.0, 0), (5.0, 2)], [(3.0, 9), (-1.0, 8), (3.0, 7)])}
    made = [spark.createDataFrame([(n, s, t) for n, x in rows.items() for t, s in x[k]], "name string, seq long, ts double") for k in (0, 1)]
    got = collections.defaultdict(set)
    for r in interval.greedy(*made, ["name"], 4.0, closed, cut).collect():
        got[r.name].add((r.seq, r.other_seq))
    assert {n: got[n] for n in rows} == {n: plain_greedy(*x, 4.0, closed) for n, x in rows.items()}


def test_greedy_matching_drops_what_is_out_of_reach():
    rng = np.random.default_rng(2)
    events, others = ([(float(t), k) for k, t in enumerate(rng.integers(0, 30_000, 25_000))] for _ in range(2))
    come = sorted([(t, 0, t, s) for t, s in others] + [(t + 2.0, 1, t, s) for t, s in events])
    got = {(seq, other) for _, seq, _, other in interval._nearest(2.0, True)(come)}
    at = collections.defaultdict(list)
    for t, s in others:
        at[t].append(s)
    for x in at.values():
        x.sort(reverse=True)
    want = set()
    for t, s in sorted(events):
        if hit := next((t + d for d in (0, -1, 1, -2, 2) if at.get(t + d)), None) if not at.get(t) else t:
            want.add((s, at[hit].pop()))
        elif at.get(0.0) and t <= 2:
            want.add((s, at[0.0].pop()))
    assert got == want


def test_tolerance_match_is_greedy_and_once(spark):
    e = spark.createDataFrame([(0, "a", 10.0), (1, "a", 12.0), (2, "a", 100.0)], "seq long, name string, ts double")
    c = spark.createDataFrame([(0, "a", 11.0), (1, "a", 16.9), (2, "b", 100.0)], "seq long, name string, ts double")
    got = {r.seq: r.config_seq for r in interval.tolerance_match(e, c, ["name"], 5.0).collect()}
    assert got == {0: 0, 1: 1}


def test_configs_of_close_events_as_in_sql(spark, sf, tmp_path):
    events = table(spark, sf, "events")
    close = events.withColumn("event_id", F.col("event_id") + 1_000_000).withColumn("ts", F.expr("ts + INTERVAL 0.000001 SECOND"))
    events.unionByName(close).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    got = plan_intervals.E8_tolerance_match(spark, str(tmp_path)).select("seq", "config_seq", "ts_diff").collect()
    want = con.sql(f"select seq, config_seq, ts_diff from ({registry.ORACLES['E8_tolerance_match']})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)


def test_events_take_the_nearest_free_config_of_their_name(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(k, "abc"[k % 3], int(rng.integers(0, (150, 900, 9000)[k % 3])), int(rng.integers(0, 3))) for k in range(360)] + [(400, "d", 5, 1), (401, "a", None, 1), (402, None, 7, 1), (403, "a", 8, None)]
    made = spark.createDataFrame(rows, "event_id long, event_type string, at long, k long")
    made.selectExpr("event_id", "cast(timestamp_micros(at + 86399999900) as timestamp_ntz) as ts", "event_id % 9 as user_id", "event_type", "1.0D as value", "to_json(named_struct('k', k)) as props").write.parquet(f"{tmp_path}/events.parquet")
    want = set()
    for name in "abcd":
        own = [(r[2] + 86399999900, r[0], r[3]) for r in rows if r[1] == name and r[2] is not None]
        want |= plain_greedy([x[:2] for x in own], [(t + k % 3 - 1, s) for t, s, k in own if k is not None], 5, True)
    got = plan_intervals.E8_tolerance_match(spark, str(tmp_path)).collect()
    assert {(r.seq, r.config_seq) for r in got} == want and any(a != b for a, b in want)
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    assert sorted(map(tuple, got)) == sorted(con.sql(registry.ORACLES["E8_tolerance_match"]).fetchall())


def test_nesting_rules(spark):
    got = {r.seq: r for r in nest.nested(frame(spark, [("f", 0, 100), ("g", 10, 50), ("f", 20, 60), ("h", 50, 55), ("k", 100, 110)]), ["pid", "tid"], F.col("name") == "g", callers=True).collect()}
    assert [got[i].depth for i in range(5)] == [0, 1, 2, 3, 0]  # h starts when g ends, but f outlives g and stays open
    assert got[3].parent_seq == 2 and got[2].is_recursive and got[2].owner_seq == 1 and got[4].owner_seq is None
    assert got[3].above == [2, 1, 0]


def test_boundary_node_holds_the_same_anchors(spark):
    rows = frame(spark, [("top", 0, 100), ("wrap", 1, 40), ("a", 2, 30), ("a", 50, 60)])
    tree = nest.nested(rows, ["pid", "tid"], callers=True)
    got = {r.seq: r.boundary_seq for r in nest.boundary_nodes(tree, ["pid", "tid"], rows.where("name = 'a'").select("pid", "tid", "seq")).collect()}
    assert got == {2: 1, 3: 3}


def test_collapse_and_hierarchy(spark):
    rows = frame(spark, [("m.call", 0, 100), ("m.forward", 1, 99), ("x", 2, 20), ("x", 20, 40)])
    tree = nest.nested(rows, ["pid", "tid"], callers=True).join(rows.select("seq", "name", "dur"), "seq")
    assert {r.seq: r.parent_seq for r in nest.collapsed(tree, ["pid", "tid"]).collect()} == {1: None, 2: 1, 3: 1}
    lines = nest.hierarchy(tree, ["pid", "tid"]).orderBy("path").collect()
    assert [(r.depth, r.name, r.times) for r in lines] == [(0, "m.call", 1), (1, "m.forward", 1), (2, "x", 2)]
    assert lines[1].idle == 98 - 38
    frames = spark.createDataFrame([(1, 0, 100), (1, 1, 95), (1, 2, 10)], "k int, depth int, dur int")
    assert [(r.depth, r.of_previous) for r in profile.levels(frames, ["k"]).orderBy("depth").collect()] == [(1, None), (2, 10 / 95)]


def test_collapse_by_share_and_aggressive(spark):
    rows = frame(spark, [("m.a", 0, 100), ("m.b", 1, 45), ("m.c", 46, 90), ("x", 2, 44)])
    tree = nest.nested(rows, ["pid", "tid"], callers=True).join(rows.select("seq", "name", "dur"), "seq")
    assert {r.seq: r.parent_seq for r in nest.collapsed(tree, ["pid", "tid"]).collect()} == {1: None, 2: None, 3: 1}  # 88 of 100 by two children of one base
    assert {r.seq: r.parent_seq for r in nest.collapsed(tree, ["pid", "tid"], aggressive=0.9).collect()} == {2: None, 3: None}


def test_deep_trees_need_no_recursion():
    rows = [(i, i - 1, "f", 10.0) for i in range(5000)]
    assert sum(1 for _ in nest.shapes(rows)) == 5000


def test_virtual_cycles():
    rows = [(0, 0, "run", 5, 1), (10, 1, "run", 15, 2), (20, 2, "result", 25, 0), (28, 3, "result", 30, 0), (40, 4, "run", 45, 2), (50, 5, "run", 55, 2)]
    assert list(folds.virtual_cycles(rows)) == [("batch", 0, 10, 0, None), ("batch", 10, 25, 1, 2), ("prefill", 50, 55, 5, None)]


def test_small_folds():
    assert [g for _, g in folds.lead_groups([(0, 0, 10), (4, 1, 10), (5, 2, 10), (12, 3, 10)])] == [0, 0, 1, 2]  # the end of the band is open
    assert list(folds.lead_groups([(0, 0, 0), (1, 1, 4)])) == [(1, 0)]
    assert list(folds.tracks([(0, 0, 10), (5, 1, 8), (8, 2, 9)])) == [(0, 0, 0), (1, 1, 5), (2, 1, 9)]
    assert list(folds.busiest([(0.0, 0.0), (10.0, 100.0), (20.0, 100.0), (22.0, 0.0)])) == [(0.0, 20.0)]
    assert folds.beats([0.0, 10.0, 21.0, 40.0], 1, 10.0) == [0, 1, 2, 3]
    assert folds.seeds([0.0, 4.0, 10.1, 20.1, 30.3, 61.0], 10.0) == [0, 2, 3, 4, 5]  # from the pair nearest to a period, over a gap
    assert folds.seeds([0.0, 10.0, 20.0], 10.0) == [] and folds.seeds([0.0, 1.0, 2.0, 3.0, 4.0], 100.0) == []
    assert folds.start_index([0.0, 100.0, 200.0, 300.0, 400.0, 500.0, 500.5, 501.0, 501.5, 600.0, 700.0], 400.0) == 5
    assert folds.beat_grid([0.0, 10.0, 20.5], 10.0) == [0, 1, 2]
    assert [c["name"] for c in folds.ranked([dict(name="a", total=100, mean=1), dict(name="b", total=95, mean=5), dict(name="c", total=10, mean=9)])] == ["b", "a", "c"]


def test_cadence_finds_a_planted_period():
    rng = np.random.default_rng(1)
    stamps = np.sort(np.arange(600) * 100_000.0 + rng.normal(0, 500, 600))
    period, score = folds.cadence(stamps)
    assert abs(period - 100_000) < 2_000 and score > 1
    assert folds.cadence(stamps[:10]) is None
    assert folds.consensus([(100.0, 1.0, "a"), (105.0, 3.0, "b"), (300.0, 2.0, "c")]) == (103.75, 4.0, ["a", "b"])


def test_followers_are_free_and_near(spark):
    seeds = spark.createDataFrame([(1, 10, 2.0), (1, 11, 104.0), (2, 20, 140.0), (2, 21, 60.0), (3, 30, 139.9)], "pid long, seq long, ts double")
    pacers = spark.createDataFrame([(0, 0.0), (1, 100.0), (2, 108.0)], "seq long, ts double")
    got = {(r.pid, r.pacer_seq, r.follower_seq) for r in periods.followers(pacers, seeds, 100.0).collect()}
    # of each process one; 140 lies at the open end of 100's band; 11 is the first pacer's that comes by
    assert got == {(1, 0, 10), (1, 1, 11), (2, 1, 21), (2, 2, 20), (3, 1, 30)}


def test_followers_of_a_dense_trace_list_no_pairs(spark):
    # 200 pacers and 400 seeds, all in reach of each other: 80,000 pairs
    pacers = spark.range(200).select(F.col("id").alias("seq"), F.col("id").cast("double").alias("ts"))
    seeds = spark.range(400).select((F.col("id") % 2 + 1).alias("pid"), F.col("id").alias("seq"), (F.expr("id div 2") + 0.25).alias("ts"))
    got = periods.followers(pacers, seeds, 1000.0)
    assert {(r.pid, r.pacer_seq, r.follower_seq) for r in got.collect()} == {(p, s, 2 * s + p - 1) for p in (1, 2) for s in range(200)}
    plan = got._jdf.queryExecution().executedPlan()
    largest = max(int(m.value()) for m in _metrics(plan, "numOutputRows"))
    assert largest < 2000


def test_layer_events_once_and_without_moving_what_they_start(spark):
    layers = spark.createDataFrame([(1, k, 0.0, 10.0) for k in range(20)], "pid long, seq long, ts double, end_ts double")
    sync = spark.createDataFrame([(1, 100, 1.0, 2.0, 7), (1, 101, 2.0, 3.0, 8), (1, 102, 3.0, 4.0, 7), (1, 103, 3.0, 14.0, 9)], "pid long, seq long, ts double, end_ts double, corr long")
    work = spark.createDataFrame([(1, k, 7) for k in range(1000, 1500)] + [(1, 900, 7), (1, 900, 8), (1, 900, 8), (1, 901, 9), (2, 902, 7)], "pid long, seq long, corr long")
    got = cycles.layer_events(layers, sync, work, ["pid"], 5)
    rows = sorted((r.layer_seq, r.seq, r.how) for r in got.collect())
    assert rows == sorted([(k, s, "contained") for k in range(20) for s in (100, 101, 102)] + [(k, s, "correlated") for k in range(20) for s in (900, *range(1000, 1500))])
    assert max(int(m.value()) for m in _metrics(got._jdf.queryExecution().executedPlan(), "shuffleRecordsWritten")) < 2000


def test_pacer_rounds(spark):
    marks = spark.createDataFrame([(0, 1, 0, 10), (1, 1, 100, 10), (2, 2, 5, 10), (3, 2, 104, 10), (4, 3, 50, 10), (5, 2, 99, 10)], "seq long, pid long, ts long, dur long")
    got = {(r["round"], r.pacer_seq, r.seq) for r in cycles.pacer_rounds(marks, 100).collect()}
    # process 2 leads; a band is half a duration to both sides, open at its end; what is left leads later rounds
    assert got == {(1, 2, 2), (1, 2, 0), (1, 3, 3), (1, 3, 1), (1, 5, 5), (1, 5, 1), (2, 4, 4)}


def test_types_by_names_and_by_durations(spark):
    marks = spark.createDataFrame([(i, 5000.0 if i else 50_000.0) for i in range(6)], "seq long, dur double")
    names = lambda *x: spark.createDataFrame(list(x), "seq long, name string")
    kinds = lambda n: {r.seq: r.type for r in cycles.types(marks, n).collect()}
    assert kinds(names((0, "step"))) == {0: 1, 1: 2, 2: 2, 3: 2, 4: 2, 5: 2}
    assert kinds(names((1, "Model.Forward_Extend"), (2, "runDecode"), (3, "decode"), (4, "decode"), (4, "ENCODE"), (5, "decoder"))) == {0: 3, 1: 1, 2: 2, 3: 2, 4: 3, 5: 3}
    same = spark.createDataFrame([(i, 5000.0) for i in range(6)], "seq long, dur double")
    assert {r.type for r in cycles.types(same, names((0, "step"))).collect()} == {3}


def test_correction_takes_the_closer_neighbour(spark):
    rows = [(0, 3, 9.0), (1, 1, 10.0), (2, 3, 18.0), (3, 3, 19.0), (4, 2, 20.0), (5, 3, 4.0), (6, 2, 5.0), (7, 3, 1.0)]
    df = spark.createDataFrame([(1, *r) for r in rows], "k int, seq long, type int, dur double")
    got = [r.type for r in cycles.corrected(df, ["k"], ["seq"]).orderBy("seq").collect()]
    assert got == [1, 1, 1, 1, 2, 2, 2, 2]  # 3: the left one is as close in duration as the right one


def test_time_cuts_change_nothing(spark):
    rng = np.random.default_rng(3)
    rows = [(int(rng.integers(3)), i, int(t), int(t + d), int(d)) for i, (t, d) in enumerate(zip(np.sort(rng.integers(0, 5000, 400)), rng.integers(0, 90, 400), strict=True))]
    df = spark.createDataFrame([(None if k == 2 else k, *r) for k, *r in rows], "k int, seq long, ts long, end_ts long, dur long").cache()
    left, right = df.where("seq % 2 = 0"), df.where("seq % 5 = 1").select("k", "seq", "ts")
    all_of = lambda x: sorted(map(str, x.collect()))
    for cut in (7, 100, 100_000):
        assert all_of(interval.merged(df, ["k"])) == all_of(interval.merged(df, ["k"], cut))
        assert all_of(interval.gaps(df, ["k"])) == all_of(interval.gaps(df, ["k"], cut))
        assert all_of(interval.sessions(df, ["k"], 5).select("seq", "session")) == all_of(interval.sessions(df, ["k"], 5, cut=cut).select("seq", "session"))
        for forward in (False, True):
            assert all_of(interval.as_of(left, right, ["k"], forward=forward).select("seq", "match")) == all_of(interval.as_of(left, right, ["k"], forward=forward, cut=cut).select("seq", "match"))


def test_nesting_by_stretches_changes_nothing(spark):
    rng = np.random.default_rng(8)
    rows = [(0, 0, 0, 5000, "main"), (0, 1, 1, 4000, "loop")]
    for i, (t, d) in enumerate(zip(np.sort(rng.integers(0, 5000, 500)), rng.choice([3, 20, 90, 700], 500), strict=True)):
        rows.append((int(rng.integers(2)), i + 2, int(t), int(t + d), f"f{rng.integers(6)}"))
    df = spark.createDataFrame([(None if k else 1, *r) for k, *r in rows], "k int, seq long, ts long, end_ts long, name string")
    args = (["k"], F.col("name") == "f1", True)
    want = sorted(map(str, nest.nested(df, *args).collect()))
    for cut in (50, 333, 1_000_000):
        assert sorted(map(str, nest.nested(df, *args, cut=cut).collect())) == want


def test_found_periods(spark):
    rows = [(p, "m", 10 * i + 2 * p + k, i * 100_000.0 + p * 500 + k * 20_000, name) for p in (1, 2) for i in range(200) for k, name in enumerate(("step", "part"))]
    events = spark.createDataFrame(rows, "pid long, tid string, seq long, ts double, name string")
    alone = periods.found(events).orderBy("start_ts").collect()
    assert len(alone) == 200 and {r.pid for r in alone} == {1} and abs(alone[5].end_ts - alone[5].start_ts - 100_000) < 1
    both = periods.found(events, align=True).orderBy("start_ts").collect()
    assert len(both) == 200 and {r.type for r in both} == {2} and abs(both[3].start_ts - 300_000.0) < 25_000


def test_comparison_text(spark):
    from tracemill.sources import sinks

    frame_ = lambda k: spark.createDataFrame([("f", 0, "gpu_usage", c, 1000.0 * k + c, 10.0 * k + c, 50.0 + c) for c in range(9)], "name string, device int, metric string, cycle int, cycle_dur double, beta_pct double, mu_pct double")
    parts = workflow.compared(frame_(1), frame_(2), 0.1)
    text = sinks.comparison(parts, "before", "after")
    assert "| cycles | 9 | 9 | 0 | - |" in text and "| mean cycle (us) | 1,004.00 | 2,004.00 | +1,000.00 | +99.60 |" in text and "f on 0: gpu_usage" in text and text.count("\n| ") > 12
    exact = parts["scores"].first()
    assert abs(exact.u_p_mu - 1) < 1e-9 and exact.u_p_beta < 0.01


def test_exact_u_for_small_samples(spark):
    rows = spark.createDataFrame([("a", 1, float(v)) for v in (1, 2, 3)] + [("a", 2, float(v)) for v in (4, 5, 6)] + [("b", 1, 1.0), ("b", 2, 2.0)], "k string, side int, v double")
    got = {r.k: r.p for r in compare.rank_sums(rows, ["k"], F.col("side"), "v").select("k", compare.u_p_value().alias("p")).collect()}
    assert abs(got["a"] - 0.1) < 1e-12 and got["b"] == 1.0


def test_every_mode_gets_a_model(spark):
    rows = spark.createDataFrame([(float(i % 7), float(m * 10 + i % 7), m) for m in range(12) for i in range(50)], "x double, y double, mode int")
    models = learn.trained(rows, ["x"], "y", mode="mode")
    assert len(models) == 12 and learn.predicted(rows, models, mode="mode").where("predicted is null").count() == 0


def test_reports_say_what_they_leave_out(spark):
    from tracemill.sources import sinks

    df = spark.range(70)
    assert sinks.markdown(df).count("\n") == 71 and "first 50 rows" in sinks.markdown(df, 50) and "first" not in sinks.markdown(df, 70)
    edges = spark.createDataFrame([(f"f{i}", "g", i) for i in range(9)], "caller string, callee string, n long")
    assert sinks.dot(edges).count("->") == 9 and "left out" in sinks.dot(edges, limit=3)


def test_tests_match_known_values(spark):
    # t = -2.0, df = 8: p = 0.0805162...; checked by the closed form of the t distribution with 8 degrees
    t, v = 2.0, 8
    x = v / (v + t * t)
    want = 1 - t / math.sqrt(v + t * t) * (1 + x / 2 + 3 * x**2 / 8 + 15 * x**3 / 48)
    assert abs(compare._beta_inc(v / 2, 0.5, x) - want) < 1e-12
    assert abs(compare.exact_u_p(3, 3, 0) - 0.1) < 1e-12 and abs(compare.exact_u_p(2, 2, 2) - 1) < 1e-12
    rows = spark.createDataFrame([("a", 1, 1.0), ("a", 1, 2.0), ("a", 2, 2.0), ("a", 2, 3.0)], "k string, side int, v double")
    r = compare.rank_sums(rows, ["k"], F.col("side"), "v").first()
    assert (r.u, r.size1, r.size2, r.ties) == (0.5, 2, 2, 6.0)


def test_pairs_labels_clusters(spark):
    a = spark.createDataFrame([("x", "decode", "n/x"), ("y", "", "n/y")], "stem string, suffix string, path string")
    b = spark.createDataFrame([("x", "", "a/x"), ("y", "", "a/y"), ("y", "decode", "a/yd")], "stem string, suffix string, path string")
    assert {(r.path1, r.path2) for r in compare.paired(a, b).collect()} == {("n/x", "a/x"), ("n/y", "a/y")}
    assert compare.labels(["a/x/1", "b/x/1", "b/y/2"]) == ["a/x/1", "b/x/1", "2"]
    assert compare.clusters({(0, 1): 0.5, (0, 2): 9.0, (1, 2): 9.0}, 3, 1.0) == [0, 0, 2]


def test_health_rules(spark):
    rows = [(1, "a", "cpu_frequency", 3000.0), (1, "b", "cpu_frequency", 1000.0), (2, "a", "disk_usage", 95.0), (3, "a", "cpu_frequency", 2000.0)]
    found = diagnose.issues(diagnose.health(spark.createDataFrame(rows, "cycle int, host string, name string, value double")))
    assert {(r.cycle, r.host, r.issue) for r in found.collect()} == {(1, "b", "CPU_FREQ_DROP_RELATIVE"), (1, "b", "CPU_FREQ_DROP_ABSOLUTE"), (2, "a", "DISK_IO_BOTTLENECK")}
    perf = spark.createDataFrame([(c, "a", "gpu_comm", "k", 1, 0, 50.0, 10.0) for c in (1, 2, 3, 4)], "cycle int, host string, func_type string, name string, pid int, device int, beta double, dur double")
    late = spark.createDataFrame([(4,)], "cycle int")
    got = {r.cycle: (r.fingerprint, r.detail) for r in diagnose.bottleneck(perf, found, late).collect()}
    assert got == {1: ("CPU_FREQ_DROP_RELATIVE", "b"), 2: ("DISK_IO_BOTTLENECK", "a"), 3: ("COMM_BOTTLENECK", "a"), 4: ("DELAYED_START", None)}


def test_split_protects_boundaries(spark):
    rows = spark.range(200).select((F.col("id") % 20).alias("a"), (F.col("id") % 10).alias("b"))
    got = detect.boundary_split(rows, ["a", "b"])
    ends = got.where("a in (0, 19) or b in (0, 9)")
    assert ends.where("not is_train").count() == 0 and 0 < got.where("not is_train").count() < 60
    t = detect.trials(rows, rows, 3, 50, 10)
    assert t.count() == 180 and t.where("is_anomaly = 1 and idx < 50").count() == 0


def test_ridge_equals_closed_form(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 2)) * [1, 30]
    y = x @ [2.0, 0.1] + 5 + rng.normal(size=80)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, y double")
    got = np.array([r.predicted for r in learn.ridge(df, ["a", "b"], "y").transform(df).collect()])
    z = (x - x.mean(0)) / x.std(0)
    w = np.linalg.solve(z.T @ z + np.eye(2), z.T @ (y - y.mean()))
    assert np.allclose(got, z @ w + y.mean(), atol=1e-8)


def test_models_of_many_modes_predict_all_rows(spark):
    rows = [(float(i), m, 2.0 * i + m) for m in range(12) for i in range(25)] + [(1.0, 50, 1.0), (2.0, None, 1.0), (None, 3, 1.0), (float("nan"), 3, 1.0)]
    df = spark.createDataFrame(rows, "x double, mode int, y double")
    models = learn.trained(df, ["x"], "y", mode="mode")
    assert [v for v, _ in models] == list(range(12))
    got = learn.predicted(df, models, mode="mode").collect()
    assert len(got) == len(rows) and sum(r.predicted is None for r in got) == 4
    assert learn.predicted(df, []).count() == len(rows)


def test_experiments_share_their_bounds(spark, sf, monkeypatch):
    made, bound = [], systems.detect.iqr_bounds
    monkeypatch.setattr(systems.detect, "iqr_bounds", lambda *a, **k: made.append(a[1:]) or bound(*a, **k))
    got = {(r.log, r.mode): r.r2 for r in systems.L4_L8_L9_experiments(spark, sf).collect()}
    assert len(made) == 1 and len(got) == 4
    rows = systems._features(spark, sf)
    whole = learn.experiment(rows, ["x1", "x2", "x3"], "y", ["x1"], learn.grid(kinds=("ridge",), splits=("group",), iqr=(3.0,))[0])
    assert whole["mdape"] is not None and whole["r2"] == pytest.approx(got[whole["log"], whole["mode"] or "unified"])


def test_boosting_takes_equal_rows_once_with_their_weight(spark, monkeypatch):
    made, fit = [], learn.Pipeline.fit
    monkeypatch.setattr(learn.Pipeline, "fit", lambda self, rows: made.append(rows.count()) or fit(self, rows))
    data = [(0.0, 10.0)] * 6 + [(0.0, 16.0)] * 3 + [(1.0, 20.0)] + [(2.0, 50.0)] * 5 + [(2.0, 62.0)]
    model = learn.boosted(spark.createDataFrame(data, "x double, y double"), ["x"], "y", trees=1, depth=1)
    got = {r.x: r.predicted for r in learn.predicted(spark.createDataFrame(data, "x double, y double"), [(None, model)]).collect()}
    assert made == [3]
    low, high = np.mean([y for x, y in data if x < 2]), np.mean([y for x, y in data if x == 2])
    assert got == pytest.approx({0.0: low, 1.0: low, 2.0: high})


def test_registered_models_use_all_rows_and_trees(spark, sf, monkeypatch):
    asked, fit = [], learn.trained
    monkeypatch.setattr(learn, "trained", lambda *a, **k: asked.append(k.pop("trees", 200)) or fit(*a, **k, **({"trees": 2} if "boosted" in a else {})))
    for f in (systems.L1_boosted_trees, systems.L2_L3_ridge):
        got = f(spark, sf)
        assert got.count() == table(spark, sf, "lineitem").count() and {r.is_train for r in got.select("is_train").distinct().collect()} == {True, False}
    assert asked == [200, 200]


def test_metrics_real_and_interpolated(spark):
    e = spark.createDataFrame([(1, 0, "oncpu", "f", 7, -1, 0.0, 10.0, 10.0, 100.0), (1, 1, "oncpu", "f", 7, -1, 20.0, 30.0, 10.0, 100.0)], "cycle int, seq long, func_type string, name string, pid long, device int, ts double, end_ts double, dur double, cycle_dur double")
    points = [("process_cpu_usage", 7, float(t), v, 100.0, i) for i, (t, v) in enumerate([(0, 10.0), (5, 20.0), (10, 30.0), (40, 60.0)])]
    c = spark.createDataFrame(points, "metric string, instance long, ts double, value double, factor double, seq long")
    r = metrics.perf_table(e, c, 10).where("metric = 'process_cpu_usage'").first()
    assert (r.n, r.beta_pct, r.real, r.interpolated) == (2, 20.0, 1, 1)
    assert abs(r.mu_pct - (20 + 45) / 2) < 1e-9


def test_cycles_of_a_small_trace(spark, tmp_path):
    events = [dict(name="step", cat="python", ph="X", pid="host(1)", tid="m", ts=t, dur=50, args={}) for t in (0, 100, 200)]
    events += [dict(name="cudaLaunch", cat="cuda_runtime", ph="X", pid=1, tid="m", ts=t + 5, dur=5, args={"correlation": k}) for k, t in enumerate((0, 100, 200))]
    events += [dict(name="gemm", cat="Kernel", ph="X", pid=1, tid="stream 7", ts=t + 90, dur=30, args={"correlation": k, "device": 0}) for k, t in enumerate((0, 100, 200))]
    import gzip
    import json

    with gzip.open(tmp_path / "a.json.gz", "wt") as f:
        json.dump({"traceEvents": [*events, 7, {"name": "bad", "ts": "x"}]}, f)
    (tmp_path / "b.json").write_text(json.dumps([dict(name="c", ph="C", cat="CAT_CPU", pid=2, tid="", ts="5", args={"value": 1, "args": '{"value": "9"}'})]))
    rows = sources.read_json(spark, str(tmp_path))
    assert rows.count() == 10
    assert rows.where("name = 'c'").first().args["value"] == "9"
    assert len(sources.find_jobs(spark, str(tmp_path))) == 2
    trace = rows.where("name <> 'c'")
    marks = workflow._typed(trace, "step")
    bounds = cycles.boundaries(marks)
    assert sorted((r.start_ts, r.end_ts) for r in bounds.collect()) == [(1, 50), (51, 150), (151, 250)]
    inside = cycles.assigned(bounds, trace)
    kernels = inside.where("cat = 'Kernel'")
    assert kernels.count() == 3 and kernels.select("cycle").distinct().count() == 3  # a kernel goes with its call, wherever it ran
    sinks.write_trace(rows, str(tmp_path / "out"), spark.createDataFrame([(1.0, 50.0, 2, 0)], "start_ts double, end_ts double, type int, track int"))
    assert sources.read_json_lines(spark, str(tmp_path / "out")).count() == 11


def test_scalars(spark):
    row = spark.createDataFrame([("node-1(77)", "x", None)], "a string, b string, n string").select(S.pid_of(F.col("a")).alias("p"), S.pid_of(F.col("b")).alias("q"), S.pid_of(F.col("n")).alias("r"), S.host_of(F.col("a")).alias("h"), S.time_text(F.lit(-1)).alias("t"), S.kernel_family(F.col("n")).alias("k"), S.priority(F.col("n")).alias("pr")).first()
    assert (row.p, row.q, row.r, row.h, row.t, row.k, row.pr) == (77, -1, -1, "node-1", "Invalid Timestamp", "unknown_function", 0)
    assert demangle.readable(["plain", ""]) == ["plain", ""]


def test_log_search():
    import re

    assert logs.find_key({"a": [{"b": 1}, {"dtype": "x"}]}, re.compile("dtype|b")) == 1
    assert logs.find_key([1, "x"], re.compile("a")) is None


@pytest.mark.parametrize("rows", [[], [(None, 1.0)], [("a", None)]])
def test_detect_on_nulls(spark, rows):
    df = spark.createDataFrame(rows, "k string, v double")
    assert detect.iqr_clean(df, detect.iqr_bounds(df, ["k"], "v"), ["k"], "v").count() == len(rows)


def test_workflows(spark):
    import json

    from tracemill.plans import workflow

    raw = [("step", "python", "X", "a(1)", "m", t, 50, {}) for t in (0, 100, 200, 300)] + [("oncpu main", "CAT_CPU", "X", "a(1)", "m", t + 2, 20, {}) for t in (0, 100, 200, 300)]
    raw += [("cudaLaunch", "cuda_runtime", "X", "a(1)", "m", t + 5, 5, {"correlation": str(t)}) for t in (0, 100, 200, 300)] + [("triton_x", "Kernel", "X", "a(1)", "stream 7", t + 10, 30, {"correlation": str(t), "device": "0"}) for t in (0, 100, 200, 300)]
    raw += [("gpu_usage_0", "CAT_XPU", "C", "a(1)", "CAT_XPU_0", t, 0, {"value": "80", "hostname": "a"}) for t in range(0, 400, 10)] + [("cpu_temp_0", "CAT_CPU", "C", "a(1)", "", t, 0, {"value": "95", "hostname": "a"}) for t in range(0, 400, 10)]
    df = spark.createDataFrame([(i, n, c, ph, p, t, str(ts), str(d), None, None, a) for i, (n, c, ph, p, t, ts, d, a) in enumerate(raw)], "seq long, name string, cat string, ph string, pid string, tid string, ts string, dur string, id string, bp string, args map<string,string>")
    events = sources.normalised(df)
    parts = workflow.deep_dive(events, "step", 8, 100)
    got = parts["perf"].where("name = 'triton_kernel' and metric = 'gpu_usage'").collect()
    assert len(got) == 4 and all(abs(r.mu_pct - 80) < 1e-9 for r in got)
    assert {r.fingerprint for r in parts["bottlenecks"].collect()} == {"CPU_THERMAL_THROTTLING"}
    text = workflow.report(parts, "run")
    assert "4 cycles. Most show CPU_THERMAL_THROTTLING (100.0 %)." in text and "Stable: all cycles show one pattern." in text and "| CPU_THERMAL_THROTTLING | a | 4 | 100.00 |" in text
    inner = [("wrap.call", "python", "X", "a(1)", "m", 500, 100, {}), ("wrap.run", "python", "X", "a(1)", "m", 501, 95, {}), ("decoder_layer.f", "python", "X", "a(1)", "m", 510, 20, {}), ("decoder_layer.f", "python", "X", "a(1)", "m", 540, 20, {}), ("op", "python", "X", "a(1)", "m", 541, 5, {}), ("_Z3fooi", "Kernel", "X", "a(1)", "stream 7", 550, 40, {})]
    more = sources.normalised(spark.createDataFrame([(i, n, c, ph, p, t, str(ts), str(d), None, None, a) for i, (n, c, ph, p, t, ts, d, a) in enumerate(inner)], df.schema))
    text = workflow.cycle_details(more, 3, 500, 700, layer=3)
    assert "200.00 us, 2 layers." in text and "wrap.call" not in text and "| Python | wrap.run | 1 | 95.00 |" in text and "| 0001/ " not in text and "| 0000/0000/ | 1 | op | 1 | 5.00 | 5.00 |" in text
    scores = workflow.compared(parts["perf"], parts["perf"])["scores"]
    assert scores.where("suspicion <> 0 or u_p_beta < 0.5").count() == 0 and scores.count() > 0

    names = [("Scheduler.run_batch", 100), ("Scheduler.process_batch_result", 150), ("Scheduler.get_next_batch_to_run", 170), ("Scheduler.get_next_batch_to_run", 180), ("Scheduler.run_batch", 300), ("Scheduler.process_batch_result", 350)]
    ev = spark.createDataFrame([(i, n, float(t), float(t + 10)) for i, (n, t) in enumerate(names)], "seq long, name string, ts double, end_ts double")
    line = lambda n, t: json.dumps({"kunlunClassAttr": {"class": "Scheduler", "fn": n.split(".")[1], "attr": "reqs"}})[:-1] + f', "Value": forward_mode=DECODE rid=a1 rid=b2 input_ids=[1, 2] output_ids=[3], "start_time": {t + 2}}}'
    lines = spark.createDataFrame([("log", i, line(n, t)) for i, (n, t) in enumerate(names) if "next" not in n], "path string, line_no long, line string")
    got = workflow.monitored(ev, lines, "job")
    assert len(got.columns) == 16
    rows = {(r.kind, r.start_ts): (r.duration_us, r.compute_forward_mode, r.compute_batch_size, r.compute_max_input_length, r.post_batch_size) for r in got.collect()}
    assert rows == {("batch", 100.0): (60.0, "DECODE", 2, 2, 2), ("batch", 300.0): (60.0, "DECODE", 2, 2, 2), ("idle", 160.0): (140.0, "N/A", 0, 0, 0)}
