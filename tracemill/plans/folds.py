"""Queries over nesting and ordered state machines (G, H3 to H12)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import cycles, folds, interval, nest, periods, profile
from ..sources import sinks
from .registry import SPANS, TRACE, query, samples, spans, trace

DAY = 86_400_000_000
_STACK = TRACE + """, x AS (SELECT seq, tid, name, ts, end_ts, dur FROM trace WHERE ph = 'X'),
 p AS (SELECT a.seq, a.tid, a.name, max((b.ts, b.seq)) AS q FROM x a LEFT JOIN x b ON a.tid = b.tid AND (b.ts < a.ts OR (b.ts = a.ts AND b.seq < a.seq)) AND b.end_ts > a.ts GROUP BY ALL),
 f AS (SELECT seq, tid, name, q[2] AS parent FROM p)"""
_TREE = "WITH RECURSIVE " + _STACK + """, r AS (SELECT seq, tid, name, parent, 0 AS depth, [name] AS above, FALSE AS rec, CASE WHEN name = 'purchase' THEN seq END AS owner FROM f WHERE parent IS NULL
 UNION ALL SELECT c.seq, c.tid, c.name, c.parent, r.depth + 1, list_append(r.above, c.name), list_contains(r.above, c.name), CASE WHEN c.name = 'purchase' THEN c.seq ELSE r.owner END FROM f c JOIN r ON c.parent = r.seq)"""

_UP = _TREE + """, up AS (SELECT seq, tid, seq AS anc, 0 AS dist FROM f UNION ALL SELECT u.seq, u.tid, f.parent, u.dist + 1 FROM up u JOIN f ON f.seq = u.anc WHERE f.parent IS NOT NULL)"""
_EDGES = f"{_TREE}, e AS (SELECT p.name AS caller, c.name AS callee, CAST(count(*) AS BIGINT) AS n FROM r c JOIN r p ON p.seq = c.parent WHERE p.name <> c.name GROUP BY ALL)"
_KINDS = """CASE WHEN pid < 5 AND seq % 37 = 0 THEN 'Model.Forward_Extend' WHEN pid < 5 AND seq % 11 = 0 THEN 'runDecode' WHEN pid < 5 AND seq % 5 = 0 THEN 'decode' WHEN pid < 5 AND seq % 3 = 0 THEN 'encode' ELSE name END"""
#: Some calls under a name of their own that are rare and long.
_RARE = f"{_TREE}, j AS (SELECT r.tid % 8 AS pid, r.depth, r.rec, CASE WHEN x.seq % 100 >= 97 THEN 'rare' || (x.seq % 2) ELSE r.name END AS name, CASE WHEN x.seq % 100 >= 97 THEN x.dur * 10 ELSE x.dur END AS dur FROM r JOIN x ON x.seq = r.seq), c AS (SELECT pid, name, count(*) FILTER (WHERE depth = 0) AS n, avg(dur) FILTER (WHERE depth = 0) AS mean, sum(dur) AS all_total FROM j WHERE NOT rec GROUP BY pid, name HAVING count(*) FILTER (WHERE depth = 0) > 2)"


def _spans(spark, sf):
    return trace(spark, sf).where("ph = 'X'").select("seq", "tid", "name", "ts", "end_ts", "dur")


def _joined(spark, sf, *more):
    """The nested spans with name and dur."""
    rows = _spans(spark, sf)
    return nest.nested(rows, ["tid"]).join(rows.select("seq", "name", "dur", *more), "seq")


@query(f"{_TREE} SELECT tid, seq, depth, parent AS parent_seq, rec AS is_recursive, owner AS owner_seq FROM r")
def G1_G2_G3_nesting(spark, sf):
    return nest.nested(_spans(spark, sf), ["tid"], F.col("name") == "purchase", cut=7 * DAY)


@query(f"{_TREE} SELECT name, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE depth = 0) AS BIGINT) AS top_level, CAST(max(depth) AS INTEGER) AS deepest FROM r WHERE NOT rec GROUP BY name")
def F3_non_recursive_stats(spark, sf):
    rows = _spans(spark, sf)
    tree = nest.nested(rows, ["tid"]).join(rows.select("seq", "name"), "seq").where("not is_recursive")
    return tree.groupBy("name").agg(F.count("*").alias("n"), F.count_if(F.col("depth") == 0).alias("top_level"), F.max("depth").alias("deepest"))


@query(f"{_UP}, mine AS (SELECT up.* FROM up JOIN f ON f.seq = up.seq WHERE f.name = 'purchase'), n AS (SELECT anc, count(*) AS n FROM mine GROUP BY anc) SELECT m.tid, m.seq, arg_max(m.anc, m.dist) AS boundary_seq FROM mine m JOIN n ON n.anc = m.anc JOIN n o ON o.anc = m.seq WHERE n.n = o.n GROUP BY m.tid, m.seq")
def G4_E24_boundary_nodes(spark, sf):
    rows = _spans(spark, sf)
    tree = nest.nested(rows, ["tid"], callers=True)
    return nest.boundary_nodes(tree, ["tid"], rows.where("name = 'purchase'").select("tid", "seq"))


@query(f"{_UP}, d AS (SELECT up.tid, up.anc AS layer_seq, up.seq, up.dist, b.name AS base FROM up JOIN f l ON l.seq = up.anc AND l.name = 'purchase' JOIN f b ON b.seq = up.seq WHERE up.dist > 0 AND b.name <> 'purchase'), m AS (SELECT *, min(dist) OVER (PARTITION BY layer_seq) AS least FROM d) SELECT tid, layer_seq, min(seq) AS seq FROM m WHERE dist = least GROUP BY tid, layer_seq, base")
def G15_operators(spark, sf):
    rows = _spans(spark, sf).withColumn("name", F.concat("name", F.lit("."), (F.col("seq") % 3).cast("string")))
    tree = nest.nested(rows, ["tid"], callers=True).join(rows.select("seq", "name"), "seq")
    return nest.operators(tree, ["tid"], rows.where("name like 'purchase%'").select("tid", "seq"))


@query(f"""{_UP}, s AS (SELECT f.seq, f.name, x.dur FROM f JOIN x ON x.seq = f.seq), w AS (SELECT p.seq FROM s p JOIN f c ON c.parent = p.seq JOIN s k ON k.seq = c.seq WHERE p.dur > 0 GROUP BY p.seq HAVING COALESCE(sum(CASE WHEN k.name = max_name THEN k.dur END) > 0.5 * max(p.dur), FALSE) OR max(k.dur) > 0.9 * max(p.dur)),
 kept AS (SELECT tid, seq FROM f WHERE seq NOT IN (SELECT seq FROM w)) SELECT k.tid, k.seq, arg_min(u.anc, u.dist) AS parent_seq FROM kept k LEFT JOIN (SELECT up.* FROM up JOIN kept ON kept.seq = up.anc WHERE dist > 0) u ON u.seq = k.seq GROUP BY k.tid, k.seq""".replace("k.name = max_name", "k.name = p.name"))
def G19_collapsed_tree(spark, sf):
    rows = _spans(spark, sf).withColumn("name", F.concat("name", F.lit("."), (F.col("seq") % 3).cast("string")))
    tree = nest.nested(rows, ["tid"], callers=True).join(rows.select("seq", "name", "dur"), "seq")
    return nest.collapsed(tree, ["tid"], 0.5, 0.9)


@query()
def G20_hierarchy(spark, sf):
    rows = _spans(spark, sf)
    tree = nest.nested(rows, ["tid"]).join(rows.select("seq", "name", F.col("dur").cast("double").alias("dur")), "seq")
    return nest.hierarchy(tree, ["tid"])


@query(f"""WITH RECURSIVE {SPANS}, n AS (SELECT tid, seq, ts, dur, row_number() OVER (PARTITION BY tid ORDER BY ts, seq) AS k FROM spans),
 g AS (SELECT tid, k, seq, ts < ts + 0.5 * dur AS ok, CASE WHEN dur > 0 THEN 0 ELSE -1 END AS grp, CASE WHEN dur > 0 THEN ts + 0.5 * dur ELSE ts END AS bound FROM n WHERE k = 1
 UNION ALL SELECT n.tid, n.k, n.seq, n.ts < g.bound OR n.dur > 0, CASE WHEN n.ts < g.bound OR n.dur <= 0 THEN g.grp ELSE g.grp + 1 END, CASE WHEN n.ts < g.bound OR n.dur <= 0 THEN g.bound ELSE n.ts + 0.5 * n.dur END FROM g JOIN n ON n.tid = g.tid AND n.k = g.k + 1) SELECT tid, seq, CAST(grp AS INTEGER) AS "group" FROM g WHERE ok""")
def G7_lead_groups(spark, sf):
    return cycles.prefill_groups(spans(spark, sf), ["tid"])


@query(f"""WITH RECURSIVE {SPANS}, n AS (SELECT tid, seq, ts, end_ts, name = 'purchase' AS done, CASE name WHEN 'view' THEN 1 ELSE 2 END AS mode, row_number() OVER (PARTITION BY tid ORDER BY ts, seq) AS k, count(*) OVER (PARTITION BY tid) AS top FROM spans),
 m AS (SELECT DISTINCT tid, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS a_ts, CAST(NULL AS BIGINT) AS a_seq, CAST(NULL AS INTEGER) AS a_mode, CAST(NULL AS BIGINT) AS last, CAST(NULL AS BIGINT) AS s, CAST(NULL AS BIGINT) AS e, CAST(NULL AS BIGINT) AS run, CAST(NULL AS BIGINT) AS res, CAST(0 AS BIGINT) AS top, CAST(NULL AS BIGINT) AS final FROM n
 UNION ALL SELECT n.tid, n.k, CASE WHEN NOT n.done THEN n.ts WHEN n.ts - m.last < 10 THEN m.a_ts END, CASE WHEN NOT n.done THEN n.seq WHEN n.ts - m.last < 10 THEN m.a_seq END, CASE WHEN NOT n.done THEN n.mode WHEN n.ts - m.last < 10 THEN m.a_mode END,
 CASE WHEN NOT n.done OR n.ts - m.last < 10 THEN m.last ELSE n.ts END,
 CASE WHEN NOT n.done AND m.a_mode <> n.mode AND n.ts > m.a_ts THEN m.a_ts WHEN n.done AND NOT COALESCE(n.ts - m.last < 10, FALSE) AND n.end_ts >= m.a_ts THEN m.a_ts END, CASE WHEN n.done THEN n.end_ts ELSE n.ts END, m.a_seq, CASE WHEN n.done THEN n.seq END, n.top, n.end_ts FROM m JOIN n ON n.tid = m.tid AND n.k = m.k + 1)
 SELECT tid, 'batch' AS kind, s AS start_ts, e AS end_ts, run AS run_seq, res AS result_seq FROM m WHERE s IS NOT NULL UNION ALL SELECT tid, 'prefill', a_ts, greatest(a_ts, final), a_seq, NULL FROM m WHERE k = top AND k > 0 AND a_ts IS NOT NULL""")
def G18_virtual_cycles(spark, sf):
    kind = F.when(F.col("name") == "purchase", "result").otherwise("run")
    rows = spans(spark, sf).withColumn("kind", kind).withColumn("mode", F.when(F.col("name") == "view", 1).otherwise(2))
    return nest.fold(rows, ["tid"], ["ts", "seq", "kind", "end_ts", "mode"], folds.virtual_cycles, "kind string, start_ts long, end_ts long, run_seq long, result_seq long")


@query(f"""WITH RECURSIVE {SPANS}, n AS (SELECT tid, seq, ts, end_ts, row_number() OVER (PARTITION BY tid ORDER BY ts, seq, end_ts) AS k FROM spans),
 t AS (SELECT tid, k, seq, ts AS start_ts, 1 AS track, [end_ts] AS ends FROM n WHERE k = 1
 UNION ALL SELECT tid, k, seq, CASE WHEN free IS NOT NULL AND ends[free] = ts THEN ts + 1 ELSE ts END, COALESCE(free, len(ends) + 1), CASE WHEN free IS NULL THEN list_append(ends, end_ts) ELSE ends[:free - 1] || [end_ts] || ends[free + 1:] END
 FROM (SELECT n.*, t.ends, nullif(COALESCE(list_position([n.ts >= e FOR e IN t.ends], TRUE), 0), 0) AS free FROM t JOIN n ON n.tid = t.tid AND n.k = t.k + 1))
 SELECT tid, seq, CAST(track - 1 AS INTEGER) AS track, start_ts FROM t""")
def G22_tracks(spark, sf):
    return nest.fold(spans(spark, sf), ["tid"], ["ts", "seq", "end_ts"], folds.tracks, "seq long, track int, start_ts long")


@query(f"""WITH {SPANS}, d AS (SELECT tid, ts, value, lead(ts) OVER w - ts AS step, (value + COALESCE(lead(value) OVER w, value)) / 200 AS m FROM samples WINDOW w AS (PARTITION BY tid ORDER BY ts, value)), k AS (SELECT tid, ts, COALESCE(step, 1) AS step, COALESCE(step, 1) * m AS work FROM d),
 c AS (SELECT *, sum(work) OVER (PARTITION BY tid ORDER BY ts ROWS UNBOUNDED PRECEDING) AS after, sum(work) OVER (PARTITION BY tid) AS total FROM k),
 e AS (SELECT a.tid, a.ts AS start_ts, min(b.ts + b.step) AS end_ts FROM c a JOIN c b ON a.tid = b.tid AND b.ts >= a.ts AND b.after >= a.after - a.work + 0.8 * a.total * (1 - 1e-12) GROUP BY a.tid, a.ts)
 SELECT tid, CAST(arg_min(start_ts, (end_ts - start_ts, start_ts)) AS DOUBLE) AS start_ts, CAST(arg_min(end_ts, (end_ts - start_ts, start_ts)) AS DOUBLE) AS end_ts FROM e GROUP BY tid""")
def H3_busiest_window(spark, sf):
    return nest.fold(samples(spark, sf), ["tid"], ["ts", "value"], folds.busiest, "start_ts double, end_ts double")


def _ticks(spark, sf):
    """The events as four names of a loop that two processes run every 100 ms, with some jitter."""
    e = trace(spark, sf)
    turn = F.expr("seq div 4")
    return e.select((turn % 2).alias("pid"), F.lit("main").alias("tid"), "seq", (turn * 100_000 + (F.col("seq") % 4) * 1000 + F.col("k")).cast("double").alias("ts"), F.concat(F.lit("part"), (F.col("seq") % 4).cast("string")).alias("name"))


@query()
def H5_H6_cadence(spark, sf):
    found = folds.cadences(_ticks(spark, sf), ["pid"])
    return folds.consensus_periods(found, ["pid"]).select("pid", F.round("period_us").alias("period_us"), "names")


@query()
def H10_H11_H12_beats(spark, sf):
    def run(rows):
        stamps = [float(t) for t, _ in rows]
        period = 20 * 3_600_000_000.0
        found = {"expand": folds.beats(stamps, folds.start_index(stamps, period), period), "jump": folds.seeds(stamps, period), "grid": folds.beat_grid(stamps, period)}
        yield from ((how, rows[k][1]) for how, at in found.items() for k in at)

    return nest.fold(trace(spark, sf).where("name = 'purchase'"), ["tid"], ["ts", "seq"], run, "how string, seq long")


@query()
def E15_followers(spark, sf):
    rows = trace(spark, sf)
    return periods.followers(rows.where("name = 'purchase' and pid = 0").select("seq", "ts"), rows.where("name = 'purchase' and pid <> 0").select("pid", "seq", "ts"), 2 * 3_600_000_000.0)


@query(f"""WITH {TRACE}, e AS (SELECT pid, seq, ts, name FROM trace), w AS (SELECT pid, (max(ts) - min(ts)) / {15 * 3_600_000_000.0} AS want FROM e GROUP BY pid), n AS (SELECT e.pid, name, count(*) AS n, min((ts, seq)) AS first, any_value(want) AS want FROM e JOIN w ON w.pid = e.pid GROUP BY e.pid, name),
 b AS (SELECT pid, arg_min(n, (abs(n - want), first)) AS best FROM n GROUP BY pid), c AS (SELECT n.*, (SELECT count(*) FROM e WHERE e.pid = n.pid AND (e.ts, e.seq) >= n.first AND e.ts <= n.first[1] + {1.5 * 3_600_000_000.0}) AS dense FROM n JOIN b ON b.pid = n.pid AND b.best = n.n
 WHERE n BETWEEN want * 0.85 AND want * 1.15 OR abs(n - want / 2) < greatest(2, want * 0.05) OR abs(n - want / 3) < greatest(2, want * 0.05))
 SELECT pid, name AS marker, CAST(n AS BIGINT) AS n FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY dense DESC, first) AS r FROM c) WHERE r = 1""")
def H7_marker(spark, sf):
    rows = trace(spark, sf).select("pid", "seq", "ts", "name")
    return periods.marker(rows, rows.select("pid").distinct().withColumn("period_us", F.lit(15 * 3_600_000_000.0)), ["pid"])


@query(f"""WITH {SPANS}, s AS (SELECT *, {_KINDS} AS label FROM spans), a AS (SELECT seq, pid, tid, ts, end_ts, CASE WHEN seq % 9 = 0 THEN dur * 20 ELSE dur END AS dur FROM spans WHERE name = 'purchase'), o AS (SELECT a.seq, s.label FROM a JOIN s ON s.tid = a.tid AND s.ts >= a.ts AND s.end_ts <= a.end_ts),
 w AS (SELECT seq, bool_or(lower(label) LIKE '%forward_extend%') AS p, bool_or(lower(label) = 'encode') AS e, bool_or(regexp_matches(label, '[dD]ecode($|[^a-z])')) AS d, bool_or(regexp_matches(label, '[dD]ecode($|[^a-z])') AND label <> 'decode') AS d2 FROM o GROUP BY seq),
 j AS (SELECT a.*, COALESCE(p, FALSE) AS p, COALESCE(CASE WHEN e THEN d2 ELSE d END, FALSE) AS d FROM a LEFT JOIN w USING (seq)), t AS (SELECT pid, bool_or(p OR d) AS tells, quantile_cont(dur, 0.5) FILTER (WHERE dur > 1000) AS mid, quantile_cont(dur, 0.8) FILTER (WHERE dur > 1000) AS p80, max(dur) FILTER (WHERE dur > 1000) AS top, count(*) FILTER (WHERE dur > 1000) AS n FROM j GROUP BY pid)
 SELECT seq, CASE WHEN tells THEN CASE WHEN p THEN 1 WHEN d THEN 2 ELSE 3 END WHEN n >= 3 AND top > 3 * mid THEN CASE WHEN dur > p80 AND dur > 3 * mid THEN 1 ELSE 2 END ELSE 3 END AS type FROM j JOIN t USING (pid)""")
def G6_anchor_classification(spark, sf):
    rows = spans(spark, sf).withColumn("label", F.expr(_KINDS))
    marks = rows.where("name = 'purchase'").select("seq", "pid", "tid", "ts", "end_ts", F.when(F.col("seq") % 9 == 0, F.col("dur") * 20).otherwise(F.col("dur")).alias("dur"))
    names = cycles.owned(marks, rows.withColumn("cat", F.lit("python")).drop("name").withColumnRenamed("label", "name"), 3_600_000_000)
    return cycles.types(marks, names, ["pid"]).select("seq", "type")


@query(f"""WITH {SPANS}, a AS (SELECT tid, seq, ts FROM spans WHERE name = 'purchase'), j AS (SELECT s.tid, s.seq, s.ts, s.end_ts, s.name, a.seq AS owner FROM spans s ASOF LEFT JOIN a ON a.tid = s.tid AND a.ts <= s.ts), o AS (SELECT tid, min((ts, seq)) AS m FROM a GROUP BY tid),
 l AS (SELECT j.tid, j.name, row_number() OVER (PARTITION BY j.tid, j.owner ORDER BY j.ts, j.seq) AS k FROM j JOIN o ON o.tid = j.tid WHERE j.owner <> o.m[2]), n AS (SELECT DISTINCT tid, name FROM l WHERE k <= 5),
 b AS (SELECT j.*, o.m[2] AS first FROM j JOIN o ON o.tid = j.tid WHERE j.end_ts <= o.m[1]), g AS (SELECT b.tid, min(b.ts) AS begin_ FROM b JOIN n ON n.tid = b.tid AND n.name = b.name GROUP BY b.tid) SELECT b.tid, b.seq, b.first AS owner_seq FROM b JOIN g ON g.tid = b.tid WHERE b.ts >= g.begin_""")
def G5_starters(spark, sf):
    rows = spans(spark, sf)
    owner = interval.as_of(rows, rows.where("name = 'purchase'").select("tid", "ts", "seq"), ["tid"])
    flat = owner.select(F.col("tid").alias("key"), "tid", "seq", "ts", "end_ts", "name", F.lit(0).alias("depth"), F.col("match.seq").alias("owner_seq"), (F.col("name") == "purchase").alias("is_anchor"))
    return cycles.starters(flat, ["key"]).select(F.col("key").alias("tid"), "seq", "owner_seq")


@query(f"{_TREE}, j AS (SELECT r.*, x.dur, x.seq % 8 AS grp FROM r JOIN x ON x.seq = r.seq) SELECT name, CAST(count(*) FILTER (WHERE depth = 0) AS BIGINT) AS n, CAST(sum(dur) FILTER (WHERE depth = 0) AS BIGINT) AS total, round(avg(dur) FILTER (WHERE depth = 0), 4) AS mean, round(stddev_pop(dur) FILTER (WHERE depth = 0) / avg(dur) FILTER (WHERE depth = 0), 6) AS instability, round(avg(depth), 6) AS avg_depth, CAST(min(depth) AS INTEGER) AS min_depth, CAST(max(depth) AS INTEGER) AS max_depth, CAST(sum(dur) AS BIGINT) AS all_total, grp FROM j WHERE NOT rec GROUP BY grp, name HAVING count(*) FILTER (WHERE depth = 0) > 2")
def F3_F4_candidate_stats(spark, sf):
    tree = _joined(spark, sf).withColumn("grp", F.col("seq") % 8)
    return profile.candidates(tree, ["grp"]).withColumns({"mean": F.round("mean", 4), "instability": F.round("instability", 6), "avg_depth": F.round("avg_depth", 6)})


@query(f"{_RARE} SELECT c.pid, arg_max(c.name, (c.all_total, c.name)) AS prefill FROM c JOIN c m ON m.pid = c.pid AND m.name = 'view' WHERE c.name <> 'view' AND c.n <= m.n * 0.1 AND c.mean > 3 * m.mean GROUP BY c.pid")
def F5_prefill_anchor(spark, sf):
    rare = F.col("seq") % 100 >= 97
    tree = _joined(spark, sf).withColumn("pid", F.col("tid") % 8).withColumn("name", F.when(rare, F.concat(F.lit("rare"), (F.col("seq") % 2).cast("string"))).otherwise(F.col("name"))).withColumn("dur", F.when(rare, F.col("dur") * 10).otherwise(F.col("dur")))
    found = profile.candidates(tree, ["pid"])
    return profile.prefill_anchor(found, found.where("name = 'view'").select("pid", "name"), ["pid"])


@query(f"""{_TREE}, j AS (SELECT r.tid % 8 AS pid, r.depth, r.rec, CASE WHEN x.seq % 3 = 0 THEN 'Layer' || (x.seq % 5) ELSE r.name END AS name, x.dur FROM r JOIN x ON x.seq = r.seq),
 c AS (SELECT pid, name, count(*) FILTER (WHERE depth = 0) AS n, sum(dur) FILTER (WHERE depth = 0) AS total, avg(dur) FILTER (WHERE depth = 0) AS mean, stddev_pop(dur) FILTER (WHERE depth = 0) AS sd, avg(depth) AS avg_depth, min(depth) AS min_depth FROM j WHERE NOT rec GROUP BY pid, name HAVING count(*) FILTER (WHERE depth = 0) > 2)
 SELECT pid, name AS anchor, CAST(min_depth AS INTEGER) AS min_depth FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY min_depth, avg_depth, mean DESC, sd / mean, total DESC, name) AS r FROM c WHERE lower(name) LIKE '%layer%') WHERE r = 1""")
def F41_anchor_choice(spark, sf):
    tree = _joined(spark, sf).withColumn("pid", F.col("tid") % 8).withColumn("name", F.when(F.col("seq") % 3 == 0, F.concat(F.lit("Layer"), (F.col("seq") % 5).cast("string"))).otherwise(F.col("name")))
    return profile.layer_anchor(profile.candidates(tree, ["pid"]), ["pid"])


@query(f"""{_TREE}, l AS (SELECT r.tid, depth, CAST(count(*) AS BIGINT) AS n, CAST(sum(x.dur) AS BIGINT) AS total FROM r JOIN x ON x.seq = r.seq GROUP BY ALL), o AS (SELECT *, COALESCE(lead(depth) OVER w = depth + 1 AND total > 0 AND lead(total) OVER w > 0.9 * total, FALSE) AS gone FROM l WINDOW w AS (PARTITION BY tid ORDER BY depth))
 SELECT tid, CAST(depth AS INTEGER) AS depth, n, total, round(total / lag(total) OVER (PARTITION BY tid ORDER BY depth), 6) AS of_previous FROM o WHERE NOT gone""")
def F12_G21_levels(spark, sf):
    return profile.levels(_joined(spark, sf), ["tid"]).withColumn("of_previous", F.round("of_previous", 6))


@query(f"{_EDGES} SELECT caller, callee, n FROM e")
def F15_call_edges(spark, sf):
    return profile.call_edges(_joined(spark, sf), ["tid"])


@query(f"""{_EDGES}, t AS (SELECT row_number() OVER (ORDER BY n DESC, caller, callee) AS line, '  "' || caller || '" -> "' || callee || '" [label=' || n || '];' AS text FROM e) SELECT CAST(line AS BIGINT) AS line, text FROM t UNION ALL SELECT 0, 'digraph calls {{' UNION ALL SELECT count(*) + 1, '}}' FROM t""")
def B7_call_graph(spark, sf):
    lines = sinks.dot(profile.call_edges(_joined(spark, sf), ["tid"])).split("\n")
    return spark.createDataFrame(list(enumerate(lines)), "line long, text string")


@query(f"{_TREE}, m AS (SELECT *, min(depth) OVER (PARTITION BY tid, name) AS least FROM r WHERE name LIKE '%view%' OR name LIKE '%cli%') SELECT tid, seq FROM m WHERE depth = least")
def G15_named_operators(spark, sf):
    return nest.named_operators(_joined(spark, sf), ["tid"], ["view", "cli"])


@query()
def G20_cross_language(spark, sf):
    rows = _spans(spark, sf).withColumn("pid", F.lit(1)).withColumn("corr", F.when(F.col("name") == "click", F.col("seq") % 50))
    work = samples(spark, sf).select(F.lit(1).alias("pid"), F.col("seq").cast("long").alias("seq"), "name", F.col("value").alias("dur"), F.col("value").cast("long").alias("corr"))
    return nest.hierarchy(nest.cross_language(rows, work.where("corr < 50")).where("tid is not null"), ["tid"])


@query()
def H9_H14_found_periods(spark, sf):
    return periods.found(_ticks(spark, sf), align=True).select("pid", F.round("start_ts").alias("start_ts"), F.round("end_ts").alias("end_ts"), "type")


@query(f"""{_TREE}, j AS (SELECT r.*, x.ts, r.name || CASE WHEN r.seq % 2 = 0 THEN 'Layer.f' || (r.seq % 3) ELSE '.layer' END AS label FROM r JOIN x ON x.seq = r.seq), c AS (SELECT *, min(depth) OVER (PARTITION BY tid) AS least FROM j WHERE lower(split_part(label, '.', 1)) LIKE '%layer%'),
 n AS (SELECT tid, label, row_number() OVER (PARTITION BY tid ORDER BY count(*) DESC, min((ts, seq))) AS r FROM c WHERE depth = least GROUP BY tid, label) SELECT c.tid, c.seq, c.label AS name FROM c JOIN n ON n.tid = c.tid AND n.label = c.label AND n.r = 1 WHERE c.depth = c.least""")
def G14_layers(spark, sf):
    tree = _joined(spark, sf, "ts").withColumn("name", F.concat("name", F.when(F.col("seq") % 2 == 0, F.concat(F.lit("Layer.f"), (F.col("seq") % 3).cast("string"))).otherwise(".layer")))
    return cycles.layers(tree.select("tid", "seq", "ts", "name", "depth"), ["tid"]).select("tid", "seq", "name")


@query(f"{_TREE}, m AS (SELECT owner, max(cycle) AS cycle FROM (SELECT seq AS owner, seq % 50 AS cycle FROM f WHERE name = 'purchase' AND seq % 4 > 0 UNION ALL SELECT seq, seq % 70 FROM f WHERE name = 'purchase' AND seq % 4 = 1) GROUP BY owner) SELECT r.seq, m.cycle FROM r LEFT JOIN m ON m.owner = r.owner WHERE r.name <> 'click'")
def E25_owner_cycle(spark, sf):
    rows = _spans(spark, sf)
    tree = nest.nested(rows, ["tid"], F.col("name") == "purchase").select("seq", "owner_seq").join(rows.select("seq", F.when(F.col("name") == "click", "Kernel").otherwise("python").alias("cat")), "seq")
    marks = rows.where("name = 'purchase'")
    members = marks.where("seq % 4 > 0").select((F.col("seq") % 50).alias("cycle"), "seq").unionByName(marks.where("seq % 4 = 1").select((F.col("seq") % 70).alias("cycle"), "seq"))
    return cycles.owned_cycles(tree, members.withColumn("start_ts", F.col("cycle"))).select("seq", "cycle")
