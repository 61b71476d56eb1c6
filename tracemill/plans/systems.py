"""Queries over sources, sinks, logs, models and streams (A, B, K, L, M)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import compare, cycles, detect, folds, learn, metrics
from ..operators.lineage import checkpoint, shared_folder
from ..sources import logs, sinks
from ..sources import trace as sources
from ..streaming import monitors
from . import workflow
from .registry import SPANS, TRACE, query, samples, spans, table, trace


def scratch(spark) -> str:
    """A new folder that all executors see."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"

_MOMENTS = f"""{SPANS}, e AS (SELECT seq, seq % 50 AS cycle, CASE name WHEN 'view' THEN 'oncpu' ELSE 'gpu_compute' END AS func_type, name, pid, tid AS device, ts, end_ts, dur FROM spans), c AS (SELECT CASE name WHEN 'error' THEN 'process_cpu_usage' ELSE 'gpu_usage' END AS metric, CASE name WHEN 'error' THEN pid ELSE -1 END AS instance, ts, value / 100 AS v FROM samples),
 s AS (SELECT DISTINCT metric, instance FROM c), w AS (SELECT e.*, s.metric, s.instance FROM e JOIN s ON (e.func_type = 'oncpu' AND s.metric = 'process_cpu_usage' AND s.instance = e.pid) OR (e.func_type = 'gpu_compute' AND s.metric = 'gpu_usage' AND s.instance = -1)),
 i AS (SELECT w.seq, count(*) AS n, avg(v) AS m, stddev_pop(v) AS s FROM w JOIN c ON c.metric = w.metric AND c.instance = w.instance AND c.ts BETWEEN w.ts AND w.end_ts GROUP BY w.seq),
 q AS (SELECT seq, metric, instance, unnest([ts, end_ts]) AS ts FROM w), b AS (SELECT q.*, c.ts AS t0, c.v AS v0 FROM q ASOF LEFT JOIN c ON c.metric = q.metric AND c.instance = q.instance AND q.ts >= c.ts), a AS (SELECT b.*, c.ts AS t1, c.v AS v1 FROM b ASOF LEFT JOIN c ON c.metric = b.metric AND c.instance = b.instance AND b.ts <= c.ts),
 x AS (SELECT seq, avg(y) AS m, stddev_pop(y) AS s FROM (SELECT seq, CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL OR t0 = ts OR t1 = t0 THEN v0 ELSE v0 + (v1 - v0) * (ts - t0) / (t1 - t0) END AS y FROM a) GROUP BY seq),
 r AS (SELECT w.*, COALESCE(i.n >= 3, FALSE) AS real, CASE WHEN i.n >= 3 THEN i.m ELSE x.m END AS m, CASE WHEN i.n >= 3 THEN i.s ELSE x.s END AS s FROM w LEFT JOIN i USING (seq) LEFT JOIN x USING (seq)),
 o AS (SELECT cycle, func_type, name, pid, device, metric, 100 * sum(m * dur) / nullif(sum(dur), 0) AS mu, 100 * sqrt(sum(s * s * dur) / nullif(sum(dur), 0)) AS sigma, CAST(count(*) FILTER (WHERE real) AS BIGINT) AS real, CAST(count(*) FILTER (WHERE NOT real) AS BIGINT) AS interpolated FROM r GROUP BY ALL)"""

_LOGS = """e AS (SELECT event_id AS e, event_id // 3 % 3 AS turn, event_id % 3 AS f FROM events),
 sg AS (SELECT e, turn FROM e WHERE f = 0), vl AS (SELECT e, turn FROM e WHERE f = 1),
 scheduled AS (SELECT e, e // 18 AS set_, lag(e // 18) OVER (ORDER BY e) AS was FROM vl WHERE turn = 1),
 items AS (SELECT 'f0' AS path, 'sglang' AS framework, 'model_name' AS item, 'name' || max(e) AS value FROM sg WHERE turn = 2 UNION ALL SELECT 'f0', 'sglang', 'tp_size', '4' UNION ALL SELECT 'f0', 'sglang', 'precision', 'BFLOAT16' UNION ALL SELECT 'f0', 'sglang', 'startup', '{"model_path":"/m/name' || max(e) || '","tp_size":4,"dtype":"bfloat16"}' FROM sg WHERE turn = 2
 UNION ALL SELECT 'f0', 'sglang', 'batch_sizes', string_agg(e % 7 + 1, ',' ORDER BY e) FROM sg WHERE turn = 0 UNION ALL SELECT 'f0', 'sglang', 'input_lengths', (SELECT string_agg(n, ',' ORDER BY n) FROM (SELECT DISTINCT n FROM (SELECT arg_min(e % 4 + 1, e) AS n FROM sg WHERE turn = 1 GROUP BY e % 5)))
 UNION ALL SELECT 'f1', 'vllm', 'model_name', 'big' UNION ALL SELECT 'f1', 'vllm', 'precision', 'FLOAT16' UNION ALL SELECT 'f1', 'vllm', 'model_layers', CAST(max(e) AS VARCHAR) FROM vl WHERE turn = 2 UNION ALL SELECT 'f1', 'vllm', 'max_length', '4096'
 UNION ALL SELECT 'f1', 'vllm', 'batch_sizes', (SELECT string_agg(n, ',' ORDER BY e) FROM (SELECT e, 1 AS n FROM vl WHERE turn = 0 UNION ALL SELECT e, 2 FROM scheduled WHERE was IS NULL OR was <> set_)) UNION ALL SELECT 'f1', 'vllm', 'input_lengths', (SELECT string_agg(n, ',' ORDER BY n) FROM (SELECT DISTINCT n FROM (SELECT arg_min(e % 3 + 1, e) AS n FROM vl WHERE turn = 0 GROUP BY e % 6)))
 UNION ALL SELECT 'f2', 'generic', 'model_layers', CAST(max(e) AS VARCHAR) FROM e WHERE f = 2)"""


def _events(spark, sf):
    t = trace(spark, sf)
    return t.select("seq", "name", F.when(F.col("ph") == "X", "python").otherwise("CAT_CPU").alias("cat"), "ph", F.col("pid"), F.concat(F.lit("host"), (F.col("pid") % 2).cast("string"), F.lit("("), F.col("pid").cast("string"), F.lit(")")).alias("original_pid"), F.col("tid").cast("string").alias("tid"), F.col("ts").cast("double").alias("ts"), F.col("dur").cast("double").alias("dur"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("bp"), F.create_map(F.lit("value"), F.col("k").cast("string")).alias("args"))


_READ = "pid, 'host' || (pid % 2) AS host, CAST(tid AS VARCHAR) AS tid, name, CAST(count(*) AS BIGINT) AS n, CAST(sum(ts) AS BIGINT) AS ts, CAST(sum(CASE WHEN ph = 'X' THEN dur ELSE 0 END) AS BIGINT) AS dur, CAST(sum(k) AS BIGINT) AS value"


def _digest(rows):
    return rows.groupBy("pid", "host", "tid", "name").agg(F.count("*").alias("n"), F.sum(F.col("ts").cast("bigint")).alias("ts"), F.sum(F.col("dur").cast("bigint")).alias("dur"), F.sum(F.col("args")["value"].cast("bigint")).alias("value"))


@query(f"WITH {TRACE} SELECT {_READ} FROM trace GROUP BY pid, tid, name")
def A1_B3_B6_trace_round_trip(spark, sf):
    path = scratch(spark)
    sinks.write_trace(_events(spark, sf), path)
    return _digest(sources.read_json_lines(spark, path))


@query(f"WITH {TRACE} SELECT {_READ} FROM trace GROUP BY pid, tid, name")
def A1_whole_trace_files(spark, sf):
    path = scratch(spark)
    rows = sinks.trace_json(_events(spark, sf)).drop("cycle")
    one = F.to_json(F.struct(*rows.columns))
    files = rows.groupBy("pid").agg(F.concat(F.lit('{"traceEvents": [5, '), F.array_join(F.collect_list(one), ","), F.lit("]}")).alias("value"))  # a file for each pid, with an entry that is none
    files.repartition(8, "pid").sortWithinPartitions("pid").select("value").write.option("lineSep", " ").text(f"{path}/t")
    texts = spark.read.text(f"{path}/t", wholetext=True).select(F.explode(F.split("value", r'(?<=\]\}) (?=\{"traceEvents)')).alias("value"))
    texts.repartition(16).write.option("maxRecordsPerFile", 1).text(f"{path}/u")
    return _digest(sources.read_json(spark, f"{path}/u", "part-*"))


@query(f"WITH {TRACE} SELECT pid, name, ph, CAST(count(*) AS BIGINT) AS n, CAST(sum(k) AS BIGINT) AS value FROM trace GROUP BY pid, name, ph")
def A2_csv_pair(spark, sf):
    path, e = scratch(spark), _events(spark, sf)
    e.where("ph = 'X'").select("name", "cat", "ph", "original_pid", "tid", "ts", "dur", F.to_json("args").alias("args")).withColumnRenamed("original_pid", "pid").write.option("header", True).option("escape", '"').csv(f"{path}/micro")
    e.where("ph = 'C'").select("name", F.col("args")["value"].alias("value"), F.col("ts").alias("timestamp"), F.col("cat").alias("category"), F.lit("CAT_HOST").alias("loc1_type"), F.lit("h").alias("loc1"), F.lit("CAT_PROCESS").alias("loc2_type"), F.col("pid").alias("loc2")).write.option("header", True).csv(f"{path}/macro")
    rows = sources.read_csv_pair(spark, f"{path}/micro", f"{path}/macro")
    return rows.groupBy("pid", "name", "ph").agg(F.count("*").alias("n"), F.sum(F.col("args")["value"].cast("bigint")).alias("value"))


@query("SELECT 'job' || (l_linenumber % 3) AS job_name, CAST(count(*) AS BIGINT) AS n, CAST(sum(l_quantity) AS DOUBLE) AS total FROM lineitem WHERE l_linenumber % 3 <> 2 GROUP BY 1 UNION ALL SELECT 'job2', CAST(count(*) AS BIGINT), CAST(sum(l_quantity) * 2 AS DOUBLE) FROM lineitem WHERE l_linenumber % 3 = 2")
def B5_B8_A10_features(spark, sf):
    path = scratch(spark)
    l = table(spark, sf, "lineitem").select(F.concat(F.lit("job"), (F.col("l_linenumber") % 3).cast("string")).alias("job_name"), F.col("l_orderkey").alias("start_ts"), F.col("l_quantity").alias("q"))
    sinks.write_features(l, path)
    sinks.write_features(l.where("job_name = 'job2'").withColumn("q", F.col("q") * 2), path)  # one job again, the others stay
    return sources.read_features(spark, path, ["job_name", "start_ts", "q"]).groupBy("job_name").agg(F.count("*").alias("n"), F.sum("q").alias("total"))


@query("SELECT DISTINCT l_orderkey % 97 AS job FROM lineitem WHERE l_orderkey % 97 NOT IN (SELECT o_custkey % 90 FROM orders)")
def B8_M4_unfinished(spark, sf):
    jobs = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 97).alias("job")).distinct()
    return sinks.unfinished(jobs, table(spark, sf, "orders").select((F.col("o_custkey") % 90).alias("job")), "job")


def _log_lines(spark, sf):
    e = F.col("event_id")
    line = F.concat(F.lit('{"kunlunClassAttr": {"class": "Scheduler", "fn": "'), F.when(e % 2 == 0, "run_batch").otherwise("process_batch_result"), F.lit('", "attr": "reqs"}, "Value": "forward_mode=DECODE rid=a1 input_ids=[1, 2] output_ids=[3]", "start_time": '), F.floor(e / 2).cast("string"), F.lit("}"))
    return table(spark, sf, "events").select(F.lit("log").alias("path"), e.alias("line_no"), line.alias("line"))


@query("SELECT CAST(event_id // 2 AS DOUBLE) AS ts, 'Scheduler.run_batch' AS name, CAST(count(*) AS INTEGER) AS n_lines, 'DECODE' AS mode, CAST(1 AS INTEGER) AS n_requests FROM events GROUP BY event_id // 2 HAVING min(event_id) % 2 = 0 UNION ALL SELECT CAST(event_id // 2 AS DOUBLE), 'Scheduler.process_batch_result', CAST(count(*) AS INTEGER), 'DECODE', 1 FROM events GROUP BY event_id // 2 HAVING min(event_id) % 2 = 1")
def A8_parameter_log(spark, sf):
    return logs.parameters(_log_lines(spark, sf)).select("ts", "name", F.size("lines").alias("n_lines"), F.col("params.forward_mode").alias("mode"), F.size("params.rids").alias("n_requests"))


@query("SELECT CAST(event_id // 2 AS DOUBLE) AS ts FROM events GROUP BY event_id // 2 HAVING event_id // 2 >= 100 OR (event_id // 2) % 200 = 100")
def B9_log_compaction(spark, sf):
    entries = logs.parameters(_log_lines(spark, sf)).select("path", "ts")
    return logs.compacted(entries, entries.where("ts % 200 = 100")).select("ts")


@query("""SELECT 'f' || (event_id % 5) AS path, x.item, CASE x.item WHEN 'model_layers' THEN CAST(max(event_id) AS VARCHAR) WHEN 'precision' THEN 'BF16' WHEN 'tp_size' THEN '4' END AS value FROM events, (SELECT unnest(['model_layers', 'precision', 'tp_size']) AS item) x GROUP BY 1, 2""")
def K3_log_rules(spark, sf):
    e = F.col("event_id")
    line = F.concat(F.lit("config 'num_hidden_layers': "), e.cast("string"), F.lit(" 'torch_dtype': 'torch.bfloat16' 'tp_size': 4"))
    keyed = F.concat(F.lit('{"a": [{"num_hidden_layers": '), e.cast("string"), F.lit(', "torch_dtype": "bfloat16", "tp_size": 4}]}'))
    lines = table(spark, sf, "events").select(F.concat(F.lit("f"), (e % 5).cast("string")).alias("path"), e.alias("line_no"), F.when(e % 2 == 0, line).otherwise(keyed).alias("line"))
    return logs.extract(lines).where("item in ('model_layers', 'precision', 'tp_size')")


@query("SELECT 'log' AS path, md5(CAST(event_id % 50 AS VARCHAR)) AS request, CAST(arg_min(event_id % 3 + 1, event_id) AS INTEGER) AS length FROM events GROUP BY 1, 2")
def K1_K2_request_lengths(spark, sf):
    e = F.col("event_id")
    line = F.concat(F.lit('"attr":"reqs" [Req(rid='), F.md5((e % 50).cast("string")), F.lit(", input_ids=["), F.array_join(F.sequence(F.lit(0), (e % 3).cast("int")), ", "), F.lit("])]"))
    return logs.request_lengths(table(spark, sf, "events").select(F.lit("log").alias("path"), e.alias("line_no"), line.alias("line")))


@query("WITH e AS (SELECT event_id AS e, event_id % 2 AS ids, 'r' || (event_id // 4) AS r FROM events), p AS (SELECT r, e FROM e WHERE ids = 0 AND e + 1 IN (SELECT e FROM e)) SELECT 'log' AS path, r AS request, CAST(arg_min((e + 1) % 5 + 1, e) AS INTEGER) AS length FROM p GROUP BY r")
def K2_pending_lengths(spark, sf):
    e = F.col("event_id")
    line = F.when(e % 2 == 0, F.concat(F.lit('{"attr":"request_id", "Value": "r'), F.expr("event_id div 4").cast("string"), F.lit('"}'))).otherwise(F.concat(F.lit('{"attr":"prompt_token_ids", "Value": ['), F.array_join(F.sequence(F.lit(0), (e % 5).cast("int")), ", "), F.lit("]}")))
    return logs.pending_lengths(table(spark, sf, "events").select(F.lit("log").alias("path"), e.alias("line_no"), line.alias("line")))


def _metric_rows(spark, sf):
    e = spans(spark, sf).select((F.col("seq") % 50).alias("cycle"), "seq", F.when(F.col("name") == "view", "oncpu").otherwise("gpu_compute").alias("func_type"), "name", "pid", F.col("tid").cast("int").alias("device"), "ts", "end_ts", "dur").withColumn("cycle_dur", F.lit(1e12))
    c = samples(spark, sf).select(F.when(F.col("name") == "error", "process_cpu_usage").otherwise("gpu_usage").alias("metric"), F.when(F.col("name") == "error", F.col("pid")).otherwise(F.lit(-1)).alias("instance"), "ts", "value", F.lit(100.0).alias("factor"), "seq")
    return e, c


def _features(spark, sf):
    l = table(spark, sf, "lineitem")
    return l.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x1"), F.col("l_discount").alias("x2"), F.col("l_tax").alias("x3"), (F.col("l_linenumber") % 2 + 1).alias("mode"), F.col("l_extendedprice").alias("y"))


@query()
def L2_L3_ridge(spark, sf):
    rows = detect.group_split(_features(spark, sf), ["l_orderkey"])
    models = learn.trained(rows.where("is_train"), ["x1", "x2", "x3"], "y", "ridge", log=True, mode="mode", degree=2)
    return learn.predicted(rows, models, True, "mode").select("l_orderkey", "l_linenumber", "is_train", F.round("predicted", 2).alias("predicted"))


@query()
def L1_boosted_trees(spark, sf):
    rows = detect.group_split(_features(spark, sf), ["l_orderkey"])
    models = learn.trained(rows.where("is_train"), ["x1", "x2", "x3"], "y", "boosted")
    return learn.predicted(rows, models).select("l_orderkey", "l_linenumber", "is_train", F.round("predicted", 2).alias("predicted"))


@query()
def L4_L8_L9_experiments(spark, sf):
    rows = _features(spark, sf)
    grid = learn.grid(kinds=("ridge",), splits=("group",), iqr=(3.0,))
    limits = learn.bounds(rows, ["x1"], "y", grid)
    results = [learn.experiment(rows, ["x1", "x2", "x3"], "y", ["x1"], c, limits, ("r2",)) for c in grid]
    best = learn.champion(results)
    return spark.createDataFrame([(r["log"], r["mode"] or "unified", float(r["r2"]), r is best) for r in results], "log boolean, mode string, r2 double, champion boolean")


@query(f"""WITH {_MOMENTS}, bt AS (SELECT cycle, func_type, name, pid, device, CAST(count(*) AS BIGINT) AS n, CAST(sum(dur) AS BIGINT) AS total, round(100.0 * sum(dur) / 1e12, 6) AS beta_pct FROM e GROUP BY ALL)
 SELECT bt.*, COALESCE(o.metric, 'N/A') AS metric, round(mu, 4) AS mu_pct, round(sigma, 4) AS sigma_pct, real, interpolated FROM bt LEFT JOIN o USING (cycle, func_type, name, pid, device)""")
def F7_E9_cycle_metrics(spark, sf):
    out = metrics.perf_table(*_metric_rows(spark, sf), 3_600_000_000)
    return out.withColumns({"mu_pct": F.round("mu_pct", 4), "sigma_pct": F.round("sigma_pct", 4), "beta_pct": F.round("beta_pct", 6)})


def _stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return monitors.source(spark, sf, "events.parquet", schema) if not sf.startswith("viewfs") else None


def _stamped(spark, sf):
    return _stream(spark, sf).select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), "event_type", "user_id", "value")


@query("SELECT user_id % 8 AS pid, epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS start_us, CAST(count(*) AS BIGINT) AS n, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high FROM events GROUP BY 1, 2")
def M5_resampled_stream(spark, sf):
    rows = _stamped(spark, sf).withColumn("pid", F.col("user_id") % 8)
    out = monitors.drained(monitors.resampled(rows, "ts", ["pid"], "value", "1 day"), scratch(spark), "complete")
    return out.select("pid", F.unix_micros("start").alias("start_us"), "n", F.round("mean", 6).alias("mean"), "low", "high")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS f FROM events), s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
 SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 21600000000 AS end_us, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id, s""")
def M2_session_stream(spark, sf):
    out = monitors.drained(monitors.idle_sessions(_stamped(spark, sf), "ts", ["user_id"], "6 hours"), scratch(spark), "complete")
    return out.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query("SELECT a.event_id AS a_seq, b.event_id AS b_seq FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'purchase' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 2 HOUR")
def M6_correlated_streams(spark, sf):
    a, b = _stamped(spark, sf).where("event_type = 'view'"), _stamped(spark, sf).where("event_type = 'purchase'")
    return monitors.drained(monitors.correlated(a, b, "user_id", "2 HOURS"), scratch(spark)).select("a_seq", "b_seq")


@query("SELECT event_id AS seq, round(CASE WHEN count(*) OVER w = 10 THEN avg(value) OVER w END, 4) AS rolling FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)")
def M1_alarm_stream(spark, sf):
    out = monitors.drained(monitors.alarms(_stamped(spark, sf).withColumnRenamed("value", "error"), "user_id", 300.0), scratch(spark))
    return out.select("seq", F.round("rolling", 4).alias("rolling"))


@query("""WITH e AS (SELECT user_id, epoch_us(ts) AS ts, event_type = 'purchase' AS done, CASE event_type WHEN 'view' THEN 1 ELSE 2 END AS mode FROM events WHERE event_type IN ('view', 'click', 'purchase')), w AS (SELECT (max(ts) // 1000 - 3600000) AS mark FROM e),
 p AS (SELECT *, lag(ts) OVER o AS was, lag(mode) OVER o AS was_mode, lag(done) OVER o AS was_done, lead(ts) OVER o IS NULL AS last FROM e WINDOW o AS (PARTITION BY user_id ORDER BY ts))
 SELECT user_id, 'batch' AS kind, was AS start_us, ts AS end_us FROM p WHERE NOT was_done AND (done OR was_mode <> mode) UNION ALL SELECT user_id, 'prefill', ts, mark * 1000 FROM p, w WHERE last AND NOT done AND ts // 1000 + 3600000 < mark""")
def M3_cycle_stream(spark, sf):
    rows = _stamped(spark, sf).where("event_type in ('view', 'click', 'purchase')").withColumn("kind", F.when(F.col("event_type") == "purchase", "result").otherwise("run")).withColumn("mode", F.when(F.col("event_type") == "view", 1).otherwise(2))
    return monitors.drained(monitors.batch_cycles(rows, "user_id"), scratch(spark))


@query("""WITH u AS (SELECT event_id AS seq, user_id % 4 AS host, user_id AS pid, event_id % 8 AS logical FROM events), i AS (SELECT s_nationkey % 4 AS host, s_suppkey AS pid, s_nationkey % 8 AS logical, s_suppkey * 10 AS physical FROM supplier)
 SELECT seq, (SELECT max(physical) FROM i WHERE i.host = u.host AND i.pid = u.pid AND i.logical = u.logical) AS physical FROM u""")
def E13_physical_gpus(spark, sf):
    from ..operators import topology

    u = table(spark, sf, "events").select(F.col("event_id").alias("seq"), (F.col("user_id") % 4).alias("host"), F.col("user_id").alias("pid"), (F.col("event_id") % 8).alias("logical"))
    i = table(spark, sf, "supplier").select((F.col("s_nationkey") % 4).alias("host"), F.col("s_suppkey").alias("pid"), (F.col("s_nationkey") % 8).alias("logical"), (F.col("s_suppkey") * 10).alias("physical"))
    return topology.physical_gpus(u, i).select("seq", "physical")


@query("SELECT 'f' || (event_id % 3) AS path, CASE event_id % 3 WHEN 0 THEN 'sglang' WHEN 1 THEN 'vllm' ELSE 'generic' END AS framework FROM events GROUP BY 1, 2")
def A11_framework(spark, sf):
    return logs.framework(_dialect_lines(spark, sf))


@query("SELECT event_id, 'f' || (user_id % 5) || 'x(int)' AS name FROM events")
def C14_demangled(spark, sf):
    from ..functions.demangle import demangled

    return demangled(table(spark, sf, "events").select("event_id", F.concat(F.lit("_Z3f"), (F.col("user_id") % 5).cast("string"), F.lit("xi")).alias("name")))


@query(f"WITH {TRACE} SELECT {_READ} FROM trace GROUP BY pid, tid, name")
def A1_trace_rows(spark, sf):
    path = scratch(spark)
    rows = sinks.trace_json(_events(spark, sf)).drop("cycle")
    one, turn = F.to_json(F.struct(*rows.columns)), F.pmod(F.xxhash64("ts", "name", "pid"), F.lit(4))
    # as tracers write them: brackets and commas around, on lines of their own or with an event
    line = F.when(turn == 0, F.concat(F.lit('{"traceEvents": ['), one, F.lit(","))).when(turn == 1, F.concat(F.lit("  "), one, F.lit(" ,"))).when(turn == 2, F.concat(F.lit(","), one)).otherwise(F.concat(one, F.lit("]}")))
    rows.select(line.alias("value")).unionByName(spark.createDataFrame([("[",), ("]",), ("",)], "value string")).write.text(f"{path}/t")
    return _digest(sources.read_json_rows(spark, f"{path}/t", "part-*"))


def _put(spark, path: str, data: bytes = b"[]") -> None:
    """A small file in whatever file system the path names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(data))
    out.close()


@query("SELECT n_regionkey AS pid, CAST(count(*) AS BIGINT) AS n, CAST(sum(n_nationkey) AS BIGINT) AS ts FROM nation GROUP BY 1 UNION ALL SELECT n_regionkey + 100, CAST(count(*) AS BIGINT), CAST(sum(n_nationkey) AS BIGINT) FROM nation GROUP BY 1")
def A3_A4_jobs(spark, sf):
    root, rows = scratch(spark), table(spark, sf, "nation").select("n_nationkey", "n_regionkey").collect()
    event = '{{"name": "f", "ph": "X", "cat": "python", "pid": {}, "tid": "t", "ts": {}, "dur": 1}}'.format
    _put(spark, f"{root}/a/x.json", ("[" + ",".join(event(r.n_regionkey, r.n_nationkey) for r in rows) + "]").encode())
    _put(spark, f"{root}/c/micro_event.csv", "\n".join(["name,cat,ph,pid,tid,ts,dur,args", *(f"f,python,X,{r.n_regionkey + 100},t,{r.n_nationkey},1," for r in rows)]).encode())
    _put(spark, f"{root}/c/macro_counter.csv", b"name,value,timestamp,category\n")
    _put(spark, f"{root}/d/micro_event.csv", b"name,cat,ph,pid,tid,ts,dur,args\nlost,python,X,1,t,1,1,")  # without counters: no job
    jobs = sources.find_jobs(spark, root) + sources.find_jobs(spark, root, csv=True)
    out = None
    for job in jobs:
        part = sources.load_events(spark, job).select("pid", "ts")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("pid").agg(F.count("*").alias("n"), F.sum(F.col("ts").cast("bigint")).alias("ts"))


@query("SELECT * FROM (VALUES ('A5', 'case1/normal', 'case1/abnormal'), ('A6', 'job1/result.json.gz', 'job1/model_config.txt'), ('A6', 'job3/result.json.gz', 'job3/model_config.txt'), ('A6 root', 'result.json.gz', 'model_config.txt'), ('A7', 'a', ''), ('A7', 'b', '')) t(what, one, other)")
def A5_A6_A7_discovery(spark, sf):
    root = scratch(spark)
    for name in ("case1/normal/t.json", "case1/abnormal/t.json", "case2/normal/t.json"):
        _put(spark, f"{root}/cases/{name}")
    for name in ("job1/result.json.gz", "job1/model_config.txt", "job2/result.json.gz", "job3/result.json.gz", "job3/model_config.txt", "result.json.gz", "model_config.txt"):
        _put(spark, f"{root}/jobs/{name}")
    for name in ("result.json.gz", "model_config.txt"):
        _put(spark, f"{root}/single/{name}")
    for name in ("x/a_perf_data.csv", "x/y/b_perf_data.csv", "x/other.csv"):
        _put(spark, f"{root}/perf/{name}")
    cut = lambda c, part: F.regexp_replace(c, f"^.*/{part}/", "")
    rows = sources.find_case_pairs(spark, f"{root}/cases").select(F.lit("A5").alias("what"), cut("normal", "cases").alias("one"), cut("abnormal", "cases").alias("other"))
    rows = rows.unionByName(sources.find_log_pairs(spark, f"{root}/jobs").select(F.lit("A6").alias("what"), cut("trace", "jobs").alias("one"), cut("log", "jobs").alias("other")))
    rows = rows.unionByName(sources.find_log_pairs(spark, f"{root}/single").select(F.lit("A6 root").alias("what"), cut("trace", "single").alias("one"), cut("log", "single").alias("other")))
    return rows.unionByName(sources.find_perf_tables(spark, f"{root}/perf").select(F.lit("A7").alias("what"), F.col("stem").alias("one"), F.lit("").alias("other")))


@query("SELECT CAST(l_orderkey AS VARCHAR) AS cycle, CAST(l_suppkey AS VARCHAR) AS pid, printf('%.4f', l_extendedprice) AS beta_pct, 'm' || l_linenumber AS metric_name FROM lineitem")
def B1_perf_csv(spark, sf):
    path = scratch(spark)
    sinks.write_perf(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("cycle"), F.col("l_suppkey").alias("pid"), F.col("l_extendedprice").alias("beta_pct"), F.concat(F.lit("m"), F.col("l_linenumber").cast("string")).alias("metric_name")), path)
    return spark.read.option("header", True).csv(path)


@query(f"WITH {SPANS} SELECT DISTINCT name AS counter_name, CAST(ts AS VARCHAR) AS timestamp, printf('%.6f', value) AS value, 'h' || pid AS hostname FROM samples")
def B1_counter_csv(spark, sf):
    path = scratch(spark)
    s = samples(spark, sf).select(F.col("name").alias("counter_name"), F.col("ts").alias("timestamp"), "value", F.concat(F.lit("h"), F.col("pid").cast("string")).alias("hostname"))
    sinks.write_counters(s.unionByName(s.where("value > 50")), path)
    return spark.read.option("header", True).csv(path)


@query(f"WITH {TRACE} SELECT CAST(tid % 5 AS INTEGER) AS cycle, name, CAST(count(*) AS BIGINT) AS n, CAST(sum(k) AS BIGINT) AS value FROM trace GROUP BY ALL")
def B2_cycle_files(spark, sf):
    path = scratch(spark)
    sinks.write_cycles(_events(spark, sf).withColumn("cycle", F.col("tid").cast("int") % 5), path)
    rows = spark.read.schema("name string, args map<string,string>, cycle int").json(path)
    return rows.groupBy("cycle", "name").agg(F.count("*").alias("n"), F.sum(F.col("args")["value"].cast("bigint")).alias("value"))


@query(f"WITH {SPANS} SELECT ts AS start_ts, end_ts, CAST(1 AS BIGINT) AS count, CAST(1 + seq % 3 AS BIGINT) AS type FROM spans")
def B4_period_file(spark, sf):
    path = scratch(spark)
    sinks.write_periods(spans(spark, sf).select(F.col("ts").alias("start_ts"), "end_ts", F.lit(1).alias("count"), (1 + F.col("seq") % 3).alias("type")), path)
    return spark.read.schema("start_ts long, end_ts long, count long, type long").json(path)


@query("SELECT n_name AS model, CAST(n_nationkey * 3 % 25 AS VARCHAR) AS r2, CAST(row_number() OVER (ORDER BY n_nationkey * 3 % 25 DESC) - 1 AS BIGINT) AS place FROM nation")
def B10_summary_file(spark, sf):
    path = scratch(spark)
    sinks.write_summary(table(spark, sf, "nation").select(F.col("n_name").alias("model"), (F.col("n_nationkey") * 3 % 25).alias("r2")), path)
    return spark.read.option("header", True).csv(path).coalesce(1).withColumn("place", F.monotonically_increasing_id())


def _dialect_lines(spark, sf):
    e, turn, f = F.col("event_id"), F.expr("event_id div 3 % 3"), F.col("event_id") % 3
    text, join = lambda c: c.cast("string"), F.concat
    ids = lambda n: F.array_join(F.sequence(F.lit(1), n.cast("int")), ", ")
    sglang = (
        F.when(turn == 0, join(F.lit('{"kunlunClassAttr": {"module": "sglang.srt.batch", "attr": "batch_size"}, "Value": '), text(e % 7 + 1), F.lit("}")))
        .when(turn == 1, join(F.lit('{"kunlunClassAttr": {"module": "sglang.srt", "attr":"reqs"}, "Value": [Req(rid='), F.md5(text(e % 5)), F.lit(", input_ids=["), ids(e % 4 + 1), F.lit("])]}")))
        .otherwise(join(F.lit('{"kunlunClassAttr": {"module": "sglang.srt", "arg_name": "server_args"}, "ClassObjectJson": {"model_path": "/m/name'), text(e), F.lit('", "tp_size": 4, "dtype": "bfloat16"}}')))
    )
    vllm = (
        F.when(turn == 0, join(F.lit('{"kunlunClassAttr": {"module": "vllm.v1.worker.gpu_model_runner", "class": "GPUModelRunner", "attr": "requests"}, "ClassObjectJson": {"r'), text(e % 6), F.lit('": "State(prompt_token_ids=['), ids(e % 3 + 1), F.lit(']"}}')))
        .when(turn == 1, join(F.lit('{"kunlunClassAttr": {"module": "vllm.core.scheduler", "class": "SchedulerOutputs", "attr": "scheduled_seq_groups"}, "Value": "[G(request_id=a'), text(F.expr("event_id div 18")), F.lit('), G(request_id=b)]"}')))
        .otherwise(join(F.lit('{"kunlunClassAttr": {"module": "vllm.config", "attr": "model_config"}, "ClassObjectJson": {"_name_or_path": "/x/big/", "torch_dtype": "float16", "num_hidden_layers": '), text(e), F.lit(', "max_position_embeddings": 4096}}')))
    )
    plain = join(F.lit("config 'num_hidden_layers': "), text(e))
    return table(spark, sf, "events").select(join(F.lit("f"), text(f)).alias("path"), e.alias("line_no"), F.when(f == 0, sglang).when(f == 1, vllm).otherwise(plain).alias("line"))


@query(f"WITH {_LOGS} SELECT path, framework, item, value FROM items WHERE value IS NOT NULL")
def A11_K1_K2_F35_model_info(spark, sf):
    return logs.model_info(_dialect_lines(spark, sf))


@query(f"WITH {_MOMENTS} SELECT cycle, func_type, name, pid, device, metric, round(mu, 4) AS mu_pct, round(sigma, 4) AS sigma_pct, real, interpolated FROM o")
def F7_F8_weighted_moments(spark, sf):
    out = metrics.moments(*_metric_rows(spark, sf), 3_600_000_000)
    return out.withColumns({"mu_pct": F.round("mu_pct", 4), "sigma_pct": F.round("sigma_pct", 4)})


@query(f"""WITH {_MOMENTS}, k AS (SELECT DISTINCT cycle, func_type, name, pid, device FROM e) SELECT func_type, COALESCE(o.metric, 'N/A') AS metric, CAST(count(*) AS BIGINT) AS n FROM k LEFT JOIN o USING (cycle, func_type, name, pid, device) GROUP BY ALL""")
def F38_metric_rows(spark, sf):
    return metrics.perf_table(*_metric_rows(spark, sf), 3_600_000_000).groupBy("func_type", "metric").agg(F.count("*").alias("n"))


@query("SELECT 's' || (n_nationkey // 2) AS stem, CASE n_nationkey % 2 WHEN 0 THEN 'decode' ELSE 'prefill' END AS suffix1, CASE WHEN n_nationkey % 2 = 1 THEN 'prefill' WHEN n_nationkey % 4 = 0 THEN 'decode' ELSE '' END AS suffix2 FROM nation WHERE NOT (n_nationkey % 2 = 1 AND n_nationkey % 3 = 0)")
def E17_paired_files(spark, sf):
    k = F.col("n_nationkey")
    n = table(spark, sf, "nation")
    stem = F.concat(F.lit("s"), F.expr("n_nationkey div 2").cast("string")).alias("stem")
    a = n.select(stem, F.when(k % 2 == 0, "decode").otherwise("prefill").alias("suffix"), F.lit("a").alias("path"))
    b = n.where(~((k % 2 == 1) & (k % 3 == 0))).select(stem, F.when(k % 2 == 1, "prefill").when(k % 4 == 0, "decode").otherwise("").alias("suffix"), F.lit("b").alias("path"))
    return compare.paired(a, b).select("stem", "suffix1", "suffix2")


def _work_events(spark, sf, kinds: dict[str, str]):
    t = spans(spark, sf)
    cat = F.element_at(F.create_map(*(x for k, v in kinds.items() for x in (F.lit(k), F.lit(v)))), F.col("name"))
    return t.select("seq", F.when(cat == "CAT_APP", F.concat(F.lit("ncclOp"), (F.col("seq") % 3).cast("string"))).otherwise(F.col("name")).alias("name"), cat.alias("cat"), F.lit("X").alias("ph"), "pid", F.col("tid").cast("string").alias("tid"), "ts", "dur", "end_ts", F.create_map(F.lit("correlation"), (F.col("seq") % 200).cast("string")).alias("args"))


@query(f"""WITH {SPANS}, n AS (SELECT seq, 'ncclOp' || (seq % 3) AS op, ts, end_ts FROM spans WHERE name = 'purchase'), r AS (SELECT seq, pid, seq % 200 AS corr, ts, end_ts FROM spans WHERE name = 'view'),
 h AS (SELECT r.pid, r.corr, arg_max(n.op, (n.ts, n.seq)) AS op FROM n JOIN r ON r.ts >= n.ts AND r.end_ts <= n.end_ts GROUP BY r.pid, r.corr) SELECT k.seq, 'ncclDevKernel_' || h.op || '_click' AS name FROM spans k JOIN h ON h.pid = k.pid AND h.corr = k.seq % 200 WHERE k.name = 'click'""")
def G17_virtual_nccl(spark, sf):
    events = _work_events(spark, sf, {"purchase": "CAT_APP", "view": "cuda_runtime", "click": "Kernel"})
    return cycles.virtual_nccl(events, 3_600_000_000).select("seq", "name")


@query(f"""WITH {SPANS}, c AS (SELECT seq AS cycle, ts, end_ts FROM spans WHERE name = 'purchase' AND pid = 0), h AS (SELECT c.cycle, s.seq, s.pid, greatest(s.ts, c.ts) AS slice_ts, least(s.end_ts, c.end_ts) - greatest(s.ts, c.ts) AS slice_dur, c.end_ts - c.ts AS cycle_dur, s.ts < c.ts OR s.end_ts > c.end_ts AS is_slice FROM c JOIN spans s ON s.name = 'view' AND s.end_ts > c.ts AND s.ts < c.end_ts),
 k AS (SELECT pid, seq % 200 AS corr, max((cycle, cycle_dur)) AS m FROM h GROUP BY ALL) SELECT cycle, cycle_dur, seq, slice_ts, slice_dur, is_slice FROM h UNION ALL SELECT k.m[1], k.m[2], s.seq, s.ts, s.dur, FALSE FROM spans s JOIN k ON k.pid = s.pid AND k.corr = s.seq % 200 WHERE s.name = 'click'""")
def E26_assigned_events(spark, sf):
    events = _work_events(spark, sf, {"view": "cuda_runtime", "click": "Kernel"}).where("cat is not null")
    span = spans(spark, sf).where("name = 'purchase' and pid = 0").select(F.col("seq").alias("cycle"), F.col("ts").alias("start_ts"), "end_ts")
    return cycles.assigned(span, events, 3_600_000_000).select("cycle", "cycle_dur", "seq", "slice_ts", "slice_dur", "is_slice")


@query('SELECT n_nationkey AS role, min(n_nationkey) OVER (PARTITION BY n_regionkey) AS "group" FROM nation')
def G23_role_clusters(spark, sf):
    rows = table(spark, sf, "nation").select("n_nationkey", "n_regionkey").orderBy("n_nationkey").collect()  # roles are few
    scores = {(i, j): float(abs(rows[i].n_regionkey - rows[j].n_regionkey)) for i in range(len(rows)) for j in range(i + 1, len(rows))}
    return spark.createDataFrame(list(enumerate(compare.clusters(scores, len(rows)))), "role long, group long")


@query("SELECT n_nationkey AS k, CASE WHEN count(*) OVER (PARTITION BY n_nationkey % 20) > 1 THEN 'r' || (n_nationkey // 5) || '/' ELSE '' END || 'n' || (n_nationkey % 20) AS label FROM nation")
def G24_labels(spark, sf):
    rows = table(spark, sf, "nation").select("n_nationkey").orderBy("n_nationkey").collect()  # few paths
    names = compare.labels([f"/runs/r{r.n_nationkey // 5}/n{r.n_nationkey % 20}" for r in rows])
    return spark.createDataFrame([(r.n_nationkey, x) for r, x in zip(rows, names, strict=True)], "k long, label string")


@query(f"WITH {SPANS} SELECT name, CAST(row_number() OVER (ORDER BY sum(dur) * CASE name WHEN 'view' THEN 1 WHEN 'click' THEN 3 ELSE 9 END DESC) AS BIGINT) AS place FROM spans GROUP BY name")
def J3_ranked_candidates(spark, sf):
    weight = F.when(F.col("name") == "view", 1).when(F.col("name") == "click", 3).otherwise(9)
    rows = spans(spark, sf).groupBy("name").agg((F.sum("dur") * F.max(weight)).cast("double").alias("total"), F.avg("dur").alias("mean")).orderBy("name").collect()  # three names
    return spark.createDataFrame([(r["name"], k) for k, r in enumerate(folds.ranked([r.asDict() for r in rows]), 1)], "name string, place long")


@query()
def L5_random_split(spark, sf):
    return learn.random_split(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")).groupBy("is_train").agg(F.count("*").alias("n"))


@query()
def L10_importances(spark, sf):
    rows = _features(spark, sf)
    (_, model), = learn.trained(rows, ["x1", "x2", "x3"], "y", "ridge")
    return spark.createDataFrame(learn.importances(model, ["x1", "x2", "x3"]), "feature string, weight double")


@query()
def I7_I9_report(spark, sf):
    path, n = scratch(spark), F.col("name")
    e = _events(spark, sf).where("name <> 'signup'").withColumns({"ts": F.col("ts") / 3600, "dur": F.col("dur") / 3600, "cat": F.when(n == "click", "CAT_CPU").otherwise(F.col("cat"))})  # a second for an hour
    sinks.write_trace(e.withColumn("name", F.when(n == "click", "oncpu click").when(n == "error", "process_cpu_usage").otherwise(n)), path)
    events = checkpoint(sources.read_json_lines(spark, path))
    parts = workflow.deep_dive(events, "purchase")
    first = parts["cycles"].orderBy("start_ts", "cycle").first()
    text = workflow.report(parts, "run") + "\n\n" + workflow.cycle_details(events, first.cycle, first.start_ts, first.end_ts)
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "line long, text string")
