"""Queries over column functions, filters, sorts and set operations (C, D, J)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from .registry import SPANS, TRACE, query, samples, spans, table, trace

#: Texts that look like trace fields, made of event columns; the same in SQL.
_TEXT = """raw AS (SELECT event_id AS seq,
 CASE event_id % 4 WHEN 0 THEN CAST(user_id AS VARCHAR) WHEN 1 THEN 'node-' || (user_id % 4) || '(' || user_id || ')' WHEN 2 THEN 'node.' || event_type ELSE '' END AS pid_text,
 CASE event_id % 12 WHEN 0 THEN 'ncclDevKernel_AllReduce_' || user_id || '<x>' WHEN 1 THEN 'Memcpy HtoD' WHEN 2 THEN 'Memcpy DtoH' WHEN 3 THEN 'Memcpy DtoD' WHEN 4 THEN 'mmap' WHEN 5 THEN 'cudaStreamSynchronize' WHEN 6 THEN 'readv' WHEN 7 THEN 'OnCPU main' WHEN 8 THEN 'runq' WHEN 9 THEN 'triton_poi_' || user_id WHEN 10 THEN 'Scheduler.run_batch' ELSE 'cuStreamSynchronize' END AS name,
 CASE event_id % 7 WHEN 0 THEN 'Kernel' WHEN 1 THEN 'Memcpy' WHEN 2 THEN 'Memset' WHEN 3 THEN 'cuda_runtime' WHEN 4 THEN 'CAT_APP' WHEN 5 THEN 'CAT_DISK' ELSE 'python' END AS cat,
 CASE event_id % 5 WHEN 0 THEN 'stream ' || (user_id % 9) WHEN 1 THEN 'device:' || (user_id % 8) WHEN 2 THEN 'CAT_XPU_' || (user_id % 8) WHEN 3 THEN 'user probe' ELSE 'Stream:' || user_id END AS tid,
 CASE event_id % 3 WHEN 0 THEN CAST(user_id % 8 AS VARCHAR) ELSE NULL END AS device,
 CASE event_id % 6 WHEN 0 THEN 'gpu_usage_' WHEN 1 THEN 'process_cpu_usage_' WHEN 2 THEN 'cpu_frequency_' WHEN 3 THEN 'gpu_pcie_receive_' WHEN 4 THEN 'net_tx_rate_' ELSE 'other_' END || (user_id % 16) AS counter,
 user_id, value FROM events)"""


def raw(spark, sf):
    """The same texts in Spark."""
    e, u = F.col("event_id"), F.col("user_id")

    def pick(n, *values):
        out = F.lit(None).cast("string")
        for k, v in enumerate(values):
            out = F.when(e % n == k, v if not isinstance(v, str) else F.lit(v)).otherwise(out)
        return out

    s = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y.cast("string") for y in x))
    return table(spark, sf, "events").select(
        e.alias("seq"), pick(4, s(u), s("node-", u % 4, "(", u, ")"), s("node.", F.col("event_type")), "").alias("pid_text"),
        pick(12, s("ncclDevKernel_AllReduce_", u, "<x>"), "Memcpy HtoD", "Memcpy DtoH", "Memcpy DtoD", "mmap", "cudaStreamSynchronize", "readv", "OnCPU main", "runq", s("triton_poi_", u), "Scheduler.run_batch", "cuStreamSynchronize").alias("name"),
        pick(7, "Kernel", "Memcpy", "Memset", "cuda_runtime", "CAT_APP", "CAT_DISK", "python").alias("cat"), pick(5, s("stream ", u % 9), s("device:", u % 8), s("CAT_XPU_", u % 8), "user probe", s("Stream:", u)).alias("tid"),
        F.when(e % 3 == 0, (u % 8).cast("string")).alias("device"), s(pick(6, "gpu_usage_", "process_cpu_usage_", "cpu_frequency_", "gpu_pcie_receive_", "net_tx_rate_", "other_"), u % 16).alias("counter"), u, "value",
    )


@query(f"""WITH {_TEXT} SELECT seq, COALESCE(TRY_CAST(NULLIF(pid_text, '') AS BIGINT), TRY_CAST(NULLIF(regexp_extract(pid_text, '\\((\\d+)\\)', 1), '') AS BIGINT), -1) AS pid,
 NULLIF(regexp_extract(pid_text, '([\\w.-]+)(?:\\(\\d+\\))?$', 1), '') AS host, object_base AS object_base FROM (SELECT *, CASE WHEN contains(name, '.') THEN split_part(name, '.', 1) END AS object_base FROM raw)""")
def C3_C4_C16_pid_host_base(spark, sf):
    return raw(spark, sf).select("seq", S.pid_of(F.col("pid_text")).alias("pid"), S.host_of(F.col("pid_text")).alias("host"), S.object_base(F.col("name")).alias("object_base"))


_KIND = """CASE WHEN cat = 'Kernel' AND contains(lower(name), 'nccl') THEN 'gpu_comm' WHEN cat = 'Kernel' THEN 'gpu_compute'
 WHEN (cat = 'Memcpy' OR name LIKE 'Memcpy%') AND contains(name, 'HtoD') THEN 'gpu_memcpy_h2d' WHEN (cat = 'Memcpy' OR name LIKE 'Memcpy%') AND contains(name, 'DtoH') THEN 'gpu_memcpy_d2h'
 WHEN (cat = 'Memcpy' OR name LIKE 'Memcpy%') AND contains(name, 'DtoD') THEN 'gpu_memcpy_d2d' WHEN cat = 'Memcpy' OR name LIKE 'Memcpy%' OR cat = 'Memset' THEN 'gpu_memcpy_h2d'
 WHEN lower(name) IN ('mmap', 'mprotect', 'munmap') THEN 'cpu_os_syscall_mem' WHEN cat = 'cuda_runtime' AND name = 'cudaStreamSynchronize' THEN 'cpu_sync'
 WHEN cat = 'CAT_APP' AND contains(tid, 'user probe') AND name = 'cuStreamSynchronize' THEN 'cpu_sync' WHEN cat = 'CAT_DISK' AND name IN ('read', 'readv', 'write') THEN 'disk_read_and_write'
 WHEN lower(name) LIKE 'oncpu%' THEN 'oncpu' WHEN name = 'runq' THEN 'runq' ELSE 'unknown' END"""


@query(f"WITH {_TEXT} SELECT {_KIND} AS func_type, cat, CAST(count(*) AS BIGINT) AS n FROM raw GROUP BY ALL")
def C6_classification(spark, sf):
    rows = raw(spark, sf)
    return rows.groupBy(S.function_type(F.col("name"), F.col("cat"), F.col("tid")).alias("func_type"), "cat").agg(F.count("*").alias("n"))


@query(f"""WITH {_TEXT} SELECT seq, CASE WHEN cat = 'python' THEN -1 ELSE COALESCE(TRY_CAST(device AS INTEGER), TRY_CAST(NULLIF(regexp_extract(tid, 'device:(\\d+)', 1), '') AS INTEGER), -1) END AS device,
 COALESCE(NULLIF(regexp_extract(lower(tid), 'stream:?\\s*(\\d+)', 1), ''), '-1') AS stream FROM raw""")
def C7_C8_device_stream(spark, sf):
    return raw(spark, sf).select("seq", S.device_of(F.col("cat"), F.col("device"), F.col("tid")).alias("device"), S.stream_of(F.col("tid")).alias("stream"))


@query(f"""WITH {_TEXT} SELECT seq, COALESCE(TRY_CAST(NULLIF(regexp_extract(tid, 'CAT_XPU_(\\d+)', 1), '') AS INTEGER), CAST(user_id % 16 AS INTEGER)) AS instance,
 CASE event_id_mod WHEN 5 THEN NULL ELSE regexp_replace(counter, '_\\d+$', '') END AS base,
 CASE event_id_mod WHEN 1 THEN 800.0 WHEN 0 THEN 100.0 WHEN 4 THEN 100.0 ELSE 1.0 END::DOUBLE AS factor FROM (SELECT *, seq % 6 AS event_id_mod FROM raw)""")
def C9_C10_C11_counter_identity(spark, sf):
    base = S.counter_base(F.col("counter"))
    return raw(spark, sf).select("seq", S.instance_of(F.col("counter"), F.lit("CAT_CPU"), F.col("tid")).alias("instance"), base.alias("base"), S.norm_factor(F.coalesce(base, F.lit("other")), 8).alias("factor"))


@query("""SELECT event_id AS seq, CAST(round(CASE WHEN s.s_acctbal > 0 THEN value / s.s_acctbal ELSE value END, 6) AS DOUBLE) AS normalized_value, COALESCE(s.s_acctbal > 0, FALSE) AS normalized
 FROM events LEFT JOIN supplier s ON user_id = s.s_suppkey""")
def C12_capacity(spark, sf):
    caps = table(spark, sf, "supplier").select("s_suppkey", "s_acctbal")
    value, known = S.by_capacity(F.col("value"), F.col("s_acctbal"))
    rows = table(spark, sf, "events").join(caps, F.col("user_id") == F.col("s_suppkey"), "left")
    return rows.select(F.col("event_id").alias("seq"), F.round(value, 6).alias("normalized_value"), known.alias("normalized"))


@query(f"""WITH {_TEXT} SELECT CASE WHEN name LIKE 'triton_%' THEN 'triton_kernel' WHEN contains(name, 'ncclDevKernel') THEN regexp_extract(name, 'ncclDevKernel_\\w+', 0) ELSE name END AS family, CAST(count(*) AS BIGINT) AS n FROM raw GROUP BY ALL""")
def C13_kernel_family(spark, sf):
    return raw(spark, sf).groupBy(S.kernel_family(F.col("name")).alias("family")).agg(F.count("*").alias("n"))


@query("SELECT event_id AS seq, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS at, epoch_us(ts) + CAST(round(value * 100) AS BIGINT) * 600000 AS end_ts FROM events")
def C5_C15_times(spark, sf):
    return trace(spark, sf).select("seq", S.time_text(F.col("ts")).alias("at"), S.end_of(F.col("ts"), F.col("dur")).alias("end_ts"))


_BATCH = "'forward_mode=' || CASE event_id % 2 WHEN 0 THEN 'EXTEND' ELSE 'DECODE' END || ' rid=' || event_id || ' input_ids=[' || CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN '7' ELSE '1, 2, 3' END || '] output_ids=[4,5] input_ids=[9,9] duration=' || value"


@query("""SELECT event_id AS seq, CASE event_id % 2 WHEN 0 THEN 'EXTEND' ELSE 'DECODE' END AS forward_mode, CAST(1 AS INTEGER) AS batch_size,
 CASE event_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 1.5 ELSE 2.5 END::DOUBLE AS avg_in, CASE event_id % 3 WHEN 2 THEN 3 ELSE 2 END AS max_in, 2.0::DOUBLE AS avg_out FROM events""")
def C17_C18_batch_params(spark, sf):
    e = F.col("event_id")
    text = F.concat(F.lit("forward_mode="), F.when(e % 2 == 0, "EXTEND").otherwise("DECODE"), F.lit(" rid="), e.cast("string"), F.lit(" input_ids=["), F.when(e % 3 == 0, "").when(e % 3 == 1, "7").otherwise("1, 2, 3"), F.lit("] output_ids=[4,5] input_ids=[9,9] duration="), F.col("value").cast("string"))
    rows = table(spark, sf, "events").select(e.alias("seq"), S.batch_params(text).alias("p"))
    (avg_in, max_in), (avg_out, _) = S.length_stats(F.col("p.input_lengths")), S.length_stats(F.col("p.output_lengths"))
    return rows.select("seq", "p.forward_mode", F.size("p.rids").alias("batch_size"), avg_in.alias("avg_in"), max_in.alias("max_in"), avg_out.alias("avg_out"))


@query("""SELECT l_orderkey, l_linenumber, CAST(q + p AS BIGINT) AS kv_len, CAST(CASE WHEN m = 2 THEN l_linenumber * (q + p) ELSE 0 END AS BIGINT) AS kv_cache,
 CAST(CASE WHEN m = 1 THEN l_linenumber * (q + p) * (q + p) ELSE 0 END AS BIGINT) AS attn_quad, CAST(CASE WHEN m = 1 THEN l_linenumber * q ELSE 0 END AS BIGINT) AS compute_tokens
 FROM (SELECT *, CAST(l_quantity AS BIGINT) AS q, l_partkey % 512 AS p, CASE WHEN l_returnflag = 'A' THEN 1 WHEN l_returnflag = 'N' THEN 2 END AS m FROM lineitem)""")
def C19_workload(spark, sf):
    q, p = F.col("l_quantity").cast("bigint"), F.col("l_partkey") % 512
    mode = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *(c.cast("bigint").alias(k) for k, c in S.workload(mode, F.col("l_linenumber"), q, p).items()))


@query("""SELECT CASE WHEN abs(128 - p) <= least(abs(256 - p), abs(512 - p), abs(1024 - p)) THEN 128 WHEN abs(256 - p) <= least(abs(512 - p), abs(1024 - p)) THEN 256 WHEN abs(512 - p) <= abs(1024 - p) THEN 512 ELSE 1024 END AS center,
 CAST(count(*) AS BIGINT) AS n FROM (SELECT l_partkey % 1100 AS p FROM lineitem) GROUP BY ALL""")
def C20_nearest_center(spark, sf):
    return table(spark, sf, "lineitem").groupBy(S.nearest(F.col("l_partkey") % 1100, (128, 256, 512, 1024)).alias("center")).agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, round(ln(1 + o_totalprice), 6) AS log_price, round(exp(ln(1 + o_totalprice)) - 1, 2) AS back, round(sqrt(o_totalprice), 6) AS root, CAST(ceil(o_totalprice / 100) AS BIGINT) AS up, CAST(floor(o_totalprice / 100) AS BIGINT) AS down, greatest(o_totalprice - 100000, 0) AS clipped FROM orders""")
def C21_math(spark, sf):
    p = F.col("o_totalprice")
    return table(spark, sf, "orders").select("o_orderkey", F.round(F.log1p(p), 6).alias("log_price"), F.round(F.expm1(F.log1p(p)), 2).alias("back"), F.round(F.sqrt(p), 6).alias("root"), F.ceil(p / 100).alias("up"), F.floor(p / 100).alias("down"), F.greatest(p - 100000, F.lit(0.0)).alias("clipped"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_discount * 12 < 1 THEN CAST(10 - floor(l_discount * 12 * 10) AS INTEGER) END AS stars,
 CASE WHEN l_extendedprice >= 1000000 THEN printf('%.1fM', l_extendedprice / 1e6) WHEN l_extendedprice >= 1000 THEN printf('%.0fk', l_extendedprice / 1e3) ELSE printf('%.0f', l_extendedprice) END AS tick FROM lineitem WHERE l_extendedprice % 1000 <> 500""")
def C22_C24_display(spark, sf):
    rows = table(spark, sf, "lineitem").where(F.col("l_extendedprice") % 1000 != 500)
    return rows.select("l_orderkey", "l_linenumber", S.stars(F.col("l_discount") * 12).alias("stars"), S.ticks(F.col("l_extendedprice")).alias("tick"))


@query("""SELECT page_id, regexp_replace(regexp_replace(url, '[<>:"/\\\\|?*]', '_', 'g'), '\\s+', '_', 'g') AS file_name, regexp_replace(substr(html, 1, 60), '([\\\\"|{}<>])', '\\\\\\1', 'g') AS escaped,
 CASE WHEN length(url) > 30 THEN substr(url, 1, 27) || '...' ELSE url END AS short FROM pages""")
def C23_C27_C32_texts(spark, sf):
    return table(spark, sf, "pages").select("page_id", S.file_name(F.col("url")).alias("file_name"), S.dot_escape(F.substring("html", 1, 60)).alias("escaped"), S.shortened(F.col("url"), 30).alias("short"))


@query("""SELECT event_id AS seq, CASE event_id % 4 WHEN 0 THEN 'BF16' WHEN 1 THEN 'FP16' WHEN 2 THEN 'FP8' ELSE 'INT4' END AS precision, CASE event_id % 3 WHEN 0 THEN 'sm90' WHEN 1 THEN 'Ampere (sm86)' END AS arch,
 CASE event_id % 2 WHEN 0 THEN 'FP8' END AS fp8, CASE event_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 4 ELSE 3 END AS priority FROM events""")
def C25_model_values(spark, sf):
    e = F.col("event_id")
    kind = F.when(e % 4 == 0, "torch.bfloat16").when(e % 4 == 1, "float16").when(e % 4 == 2, "fp8").otherwise("int4")
    arch = F.when(e % 3 == 0, "arch='sm90'").when(e % 3 == 1, "device_capability=8.6").otherwise("none")
    level = F.when(e % 5 == 1, "").when(e % 5 == 2, "auto").when(e % 5 == 3, "sm80").when(e % 5 == 4, "tensor")
    return table(spark, sf, "events").select(e.alias("seq"), S.precision(kind).alias("precision"), S.architecture(arch).alias("arch"), S.fp8(e % 2 == 0).alias("fp8"), S.priority(level).alias("priority"))


@query("""SELECT n_nationkey, CAST(80 AS DOUBLE) AS gpu_memory_gb, CAST(n_nationkey AS DOUBLE) AS host_memory_gb, CAST(2000 + n_nationkey AS DOUBLE) AS max_mhz, CAST(n_nationkey AS INTEGER) AS cores FROM nation""")
def A9_C28_hardware(spark, sf):
    n = F.col("n_nationkey")
    config = F.to_json(F.struct(F.lit("81920 MB").alias("memory"), (n.cast("bigint") * (1 << 30)).cast("string").alias("total"), F.concat((n + 2000).cast("string"), F.lit(" MHz")).alias("freq"), n.cast("string").alias("cores")))
    return table(spark, sf, "nation").select("n_nationkey", *(c.alias(k) for k, c in S.hardware(config).items()))


@query(f"""WITH {_TEXT} SELECT seq, CASE WHEN seq % 3 = 0 THEN 'h' || user_id WHEN seq % 3 = 1 THEN 'g' || user_id END AS host, CASE WHEN user_id % 3 = 0 THEN ' ' WHEN user_id % 2 = 0 THEN '**' ELSE '*' END AS flag,
 CASE WHEN user_id % 4 = 0 THEN 'Host' WHEN user_id % 4 = 1 THEN 'GPU ' || (user_id % 8) ELSE 'GPU ' || (user_id % 4 - 1) || ' (virtual)' END AS label FROM raw""")
def C29_C30_C31_labels(spark, sf):
    u, s = F.col("user_id"), F.col("seq")
    first = F.when(s % 3 == 0, "CAT_HOST").otherwise("CAT_PROCESS")
    host = S.location("CAT_HOST", (first, F.concat(F.lit("h"), u.cast("string"))), (F.when(s % 3 == 1, "CAT_HOST").otherwise("x"), F.concat(F.lit("g"), u.cast("string"))))
    return raw(spark, sf).select("seq", host.alias("host"), S.interpolation_flag(u % 2, u % 3).alias("flag"), S.device_label((u % 4 - 1).cast("int"), F.when(u % 4 == 1, u % 8)).alias("label"))


@query("""SELECT event_id AS seq, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(event_id AS VARCHAR) AS id, CAST(2 AS INTEGER) AS n_args FROM events""")
def C1_C2_envelope_args(spark, sf):
    nested = F.create_map(F.lit("id"), F.col("event_id").cast("string"), F.lit("args"), F.col("props"), F.lit("k"), F.lit("outer"))
    rows = table(spark, sf, "events").select("event_id", S.promote_args(nested).alias("args"))
    return rows.select(F.col("event_id").alias("seq"), S.number(F.col("args")["k"], "bigint").alias("k"), F.col("args")["id"].alias("id"), F.size(F.map_filter("args", lambda k, _: k != "args")).alias("n_args"))


@query("""WITH f AS (SELECT conv_id, turn, role, role <> 'system' AS has, [length(COALESCE(text, '')), turn, 7] AS lens FROM conversations) SELECT conv_id, turn, CASE WHEN has THEN role ELSE 'N/A' END AS post_forward_mode, CASE WHEN has THEN 2 ELSE 0 END AS post_batch_size, round(CASE WHEN has THEN list_avg(lens) ELSE 0 END, 2) AS post_avg_input_length,
 CAST(CASE WHEN has THEN list_max(lens) ELSE 0 END AS INTEGER) AS post_max_input_length, CAST(0 AS DOUBLE) AS post_avg_output_length, CAST(0 AS INTEGER) AS post_max_output_length FROM f""")
def C33_flatten_features(spark, sf):
    from .workflow import features

    lens = F.array(F.length(F.coalesce("text", F.lit(""))), F.col("turn").cast("int"), F.lit(7))
    batch = F.struct(F.col("role").alias("forward_mode"), F.array(F.lit("a"), F.lit("b")).alias("rids"), lens.alias("input_lengths"), F.array().cast("array<int>").alias("output_lengths"))
    rows = table(spark, sf, "conversations").withColumn("post", F.when(F.col("role") != "system", batch))
    return rows.select("conv_id", "turn", *features("post", "post"))


@query(f"WITH {TRACE} SELECT name, CAST(count(*) AS BIGINT) AS n, CAST(sum(dur) AS BIGINT) AS total FROM trace WHERE ph = 'X' AND dur > 10 GROUP BY ALL")
def D1_D2_duration_events(spark, sf):
    return trace(spark, sf).where("ph = 'X' and dur > 10").groupBy("name").agg(F.count("*").alias("n"), F.sum("dur").alias("total"))


@query(f"WITH {TRACE} SELECT name, tid, CAST(count(*) AS BIGINT) AS n FROM trace WHERE ph = 'X' AND name NOT IN ('click') GROUP BY ALL HAVING count(*) > 2")
def D3_anchor_filter(spark, sf):
    return trace(spark, sf).where((F.col("ph") == "X") & ~F.col("name").isin("click")).groupBy("name", "tid").agg(F.count("*").alias("n")).where("n > 2")


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000 AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_quantity > 40)""")
def D4_meaningful_semi_join(spark, sf):
    inside = table(spark, sf, "lineitem").where("l_returnflag = 'R' and l_quantity > 40").select("l_orderkey")
    return table(spark, sf, "orders").where("o_totalprice > 1000").join(inside, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey", "o_totalprice")


@query(f"WITH {TRACE} SELECT seq, name, tid FROM (SELECT *, count(*) OVER (PARTITION BY name, tid) AS n FROM trace WHERE name IN ('view', 'click')) WHERE n >= 20")
def D5_signal_filter(spark, sf):
    rows = trace(spark, sf).where(F.col("name").isin("view", "click"))
    return rows.withColumn("n", F.count("*").over(Window.partitionBy("name", "tid"))).where("n >= 20").select("seq", "name", "tid")


@query("""SELECT l_orderkey, l_linenumber, l_discount FROM (SELECT *, max(l_discount) OVER (PARTITION BY l_orderkey) AS top FROM lineitem) WHERE l_discount > 0.05 OR top <= 0.05""")
def D6_filter_with_fallback(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("top", F.max("l_discount").over(Window.partitionBy("l_orderkey")))
    return rows.where("l_discount > 0.05 or top <= 0.05").select("l_orderkey", "l_linenumber", "l_discount")


@query("SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n FROM lineitem WHERE l_extendedprice > 10000 GROUP BY ALL")
def D7_A10_feature_filter(spark, sf):
    return table(spark, sf, "lineitem").where("l_extendedprice > 10000").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query(f"WITH {TRACE} SELECT t.pid, seq, ts FROM trace t JOIN (SELECT pid, min(ts) AS first FROM trace WHERE name = 'purchase' GROUP BY pid) USING (pid) WHERE ts >= first")
def D8_trim_to_marker(spark, sf):
    rows = trace(spark, sf)
    first = rows.where("name = 'purchase'").groupBy("pid").agg(F.min("ts").alias("first"))
    return rows.join(first, "pid").where("ts >= first").select("pid", "seq", "ts")


@query(f"WITH {TRACE} SELECT * FROM (SELECT tid, name, CAST(sum(dur) AS BIGINT) AS total, round(100.0 * sum(dur) / sum(sum(dur)) OVER (PARTITION BY tid), 4) AS share FROM trace WHERE ph = 'X' GROUP BY tid, name) WHERE share >= 30")
def D9_share_threshold(spark, sf):
    rows = trace(spark, sf).where("ph = 'X'").groupBy("tid", "name").agg(F.sum("dur").alias("total"))
    share = F.round(F.lit(100.0) * F.col("total") / F.sum("total").over(Window.partitionBy("tid")), 4)
    return rows.withColumn("share", share).where("share >= 30")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)")
def D10_representative_filter(spark, sf):
    few = table(spark, sf, "customer").where("c_acctbal > 9000").select("c_custkey")
    return table(spark, sf, "orders").join(few, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey", "o_orderstatus")


@query("""SELECT o_custkey, o_orderkey, CASE WHEN typed = 0 THEN 'all' WHEN o_orderstatus = 'F' THEN 'prefill' ELSE 'decode' END AS part FROM (SELECT *, count(*) FILTER (WHERE o_orderstatus IN ('F', 'O')) OVER (PARTITION BY o_custkey) AS typed FROM orders) WHERE typed = 0 OR o_orderstatus IN ('F', 'O')""")
def D12_split_by_type(spark, sf):
    rows = table(spark, sf, "orders").withColumn("typed", F.count_if(F.col("o_orderstatus").isin("F", "O")).over(Window.partitionBy("o_custkey")))
    part = F.when(F.col("typed") == 0, "all").when(F.col("o_orderstatus") == "F", "prefill").otherwise("decode")
    return rows.where((F.col("typed") == 0) | F.col("o_orderstatus").isin("F", "O")).select("o_custkey", "o_orderkey", part.alias("part"))


@query(f"WITH {SPANS} SELECT seq, tid, CAST(row_number() OVER (PARTITION BY tid ORDER BY ts, seq) AS INTEGER) AS place FROM spans")
def J1_stable_order(spark, sf):
    return spans(spark, sf).select("seq", "tid", F.row_number().over(Window.partitionBy("tid").orderBy("ts", "seq")).alias("place"))


@query("SELECT o_orderstatus, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 10")
def J2_J4_top_k(spark, sf):
    w = Window.partitionBy("o_orderstatus").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf, "orders").withColumn("r", F.row_number().over(w)).where("r <= 10").select("o_orderstatus", "o_orderkey", "o_totalprice")


@query("SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS biggest, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS smallest FROM orders GROUP BY o_custkey")
def J5_arg_extremes(spark, sf):
    key = F.struct("o_totalprice", "o_orderkey")
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", key).alias("biggest"), F.min_by("o_orderkey", key).alias("smallest"))


@query("""SELECT kind, CAST(count(*) AS BIGINT) AS n FROM (SELECT 'order' AS kind FROM orders UNION ALL SELECT 'line' FROM lineitem) GROUP BY kind""")
def J6_union_all(spark, sf):
    a, b = (table(spark, sf, t).select(F.lit(k).alias("kind")) for t, k in (("orders", "order"), ("lineitem", "line")))
    return a.unionByName(b).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def J7_distinct(spark, sf):
    return table(spark, sf, "lineitem").select("l_suppkey", "l_returnflag").dropDuplicates()


@query("""SELECT 'both' AS side, user_id FROM (SELECT user_id FROM events WHERE event_type = 'purchase' INTERSECT SELECT user_id FROM events WHERE event_type = 'error')
 UNION ALL SELECT 'first', user_id FROM (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' EXCEPT SELECT user_id FROM events WHERE event_type = 'error')""")
def J8_E18_set_operations(spark, sf):
    e = table(spark, sf, "events")
    a, b = (e.where(F.col("event_type") == k).select("user_id").distinct() for k in ("purchase", "error"))
    return a.intersect(b).select(F.lit("both").alias("side"), "user_id").unionByName(a.exceptAll(b).select(F.lit("first").alias("side"), "user_id"))


@query(f"WITH {TRACE} SELECT tid, name, seq FROM (SELECT *, row_number() OVER (PARTITION BY tid, name ORDER BY ts, seq) AS r FROM trace) WHERE r = 1")
def J9_keep_first(spark, sf):
    w = Window.partitionBy("tid", "name").orderBy("ts", "seq")
    return trace(spark, sf).withColumn("r", F.row_number().over(w)).where("r = 1").select("tid", "name", "seq")


@query(f"WITH {TRACE} SELECT tid, name FROM (SELECT tid, name, row_number() OVER (PARTITION BY tid ORDER BY count(*) DESC, min(seq)) AS r FROM trace GROUP BY tid, name) WHERE r = 1")
def J10_most_common(spark, sf):
    rows = trace(spark, sf).groupBy("tid", "name").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    return rows.groupBy("tid").agg(F.max_by("name", F.struct("n", -F.col("first"))).alias("name"))


@query(f"WITH {SPANS} SELECT pid, name, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd FROM samples GROUP BY ALL")
def B1_counter_digest(spark, sf):
    return samples(spark, sf).groupBy("pid", "name").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("sd"))
