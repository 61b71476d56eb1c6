"""Column functions of the trace model (C1 to C33). All stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    """A regular expression's group, null without a match or with an empty one."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def number(text: Column, kind: str = "double") -> Column:
    """A number or null, never an error."""
    return text.cast("string").try_cast(kind)


def clean(x: Column) -> Column:
    """Null for NaN."""
    return F.when(~F.isnan(x), x)


def promote_args(args: Column) -> Column:
    """Merge the keys of a nested JSON object under `args` into the map; nested keys win."""
    nested = F.coalesce(F.from_json(args["args"], "map<string,string>"), F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(args, lambda k, _: ~F.array_contains(F.map_keys(nested), k)), nested)


def pid_of(text: Column) -> Column:
    """A number, or the number in parentheses behind a host, else -1."""
    return F.coalesce(number(text, "bigint"), number(F.regexp_extract(text, r"\((\d+)\)", 1), "bigint"), F.lit(-1).cast("bigint"))


def host_of(text: Column) -> Column:
    """C4: the host before the number in parentheses."""
    return _found(text, r"([\w.-]+)(?:\(\d+\))?$")


def end_of(ts: Column, dur: Column) -> Column:
    """C5."""
    return ts + F.coalesce(dur, F.lit(0))


def function_type(name: Column, cat: Column, tid: Column) -> Column:
    """The kind of function of an event; the first rule that fits."""
    low, copy = F.lower(name), (cat == "Memcpy") | name.startswith("Memcpy")
    rules = [
        ((cat == "Kernel") & low.contains("nccl"), "gpu_comm"), (cat == "Kernel", "gpu_compute"),
        (copy & name.contains("HtoD"), "gpu_memcpy_h2d"), (copy & name.contains("DtoH"), "gpu_memcpy_d2h"), (copy & name.contains("DtoD"), "gpu_memcpy_d2d"), (copy | (cat == "Memset"), "gpu_memcpy_h2d"),
        (low.isin("mmap", "mprotect", "munmap"), "cpu_os_syscall_mem"), ((cat == "cuda_runtime") & (name == "cudaStreamSynchronize"), "cpu_sync"),
        ((cat == "CAT_APP") & tid.contains("user probe") & (name == "cuStreamSynchronize"), "cpu_sync"), ((cat == "CAT_DISK") & name.isin("read", "readv", "write"), "disk_read_and_write"),
        (low.startswith("oncpu"), "oncpu"), (name == "runq", "runq"),
    ]
    out = F.lit("unknown")
    for test, kind in reversed(rules):
        out = F.when(test, F.lit(kind)).otherwise(out)
    return out


def device_of(cat: Column, device: Column, tid: Column) -> Column:
    """The device argument, else the number in the thread's name; -1 for Python events."""
    return F.when(cat == "python", F.lit(-1)).otherwise(F.coalesce(number(device, "int"), number(F.regexp_extract(tid, r"device:(\d+)", 1), "int"), F.lit(-1)))


def stream_of(tid: Column) -> Column:
    """C8."""
    return F.coalesce(_found(F.lower(tid), r"stream:?\s*(\d+)"), F.lit("-1"))


def instance_of(name: Column, cat: Column, tid: Column) -> Column:
    """Which instance a counter belongs to, else -1."""
    last = F.element_at(F.split(name, "_"), -1)
    return F.coalesce(number(F.regexp_extract(tid, r"CAT_XPU_(\d+)", 1), "int"), F.when(cat.isin("CAT_CPU", "CAT_MEMORY", "CAT_PROCESS") & name.contains("_"), number(last, "int")), F.lit(-1))


def counter_base(name: Column, bases: list[str] | None = None) -> Column:
    """The known counter whose name begins this one."""
    out = F.lit(None).cast("string")
    for base in sorted(bases or V.COUNTERS, reverse=True):
        out = F.when(name.startswith(base), F.lit(base)).otherwise(out)
    return out


def norm_factor(name: Column, cores: Column | int = 1) -> Column:
    """C11: what a counter's value is divided by."""
    cores = cores if isinstance(cores, Column) else F.lit(cores)
    return F.when(name == "process_cpu_usage", F.when(cores > 0, cores * 100.0).otherwise(100.0)).when(name.rlike("usage|rate|util|occupancy"), F.lit(100.0)).otherwise(F.lit(1.0))


def by_capacity(value: Column, capacity: Column) -> tuple[Column, Column]:
    """Value by capacity where there is one, and whether there was."""
    known = capacity.isNotNull() & (capacity > 0)
    return F.when(known, value / capacity).otherwise(value), known


def kernel_family(name: Column) -> Column:
    """A short name for a family of kernels."""
    #: Prefix and name of each family.
    families = [
        ("void at::native::elementwise_kernel", "at::native::elementwise_kernel"), ("void at::native::unrolled_elementwise_kernel", "at::native::unrolled_elementwise_kernel"), ("void at::native::vectorized_elementwise_kernel", "at.native.vectorized_elementwise_kernel"),
        ("void pytorch_flash::flash_fwd_kernel", "pytorch_flash::flash_fwd_kernel"), ("ampere_bf16_s16816gemm", "ampere_bf16_gemm"), ("triton_", "triton_kernel"),
    ]
    out = F.when(name.contains("ncclDevKernel"), F.coalesce(_found(name, r"ncclDevKernel_\w+", 0), F.lit("nccl_kernel"))).otherwise(name)
    for prefix, family in reversed(families):
        out = F.when(name.startswith(prefix), F.lit(family)).otherwise(out)
    return F.coalesce(out, F.lit("unknown_function"))


def time_text(ts_us: Column) -> Column:
    """Microseconds since 1970 as text in the session's time zone."""
    return F.when(ts_us >= 0, F.date_format(F.timestamp_micros(ts_us.cast("bigint")), "yyyy-MM-dd HH:mm:ss.SSSSSS")).otherwise("Invalid Timestamp")


def object_base(name: Column) -> Column:
    """What stands before the first dot, null without a dot."""
    return F.when(name.contains("."), F.split(name, r"\.")[0])


def list_lengths(text: Column, field: str) -> Column:
    """C17: the number of items of each list `field=[...]`."""
    return F.transform(F.regexp_extract_all(text, F.lit(field + r"=\[(.*?)\]"), F.lit(1)), lambda x: F.when(F.trim(x) == "", 0).otherwise(F.size(F.split(x, ","))))


def batch_params(text: Column) -> Column:
    """C17: struct of forward_mode, rids, input_lengths, output_lengths, duration."""
    return F.struct(
        _found(text, r"forward_mode=(\w+)").alias("forward_mode"), F.regexp_extract_all(text, F.lit(r"rid=([0-9a-fA-F]+)"), F.lit(1)).alias("rids"),
        list_lengths(text, "input_ids").alias("input_lengths"), list_lengths(text, "output_ids").alias("output_lengths"), number(_found(text, r"duration=(\d+\.\d+)")).alias("duration"),
    )


def length_stats(lengths: Column) -> tuple[Column, Column]:
    """Mean and maximum of an array, 0 for none."""
    total = F.aggregate(lengths, F.lit(0).cast("bigint"), lambda s, x: s + x)
    return F.coalesce(F.try_divide(total.cast("double"), F.size(lengths)), F.lit(0.0)), F.coalesce(F.array_max(lengths), F.lit(0))


def workload(mode: Column, batch: Column, tokens_in: Column, tokens_out: Column) -> dict[str, Column]:
    """Load features of a cycle; mode 1 is prefill, 2 decode."""
    mode, batch, tokens_in, tokens_out = (F.coalesce(c, F.lit(0)) for c in (mode, batch, tokens_in, tokens_out))
    kv, prefill, decode = tokens_in + tokens_out, (mode == 1).cast("int"), (mode == 2).cast("int")
    return {"kv_len": kv, "kv_cache": decode * batch * kv, "attn_quad": prefill * batch * kv * kv, "compute_tokens": prefill * batch * tokens_in}


def nearest(x: Column, centers) -> Column:
    """C20: the nearest of some values, the first of equally near ones."""
    return F.array_min(F.array(*(F.struct(F.abs(x - c).cast("double").alias("d"), F.lit(i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(centers))))["c"]


def stars(ratio: Column) -> Column:
    """C22."""
    return F.when(ratio < 1, (10 - F.floor(ratio * 10)).cast("int"))


def file_name(text: Column) -> Column:
    """A text that can name a file."""
    return F.regexp_replace(F.regexp_replace(text, r'[<>:"/\\|?*]', "_"), r"\s+", "_")


def ticks(x: Column) -> Column:
    """Rounded as printf does, by the binary value; of two equally near texts the even one. (Java's formats round decimal digits up.)"""
    m = x / 1e6
    # ten times m is s + rest exactly; where s lies midway between two numbers, the rest decides
    s = m * 8 + m * 2
    rest = m * 2 - (s - m * 8)
    tenths = F.when((s - F.floor(s) == 0.5) & (rest != 0), F.when(rest > 0, F.ceil(s)).otherwise(F.floor(s)).cast("double")).otherwise(F.rint(s))
    whole = lambda c: F.rint(c.cast("double"))
    return F.when(x >= 1_000_000, F.format_string("%.1fM", tenths / 10)).when(x >= 1000, F.format_string("%.0fk", whole(x / 1e3))).otherwise(F.format_string("%.0f", whole(x)))


def precision(text: Column) -> Column:
    """The usual short name of a number format."""
    last = F.element_at(F.split(text, r"\."), -1)
    return F.when(last == "bfloat16", "BF16").when(last == "float16", "FP16").otherwise(F.upper(last))


def architecture(text: Column) -> Column:
    """The GPU architecture in a text."""
    capability = _found(text, r"device_capability=(\d+\.\d+)")
    named = F.when(capability == "9.0", "Hopper (sm90)").when(capability == "8.0", "Ampere (sm80)").when(capability == "8.6", "Ampere (sm86)").otherwise(F.concat(F.lit("Capability "), capability))
    return F.coalesce(_found(text, r"arch='(sm\d+)'"), named)


def fp8(text: Column) -> Column:
    """C25."""
    return F.when(F.lower(text.cast("string")) == "true", F.lit("FP8"))


def priority(text: Column) -> Column:
    """How specific a value is, 0 (null) to 4."""
    up = F.upper(text)
    unknown = ("", "未知")  # fixed values: what logs say for unknown
    return F.when(text.isNull(), 0).when(up.isin(*unknown), 1).when(up.contains("AUTO") | up.contains("(NULL)"), 2).when(up.rlike(r"BF16|FP16|FP8|INT|SM|HOPPER|AMPERE|\d"), 4).otherwise(3)


def dot_escape(text: Column) -> Column:
    """C27."""
    return F.regexp_replace(text, r'([\\"|{}<>])', r"\\$1")


def hardware(config: Column) -> dict[str, Column]:
    """Sizes in GB and frequencies in MHz from an inventory JSON."""
    field = lambda k: F.get_json_object(config, f"$.{k}")
    return {"gpu_memory_gb": number(F.regexp_extract(field("memory"), r"(\d+)", 1)) / 1024, "host_memory_gb": number(field("total")) / (1 << 30), "max_mhz": number(F.regexp_extract(field("freq"), r"(\d+)", 1)), "cores": number(field("cores"), "int")}


def location(kind: str, *pairs: tuple[Column, Column]) -> Column:
    """The value of the first (type, value) pair of that type."""
    return F.coalesce(*(F.when(t == kind, v) for t, v in pairs))


def interpolation_flag(real: Column, interpolated: Column) -> Column:
    """Blank if all measured, ** if none, * if some."""
    return F.when(interpolated == 0, " ").when(real == 0, "**").otherwise("*")


def device_label(device: Column, physical: Column) -> Column:
    """C31."""
    return F.when(device < 0, F.lit("Host")).when(physical.isNotNull(), F.concat(F.lit("GPU "), physical.cast("string"))).otherwise(F.concat(F.lit("GPU "), device.cast("string"), F.lit(" (virtual)")))


def shortened(text: Column, width: int) -> Column:
    """C32."""
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width - 3), F.lit("..."))).otherwise(text)
