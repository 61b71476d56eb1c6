"""Which physical GPU a process means (E13), where peers are (E11, E12, F39), and reports of the hardware."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def physical_gpus(uses: DataFrame, inventory: DataFrame) -> DataFrame:
    """uses (host, pid, logical, ...) with physical: by host, pid and logical id; where the inventory (host, pid, logical,
    physical) knows one host alone, by pid and logical id. Of repeated entries the largest physical id counts."""
    exact = inventory.groupBy(F.col("host").alias("_h"), F.col("pid").alias("_p"), F.col("logical").alias("_l")).agg(F.max("physical").alias("_exact"))
    single = inventory.groupBy(F.col("pid").alias("_p2"), F.col("logical").alias("_l2")).agg(F.max("physical").alias("_loose"))
    hosts = inventory.agg((F.countDistinct("host") <= 1).alias("_one"))
    rows = uses.join(exact, F.col("host").eqNullSafe(F.col("_h")) & (F.col("pid") == F.col("_p")) & (F.col("logical") == F.col("_l")), "left")
    rows = rows.join(single, (F.col("pid") == F.col("_p2")) & (F.col("logical") == F.col("_l2")), "left").join(F.broadcast(hosts), F.lit(True))  # one row
    return rows.select(*uses.columns, F.coalesce("_exact", F.when(F.col("_one"), F.col("_loose"))).alias("physical"))


def by_category(inventory: DataFrame) -> DataFrame:
    """category, n, components."""
    return inventory.groupBy("category").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("component")).alias("components"))


def hardware_report(inventory: DataFrame, detailed: bool = False) -> str:
    """K4: text of the categories and, if detailed, of their components: all of them, for the inventory of one site."""
    lines = []
    for r in by_category(inventory).orderBy("category").toLocalIterator():
        lines.append(f"{r.category}: {r.n}")
        lines += [f"  - {c}" for c in r.components] if detailed else []
    return "\n".join(lines)


def cores(inventory: DataFrame) -> DataFrame:
    """Host, cores (of all its processors), memory_gb (the last given). Rows host, seq, cores, memory_gb."""
    return inventory.groupBy("host").agg(F.sum("cores").alias("cores"), F.max_by("memory_gb", F.when(F.col("memory_gb").isNotNull(), F.col("seq"))).alias("memory_gb"))


def enriched(events: DataFrame, key: str = "pid", host: str = "host", order: str = "seq") -> DataFrame:
    """Events with the host that their process was last seen with, where they have none."""
    known = events.where(F.col(host).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max_by(host, order).alias("_host"))
    return events.join(known, F.col(key) == F.col("_key"), "left").withColumn(host, F.coalesce(host, "_host")).drop("_key", "_host")


def maps(calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """where ranks are (comm, rank, node, device: the last call counts) and what nodes are called (comm, node, host: the first
    does), from collective calls seq, comm, rank, node, device, host; incomplete ones don't count."""
    whole = calls.dropna(subset=["comm", "rank", "node", "device", "host"])
    ranks = whole.groupBy("comm", "rank").agg(F.max(F.struct("seq", "node", "device")).alias("x")).select("comm", "rank", "x.node", "x.device")
    return ranks, whole.groupBy("comm", "node").agg(F.min_by("host", F.struct("seq", "host")).alias("host"))


#: The arguments that name peers.
ROLES = ("rp", "rn", "td0", "td1", "td2", "tu")


def peers(events: DataFrame, ranks: DataFrame, hosts: DataFrame) -> DataFrame:
    """Seq, role, peer ("host:...,dev:...") of each peer rank an event names that is known. events: seq, comm and a column for each of
    ROLES. The maps grow with communicators, so how they are joined is left to their size."""
    each = F.explode(F.array(*(F.struct(F.lit(r).alias("role"), F.col(r).cast("long").alias("rank")) for r in ROLES)))
    rows = events.select("seq", "comm", each.alias("x")).select("seq", "comm", "x.role", "x.rank").where("rank is not null")
    rows = rows.join(ranks.select("comm", F.col("rank").cast("long").alias("rank"), "node", "device"), ["comm", "rank"]).join(hosts, ["comm", "node"], "left")
    return rows.select("seq", "role", F.concat(F.lit("host:"), F.coalesce("host", F.col("node").cast("string")), F.lit(",dev:"), F.col("device").cast("string")).alias("peer"))
