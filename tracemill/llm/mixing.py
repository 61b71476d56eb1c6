"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a target number of words; all its documents share the expected number of copies target / size. The
whole part is certain. Fractions are rounded by pairs: words move from one document's fraction to the other's until one
is 0 or 1, in the direction that a hashed draw picks with the odds that keep every expectation, so the sum of words
stays the same. Blocks of at most about BLOCK documents are folded by themselves; the one document of a block that
stays fractional goes up to the next level of a tree over blocks, and the last one of a source is drawn.

Cases: a null text has size 0 and takes nothing; a null source is a source of its own, the last; sources without words
have target 0; repeated rows are told apart by a running number and rounded each for itself; an empty table has no
rows; ids may be null; columns besides id, text and source don't matter, whatever their names. Targets are ranked in windows
over one narrow row for each source in one task, which spills: meant for up to some millions of sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

BLOCK, CAP, WEIGHTS, SEED, STEP = 64, 3, 3, 17, 4096
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """From source, source_size (and other columns, which stay) the target of each source.

    Sources in order weigh 1, 2, 3 and again; a target is at most CAP times the source. Going up by size / weight,
    a source is full as long as CAP times its size is below its share of what the full ones before leave.
    The windows run over one row for each source.
    """
    rows = sizes.withColumn("_n", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn("_w", ((F.col("_n") - 1) % WEIGHTS + 1).cast("double"))
    rows = rows.withColumn("_cap", F.lit(float(CAP)) * F.col("source_size"))
    all_rows, before = Window.partitionBy(), Window.orderBy(F.col("_cap") / F.col("_w"), "_n").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_left", F.sum("source_size").over(all_rows) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
    rows = rows.withColumn("_level", F.col("_left") / (F.sum("_w").over(all_rows) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))))
    rows = rows.withColumn("_full", F.col("_cap") <= F.col("_level") * F.col("_w"))
    share = F.max(F.when(~F.col("_full"), F.col("_level"))).over(all_rows)
    return rows.withColumn("target", F.when(F.col("_full"), F.col("_cap")).otherwise(share * F.col("_w"))).drop("_n", "_w", "_cap", "_left", "_level", "_full")


def _draw(level: int) -> Column:
    """Uniform in [0, 1), the same in each run."""
    return F.shiftrightunsigned(F.xxhash64("id", "k", F.lit(level), F.lit(SEED)), 11) / F.lit(float(1 << 53))


def _fold(rows: DataFrame, level: int) -> DataFrame:
    """Round blocks of (source, block; u, id, k, size, base, p): `done` has settled rows, `rest` the one that stays fractional."""
    item = F.struct("u", "id", "k", "size", "base", "p")
    kind = "struct<u:double,id:string,k:bigint,size:bigint,base:bigint,p:double>"
    start = F.struct(F.lit(None).cast(kind).alias("rest"), F.array().cast(f"array<{kind}>").alias("done"))

    def put(x: Column, p: Column) -> Column:
        return F.struct(x["u"].alias("u"), x["id"].alias("id"), x["k"].alias("k"), x["size"].alias("size"), x["base"].alias("base"), p.alias("p"))

    def step(state: Column, x: Column) -> Column:
        a = state["rest"]
        room_a, mass_a = a["size"] * (1 - a["p"]), a["size"] * a["p"]
        room_x, mass_x = x["size"] * (1 - x["p"]), x["size"] * x["p"]
        up, down = F.least(room_a, mass_x), F.least(mass_a, room_x)  # words that could move to a, and from a
        rises = x["u"] * (up + down) < down
        one, zero = F.lit(1.0), F.lit(0.0)

        def after(a_settles: Column, a_end: Column, x_p: Column, x_end: Column, a_p: Column) -> Column:
            return F.when(a_settles, F.struct(put(x, x_p).alias("rest"), F.concat(state["done"], F.array(put(a, a_end))).alias("done"))).otherwise(
                F.struct(put(a, a_p).alias("rest"), F.concat(state["done"], F.array(put(x, x_end))).alias("done"))
            )

        to_a = after(room_a <= mass_x, one, x["p"] - room_a / x["size"], zero, a["p"] + mass_x / a["size"])
        to_x = after(mass_a <= room_x, zero, x["p"] + mass_a / x["size"], one, a["p"] - room_x / a["size"])
        return F.when(a.isNull(), F.struct(x.alias("rest"), state["done"].alias("done"))).when(rises, to_a).otherwise(to_x)

    rows = rows.withColumn("u", _draw(level)).groupBy("source", "block", "blocks").agg(F.sort_array(F.collect_list(item)).alias("items"))
    return rows.select("source", "block", "blocks", F.aggregate("items", start, step).alias("state")).select("source", "block", "blocks", "state.rest", "state.done")


def _counted(rows: DataFrame, count: str, name: str) -> DataFrame:
    """Each row `count` times, with the running number `name` from 1; in two steps, so that no array is longer than STEP."""
    (step,) = common.free([*rows.columns, name], "_step")
    rows = rows.where(F.col(count) > 0).withColumn(step, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(count) - 1) / STEP))))
    last = F.least(F.col(count).cast("long"), (F.col(step) + 1) * STEP)
    return rows.withColumn(name, F.explode(F.sequence(F.col(step) * STEP + 1, last))).drop(step)


def copies(docs: DataFrame, block: int = BLOCK, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Rows id, k (1 for the first of repeated rows), source, size, source_size, target, copies."""
    kind = docs.schema[id].dataType
    keys = docs.select(F.col(id).cast("string").alias("id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size")).groupBy("id", "source", "size").count()
    keys = common.checkpoint(keys)
    sizes = keys.groupBy("source").agg(F.sum(F.col("size") * F.col("count")).alias("source_size"), F.sum("count").alias("_docs"))
    sources = common.checkpoint(targets(sizes).withColumn("_each", F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))))
    widths = sources.agg(F.count("*"), F.max("_docs")).first()
    few = common.small(sources.withColumnRenamed("source", "_source"), widths[0], 200)
    rows = _counted(keys.join(few, F.col("source").eqNullSafe(F.col("_source"))), "count", "k")
    rows = rows.select("id", "source", "size", "source_size", "target", "_docs", "k", F.floor("_each").alias("base"), (F.col("_each") - F.floor("_each")).alias("p"))
    settled = rows.where("size = 0 or p = 0").select("id", "k", "source", "size", "base", F.when(_draw(-1) < F.col("p"), 1).otherwise(0).alias("bit"))
    blocks = F.ceil(F.col("_docs") / F.lit(block))
    left = rows.where("size > 0 and p > 0").select("source", "id", "k", "size", "base", "p", F.pmod(F.xxhash64("id", "k", F.lit(SEED)), blocks).alias("block"), blocks.alias("blocks"))
    most, level = -(-(widths[1] or 1) // block), 0
    while True:
        folded = common.checkpoint(_fold(left, level))
        settled = settled.unionByName(folded.select("source", F.explode("done").alias("x")).select("x.id", "x.k", "source", "x.size", "x.base", F.col("x.p").cast("int").alias("bit")))
        left = folded.where("rest is not null").select("source", F.floor(F.col("block") / F.lit(block)).alias("block"), "blocks", "rest.id", "rest.k", "rest.size", "rest.base", "rest.p")
        if most <= 1:
            break
        most, level = -(-most // block), level + 1
    last = left.select("id", "k", "source", "size", "base", F.when(_draw(-2) < F.col("p"), 1).otherwise(0).alias("bit"))
    out = settled.unionByName(last).join(few.select("_source", "source_size", "target"), F.col("source").eqNullSafe(F.col("_source")))
    return out.select(F.col("id").cast(kind).alias(id), "k", F.col("source").alias(source), "size", "source_size", "target", (F.col("base") + F.col("bit")).alias("copies"))


def mixture(docs: DataFrame, text: str = "text", id: str = "doc_id", source: str = "source", block: int = BLOCK) -> DataFrame:
    """The documents, each repeated as often as the mix takes it; the columns stay. Documents without words take nothing,
    so they are left out. Rows that agree in id, source and size are numbered by a hash of all their columns; rows
    that agree in all of them are interchangeable, so each such class is one row with the copies of all its members."""
    size, d1, d2, start, k, takes, copy = common.free(docs.columns, "_size", "_d1", "_d2", "_start", "_k", "_takes", "_copy")
    p_id, p_k, p_source, p_size, p_takes, p_last, p_d1, p_d2, p_copies = common.free(docs.columns, "p_id", "p_k", "p_source", "p_size", "p_takes", "p_last", "p_d1", "p_d2", "p_copies")
    key = [id, source, size]
    plan = copies(docs, block, id, text, source).where("size > 0").select(F.col(id).alias(p_id), F.col("k").alias(p_k), F.col(source).alias(p_source), F.col("size").alias(p_size), F.col("copies").alias(p_copies))
    per = plan.groupBy(p_id, p_source, p_size).agg(F.sum(p_copies).alias(p_takes), F.max(p_k).alias(p_last))
    same = F.col(id).eqNullSafe(F.col(p_id)) & F.col(source).eqNullSafe(F.col(p_source)) & (F.col(size) == F.col(p_size))
    rows = docs.withColumn(size, word_count(F.col(text)))
    alone = rows.join(per.where((F.col(p_last) == 1) & (F.col(p_takes) > 0)), same).select(*docs.columns, F.col(p_takes).alias(takes))
    more = rows.join(per.where((F.col(p_last) > 1) & (F.col(p_takes) > 0)), same).select(*rows.columns).withColumn(d1, F.xxhash64(*docs.columns)).withColumn(d2, F.hash(*docs.columns))
    # numbers of the members of each class: narrow rows, a class once
    classes = more.groupBy(*key, d1, d2).agg(F.count("*").alias(takes))
    before = Window.partitionBy(*key).orderBy(d1, d2).rowsBetween(Window.unboundedPreceding, -1)
    members = _counted(classes.withColumn(start, F.coalesce(F.sum(takes).over(before), F.lit(0))), takes, k).withColumn(k, F.col(k) + F.col(start)).drop(takes, start)
    taken = members.join(plan.where(F.col(p_copies) > 0), same & (F.col(k) == F.col(p_k))).groupBy(*key, d1, d2).agg(F.sum(p_copies).alias(takes))
    taken = taken.select(F.col(id).alias(p_id), F.col(source).alias(p_source), F.col(size).alias(p_size), F.col(d1).alias(p_d1), F.col(d2).alias(p_d2), takes)
    more = more.dropDuplicates([*key, d1, d2]).join(taken, same & (F.col(d1) == F.col(p_d1)) & (F.col(d2) == F.col(p_d2))).select(*docs.columns, takes)
    return _counted(alone.unionByName(more), takes, copy).select(*docs.columns)
