"""Call nesting of spans and what follows from it.

A thread is cut where no earlier span is open any more; the stack is empty there, so the pieces nest by themselves. Pieces
are packed into runs of a bounded number of spans as far as the data allow; a long thread is many runs in many tasks. A
thread with a frame around it all has no such places; it is cut by time, with the spans open at a cut carried over.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable
from functools import partial
from hashlib import blake2b
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import interval
from .lineage import checkpoint

#: Spans of a run, if pieces are small.
PACK = 20_000


def fold(df: DataFrame, keys: list[str], columns: list[str], f: Callable[[list[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """f over the rows (tuples of `columns`) of each key, sorted; results get the key's columns in front. Partitions are sorted by
    key and streamed through Python, so a task holds the rows of one key at a time, and small keys cost no call of their own."""
    n = len(keys)
    out = T.StructType([T.StructField(k, df.schema[k].dataType) for k in keys] + list(T.StructType.fromDDL(schema)))
    kinds = to_arrow_schema(out)

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    def run(batches):
        key, rows, done = None, [], []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:n] != key:
                    done += [(*key, *r) for r in f(rows)] if rows else []
                    key, rows = row[:n], []
                rows.append(row[n:])
            if done:
                yield pack(done)
                done = []
        if rows and (done := [(*key, *r) for r in f(rows)]):
            yield pack(done)

    return df.select(*keys, *columns).repartition(*keys).sortWithinPartitions(*keys, *columns).mapInArrow(run, out)


def streamed(df: DataFrame, keys: list[str], columns: list[str], f: Callable[[Iterable[tuple]], Iterable[tuple]], schema: str, dealt: bool = False) -> DataFrame:
    """As fold, but f gets the rows of a key one by one, so a task holds only what f keeps of them. dealt: a key's rows lie in one
    partition already."""
    n = len(keys)
    out = T.StructType([T.StructField(k, df.schema[k].dataType) for k in keys] + list(T.StructType.fromDDL(schema)))
    kinds = to_arrow_schema(out)

    def run(batches):
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        found = ((*key, *r) for key, group in groupby(rows, lambda row: row[:n]) for r in f(row[n:] for row in group))
        while done := list(islice(found, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], schema=kinds)

    rows = df.select(*keys, *columns)
    return (rows if dealt else rows.repartition(*keys)).sortWithinPartitions(*keys, *columns).mapInArrow(run, out)


def stack(rows: list[tuple], callers: bool = True) -> Iterable[tuple]:
    """From (ts, seq, end_ts, name, anchor) sorted: seq, depth, parent_seq, is_recursive, owner_seq and, if asked for, above. A span
    stays open for later ones that start before its end, even if it outlives its parent; the owner is the nearest anchor, itself first."""
    open_: list[tuple] = []  # end, seq, name, owner
    names: Counter = Counter()
    for ts, seq, end, name, anchor in rows:
        while open_ and ts >= open_[-1][0]:
            names[open_.pop()[2]] -= 1
        owner = seq if anchor else open_[-1][3] if open_ else None
        out = seq, len(open_), open_[-1][1] if open_ else None, names[name] > 0, owner
        yield (*out, [x[1] for x in reversed(open_)]) if callers else out
        open_.append((end, seq, name, owner))
        names[name] += 1


def nested(spans: DataFrame, keys: list[str], anchor: Column | None = None, callers: bool = False, cut: int | None = None) -> DataFrame:
    """Keys, seq, depth, parent_seq, is_recursive (a caller has the same name), owner_seq; with callers also above. With
    `cut` threads are nested in stretches of that many microseconds, so that a frame around a whole thread holds nothing up."""
    spans = spans.withColumn("seq", F.col("seq").cast("bigint")).withColumn("_anchor", anchor if anchor is not None else F.lit(False))
    if cut is not None:
        return _nested_by_parts(spans, keys, cut, callers)
    pieces = interval.sessions(spans, keys, 0)
    # pieces are packed by their numbers and sizes: a piece goes where the count of spans before it says
    sizes = pieces.groupBy(*keys, "session").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("session").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = sizes.select(*(F.col(c).alias(f"_of_{c}") for c in keys), F.col("session").alias("_of_session"), F.floor(before / PACK).alias("_pack"))
    on = F.col("session") == F.col("_of_session")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    kinds = "seq long, depth int, parent_seq long, is_recursive boolean, owner_seq long" + ", above array<bigint>" * callers
    return fold(pieces.join(place, on), [*keys, "_pack"], ["ts", "seq", "end_ts", "name", "_anchor"], partial(stack, callers=callers), kinds).drop("_pack")


def stack_part(rows: list[tuple]) -> Iterable[tuple]:
    """From (ts, seq, end_ts, name, anchor, is_old, reaches) sorted, old ones being spans of earlier stretches that are still open: of the
    others seq, name, parent_seq, base (the old span they stand on), and what lies between: depth, is_recursive, owner_seq, above,
    and for spans that reach into later stretches the names above."""
    open_: list[tuple] = []  # end, seq, name, owner, is_old
    base = 0  # old spans at the bottom of the stack
    for ts, seq, end, name, anchor, is_old, reaches in rows:
        if is_old:
            open_.append((end, seq, name, None, True))
            base += 1
            continue
        while open_ and ts >= open_[-1][0]:
            base -= open_.pop()[4]
        mine = open_[base:]
        owner = seq if anchor else mine[-1][3] if mine else None
        names = [x[2] for x in mine]
        yield seq, name, open_[-1][1] if open_ else None, open_[base - 1][1] if base else None, len(mine), name in names, owner, [x[1] for x in reversed(mine)], names if reaches else None
        open_.append((end, seq, name, owner, False))


def resolved(rows: list[tuple]) -> Iterable[tuple]:
    """From (ts, seq, name, base, depth, owner_seq, above, names) of the spans of a key that reach into later stretches, sorted: seq, depth,
    owner_seq, above, and the names of the span and all above it. A base comes before what stands on it."""
    known: dict[int, tuple] = {}
    for _, seq, name, base, depth, owner, above, names in rows:
        if base is not None:
            b_depth, b_owner, b_above, b_names = known[base]
            depth, owner, above, names = depth + b_depth + 1, owner if owner is not None else b_owner, [*above, base, *b_above], [*names, *b_names]
        known[seq] = depth, owner, above, sorted({name, *names})
        yield seq, *known[seq]


def _nested_by_parts(spans: DataFrame, keys: list[str], cut: int, callers: bool) -> DataFrame:
    """A span that is open where a stretch begins stands at the bottom of the stack there. What a stretch cannot know, the way from
    such a span up, comes from the spans that cross stretches alone: they are few if `cut` is long beside most spans."""
    last = F.ceil(F.col("end_ts") / cut) - 1  # the last stretch that begins before the end
    rows = spans.select(*keys, "ts", "seq", "end_ts", "name", "_anchor", F.floor(F.col("ts") / cut).cast("bigint").alias("_part")).withColumn("_reaches", last > F.col("_part"))
    old = rows.where("_reaches").withColumn("_part", F.explode(F.sequence(F.col("_part") + 1, last.cast("bigint"))))
    both = rows.withColumn("_old", F.lit(False)).unionByName(old.withColumn("_old", F.lit(True)))
    kinds = "seq long, name string, parent_seq long, base long, depth int, is_recursive boolean, owner_seq long, above array<bigint>, names array<string>"
    local = checkpoint(fold(both, [*keys, "_part"], ["ts", "seq", "end_ts", "name", "_anchor", "_old", "_reaches"], stack_part, kinds))
    crossing = local.where("names is not null").join(spans.select(*(F.col(k).alias(f"_of_{k}") for k in keys), F.col("seq").alias("_of_seq"), "ts"), _same(["seq", *keys])).drop(*(f"_of_{k}" for k in ["seq", *keys]))
    up = fold(crossing, keys, ["ts", "seq", "name", "base", "depth", "owner_seq", "above", "names"], resolved, "seq long, depth int, owner_seq long, above array<bigint>, names array<string>")
    up = up.select(*(F.col(k).alias(f"_of_{k}") for k in keys), F.col("seq").alias("_of_base"), F.col("depth").alias("_depth"), F.col("owner_seq").alias("_owner"), F.col("above").alias("_above"), F.col("names").alias("_names"))
    tree = local.join(up, _same(["base", *keys]), "left")
    depth = (F.col("depth") + F.coalesce(F.col("_depth") + 1, F.lit(0))).alias("depth")
    same = (F.col("is_recursive") | F.coalesce(F.array_contains("_names", F.col("name")), F.lit(False))).alias("is_recursive")
    above = F.when(F.col("base").isNull(), F.col("above")).otherwise(F.concat("above", F.array("base"), "_above")).alias("above")
    out = tree.select(*keys, "seq", depth, "parent_seq", same, F.coalesce("owner_seq", "_owner").alias("owner_seq"), above)
    return out if callers else out.drop("above")


def _same(columns: list[str]) -> Column:
    """columns equal their _of_ twins; null keys are keys too."""
    on = F.lit(True)
    for c in columns:
        on = on & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return on


def ancestors(tree: DataFrame, keys: list[str]) -> DataFrame:
    """Rows keys, seq, ancestor_seq, distance of a nested(callers=True) result."""
    return tree.select(*keys, "seq", F.posexplode("above").alias("_p", "ancestor_seq")).select(*keys, "seq", "ancestor_seq", (F.col("_p") + 1).alias("distance"))


def boundary_nodes(tree: DataFrame, keys: list[str], anchors: DataFrame) -> DataFrame:
    """For each anchor the outermost ancestor whose subtree holds the same anchors as the anchor itself.
    anchors: keys, seq. Subtree counts decide, for an ancestor's subtree holds the node's."""
    up = ancestors(tree, keys)
    reach = up.select(*keys, "seq", "ancestor_seq", "distance").unionByName(tree.select(*keys, "seq", F.col("seq").alias("ancestor_seq"), F.lit(0).alias("distance")))
    mine = reach.join(anchors.select(*keys, "seq"), [*keys, "seq"])
    counts = mine.groupBy(*keys, "ancestor_seq").agg(F.count("*").alias("_n"))
    rows = mine.join(counts, [*keys, "ancestor_seq"])
    own = rows.where("distance = 0").select(*keys, "seq", F.col("_n").alias("_own"))
    return rows.join(own, [*keys, "seq"]).where("_n = _own").groupBy(*keys, "seq").agg(F.max_by("ancestor_seq", "distance").alias("boundary_seq"))


def _base(name: Column) -> Column:
    """The part of a name in front of the first dot, null without one."""
    return F.when(name.contains("."), F.split(name, r"\.")[0])


def operators(tree: DataFrame, keys: list[str], layers: DataFrame) -> DataFrame:
    """Below each layer (keys, seq) the first level of spans whose base name differs from the layer's, one for each
    base: keys, layer_seq, seq. tree: nested() with name."""
    named = tree.select(*keys, "seq", _base(F.col("name")).alias("_base"))
    root = layers.join(named, [*keys, "seq"]).select(*keys, F.col("seq").alias("layer_seq"), F.col("_base").alias("_root"))
    below = ancestors(tree, keys).join(root.withColumnRenamed("layer_seq", "ancestor_seq"), [*keys, "ancestor_seq"]).join(named, [*keys, "seq"]).where("_base is not null and _base <> _root")
    w = Window.partitionBy(*keys, "ancestor_seq")
    level = below.withColumn("_l", F.min("distance").over(w)).where("distance = _l")
    return level.groupBy(*keys, F.col("ancestor_seq").alias("layer_seq"), "_base").agg(F.min("seq").alias("seq")).drop("_base")


def named_operators(tree: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """G15 fast path: spans whose name holds one of the given names, of each base name those at its least depth: keys, seq."""
    hit = F.lit(False)
    for n in names:
        hit = hit | F.col("name").contains(n)
    rows = tree.where(hit).select(*keys, "seq", "depth", F.coalesce(_base(F.col("name")), F.col("name")).alias("_base"))
    return rows.withColumn("_least", F.min("depth").over(Window.partitionBy(*keys, "_base"))).where("depth = _least").select(*keys, "seq")


def collapsed(tree: DataFrame, keys: list[str], share: float = 0.8, aggressive: float | None = None) -> DataFrame:
    """Drops wrappers and hangs what is below them on the nearest kept span: keys, seq, parent_seq. A wrapper's children of the
    same base name take over `share` of its time; with `aggressive` (0.9) also a span of whose time any one child takes over that
    share. tree: nested(callers=True) with name and dur."""
    child = tree.where("parent_seq is not null").select(*keys, F.col("parent_seq").alias("_p"), _base(F.col("name")).alias("_cb"), F.col("dur").alias("_cd"))
    rows = tree.select(*keys, "seq", "dur", _base(F.col("name")).alias("_b")).join(child.withColumnRenamed("_p", "seq"), [*keys, "seq"])
    own = F.coalesce(F.sum(F.when(F.col("_cb") == F.col("_b"), F.col("_cd"))) > share * F.max("dur"), F.lit(False))
    if aggressive is not None:
        own = own | (F.max("_cd") > aggressive * F.max("dur"))
    wraps = rows.where("dur > 0").groupBy(*keys, "seq").agg(own.alias("_wrap")).where("_wrap").select(*keys, "seq")
    kept = tree.select(*keys, "seq").join(wraps, [*keys, "seq"], "left_anti")
    up = ancestors(tree, keys).join(kept.withColumnRenamed("seq", "ancestor_seq"), [*keys, "ancestor_seq"])
    parent = up.groupBy(*keys, "seq").agg(F.min_by("ancestor_seq", "distance").alias("parent_seq"))
    return kept.join(parent, [*keys, "seq"], "left")


def cross_language(host: DataFrame, kernels: DataFrame) -> DataFrame:
    """Host spans (pid, tid, seq, ts, end_ts, name, dur, corr: that of runtime calls, else null) and GPU work (pid, seq, name, dur,
    corr) as one tree: pid, tid, seq, parent_seq, name, dur. A runtime call hangs on the span of its thread that holds it, and GPU
    work on the call with its correlation id (of several the last); work without a call hangs on nothing."""
    tree = nested(host, ["pid", "tid"]).select("pid", "tid", "seq", "parent_seq").join(host.select("pid", "tid", "seq", "name", F.col("dur").cast("double").alias("dur"), "corr"), ["pid", "tid", "seq"])
    calls = tree.where("corr is not null").groupBy("pid", "corr").agg(F.max(F.struct("seq", "tid")).alias("_call"))
    work = kernels.select("pid", "seq", "name", F.col("dur").cast("double").alias("dur"), "corr").join(calls, ["pid", "corr"], "left")
    return tree.drop("corr").unionByName(work.select("pid", F.col("_call.tid").alias("tid"), "seq", F.col("_call.seq").alias("parent_seq"), "name", "dur"))


def shapes(rows: list[tuple]) -> Iterable[tuple]:
    """From (seq, parent_seq or -1, name, dur) of a tree: equal neighbouring subtrees under a parent as one line: path, depth, name,
    times, total, idle (time that no child takes). Subtrees are compared by digests, made from the leaves up without recursion."""
    kids: dict[int, list[tuple]] = {}
    for seq, parent, name, dur in rows:
        kids.setdefault(parent, []).append((seq, name, dur))
    order, todo = [], [(s, n) for s, n, _ in kids.get(-1, ())]
    while todo:
        seq, name = todo.pop()
        order.append((seq, name))
        todo += [(s, n) for s, n, _ in kids.get(seq, ())]
    shape: dict[int, bytes] = {}
    for seq, name in reversed(order):  # children come behind their parents in `order`
        shape[seq] = blake2b(b"".join([name.encode(), b"\0", *(shape[s] for s, _, _ in kids.get(seq, ()))]), digest_size=16).digest()
    todo = [("", 0, -1)]
    while todo:
        path, depth, parent = todo.pop()
        lines: list[list] = []
        for seq, name, dur in kids.get(parent, ()):
            if lines and lines[-1][0] == shape[seq]:
                lines[-1][2].append((seq, dur))
            else:
                lines.append([shape[seq], name, [(seq, dur)]])
        for k, (_, name, same) in enumerate(lines):
            here = f"{path}{k:04d}/"
            total = sum(d for _, d in same)
            yield here, depth, name, len(same), total, total - sum(d for s, _ in same for _, _, d in kids.get(s, ()))
            todo.append((here, depth + 1, same[0][0]))


def hierarchy(tree: DataFrame, keys: list[str]) -> DataFrame:
    """The grouped tree of each key (a layer): path, depth, name, times, total, idle. tree: seq, parent_seq, name, dur."""
    rows = tree.withColumn("parent_seq", F.coalesce(F.col("parent_seq"), F.lit(-1)).cast("bigint"))
    return fold(rows, keys, ["seq", "parent_seq", "name", "dur"], shapes, "path string, depth int, name string, times int, total double, idle double")
