"""Substring dedup by level-wise doubling of repeated word windows.

Level one looks at windows of half the target length. Of the half windows inside each target window only the one with
the least hash is an anchor: equal target windows have equal anchors, so a target window can repeat only if its anchor
does. Anchors that occur in one document alone go; around the others windows of twice the length are formed, and
those that another document holds survive. They decide what is removed. From there on the surviving windows that begin at
an anchor are extended to twice their length, level by level, until no candidates survive: that tells how long the
repeated passages are. Exact copies of a text are decided by the text's digest beforehand.

Cases: a null text has no words; a text shorter than the window loses nothing; rows with a null id lose nothing and
remove nothing; repeated rows (equal id and text) don't remove each other; an empty table has no rows; a very long
text is hashed whole, in arrays of eight bytes a word; columns besides doc_id and text are left out, whatever their names;
of an id that has several texts, `longest` holds for all of them together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

WINDOW = 50
#: Bits of the bitmap that preselects documents: 8 MB.
BITMAP = 1 << 26
#: Odd bases of the window polynomials.
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    words, bounds = common.words_of(texts)
    coded = words.dictionary_encode()
    distinct = coded.dictionary.cast(pa.binary()).to_pylist()
    table = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))
    return table[coded.indices.to_numpy(zero_copy_only=False)] if len(distinct) else table, bounds


def window_hashes(words: np.ndarray, length: int, base: np.uint64) -> np.ndarray:
    """A 64-bit hash of each run of `length` words, by prefix sums of a polynomial modulo 2**64."""
    n = len(words)
    if n < length:
        return np.zeros(0, np.uint64)
    inverse = np.uint64(pow(int(base), -1, 2**64))
    power = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)]))
    back = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - length, inverse, np.uint64)]))
    sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(words * power)])
    return _mix((sums[length:] - sums[:-length]) * back)


def _sliding(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over each `width` neighbours, by doubling."""
    have = 1
    while 2 * have <= width:
        x = f(x[: len(x) - have], x[have:])
        have *= 2
    return f(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def inside(bounds: np.ndarray, length: int) -> np.ndarray:
    """Which runs of `length` words lie in one text."""
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    return doc[length - 1 :] == doc[: len(doc) - length + 1] if len(doc) >= length else np.zeros(0, bool)


def anchors(words: np.ndarray, bounds: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the half windows that are least in some window of a text."""
    half = window // 2
    span = window - half + 1  # half windows in a window
    hashes = window_hashes(words, half, _BASES[0]) | np.uint64(1)
    valid = inside(bounds, window)
    if not valid.any():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = np.where(valid, _sliding(hashes, span, np.minimum), np.uint64(0))
    around = np.concatenate([np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)])
    at = np.flatnonzero(_sliding(around, span, np.maximum) == hashes)
    return at, hashes[at]


def _lists(values: np.ndarray, stops: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(stops.astype(np.int32)), pa.array(values, kind))


def _joined(texts: pa.Array) -> list[bytes]:
    return [b" ".join(x.split()) for x in texts.cast(pa.binary()).to_pylist()]


def surveyed(docs: DataFrame, window: int) -> DataFrame:
    """doc_id with n_words, d1 and d2 (the digest of the text), whole (the digest of all words), hashes and places of anchors."""
    def f(texts):
        words, bounds = word_hashes(texts)
        at, hashes = anchors(words, bounds, window)
        stops = np.searchsorted(at, bounds)
        places = at - np.repeat(bounds[:-1], np.diff(stops))
        sums = np.frombuffer(b"".join(hashlib.md5(x).digest() for x in texts.cast(pa.binary()).to_pylist()), np.int64).reshape(-1, 2)
        whole = pa.array([hashlib.sha256(x).hexdigest() for x in _joined(texts)], pa.string())
        return [pa.array(np.diff(bounds)), pa.array(sums[:, 0]), pa.array(sums[:, 1]), whole, _lists(hashes.view(np.int64), stops, pa.int64()), _lists(places.astype(np.int32), stops, pa.int32())]

    added = T.StructType().add("n_words", "long").add("d1", "long").add("d2", "long").add("whole", "string").add("hashes", T.ArrayType(T.LongType())).add("places", T.ArrayType(T.IntegerType()))
    return common.map_texts(docs.select("doc_id", "text"), lambda: f, added)


def extended(docs: DataFrame, window: int) -> DataFrame:
    """From doc_id, text, places (of repeated half windows) the windows whose anchor is one: doc_id, start, h1, h2."""
    half = window // 2
    span = window - half + 1

    def run(batches):
        for batch in batches:
            for part in common.slices(batch, 1):
                words, bounds = word_hashes(pc.fill_null(part.column(1), ""))
                hashes, valid = window_hashes(words, half, _BASES[0]) | np.uint64(1), inside(bounds, window)
                repeated = np.full(len(hashes), np.iinfo(np.uint64).max, np.uint64)
                for i, places in enumerate(part.column(2)):
                    at = bounds[i] + np.asarray(places.values)
                    at = at[at < min(bounds[i + 1], len(hashes))]  # rows of one id may differ in text
                    repeated[at] = hashes[at]
                start = np.zeros(0, np.int64)
                if valid.any():
                    start = np.flatnonzero((_sliding(repeated, span, np.minimum) == _sliding(hashes, span, np.minimum)) & valid)
                doc = (np.searchsorted(bounds, start, side="right") - 1).astype(np.int64)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                first, second = (window_hashes(words, window, b)[start] if len(start) else np.zeros(0, np.uint64) for b in _BASES)
                yield pa.RecordBatch.from_arrays([pa.array(ids[doc], pa.int64()), pa.array((start - bounds[doc]).astype(np.int32)), pa.array(first.view(np.int64)), pa.array((second >> np.uint64(32)).astype(np.uint32).view(np.int32))], names=["doc_id", "start", "h1", "h2"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "places").mapInArrow(run, "doc_id long, start int, h1 long, h2 int")


def among(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and text of the documents whose id may be among `ids` (column _id): a bitmap of BITMAP bits, which never
    grows, drops most others before their texts are shuffled. With very many ids it passes all, which costs time alone."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(BITMAP))
    words = ids.select(F.shiftright(place("_id"), 6).alias("word"), F.expr(f"shiftleft(1L, CAST(pmod(xxhash64(_id), {BITMAP}) & 63 AS INT))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    bitmap = np.zeros(BITMAP >> 6, np.uint64)
    bitmap[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        bits = shared.value
        for batch in batches:
            at = batch.column(2).to_numpy(zero_copy_only=False)
            keep = bits[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)
            yield batch.select([0, 1]).filter(pa.array(keep.astype(bool)))

    return docs.where("doc_id is not null").select("doc_id", "text", place("doc_id").alias("_at")).mapInArrow(run, "doc_id long, text string")


def reduced(docs: DataFrame, window: int) -> DataFrame:
    """From doc_id, text, starts (of windows to remove) doc_id, n_removed, kept_text."""
    def run(batches):
        for batch in batches:
            for part in common.slices(batch, 1):
                gone, kept = [], []
                for text, starts in zip(part.column(1).cast(pa.binary()).to_pylist(), part.column(2), strict=True):
                    words = text.split()
                    edge, at = np.zeros(len(words) + 1, np.int64), np.asarray(starts.values)
                    at = at[at + window <= len(words)]  # rows of one id may differ in text
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                    stay = np.flatnonzero(np.cumsum(edge)[:-1] == 0).tolist()
                    gone.append(len(words) - len(stay))
                    kept.append(b" ".join([words[i] for i in stay]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_removed", "kept_text"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "starts").mapInArrow(run, "doc_id long, n_removed long, kept_text string")


def repeated(docs: DataFrame, survey: DataFrame, window: int, reps: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The texts that may hold repeated windows, the places of their repeated anchors (_id, places), and the windows that two
    documents hold: doc_id, start, h1, h2, first (the smallest id that holds the same). reps: the ids (rep) that are looked at."""
    # level one: anchors that at least two different texts hold
    marks = survey.where("doc_id is not null").select("doc_id", "d1", F.explode(F.arrays_zip("hashes", "places")).alias("x")).select("doc_id", "d1", F.col("x.hashes").alias("h"), F.col("x.places").alias("place"))
    by = "d1" if reps is not None else "doc_id"
    again = marks.groupBy(F.col("h").alias("_h")).agg(F.min(by).alias("_a"), F.max(by).alias("_b")).where("_a < _b").select("_h")
    again = common.checkpoint(again)  # by itself, so that the join may split a hot anchor
    places = marks.drop("d1").join(again, F.col("h") == F.col("_h")).groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set("place").alias("places"))
    places = common.checkpoint(places if reps is None else places.join(reps, F.col("_id") == F.col("rep"), "left_semi"))
    # level two: windows of twice the length around them, without a copy of them on disk
    texts = among(docs, places)
    return texts, places, _held(extended(texts.join(places, F.col("doc_id") == F.col("_id")), window))


def _held(windows: DataFrame) -> DataFrame:
    """Of windows with doc_id, h1, h2 those that two documents hold, with the smaller id as `first`."""
    held = windows.groupBy(F.col("h1").alias("_h1"), F.col("h2").alias("_h2")).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("_b")).where("first < _b").drop("_b")
    held = common.checkpoint(held)  # by itself, so that the join may split a hot window
    return windows.join(held, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))).drop("_h1", "_h2")


def chains(found: DataFrame, places: DataFrame | None, window: int) -> tuple[DataFrame, DataFrame]:
    """From repeated windows doc_id, start, h1, h2, first: the starts of those that a smaller id holds too (_id, starts), and the levels of
    each window that begins at a place (places: _id, places; None: at any start): doc_id, start, and in h1s, h2s its hash and those
    of twice, four times ... the length, as long as repeated windows follow each other. A longer window's hash is made of those
    of its halves. The windows of a document meet once, packed into two numbers each; what is written is far less."""
    last = (F.shiftleft(F.col("h2").cast("long"), 32) + F.col("start") * 2 + (F.col("doc_id") > F.col("first")).cast("int")).alias("b")
    per = found.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("h1").alias("a"), last)).alias("found"))
    per = per.join(places, F.col("doc_id") == F.col("_id")) if places is not None else per.withColumn("places", F.lit(None).cast("array<int>"))
    names = ["doc_id", "starts", "place", "offset", "reach", "h1", "h2"]

    def run(batches):
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                each = batch.column(1)[k].values
                a, b = (each.field(f).to_numpy(zero_copy_only=False) for f in (0, 1))
                low = b & 0xFFFFFFFF
                later = np.unique(low[low & 1 == 1] >> 1)
                start, at = np.unique(low >> 1, return_index=True)
                one, two = a[at].view(np.uint64), (b[at] >> 32).view(np.uint64)
                mine = np.flatnonzero(np.isin(start, np.asarray(batch.column(2)[k].values))) if batch.column(2)[k].is_valid else np.arange(len(start))
                alive, levels, length = np.ones(len(start), bool), [], window
                while alive[mine].any():
                    levels.append((alive[mine], one[mine], two[mine]))
                    nxt = np.minimum(np.searchsorted(start, start + length), len(start) - 1)
                    alive = alive & (start[nxt] == start + length) & alive[nxt]
                    one, two = _mix(one * _BASES[0] ^ one[nxt]), _mix(two * _BASES[1] ^ two[nxt])
                    length *= 2
                on = np.array([x[0] for x in levels], bool).T.reshape(len(mine), len(levels))  # a place by level; levels of a place have no holes
                reach = on.sum(axis=1)
                flat = [np.array([x[j] for x in levels], np.uint64).T.reshape(on.shape)[on].view(np.int64) for j in (1, 2)]
                out.append((batch.column(0)[k].as_py(), later, start[mine], np.cumsum(reach) - reach, reach, *flat))
            kinds = [pa.int64(), *(pa.list_(t) for t in (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], names=names)

    kept = common.checkpoint(per.select("doc_id", "found", "places").mapInArrow(run, "doc_id long, starts array<int>, place array<int>, offset array<int>, reach array<int>, h1 array<long>, h2 array<long>"))
    rows = kept.select("doc_id", "h1", "h2", F.explode(F.arrays_zip("place", "offset", "reach")).alias("x"))
    part = lambda c: F.slice(c, F.col("x.offset") + 1, F.col("x.reach"))
    return kept.where("size(starts) > 0").select(F.col("doc_id").alias("_id"), "starts"), rows.select("doc_id", F.col("x.place").alias("start"), part("h1").alias("h1s"), part("h2").alias("h2s"))


def doubled(chained: DataFrame, length: int) -> Iterator[tuple[int, DataFrame]]:
    """The repeated windows of `length` words, then of twice, four times ... as many, each level made from the windows that the one
    before has left, until none is left: the length, and doc_id, start, h1, h2, first of its windows."""
    left, level = chained, 0
    while True:
        rows = left.where(F.size("h1s") > level).withColumn("h1", F.col("h1s")[level]).withColumn("h2", F.col("h2s")[level])
        left = common.checkpoint(_held(rows.select("doc_id", "start", "h1s", "h2s", "h1", "h2")))
        if left.isEmpty():
            return
        yield length << level, left
        left, level = left.drop("h1", "h2", "first"), level + 1


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows doc_id, n_words, n_removed, kept_text (null where nothing or everything goes), kept_sha256, longest (the largest
    doubled length of which a window that begins at an anchor of the document also stands in a document with a smaller id; of a
    copy the largest that fits; null: none)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    survey = common.checkpoint(surveyed(docs, window))
    # of exact copies the first alone is looked at; digests of one row need no join, and a hot one can be split
    copied = common.checkpoint(survey.groupBy(F.col("d1").alias("_d1"), F.col("d2").alias("_d2")).agg(F.min("doc_id").alias("rep"), F.count("*").alias("_n")).where("_n > 1").drop("_n"))
    rows = survey.drop("hashes", "places").join(copied, (F.col("d1") == F.col("_d1")) & (F.col("d2") == F.col("_d2")), "left")
    rows = common.checkpoint(rows.select("doc_id", "n_words", "whole", F.coalesce("rep", "doc_id").alias("rep")))
    texts, places, found = repeated(docs, survey, window, rows.where("doc_id = rep").select("rep"))
    starts, chained = chains(found, places, window)
    cut = reduced(texts.join(starts, F.col("doc_id") == F.col("_id")), window).select(F.col("doc_id").alias("_id"), "n_removed", "kept_text", F.sha2("kept_text", 256).alias("_sha")).dropDuplicates(["_id", "_sha"])
    # further levels, until no candidates survive
    reach = docs.sparkSession.createDataFrame([], "_doc long, longest long")
    for length, level in doubled(chained, window):
        reach = reach.unionByName(level.where("doc_id > first").select(F.col("doc_id").alias("_doc"), F.lit(length).cast("long").alias("longest")).distinct())
    reach = reach.groupBy("_doc").agg(F.max("longest").alias("_longest"))
    rows = rows.join(cut, F.col("doc_id") == F.col("_id"), "left").join(reach, F.col("doc_id") == F.col("_doc"), "left")
    copy = (F.col("doc_id") > F.col("rep")) & (F.col("n_words") >= window)
    all_of_it = F.lit(window) * F.expr(f"shiftleft(1L, length(bin(n_words div {window})) - 1)")
    return rows.select(
        "doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"), "kept_text",
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("_sha", "whole")).alias("kept_sha256"), F.when(copy, all_of_it).otherwise(F.col("_longest")).alias("longest"),
    )


def levels(docs: DataFrame, start: int = WINDOW // 2) -> list[tuple[int, int]]:
    """Window lengths from `start`, doubled as long as windows repeat between documents, with the number of distinct windows
    of that length that do, wherever they begin."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    _, _, found = repeated(docs, common.checkpoint(surveyed(docs, start)), start)
    _, chained = chains(found, None, start)
    return [(length, level.select("h1", "h2").distinct().count()) for length, level in doubled(chained, start)]
