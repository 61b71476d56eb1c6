"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into three segments of at most 23 bits. The binary Golay code is perfect: each segment
has exactly one codeword within three bits, and those at exactly three have five more at four bits. Two segments that
differ in one bit at most therefore share a codeword if one side gives the nearest and the other all within four bits.

Of two fingerprints that differ in at most three bits either two segments are equal, or one is equal and another differs
in one bit, or each differs in one. So there are three kinds of keys: two whole segments; a whole segment and a codeword
of another; a codeword of each segment. Keys have 33 bits at least, so N fingerprints meet about N * N / 1.7e8 others by
chance. Which side gives all codewords of a segment is dealt out so that both sides have few keys (27 and 51). A
comparison of all 64 bits decides. Components of the links come from alternating large and small stars.

Cases: null and empty texts have fingerprint zero and link to each other; repeated rows and equal texts share a
fingerprint, so they are expanded only in the last join; null ids take part in links but never name a component (a
component of null ids alone has a null name); an empty table has no rows; texts of any length are read whole; other
columns, whatever their names, stay or are left out as the functions say.
"""

from __future__ import annotations

from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SHINGLE, SEED, DISTANCE = 3, 42, 3
#: Width and place of each segment.
SEGMENTS = ((22, 42), (21, 21), (21, 0))
#: Fixed value: the generator polynomial of the (23, 12) Golay code.
GENERATOR = 0b101011100011
#: Fingerprints expanded at once.
RUN = 4096

#: Each bit of a byte in a lane of its own, to sum up to 255 bytes in one word.
_LANES = np.array([sum((v >> j & 1) << 8 * j for j in range(8)) for v in range(256)], np.uint64)


def shingle_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of all word shingles, repeats included, and where each text's begin. A text of fewer words has one."""
    words, bounds = common.words_of(pc.ascii_lower(texts))
    spaced = pc.binary_join_element_wise(words, pa.scalar(""), " ")
    at, data = common.offsets_of(spaced), bytes(common.bytes_of(spaced))
    n = np.diff(bounds)
    count = np.where(n > 0, np.maximum(n - SHINGLE + 1, 1), 0)
    stop = np.concatenate([[0], np.cumsum(count)])
    first = np.arange(stop[-1]) - np.repeat(stop[:-1], count) + np.repeat(bounds[:-1], count)
    last = np.minimum(first + SHINGLE, np.repeat(bounds[1:], count))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(data[a:b], SEED) for a, b in zip(at[first].tolist(), (at[last] - 1).tolist(), strict=True)), np.uint64, len(first))
    return hashes, stop


def fingerprints(texts: pa.Array) -> np.ndarray:
    """The fingerprint of each text; a bit is 1 if set in over half its hashes."""
    hashes, stop = shingle_hashes(texts)
    n, out = np.diff(stop), np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    pieces = -(-n[full] // 255)  # runs of at most 255 hashes
    begin = np.cumsum(pieces) - pieces
    run = np.arange(pieces.sum()) - np.repeat(begin, pieces)
    lanes = np.add.reduceat(_LANES[hashes.view(np.uint8).reshape(-1, 8)], np.repeat(stop[:-1][full], pieces) + 255 * run, axis=0)
    counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 64).astype(np.int64), begin, axis=0)
    bits = 2 * counts > n[full][:, None]
    out[full] = (bits.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return out


def fingerprinted(docs: DataFrame, text: str = "text", drop_text: bool = True) -> DataFrame:
    """Add fp (long: the 64 bits)."""
    return common.map_texts(docs, lambda: lambda texts: [pa.array(fingerprints(texts).view(np.int64))], T.StructType().add("fp", "long"), text, drop_text)


def _syndrome(x: np.ndarray) -> np.ndarray:
    x = x.copy()
    for k in range(22, 10, -1):
        x = np.where(x >> k & 1, x ^ GENERATOR << k - 11, x)
    return x


def golay() -> np.ndarray:
    """For each syndrome the error patterns of the codewords within four bits, the nearest first; -1 where there are fewer."""
    table, used = np.full((2048, 6), -1, np.int64), np.zeros(2048, np.int64)
    for weight in range(5):
        patterns = np.array([sum(1 << k for k in c) for c in combinations(range(23), weight)], np.int64)
        for s, e in zip(_syndrome(patterns).tolist(), patterns.tolist(), strict=True):
            if used[s] < 6:
                table[s, used[s]] = e
                used[s] += 1
    return table


def codewords(fps: np.ndarray, table: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Each segment, and the numbers (12 bits) of its codewords within four bits, the nearest first; -1 where there are fewer."""
    segments, numbers = [], []
    for width, place in SEGMENTS:
        segment = (fps >> np.uint64(place)).astype(np.int64) & (1 << width) - 1
        errors = table[_syndrome(segment)]
        segments.append(segment)
        numbers.append(np.where(errors < 0, -1, (segment[:, None] ^ errors) >> 11))
    return segments, numbers


def keys(fps: np.ndarray, table: np.ndarray, one: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions in fps and their keys: the kind from bit 48 on, below it segments and codeword numbers. Side `one` gives all
    codewords of a segment where the other side gives the nearest, and the reverse."""
    segments, numbers = codewords(fps, table)
    whole = lambda i: (segments[i][:, None], 22)
    code = lambda j, every: (numbers[j] if every else numbers[j][:, :1], 12)
    kinds = [(whole(i), whole(j)) for i, j in combinations(range(3), 2)]
    kinds += [(whole(i), code(j, one == (i < j))) for i, j in permutations(range(3), 2)]
    kinds.append(tuple(code(j, one == (j == 0)) for j in range(3)))
    rows, out = [], []
    for kind, parts in enumerate(kinds):
        key, ok = np.zeros((len(fps), 1), np.int64), np.ones((len(fps), 1), bool)
        for values, width in parts:
            key = (key[:, :, None] << width | np.maximum(values, 0)[:, None, :]).reshape(len(fps), -1)
            ok = (ok[:, :, None] & (values >= 0)[:, None, :]).reshape(len(fps), -1)
        at = np.nonzero(ok)
        rows.append(at[0])
        out.append(key[at] | kind << 48)
    return np.concatenate(rows), np.concatenate(out)


def keyed(fps: DataFrame, one: bool, name: str) -> DataFrame:
    """Rows key, name for distinct fingerprints in column fp."""
    def run(batches):
        table = golay()
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(x), RUN):
                part = x[i : i + RUN]
                at, key = keys(part.view(np.uint64), table, one)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[at])], names=["key", name])

    return fps.select("fp").mapInArrow(run, f"key long, {name} long")


def links(fps: DataFrame) -> DataFrame:
    """All pairs a < b of distinct fingerprints that differ in at most DISTANCE bits."""
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)
    return keyed(fps, True, "a").join(keyed(fps, False, "b").withColumnRenamed("key", "_key"), (F.col("key") == F.col("_key")) & near).select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Rows v, root: each vertex of the edges (a, b) that isn't the smallest of its component, and that smallest."""
    def state(df):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first())

    def stars(df, large):
        ends = df.unionByName(df.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = ends.groupBy(F.col("a").alias("_a")).agg(F.min("b").alias("m")).withColumn("m", F.least("m", "_a"))
        least = common.checkpoint(least)  # by itself, so that the join may split a vertex with very many links
        moved = ends.join(least, F.col("a") == F.col("_a"))
        if large:
            out = moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("_a").alias("a"), F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    edges = common.checkpoint(edges)
    before, now = None, state(edges)
    while now != before:
        edges = common.checkpoint(stars(stars(edges, True), False))
        before, now = now, state(edges)
    return edges.select(F.col("a").alias("v"), F.col("b").alias("root"))


def _grouped(docs: DataFrame, id: str, text: str, *more: str) -> DataFrame:
    """Rows id, more, fp, root (one value for each component), component_id."""
    prints = common.checkpoint(fingerprinted(docs.select(id, text, *more), text))
    fps = common.checkpoint(prints.groupBy("fp").agg(F.min(id).alias("rep")))
    n = fps.count()
    roots = components(links(fps))
    rooted = common.checkpoint(fps.join(roots, F.col("fp") == F.col("v"), "left").select("fp", "rep", F.coalesce("root", "fp").alias("root")))
    names = common.checkpoint(rooted.groupBy("root").agg(F.min("rep").alias("component_id")))  # so that the join may split a giant component
    named = common.checkpoint(rooted.select(F.col("fp").alias("_fp"), "root").join(names, "root").select("_fp", "root", "component_id"))
    return prints.join(common.small(named, n, 32), F.col("fp") == F.col("_fp")).select(id, *more, "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows id, fp, component_id (the smallest id that links reach). Other columns are left out."""
    return _grouped(docs.select(F.col(f"`{id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), "doc_id", "text").select(F.col("doc_id").alias(id), "fp", "component_id")


def representatives(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component: one with the smallest id, or with a null id if it has no other. Columns stay.
    Of several such rows that with the least hash of its text stays; rows of equal id and text are repeats, and any one stays."""
    h, g, p_id, p_h, p_g = common.free(docs.columns, "_h", "_g", "p_id", "p_h", "p_g")
    plain = docs.select(F.col(f"`{id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.xxhash64(text).alias("h"), F.hash(text).alias("g"))
    rows = _grouped(plain, "doc_id", "text", "h", "g").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    found = rows.groupBy("root").agg(F.min(F.struct("doc_id", "h", "g")).alias("x")).select(F.col("x.doc_id").alias(p_id), F.col("x.h").alias(p_h), F.col("x.g").alias(p_g))
    mine = docs.withColumns({h: F.xxhash64(text), g: F.hash(text)})
    same = F.col(f"`{id}`").eqNullSafe(F.col(p_id)) & (F.col(h) == F.col(p_h)) & (F.col(g) == F.col(p_g))
    return mine.join(found, same).dropDuplicates([id, h, g]).select(*(F.col(f"`{c}`") for c in docs.columns))
