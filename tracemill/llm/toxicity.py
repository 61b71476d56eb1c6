"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A word is a run of letters and digits, lower-cased. Features are the presence of words, of their first four and five
characters (word stems, for inflected forms), of adjacent pairs and of pairs that skip one word, hashed to 2**BITS
places. Training goes through a bounded sample of labelled documents, EPOCHS times in the order of a hash of their
ids, in one task; per-coordinate rates and L1 leave few weights, which are broadcast.

Cases: a null or empty text has no features, so its score is that of the bias; ids, languages and sources are never
inputs; without labelled rows all scores are 0.5; an id is one row of the sample, however often it stands in the table; a score
at the threshold is predicted 1; any length is scored whole; an empty table has no rows; all columns but the text stay, those
with the name of an output are replaced. A null id is not held out, nor does it lend a label.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

BITS, EPOCHS, ALPHA, BETA, L1, L2 = 20, 6, 0.4, 1.0, 5.0, 0.1
SAMPLE_ROWS = 10_000
THRESHOLD = 0.7

_TOKEN = re.compile(r"[^\W_]+")
#: Odd multipliers, one for each kind of feature.
_KIND = [np.uint64((2 * k + 1) * 0x9E3779B97F4A7C15 % 2**64) for k in range(5)]


def _hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The text and the place of each feature occurrence in the texts."""
    words, bounds = common.words_of(texts)
    coded = words.dictionary_encode()
    parts = [_TOKEN.findall(w.lower()) for w in coded.dictionary.to_pylist()]
    table = np.array([[_hash(t), _hash(t[:4]) if len(t) > 4 else 0, _hash(t[:5]) if len(t) > 5 else 0] for p in parts for t in p], np.uint64).reshape(-1, 3)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    at = np.cumsum(sizes) - sizes
    index = coded.indices.to_numpy(zero_copy_only=False)
    each = sizes[index]
    stop = np.concatenate([[0], np.cumsum(each)])
    token = np.arange(stop[-1]) - np.repeat(stop[:-1], each) + np.repeat(at[index], each)
    h, stem4, stem5 = table[token].T if len(token) else np.zeros((3, 0), np.uint64)
    doc = np.repeat(np.arange(len(texts)), np.diff(stop[bounds]))
    two, skip = doc[1:] == doc[:-1], doc[2:] == doc[:-2]
    found = [(doc, h * _KIND[0]), (doc[stem4 != 0], stem4[stem4 != 0] * _KIND[1]), (doc[stem5 != 0], stem5[stem5 != 0] * _KIND[2])]
    turn = h * np.uint64(0xC2B2AE3D27D4EB4F) ^ h >> np.uint64(29)
    found += [(doc[1:][two], ((turn[:-1] + h[1:]) * _KIND[3])[two]), (doc[2:][skip], ((turn[:-2] + h[2:]) * _KIND[4])[skip])]
    return np.concatenate([d for d, _ in found]), (np.concatenate([x for _, x in found]) >> np.uint64(64 - BITS)).astype(np.int64)


def packed(texts: pa.Array) -> pa.Array:
    """The distinct places of each text as packed 32-bit integers."""
    doc, at = features(texts)
    key = np.unique(doc << BITS | at)
    bounds = np.searchsorted(key, np.arange(len(texts) + 1) << BITS)
    at = (key & (1 << BITS) - 1).astype("<u4")
    return pa.array([at[bounds[i] : bounds[i + 1]].tobytes() for i in range(len(texts))], pa.binary())


def ftrl(rows: list[tuple[bytes, int]]) -> np.ndarray:
    """Weights of each place, the bias last, from packed places and labels."""
    z, n, w = (np.zeros((1 << BITS) + 1) for _ in range(3))
    ones = sum(label for _, label in rows)
    weight = max(1.0, (len(rows) - ones) / ones) ** 0.5 if ones else 1.0  # the rarer toxic rows count more
    for _ in range(EPOCHS):
        for places, label in rows:
            at = np.append(np.frombuffer(places, "<u4"), np.uint32(1 << BITS))
            wx = w[at]
            g = (1 / (1 + np.exp(-np.clip(wx.sum(), -35, 35))) - label) * (weight if label else 1)
            nx, zx = n[at], z[at]
            root = np.sqrt(nx + g * g)
            zx += g - (root - np.sqrt(nx)) / ALPHA * wx
            n[at], z[at] = nx + g * g, zx
            w[at] = np.where(np.abs(zx) <= L1, 0, (np.sign(zx) * L1 - zx) / ((BETA + root) / ALPHA + L2))
    return w


def fit(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the non-zero weights, from doc_id, text, label rows of bounded number."""
    placed = common.map_texts(sample.select("doc_id", "label", "text"), lambda: lambda texts: [packed(texts)], T.StructType().add("places", "binary"))

    def train(batches):
        rows = []
        for b in batches:
            for i, label, places in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                rows.append((xxhash.xxh3_64_intdigest(str(i)), places, label))
        rows.sort(key=lambda r: r[:2])
        w = ftrl([(p, y) for _, p, y in rows])
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w[at], pa.float64())], names=["place", "weight"])

    got = placed.repartition(1).mapInArrow(train, "place long, weight double").toPandas()
    return got["place"].to_numpy(np.int64), got["weight"].to_numpy(np.float64)


def scorer(weights: tuple[np.ndarray, np.ndarray]):
    """A function from texts to scores."""
    dense = np.zeros((1 << BITS) + 1, np.float32)
    dense[weights[0]] = weights[1]

    def f(texts):
        doc, at = features(texts)
        some = dense[at] != 0
        key = np.unique(doc[some] << BITS | at[some])
        total = np.bincount(key >> BITS, dense[key & (1 << BITS) - 1], len(texts)) + dense[-1]
        return [pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))]

    return f


def score(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray], text: str = "text", drop_text: bool = True) -> DataFrame:
    """Add score (double, 0 to 1). The weights are few and go to each worker."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    return common.map_texts(docs, lambda: scorer(shared.value), T.StructType().add("score", "double"), text, drop_text)


def train_split(doc_id):
    """Which documents may lend their labels."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, drop_text: bool = True) -> DataFrame:
    """Score documents (doc_id, text, ...) with weights fitted on at most `rows` labelled ones: adds held_out, score, predicted."""
    weights = fit(common.labelled_sample(docs, labels, "toxic", rows, train_split))
    out = score(docs, weights, drop_text=drop_text)
    return out.withColumn("held_out", F.coalesce(~train_split(F.col("doc_id")), F.lit(False))).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
