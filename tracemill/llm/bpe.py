"""Byte-level BPE encoding and decoding.

A pre-token is looked up in two tiers. A minimal perfect hash over the vocabulary (hash and displace: each bucket of
keys stores the displacement that puts all its keys on free slots) gives the one slot where a pre-token could be; an
exact comparison with the slot's key decides. Pre-tokens that are not in the vocabulary are merged with a heap of
candidate pairs over a linked list of byte positions. Repeated chunks of texts are resolved once.

Cases: a null text is an empty text and has no ids; any text decodes to its own UTF-8 bytes; very long texts are
processed in runs of pre-tokens; repeated rows and empty tables need nothing special; other columns are kept, except
those named like an output.
"""

from __future__ import annotations

import base64
import heapq
import re
import struct
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common

#: Pre-tokens resolved at once.
RUN = 300_000
#: Chunks, and pre-tokens, that a generation of a worker's memory holds, and the longest of them.
CHUNKS, PIECES, MEMO_CHARS = 50_000, 200_000, 64


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file in order of their ids, which count up from 0."""
    with open(path, "rb") as f:
        pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in (line.split() for line in f if line.strip()))
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks must count up from 0")
    return [t for _, t in pairs]


class PerfectHash:
    """Minimal perfect hash of distinct byte strings."""

    def __init__(self, keys: list[bytes], load: int = 4):
        n = self.n = len(keys)
        self.buckets = max(1, n // load)
        h = self.hashes(keys)
        bucket, f, g = self._parts(h)
        order = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        self.d0, self.d1 = np.zeros(self.buckets, np.int64), np.zeros(self.buckets, np.int64)
        taken, slot = np.zeros(2 * n, bool), np.zeros(n, np.int64)
        for b in np.argsort(-np.diff(bounds), kind="stable"):
            mine = order[bounds[b] : bounds[b + 1]]
            if not len(mine):
                break
            for d0 in range(n + 1):
                at = (f[mine] + d0 * g[mine]) % n
                if len(np.unique(at)) < len(mine):
                    continue
                clash = np.zeros(n, bool)
                for p in at:
                    clash |= taken[p : p + n]
                d1 = int(np.argmin(clash))
                if not clash[d1]:
                    break
            else:
                raise ValueError("keys are not distinct")
            slot[mine] = at = (at + d1) % n
            taken[at] = taken[at + n] = True
            self.d0[b], self.d1[b] = d0, d1
        self.key_at = np.zeros(n, np.int64)
        self.key_at[slot] = np.arange(n)

    @staticmethod
    def hashes(keys) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))

    def _parts(self, h: np.ndarray):
        n = np.uint64(self.n)
        return (h % np.uint64(self.buckets)).astype(np.int64), ((h >> np.uint64(20)) % n).astype(np.int64), ((h >> np.uint64(41)) % (n - np.uint64(1)) + np.uint64(1) if self.n > 1 else np.ones_like(h)).astype(np.int64)

    def candidates(self, keys) -> np.ndarray:
        """For each key the position of the only stored key that could equal it."""
        bucket, f, g = self._parts(self.hashes(keys))
        return self.key_at[(f + self.d0[bucket] * g + self.d1[bucket]) % self.n]


class Memo:
    """What strings resolve to, in two generations: when the young one is full, it becomes the old one, which goes.
    Strings in use stay, and no more than two generations of strings of at most MEMO_CHARS characters are held."""

    def __init__(self, most: int):
        self.most = most
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def resolve(self, keys: list[str], make) -> list[bytes]:
        """The value of each of the distinct keys; make() gives those of the keys that are not held."""
        found, young, old = list(map(self.young.get, keys)), self.young, self.old
        gone = []
        for i in [i for i, v in enumerate(found) if v is None]:
            if (v := old.get(keys[i])) is None:
                gone.append(i)
            else:
                found[i] = young[keys[i]] = v
        if gone:
            made = [keys[i] for i in gone]
            for i, key, v in zip(gone, made, make(made), strict=True):
                found[i] = v
                if len(key) <= MEMO_CHARS:
                    young[key] = v
        if len(young) > self.most:
            self.young, self.old = {}, young
        return found


class ByteBPE:
    """Encoder and decoder over a rank list and a pre-token pattern."""

    def __init__(self, tokens: list[bytes], pattern: str, table: PerfectHash):
        self.tokens, self.table = pa.array(tokens, pa.binary()), table
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.pattern = regex.compile(pattern)
        self.chunk_memo, self.piece_memo = Memo(CHUNKS), Memo(PIECES)
        self.loose = re.compile(r" (?:\s|\Z)|\0").search

    def merge(self, piece: bytes) -> bytes:
        """Packed ids of a pre-token: merge the pair of lowest rank, the leftmost first, until no pair has a rank."""
        get, n = self.rank.get, len(piece)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that begins here; where the one before begins
        pair = [get(piece[i : i + 2], -1) for i in range(n - 1)]  # rank of the part that begins here with the next
        pair.append(-1)
        heap = [r * n + i for i, r in enumerate(pair) if r >= 0]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            r, i = divmod(pop(heap), n)
            if pair[i] != r:
                continue
            mid = end[i]
            stop = end[i] = end[mid]
            pair[mid] = pair[i] = -1
            if stop < n:
                before[stop] = i
                if (r := get(piece[i : end[stop]], -1)) >= 0:
                    pair[i] = r
                    push(heap, r * n + i)
            if (p := before[i]) >= 0:
                r = pair[p] = get(piece[p:stop], -1)
                if r >= 0:
                    push(heap, r * n + p)
        ids, i = [], 0
        while i < n:
            ids.append(get(piece[i : end[i]]))
            i = end[i]
        return struct.pack(f"<{len(ids)}I", *ids)

    def pieces(self, distinct: list[str]) -> list[bytes]:
        """The packed ids of each pre-token: those of the vocabulary by the perfect hash, the others by merging."""
        keys = pa.array(distinct, pa.string()).cast(pa.binary())
        raw = keys.to_pylist()
        at = self.table.candidates(raw)
        whole = at.astype("<u4").tobytes()
        out = [whole[i : i + 4] for i in range(0, len(whole), 4)]
        for i in np.flatnonzero(~pc.equal(self.tokens.take(pa.array(at)), keys).to_numpy(zero_copy_only=False)).tolist():
            out[i] = self.merge(raw[i])
        return out

    def split(self, chunks: list[str]) -> list[bytes]:
        """The packed ids of each chunk, from those of its pre-tokens."""
        found = list(map(self.pattern.findall, chunks))
        distinct = list(dict.fromkeys(chain.from_iterable(found)))
        ids = dict(zip(distinct, self.piece_memo.resolve(distinct, self.pieces), strict=True))
        return [ids[x[0]] if len(x) == 1 else b"".join([ids[p] for p in x]) for x in found]

    def ids(self, chunks: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """Where the ids of each chunk begin (one more at the end), and all ids; distinct chunks are resolved once."""
        coded = chunks.dictionary_encode()
        packed = self.chunk_memo.resolve(coded.dictionary.to_pylist(), self.split)
        stops = np.cumsum([0, *map(len, packed)]) // 4
        lists = pa.ListArray.from_arrays(pa.array(stops.astype(np.int32)), pa.array(np.frombuffer(b"".join(packed), "<u4"))).take(coded.indices)
        return np.asarray(lists.offsets, np.int64), lists.values

    def long(self, text: str) -> bytes:
        """The packed ids of a very long text, a run of pre-tokens at a time."""
        rest, runs = (m.group() for m in self.pattern.finditer(text)), []
        while part := list(islice(rest, RUN)):
            runs.append(self.ids(pa.array(part, pa.string()))[1].to_numpy(zero_copy_only=False).tobytes())
        return b"".join(runs)

    def together(self, lists: pa.ListArray) -> list[bytes]:
        """The packed ids of texts that are given as lists of chunks."""
        if not len(lists):
            return []
        at, flat = self.ids(lists.flatten())
        data = memoryview(flat.to_numpy(zero_copy_only=False)).cast("B")
        bounds = np.asarray(lists.offsets, np.int64)
        stop = (4 * at[bounds - bounds[0]]).tolist()
        return [bytes(data[a:b]) for a, b in zip(stop[:-1], stop[1:], strict=True)]

    def encode(self, texts: pa.Array | list[str]) -> pa.Array:
        """The ids of each text as little-endian unsigned 32-bit integers, packed.

        A text is cut before each space that begins a pre-token: where no space stands before white space or the end,
        that is each space. Other texts are cut into their pre-tokens."""
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        said = texts.to_pylist()
        out, tight, loose = [None] * len(said), [], []
        for i, text in enumerate(said):
            if len(text) > 20 * RUN:
                out[i] = self.long(text)
            elif self.loose(text):
                loose.append(i)
            else:
                tight.append(i)
        some = texts if len(tight) == len(said) else texts.take(pa.array(tight, pa.int64()))
        cut = self.together(pc.split_pattern(pc.replace_substring(some, " ", "\0 "), "\0"))
        found = self.together(pa.array([self.pattern.findall(said[i]) for i in loose], pa.list_(pa.string())))
        for i, x in chain(zip(tight, cut, strict=True), zip(loose, found, strict=True)):
            out[i] = x
        return pa.array(out, pa.binary())

    def decode(self, packed: pa.Array) -> pa.Array:
        """The bytes that packed ids stand for."""
        out = []
        for x in packed:
            got = self.tokens.take(pa.array(np.frombuffer(x.as_buffer(), "<u4")))
            at = common.offsets_of(got)
            out.append(bytes(common.bytes_of(got)[at[0] : at[-1]]))
        return pa.array(out, pa.binary())


class Vocabulary:
    """What goes to the workers. Each worker builds its encoder once and keeps it, memos included, from task to task."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.parts, self.made = (tokens, pattern, PerfectHash(tokens)), None

    def __getstate__(self):
        return {"parts": self.parts, "made": None}

    def encoder(self) -> ByteBPE:
        if self.made is None:
            self.made = ByteBPE(*self.parts)
        return self.made


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", decode: bool = False, drop_text: bool = True) -> DataFrame:
    """Add n_tokens (long) and ids (packed little-endian unsigned 32-bit integers); with decode also decoded (the bytes
    that the stored ids stand for). The rank file is read by the driver and goes to each worker: it has a fixed size."""
    tokens = read_ranks(path)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Vocabulary(tokens, pattern))

    def make():
        bpe = shared.value.encoder()

        def f(texts):
            ids = bpe.encode(texts)
            n = pc.divide(pc.binary_length(ids), 4).cast(pa.int64())
            return [n, ids, bpe.decode(ids)] if decode else [n, ids]

        return f

    added = T.StructType().add("n_tokens", "long").add("ids", "binary")
    return common.map_texts(docs, make, added.add("decoded", "binary") if decode else added, text, drop_text)
