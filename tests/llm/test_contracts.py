"""The registered queries against brute force over whole tables."""

import collections
import hashlib
import struct
import zlib

import duckdb
import public_tokenizers
import tiktoken

from tracemill.llm import bpe, queries

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def words(text):
    return [w for w in "".join(" " if c in SPACE else c for c in text or "").split(" ") if w]


def rows_of(sf, table):
    return duckdb.sql(f"select * from '{sf}/{table}.parquet'").fetchall()


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def test_op1(spark, sf):
    got = {r.page_id: r for r in queries.op1_url_filters(spark, sf).collect()}
    pages = rows_of(sf, "pages")
    assert len(got) == len(pages)
    for page_id, url, _ in pages:
        host = path = ""
        if "://" in (url or ""):
            rest = url.split("://", 1)[1]
            stop = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
            host, rest = rest[:stop].lower(), rest[stop:]
            path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
        best = None
        for verdict, rule in queries.URL_RULES:
            name, _, sub = rule.partition("/")
            if (host == name or host.endswith("." + name)) and path.startswith("/" + sub) and (best is None or len(rule) > len(best[1])):
                best = verdict, rule
        r = got[page_id]
        assert (r.host, r.path, r.rule) == (host, path, best and best[1])
        assert r.verdict == best[0] if best else r.verdict in ("allow", "block")


def test_op2(spark, sf):
    tokens = bpe.read_ranks(public_tokenizers.path(queries.RANKS))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    got = {r.doc_id: r for r in queries.op2_byte_bpe(spark, sf).collect()}
    for doc_id, text, *_ in rows_of(sf, "documents"):
        ids = own.encode_ordinary(text or "")
        assert tuple(got[doc_id]) == (doc_id, len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(text or ""))


def test_op3(spark):
    sf = "/root/testdata/sf0.01"
    toxic = {i: t for i, _, t in rows_of(sf, "labels")}
    got = queries.op3_toxicity(spark, sf).collect()
    assert len(got) == len(rows_of(sf, "documents"))
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    ones = [r.score for r in got if r.held_out and toxic.get(r.doc_id) == 1]
    zeros = [r.score for r in got if r.held_out and toxic.get(r.doc_id) == 0]
    assert sum(a > b for a in ones for b in zeros) > 0.9 * len(ones) * len(zeros)


def test_op4(spark, sf):
    got = {r.doc_id: r for r in queries.op4_quality_rules(spark, sf).collect()}
    for doc_id, text, *_ in rows_of(sf, "documents"):
        w = words(text)
        lines = [x for x in (text or "").split("\n") if words(x)]
        seen = collections.Counter(zip(w, w[1:], w[2:]))
        hit = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
        r = got[doc_id]
        want = len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w))
        assert r.kept is not None and not (r.kept and r.base_failed)
    bad = {i for i, q, _ in rows_of(sf, "labels") if q == 0}
    good = {i for i, q, _ in rows_of(sf, "labels") if q == 1}
    assert sum(not got[i].kept for i in bad) >= 0.8 * len(bad)
    assert sum(not got[i].kept and not got[i].base_failed for i in good) <= 0.05 * len(good)


def expected_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight, total = {s: i % 3 + 1 for i, s in enumerate(names)}, sum(sizes.values())
    full, target = set(), {}
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        free = [s for s in names if s not in full]
        target = {s: 3.0 * sizes[s] for s in full} | {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if target[s] > 3 * sizes[s]}
        if not over:
            return target
        full |= over


def test_op5(spark, sf):
    docs = rows_of(sf, "documents")
    size = {d[0]: len(words(d[1])) for d in docs}
    sizes = collections.Counter()
    for d in docs:
        sizes[d[3]] += size[d[0]]
    source, target = {d[0]: d[3] for d in docs}, expected_targets(sizes)
    got = queries.op5_mixing(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(size)
    taken, most = collections.Counter(), collections.Counter()
    for r in got:
        s = source[r.doc_id]
        assert (r["size"], r.source_size) == (size[r.doc_id], sizes[s]) and abs(r.target - target[s]) < 1e-6 * (1 + target[s])
        assert r.taken <= 3 * r["size"] and (not r["size"] or r.taken % r["size"] == 0)
        taken[s] += r.taken
        most[s] = max(most[s], r["size"])
    assert all(abs(taken[s] - target[s]) <= most[s] for s in target)  # one drawn document is all that may be missing
    assert sorted(map(tuple, got)) == sorted(map(tuple, queries.op5_mixing(spark, sf).collect()))


def test_op6(spark, sf):
    talks = collections.defaultdict(list)
    for conv, turn, role, text in [*rows_of(sf, "conversations"), (-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]:
        talks[conv].append((turn, role, text or ""))
    got = queries.op6_chat_formatting(spark, sf).collect()
    assert sorted(r.conv_id for r in got) == sorted(talks)
    for r in got:
        turns = sorted(talks[r.conv_id])
        loss = "".join(t for _, role, t in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{role}\n{t}\n" for _, role, t in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))


def test_op8(spark, sf):
    got = {r.doc_id: r for r in queries.op8_media_columns(spark, sf).collect()}
    for doc_id, text, *_ in rows_of(sf, "documents"):
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        r = got[doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), sha(payload))
        assert r.tail_crc32 == zlib.crc32(payload[-64:]) and r.media_bytes == len(payload) + 44


def test_op9(spark, sf):
    import xxhash

    docs, prints = rows_of(sf, "documents"), {}
    for doc_id, text, *_ in docs:
        w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints[doc_id] = sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))
    parent = {i: i for i in prints}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(prints)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    got = queries.op9_simhash(spark, sf).collect()
    assert sorted(map(tuple, got)) == [(i, f"{prints[i]:016x}", find(i)) for i in ids]
    assert any(find(i) != i for i in ids)


def test_golay_keys_meet_all_near_fingerprints():
    import numpy as np

    from tracemill.llm import simhash

    table, rng = simhash.golay(), np.random.default_rng(5)
    x = rng.integers(0, 2**64, 4000, np.uint64, endpoint=False)
    y = x.copy()
    for _ in range(3):
        y ^= np.uint64(1) << rng.integers(0, 64, len(x)).astype(np.uint64)
    for a, b in ((x, y), (y, x)):
        at, mine = simhash.keys(a, table, True)
        to, other = simhash.keys(b, table, False)
        have = set(zip(at.tolist(), mine.tolist()))
        assert {i for i, k in zip(to.tolist(), other.tolist()) if (i, k) in have} == set(range(len(x)))
    assert len(at) < 30 * len(x) and len(to) < 55 * len(x)
    # strangers hardly meet: that is what the width of the keys is for
    at, mine = simhash.keys(rng.integers(0, 2**64, 4000, np.uint64, endpoint=False), table, True)
    assert len(set(mine.tolist()) & set(other.tolist())) < 40


def brute_substrings(docs, window=50):
    first = {}
    w = {i: words(t) for i, t in docs}
    for i in w:
        for s in range(len(w[i]) - window + 1):
            key = tuple(w[i][s : s + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i in w:
        gone = set()
        for s in range(len(w[i]) - window + 1):
            if first[tuple(w[i][s : s + window])] < i:
                gone.update(range(s, s + window))
        out.append((i, len(w[i]), len(gone), sha(" ".join(x for k, x in enumerate(w[i]) if k not in gone))))
    return sorted(out)


def test_op7(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op7_substring_dedup(spark, sf).collect()
    want = brute_substrings([(d[0], d[1]) for d in rows_of(sf, "documents")])
    assert sorted(map(tuple, got)) == want
    assert sum(0 < r[2] < r[1] for r in want) > 10


def test_substring_edges(spark):
    from tracemill.llm import substrings

    base = " ".join(f"w{i}" for i in range(120))
    docs = [(1, base), (2, "x " * 9 + " ".join(f"w{i}" for i in range(30, 80)) + " y"), (3, " ".join(f"w{i}" for i in range(30, 79))), (4, "a " * 200), (5, "a " * 60), (6, None), (7, ""), (8, base), (9, " ".join(f"w{i}" for i in range(49)))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.substring_dedup(df).collect())
    assert got == brute_substrings(docs)
    assert substrings.substring_dedup(df.limit(0)).count() == 0
    held = lambda n: len({w for w, k in collections.Counter(w for _, t in docs for w in {tuple(words(t)[i : i + n]) for i in range(len(words(t)) - n + 1)}).items() if k > 1})
    assert substrings.levels(df) == [(n, held(n)) for n in (25, 50, 100)] and held(200) == 0  # all windows of two documents, level by level


def test_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for name in ("conversations", "documents"):
        con.sql(f"create view {name} as select * from '{sf}/{name}.parquet'")
    for name, sql in queries.ORACLES.items():
        got, want = queries.QUERIES[name](spark, sf), con.sql(sql)
        at = [want.columns.index(c) for c in got.columns]
        assert sorted(map(tuple, got.collect())) == sorted(tuple(r[k] for k in at) for r in want.fetchall())
