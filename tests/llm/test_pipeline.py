"""The corpus pipeline: each stage on its own input, and run() as a whole, against plain Python; odd inputs of each stage."""

import collections
import hashlib
import math
import struct

import corpus_pipeline as pipeline
import pytest
import tiktoken
import xxhash

from tracemill.llm import bpe, common, mixing, secrets, simhash, toxicity

SF = "/root/testdata/sf0.01"
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def words(text):
    return [w for w in "".join(" " if c in SPACE else c for c in text or "").split(" ") if w]


def plain_fingerprint(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def plain_groups(rows):
    """Components of (key, fingerprint) by comparing all pairs of distinct fingerprints."""
    fps = sorted({f for _, f in rows})
    parent = {f: f for f in fps}

    def find(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for k, a in enumerate(fps):
        for b in fps[k + 1 :]:
            if (a ^ b).bit_count() <= 3:
                parent[find(b)] = find(a)
    groups = collections.defaultdict(list)
    for key, f in rows:
        groups[find(f)].append(key)
    return list(groups.values())


def plain_score(weights, text):
    """Toxicity by counting distinct places in plain Python."""
    import pyarrow as pa

    place = dict(zip(weights[0].tolist(), weights[1].tolist()))
    _, at = toxicity.features(pa.array([text or ""]))
    total = sum(place.get(i, 0.0) for i in set(at.tolist())) + place.get(1 << toxicity.BITS, 0.0)
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, total))))


def targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight, total, full = {s: i % 3 + 1 for i, s in enumerate(names)}, sum(sizes.values()), set()
    while True:
        rest, free = total - sum(3 * sizes[s] for s in full), [s for s in names if s not in full]
        out = {s: 3.0 * sizes[s] for s in full} | {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if out[s] > 3 * sizes[s]}
        if not over:
            return out
        full |= over


def test_run_against_plain_python(spark):
    docs = common.table(spark, SF, "documents").select(*pipeline.COLUMNS)
    rows = {r.doc_id: r for r in docs.collect()}
    weights = toxicity.fit(common.labelled_sample(docs, common.table(spark, SF, "labels"), "toxic", toxicity.SAMPLE_ROWS, toxicity.train_split))
    scores = {i: plain_score(weights, r.text) for i, r in rows.items()}
    assert all(abs(s - toxicity.THRESHOLD) > 1e-5 for s in scores.values())
    clean = [i for i, s in scores.items() if s < toxicity.THRESHOLD]
    assert 0.5 * len(rows) < len(clean) < len(rows)
    single = sorted(min(g) for g in plain_groups([(i, plain_fingerprint(rows[i].text)) for i in clean]))
    assert len(single) < len(clean)

    out = [spark.createDataFrame([rows[i] for i in single], docs.schema)]
    forest = secrets.fit(secrets.labelled_findings(spark))
    hits = collections.defaultdict(list)
    for r in secrets.scan(out[0], forest).where("is_secret").collect():
        hits[r.doc_id].append(r.candidate)
    text = {}
    for i in single:
        t, done = rows[i].text, ""
        for candidate in hits.get(i, ()):
            before, found, t = t.partition(candidate)
            done += before + secrets.MASK
            assert found
        text[i] = None if rows[i].text is None else done + t
    size = {i: len(words(text[i])) for i in single}
    sizes = collections.Counter()
    for i in single:
        sizes[rows[i].source] += size[i]

    own = tiktoken.Encoding("own", pat_str=pipeline.public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(bpe.read_ranks(pipeline.public_tokenizers.path(pipeline.RANKS)))}, special_tokens={})
    got = pipeline.run(spark, SF).collect()
    taken, times = collections.Counter(), collections.Counter()
    for r in got:
        ids = own.encode_ordinary(text[r.doc_id])
        assert (r.n_tokens, bytes(r.ids), r.text_sha256) == (len(ids), struct.pack(f"<{len(ids)}I", *ids), hashlib.sha256(text[r.doc_id].encode()).hexdigest())
        assert r.source == rows[r.doc_id].source and size[r.doc_id]
        taken[r.source] += size[r.doc_id]
        times[r.doc_id] += 1
    want = targets(sizes)
    most = collections.Counter()
    for i in single:
        most[rows[i].source] = max(most[rows[i].source], size[i])
    assert all(abs(taken[s] - want[s]) <= most[s] for s in want)
    for i in single:  # the whole part of a document's copies is certain
        if size[i]:
            each = want[rows[i].source] / sizes[rows[i].source]
            assert math.floor(each) <= times[i] <= math.ceil(each)


def test_each_stage_on_its_own_input(spark, tmp_path):
    docs, names = common.table(spark, SF, "documents"), [n for n, _ in pipeline.STAGES]
    assert len(names) == 5
    kept, columns = [docs], docs.columns
    for name, stage in pipeline.STAGES:
        out = stage(spark, kept[-1], SF)
        out.write.parquet(f"{tmp_path}/{len(kept)}")
        kept.append(spark.read.parquet(f"{tmp_path}/{len(kept)}"))
        if name != names[-1]:
            assert kept[-1].columns == columns
    _, clean, single, safe, mixed, tokens = kept
    groups = plain_groups([(r.doc_id, plain_fingerprint(r.text)) for r in clean.collect()])
    assert sorted(r.doc_id for r in single.collect()) == sorted(min(g) for g in groups)
    assert safe.count() == single.count() and {r.doc_id: r.n_chars for r in safe.collect()} == {r.doc_id: len(r.text) if r.text is not None else r.n_chars for r in safe.collect()}
    before = {r.doc_id: r.text for r in single.collect()}
    touched = [r for r in safe.collect() if r.text != before[r.doc_id]]
    assert len(touched) > 5 and all(secrets.MASK in r.text for r in touched)
    plan = {r.doc_id: r.copies for r in mixing.copies(safe).where("copies > 0 and size > 0").collect()}
    assert collections.Counter(r.doc_id for r in mixed.collect()) == plan
    assert sorted(map(tuple, tokens.select("doc_id", "n_tokens", "text_sha256").collect())) == sorted(map(tuple, pipeline.run(spark, SF).select("doc_id", "n_tokens", "text_sha256").collect()))


ODD = "doc_id long, text string, lang string, source string, n_chars long, extra string, _id int, h string"


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (None, "no id at all here", "en", None, 17), (None, "no id at all here", "en", None, 17), (3, long, "en", "a", len(long)), (4, "same words here now", "en", "b", 19), (5, "same words here now", "en", "b", 19), (6, 'token = "0123456789abcdef0123456789abcdef01234567" é 👍', None, "b", None)]
    return spark.createDataFrame([(*r, "own", 9, "h") for r in rows], ODD)


@pytest.mark.parametrize("number", range(5))
def test_stages_take_odd_and_empty_tables(spark, odd, number):
    name, stage = pipeline.STAGES[number]
    none = stage(spark, odd.limit(0), SF)
    assert none.count() == 0
    rows = stage(spark, odd, SF).collect()
    ids = collections.Counter(r.doc_id for r in rows)
    if name == "tokens":
        assert sum(ids.values()) == odd.count() and {r.n_tokens for r in rows if r.doc_id in (1, 2)} == {0}
        return
    assert none.columns == list(pipeline.COLUMNS)
    if name == "toxicity":
        assert {3, 4, 5}.issubset(ids) and ids[2] == 2 and ids[None] == 2  # repeats, nulls and clean ones stay
    if name == "near duplicates":
        assert ids == {1: 1, None: 1, 3: 1, 4: 1, 6: 1}
    if name == "secrets":
        assert sum(ids.values()) == odd.count() and [r.text for r in rows if r.doc_id == 6] == [f'token = "{secrets.MASK}" é 👍'] and [r.text for r in rows if r.doc_id == 1] == [None]
    if name == "mixing":
        assert not {1, 2} & set(ids) and all(r.text for r in rows)


def test_representatives_take_the_least(spark):
    docs = common.table(spark, "/root/testdata/sf0.001", "documents")
    got = {r.doc_id for r in simhash.representatives(docs).collect()}
    assert got == {min(g) for g in plain_groups([(r.doc_id, plain_fingerprint(r.text)) for r in docs.collect()])}
