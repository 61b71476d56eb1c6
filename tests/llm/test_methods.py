"""The methods behind the contracts: each against plain Python on fixtures, with hot groups, caps and clashing names."""

import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from tracemill.llm import chat, common, media, mixing, queries, secrets, simhash, substrings, toxicity, urls

SF = "/root/testdata/sf0.01"


def test_ftrl_against_a_plain_loop(monkeypatch):
    monkeypatch.setattr(toxicity, "BITS", 6)
    rng = random.Random(4)
    rows = [(np.array(sorted(rng.sample(range(64), rng.randint(0, 9))), "<u4"), int(rng.random() < 0.3)) for _ in range(120)]
    z, n, w = [0.0] * 65, [0.0] * 65, [0.0] * 65
    ones = sum(y for _, y in rows)
    weight = max(1.0, (len(rows) - ones) / ones) ** 0.5
    for _ in range(toxicity.EPOCHS):
        for places, y in rows:
            at = [*places.tolist(), 64]
            p = 1 / (1 + math.exp(-sum(w[i] for i in at)))
            g = (p - y) * (weight if y else 1)
            for i in at:
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA
                z[i] += g - sigma * w[i]
                n[i] += g * g
                w[i] = 0.0 if abs(z[i]) <= toxicity.L1 else -(z[i] - math.copysign(toxicity.L1, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)
    got = toxicity.ftrl([(p.tobytes(), y) for p, y in rows])
    assert np.allclose(got, w, atol=1e-9) and any(w) and not all(w)


def test_features_against_plain_words():
    import pyarrow as pa
    import xxhash

    text = "One two two, thr33-four\n five"
    h = lambda t: xxhash.xxh3_64_intdigest(t)
    mask, words = 2**64 - 1, [t.lower() for t in re.findall(r"[^\W_]+", text)]
    turn = lambda x: (x * 0xC2B2AE3D27D4EB4F & mask) ^ x >> 29
    kind = [int(k) for k in toxicity._KIND]
    want = [h(t) * kind[0] for t in words] + [h(t[:4]) * kind[1] for t in words if len(t) > 4] + [h(t[:5]) * kind[2] for t in words if len(t) > 5]
    want += [(turn(h(a)) + h(b)) * kind[3] for a, b in zip(words, words[1:])] + [(turn(h(a)) + h(b)) * kind[4] for a, b in zip(words, words[2:])]
    doc, at = toxicity.features(pa.array([text, ""]))
    assert sorted(at.tolist()) == sorted((x & mask) >> 64 - toxicity.BITS for x in want) and set(doc.tolist()) == {0}


def test_the_sample_holds_an_id_once(spark):
    docs = spark.createDataFrame([(7, f"text {i}") for i in range(400)] + [(i, "other") for i in range(100, 130)], "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1, 1)] * 5 + [(i, 0, 0) for i in range(100, 130)], "doc_id long, quality int, toxic int")
    got = common.labelled_sample(docs, labels, "toxic", 10).collect()
    assert len(got) == 10 and len({r.doc_id for r in got}) == 10
    whole = common.labelled_sample(docs, labels, "toxic").collect()
    assert len(whole) == 31 and [r.label for r in whole if r.doc_id == 7] == [1]


def brute_rules(rows, support, confidence):
    """Rules by all subsets of the tokens of all rows."""
    n, counts, both = len(rows), collections.Counter(), collections.Counter()
    for tokens, verdict in rows:
        for k in range(1, len(tokens) + 1):
            for s in itertools.combinations(sorted(tokens), k):
                counts[s] += 1
                both[s, verdict] += 1
    rules = {(s, v): (m / counts[s], m / n) for (s, v), m in both.items() if m >= support * n and m / counts[s] >= confidence}
    return {k: x for k, x in rules.items() if not any((k[0][:i] + k[0][i + 1 :], k[1]) in rules and rules[k[0][:i] + k[0][i + 1 :], k[1]][0] >= x[0] for i in range(len(k[0])))}


def test_mined_verdicts_against_all_subsets(spark):
    rng = random.Random(9)
    words = ["alpha", "beta", "gamma", "delta", "eps"]
    pages = []
    for i in range(700):
        path = rng.sample(words, rng.randint(1, 4))
        bad = "alpha" in path and "beta" in path or rng.random() < 0.05
        pages.append((i, f"https://{'bad' if bad else 'good'}.list.net/{'/'.join(path)}?{rng.choice(words)}=1"))
    pages += [(1000 + i, f"https://x{i % 3}.org/{'/'.join(rng.sample(words, rng.randint(0, 4)))}") for i in range(80)]
    rules = [("block", "bad.list.net/"), ("allow", "good.list.net/")]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string"), rules).collect()}

    def tokens(url):
        host, _, rest = url.split("://")[1].partition("/")
        path, _, query = rest.partition("?")
        plain = lambda x: re.sub("[0-9]+", "#", x)
        return {f"h:{plain(x)}" for x in host.split(".") if x} | {f"p:{plain(x)}" for x in path.split("/") if x} | {f"q:{plain(x.split('=')[0])}" for x in query.split("&") if x}

    learned = [(tokens(u), "block" if "//bad." in u else "allow") for i, u in pages if i < 1000]
    found = brute_rules(learned, urls.MIN_SUPPORT, urls.MIN_CONFIDENCE)
    # of tokens that always stand together one is mined
    where = collections.defaultdict(list)
    for t in sorted(set().union(*(x for x, _ in learned))):
        where[tuple(t in x for x, _ in learned)].append(t)
    lead = {v[0] for v in where.values()}
    found = {k: x for k, x in found.items() if set(k[0]) <= lead}
    said = collections.Counter()
    for i, u in pages:
        if i >= 1000:
            fits = [(c, len(s), p, v, s) for (s, v), (c, p) in found.items() if set(s) <= tokens(u)]
            best = max(fits, default=None, key=lambda f: (round(f[0], 12), f[1], round(f[2], 12), f[3], f[4]))
            assert got[i].verdict == (best[3] if best else "allow") and (best is None or abs(got[i].confidence - best[0]) < 1e-9)
            said[got[i].verdict] += 1
    assert said["block"] > 3 and said["allow"] > 3


def test_urls_with_many_tokens_are_mined_whole(spark):
    long = "/".join(f"a{chr(97 + i)}" for i in range(14))
    pages = [(i, f"https://l.net/{long}/{'zbad' if i % 2 else 'zgood'}") for i in range(200)] + [(900, "https://o.org/zbad"), (901, "https://o.org/zgood"), (902, None)]
    rules = [("block", f"l.net/{long}/zbad"), ("allow", f"l.net/{long}/zgood")]
    got = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string"), rules).collect()}
    assert (got[900], got[901], got[902]) == ("block", "allow", "allow")


def plain_dft(frame):
    n = len(frame)
    return [abs(sum(x * complex(math.cos(2 * math.pi * k * t / n), -math.sin(2 * math.pi * k * t / n)) for t, x in enumerate(frame))) for k in range(n // 2 + 1)]


def test_peaks_against_a_plain_transform():
    rng = random.Random(3)
    data = bytes(int(128 + 50 * math.sin(t / 3) + 30 * math.sin(t * 1.1) + rng.randint(-20, 20)) for t in range(448))
    x = [float(b) - 128 for b in data]
    x += [0.0] * (-(len(x) - media.WINDOW) % media.HOP)
    hann = [0.5 - 0.5 * math.cos(2 * math.pi * t / (media.WINDOW - 1)) for t in range(media.WINDOW)]
    bins = []
    for at in range(0, len(x) - media.WINDOW + 1, media.HOP):
        s = [round(v, 2) for v in plain_dft([a * b for a, b in zip(x[at : at + media.WINDOW], hann)])]
        tops = sorted((k for k in range(1, len(s) - 1) if s[k] > s[k - 1] and s[k] >= s[k + 1]), key=lambda k: (-s[k], k))[: media.PEAKS]
        bins.append(tops)
    want = sorted(t << 24 | a << 14 | b << 4 | d for t in range(len(bins)) for d in range(1, media.AHEAD + 1) if t + d < len(bins) for a in bins[t] for b in bins[t + d])
    frames, got = media.fingerprint(np.frombuffer(data, np.uint8))
    assert frames == len(bins) and got.tolist() == want


def test_media_files_are_wav(spark):
    import io
    import wave

    r = media.media(spark.createDataFrame([(1, "hello " * 50)], "doc_id long, text string"), keep_file=True).first()
    with wave.open(io.BytesIO(bytes(r.media))) as w:
        assert (w.getnchannels(), w.getsampwidth(), w.getframerate()) == (1, 1, media.RATE) and w.readframes(w.getnframes()).rstrip(b"\0") == (b"hello " * 50)
    assert r.media_sha256 == hashlib.sha256(bytes(r.media)).hexdigest()


def test_secret_scan_against_plain_python(spark):
    findings = secrets.labelled_findings(spark)
    forest = secrets.fit(findings)
    got = collections.defaultdict(list)
    for r in queries.op10_secret_scans(spark, SF).collect():
        got[r.doc_id].append((r.ordinal, r.candidate_sha256, round(r.score, 9), r.is_secret))
    pattern = regex.compile(secrets.CANDIDATE)
    rows = []
    for r in common.table(spark, SF, "documents").collect():
        at = 0
        for k, m in enumerate(pattern.finditer(r.text or "")):
            part = r.text[at : m.start()]
            if k and regex.search(secrets.SIGN, part):
                part = last + part
            follow = pattern.search(r.text, m.end())
            rows.append((r.doc_id, k, part[-48:], m.group(), r.text[m.end() : follow.start() if follow else len(r.text)][:8]))
            at, last = m.end(), m.group()
    # the trees of the library themselves, not their compiled form
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    columns = secrets.features(F.col("candidate"), F.col("before"), F.col("after"))
    ready = lambda df: VectorAssembler(inputCols=list(columns), outputCol="features").transform(df.select("*", *(c.alias(k) for k, c in columns.items())))
    model = RandomForestClassifier(numTrees=secrets.TREES, maxDepth=secrets.DEPTH, seed=secrets.SEED).fit(ready(findings))
    want = collections.defaultdict(list)
    found = spark.createDataFrame(rows, "doc_id long, ordinal int, before string, candidate string, after string")
    for r in model.transform(ready(found)).collect():
        p = float(r.probability[1])
        want[r.doc_id].append((r.ordinal, hashlib.sha256(r.candidate.encode()).hexdigest(), round(p, 9), p >= secrets.THRESHOLD))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()} and len(rows) > 20
    assert forest.count("CASE") > secrets.TREES


def test_planted_keys_are_found_by_a_forest_that_never_saw_their_form(spark):
    forest = secrets.fit(secrets.labelled_findings(spark, without=(0, 6)))  # no hexadecimal key in an assignment
    planted = {}
    for r in common.table(spark, SF, "documents").collect():
        for key in re.findall(r'token = "([0-9a-f]{40})"', r.text or ""):
            planted[r.doc_id, key] = True
    found = {(r.doc_id, r.candidate): r.is_secret for r in secrets.scan(common.table(spark, SF, "documents"), forest).collect()}
    assert len(planted) > 5 and sum(found.get(k, False) for k in planted) >= 0.9 * len(planted)
    assert sum(v for k, v in found.items() if k not in planted) <= 0.2 * len(found)
    # other forms that the forest never saw
    for one in ((1, 13), (8, 10), (5, 16)):
        apart = secrets.fit(secrets.labelled_findings(spark, without=one))
        rows = secrets.labelled_findings(spark, only=one).withColumn("f", F.array(F.struct(*(c.alias(k) for k, c in secrets.features(F.col("candidate"), F.col("before"), F.col("after")).items()))))
        right = rows.withColumn("s", F.expr(f"transform(f, f -> {apart})")[0]).where("(s >= 0.5) = (label = 1)").count()
        assert right >= 0.7 * secrets.FINDINGS, one


def test_mixture_takes_words_alone_and_counts_repeats(spark):
    rows = [(1, None, "a", "x"), (2, "", "a", "x"), (3, " \n", "a", "x")] + [(i, "w " * (i % 5 + 1), "ab"[i % 2], "x") for i in range(10, 300)]
    rows += [(500, "one two", "a", "x")] * 700 + [(None, f"v{i} w", "b", "x") for i in range(40)] + [(600, "p q", "a", lang) for lang in "xyz"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _k string").withColumn("_n", F.lit(8)).withColumn("_id", F.lit("own")).withColumn("_size", F.lit(3)).withColumn("p_id", F.lit(2))
    plan = mixing.copies(docs, block=16).where("size > 0")
    got = mixing.mixture(docs, block=16)
    assert got.columns == docs.columns
    out = got.collect()
    assert {r._n for r in out} == {8} and {r._id for r in out} == {"own"} and {r._size for r in out} == {3}
    assert not {r.doc_id for r in out} & {1, 2, 3}
    want, have = collections.Counter(), collections.Counter(r.doc_id for r in out)
    for r in plan.collect():
        want[r.doc_id] += r.copies
    assert have == collections.Counter({k: v for k, v in want.items() if v})


def test_clashing_names_stay(spark):
    docs = spark.createDataFrame([(1, 'token = "0123456789abcdef0123456789abcdef01234567" x', "t", "own"), (2, "some words here", "t", "own")], "doc_id long, text string, source string, _text string")
    docs = docs.withColumns({c: F.lit(c) for c in ("_id", "_n", "_parts", "_found", "findings", "_h", "h", "fp", "row", "p_id", "_said", "TEXT_", "root")})
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    forest = secrets.fit(secrets.labelled_findings(spark, 600))
    for out in (media.media(docs), toxicity.toxicity(docs, labels), secrets.redact(docs, forest), simhash.representatives(docs), mixing.mixture(docs)):
        rows = out.collect()
        assert rows and all(r._text == "own" and r._id == "_id" and r._n == "_n" and r._parts == "_parts" for r in rows)
    assert simhash.near_duplicates(docs).count() == 2 and substrings.substring_dedup(docs).count() == 2
    assert {r.findings for r in secrets.redact(docs, forest).collect()} == {"findings"}


def test_joins_by_shuffle_give_the_same(spark, monkeypatch):
    docs = common.table(spark, "/root/testdata/sf0.001", "documents")
    pages = common.table(spark, "/root/testdata/sf0.001", "pages")
    run = lambda: (sorted(map(tuple, simhash.near_duplicates(docs).collect())), sorted(map(tuple, mixing.copies(docs).collect())), sorted((r.page_id, r.verdict) for r in urls.judge(pages, queries.URL_RULES).collect()))
    near = run()
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    assert run() == near


def test_edits_reach_earlier_messages(spark):
    rows = [(1, 0, 1, "message", "user", "a", 1), (1, 0, 2, "message", "assistant", "b", 2), (1, 0, 3, "edit", None, "A", 1), (1, 0, 4, "delta", None, "!", 2), (1, 0, 5, "delta", None, "?", 1)]
    events = spark.createDataFrame(rows, "conv_id long, turn long, seq long, kind string, role string, text string, message long")
    got = [(r.role, r.text) for r in chat.fold(events).orderBy("part").collect()]
    assert got == [("user", "A?"), ("assistant", "b!")]
    talks = spark.createDataFrame([(1, 0, "user", "hello there"), (1, 0, "user", "hello there"), (1, 1, None, None), (2, None, "x", "y" * 300)], "conv_id long, turn long, role string, text string")
    log = chat.as_events(talks)
    assert {r.kind for r in chat.as_events(common.table(spark, SF, "conversations")).select("kind").distinct().collect()} == {"message", "delta", "edit", "regenerate"}
    assert log.count() > talks.count()
    assert sorted(map(str, ((r.conv_id, r.turn, r.role, r.text) for r in chat.fold(log).collect()))) == sorted(map(str, ((r.conv_id, r.turn, r.role or "", r.text or "") for r in talks.collect())))


def test_longest_repeats(spark):
    shared = " ".join(f"u{i}" for i in range(700))
    docs = [(1, "a " * 20 + shared), (2, " ".join(f"q{i}" for i in range(30)) + " " + shared + " end"), (3, shared), (4, shared), (5, "lonely " + " ".join(f"z{i}" for i in range(80)))]
    got = {r.doc_id: r.longest for r in substrings.substring_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: None, 2: 400, 3: 400, 4: 400, 5: None}


@pytest.mark.parametrize("master", ["local[2]", "spark://host:7077"])
def test_checkpoints_need_a_shared_folder(master):
    class Context:
        def __init__(self):
            self.master, self.folder = master, None

        def getCheckpointDir(self):
            return self.folder

        def setCheckpointDir(self, folder):
            self.folder = folder

    class Frame:
        def __init__(self):
            self.sparkSession = self
            self.sparkContext, self.conf = Context(), {}

        def checkpoint(self):
            return self.sparkContext.folder

    if master.startswith("local"):
        assert common.checkpoint(Frame())
    else:
        with pytest.raises(ValueError):
            common.checkpoint(Frame())
