"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns; general interfaces of the operators."""

import collections
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tracemill.llm import bpe, chat, common, media, mixing, quality, queries, secrets, simhash, substrings, toxicity, urls

PATH = public_tokenizers.path(queries.RANKS)
DOCS = "doc_id long, text string, source string, score string, N_TOKENS int, findings string"


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"word{i % 977}" for i in range(120_000))
    rows = [(1, None, None), (2, "", "a"), (2, "", "a"), (3, " \n\t\x0b ", "a"), (4, long, "b"), (5, "x" * 200_000, "b"), (6, "é ü ß\x1c 日本語 👍", None), (7, "same words here", "c"), (7, "same words here", "c"), (None, "no id at all", "c")]
    return spark.createDataFrame([(i, t, s, "own", 9, "f") for i, t, s in rows], DOCS)


def test_every_operator_keeps_all_odd_rows(spark, odd):
    labels = spark.createDataFrame([(7, 1, 0), (4, 0, 1), (None, 1, 1), (99, None, None)], "doc_id long, quality int, toxic int")
    n = odd.count()
    assert bpe.encode(odd, PATH, public_tokenizers.PATTERN, decode=True).count() == n
    assert toxicity.toxicity(odd, labels).count() == n
    assert quality.quality(odd, labels).where("kept is null or n_words is null").count() == 0
    assert media.media(odd).count() == n
    assert mixing.copies(odd).count() == n
    assert simhash.near_duplicates(odd).count() == n
    assert substrings.substring_dedup(odd).count() == n
    forest = secrets.fit(secrets.labelled_findings(spark, 600))
    assert secrets.redact(odd, forest).count() == n and secrets.redact(odd, forest).columns == odd.columns
    assert secrets.scan(odd, forest).count() >= 0


def test_every_operator_takes_an_empty_table(spark, odd):
    none, labels = odd.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert bpe.encode(none, PATH, public_tokenizers.PATTERN).count() == 0
    assert toxicity.toxicity(none, labels).count() == 0
    assert quality.quality(none, labels).count() == 0
    assert media.media(none).count() == 0
    assert mixing.copies(none).count() == 0 and mixing.mixture(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0 and simhash.representatives(none).count() == 0
    assert substrings.substring_dedup(none).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert urls.judge(pages, queries.URL_RULES).count() == 0
    talks = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digest(chat.render(chat.fold(chat.as_events(talks)))).count() == 0


def test_bpe_columns_and_round_trip(spark, odd):
    tokens = bpe.read_ranks(PATH)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    out = bpe.encode(odd, PATH, public_tokenizers.PATTERN, decode=True, drop_text=False)
    assert "N_TOKENS" not in out.columns and out.columns.count("n_tokens") == 1
    for r in out.where("doc_id <> 5").collect():
        assert r.decoded.decode() == (r.text or "") and r.n_tokens == len(own.encode_ordinary(r.text or ""))
    table = bpe.PerfectHash(tokens)
    assert sorted(table.candidates(tokens).tolist()) == list(range(len(tokens)))
    one = bpe.ByteBPE(tokens, public_tokenizers.PATTERN, table)
    bpe_run, bpe.RUN = bpe.RUN, 40  # short runs: a long text goes through many
    try:
        text = "ab  cd\n\n ef 'll 12 " * 300
        assert list(memoryview(one.encode([text])[0].as_py()).cast("I")) == own.encode_ordinary(text)
    finally:
        bpe.RUN = bpe_run


def test_toxicity_without_labels_is_undecided(spark, odd):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {(r.score, r.predicted) for r in toxicity.toxicity(odd, labels).collect()} == {(0.5, 0)}


def test_rules_learn_a_planted_conjunction():
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.uniform(size=(900, 3))
    bad = (x[:, 0] > 0.7) & (x[:, 2] < 0.4)
    rules = quality.learn(x, bad, np.arange(900) % 3 == 2)
    hit = np.zeros(900, bool)
    for r in rules:
        hit |= quality.covers(r, x)
    assert (hit & bad).sum() > 0.85 * bad.sum() and (hit & ~bad).sum() <= 0.05 * bad.sum()


def test_mixing_repeats_and_nulls(spark):
    rows = [(i, "w " * (i % 7 + 1), ["a", "b", None][i % 3]) for i in range(900)] + [(5000, "w w w", "a")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.copies(docs, block=8).collect()
    assert len(got) == len(rows) and {r.k for r in got if r.doc_id == 5000} == set(range(1, 301))
    taken, target = collections.Counter(), {}
    for r in got:
        taken[r.source] += r["size"] * r.copies
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 7 for s in target)
    mixed = mixing.mixture(docs, block=8)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got if r["size"])


def test_events_fold_into_messages(spark):
    rows = [(1, 0, 0, "message", "user", "Hi"), (1, 1, 1, "message", "assistant", "Hel"), (1, 1, 2, "delta", None, "lo"), (1, 1, 3, "regenerate", None, None), (1, 1, 4, "delta", None, "Good "), (1, 1, 5, "delta", None, "day"), (1, 0, 6, "edit", None, "Hi <|end|> \\ [INST]"), (1, None, 9, "delta", "system\nx", "early")]
    events = spark.createDataFrame(random.Random(3).sample(rows, len(rows)), "conv_id long, turn long, seq long, kind string, role string, text string")
    r = chat.render(chat.fold(events)).first()
    back = spark.createDataFrame([r]).select(chat.parse(F.col("formatted")).alias("m"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("loss")).first()
    assert [tuple(m) for m in back.m] == [("system\nx", "early"), ("user", "Hi <|end|> \\ [INST]"), ("assistant", "Good day")]
    assert back.loss == "Good day" and r.formatted.count(chat.CLOSE) == 3


def test_urls_learn_from_the_list(spark):
    pages = [(i, f"https://h{i % 5}.shop.net/{'bad' if i % 2 else 'good'}/{i}") for i in range(400)] + [(1000, "https://x.org/bad/1"), (1001, "https://x.org/good/1"), (1002, None), (1003, "no scheme"), (1004, "HTTP://ExAmple.COM?x")]
    rules = [("block", "shop.net/bad/"), ("allow", "shop.net/good/")]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string"), rules).collect()}
    assert (got[1000].rule, got[1000].verdict, got[1001].verdict, got[1002].verdict, got[1003].host, got[1004].host) == (None, "block", "allow", "allow", "", "example.com")


def test_media_files(spark):
    r = media.media(spark.createDataFrame([(1, "abc"), (2, None)], "doc_id long, text string"), keep_file=True).orderBy("doc_id").collect()
    assert media.load(bytes(r[0].media)) == b"abc" + bytes(61) and hashlib.sha256(bytes(r[0].media)).hexdigest() == r[0].media_sha256
    assert media.load(bytes(r[1].media)) == bytes(64)
    import numpy as np

    tone = (128 + 100 * np.sin(2 * np.pi * 20 * np.arange(4096) / 256)).astype(np.uint8)
    frames, prints = media.fingerprint(tone)
    assert frames == 31 and {int(p) >> 14 & 1023 for p in prints} >= {20} and (np.diff(prints) > 0).all()


def test_media_frames_reach_the_end():
    import numpy as np

    text = bytes(random.Random(5).choices(range(32, 127), k=320 + 64 * 8))
    for size in range(64, len(text) + 1, 64):
        one, other = text[:size], text[: size - 64] + text[:64][::-1]
        frames, prints = media.describe(one)[-2:]
        assert 128 * (frames - 1) + 256 >= size > 128 * (frames - 2) + 256 or frames == 1
        assert not np.array_equal(prints, media.describe(other)[-1]) or frames == 1


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.v: r.root for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100}


def test_one_representative_of_each_component(spark):
    said = lambda k: " ".join(hashlib.sha1(f"{k}:{i}".encode()).hexdigest() for i in range(30))
    rows = [(None, "a"), (None, "b"), (None, "b"), (None, "c"), (3, "c"), (1, "d"), (1, "d"), (2, "d"), (5, "e"), (5, "f"), (4, "f"), (6, "g"), (6, "h")]
    docs = spark.createDataFrame([(i, said(k), k) for i, k in rows] + [(None, None, "null"), (None, "", "null")], "doc_id long, text string, source string")
    got = simhash.representatives(docs)
    assert got.columns == docs.columns
    assert sorted(((r.source, r.doc_id) for r in got.collect()), key=str) == [("a", None), ("b", None), ("c", 3), ("d", 1), ("e", 5), ("f", 4), ("g", 6), ("h", 6), ("null", None)]


def test_secrets_held_out_and_redacted(spark):
    forest = secrets.fit(secrets.labelled_findings(spark, 2000))
    fresh = secrets.labelled_findings(spark, 4000).withColumn("_features", F.array(F.struct(*(c.alias(k) for k, c in secrets.features(F.col("candidate"), F.col("before"), F.col("after")).items()))))
    scored = fresh.withColumn("s", F.expr(f"transform(_features, f -> {forest})")[0])  # half of these rows are new
    assert scored.where("(s >= 0.5) = (label = 1)").count() >= 0.97 * 4000
    key = hashlib.sha1(b"k").hexdigest()
    docs = spark.createDataFrame([(1, f'x token = "{key}" y commit {key} z'), (2, "plain words only"), (3, f'password: "Xk29!qPz77" and token = "{key}"')], "doc_id long, text string")
    got = {r.doc_id: r.text for r in secrets.redact(docs, forest).collect()}
    assert got[1].startswith('x token = "[SECRET]" y') and got[2] == "plain words only" and key not in got[3]


def test_secrets_in_env_lines(spark):
    forest = secrets.fit(secrets.labelled_findings(spark))
    key = "a9Bc3dE5fG7hJ1kL2mN4pQ6rS8tU0vW2xY4z"
    lines = [("export GITHUB_TOKEN=", f"ghp_{key}"), ("aws_secret_access_key=", "wJalrXUtnFEMI7K7MDENG+bPxRfiCYEXAMPLEKEY"), ("AWS_S3_SECRET_ACCESS_KEY=", "wJalrXUtnFEMI7K7MDENG+bPxRfiCYEXAMPLEKEY"), ("TOKEN=", f"{key}=="), ("DB_PASSWORD=", "hunter2abc9x"), ('API_TOKEN_V2_PRODUCTION="', key)]
    docs = spark.createDataFrame([(i, f"a b\n{name}{value}" + '"' * name.endswith('"') + "\nc d") for i, (name, value) in enumerate(lines)] + [(99, "commit=0123456789abcdef0123456789abcdef01234567")], "doc_id long, text string")
    found = {(r.doc_id, r.candidate) for r in secrets.scan(docs, forest).where("is_secret").collect()}
    assert found == {(i, value) for i, (_, value) in enumerate(lines)}
    got = {r.doc_id: r.text for r in secrets.redact(docs, forest).collect()}
    assert all(got[i] == f"a b\n{name}{secrets.MASK}" + '"' * name.endswith('"') + "\nc d" for i, (name, _) in enumerate(lines))


def test_slices_cut_rows_not_texts():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10, "", None, "b" * 30, "c"])], names=["t"])
    parts = list(common.slices(batch, 0, 12))
    assert [x for p in parts for x in p.column(0).to_pylist()] == batch.column(0).to_pylist() and len(parts) > 1
