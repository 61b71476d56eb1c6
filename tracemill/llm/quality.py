"""Quality rules: learned decision lists over text statistics.

Statistics of whole texts are computed once. On a bounded sample of labelled rows, sequential covering grows a
conjunction of thresholds for the low-quality class by FOIL gain, prunes it on a third of the rows kept apart, and
removes what it covers, until a rule falls below MIN_PRECISION. The list is emitted as one ordered Spark conditional expression.

Cases: a null or text without words has all statistics 0; a ratio without words is 0; without labelled rows of both
classes the list is empty and keeps what the base keeps; repeated rows have equal results; texts of any length are read whole;
of conditions with equal gain the first in the order of the statistics and cuts is taken; an empty table has no rows; all
columns but the text stay, those with the name of an output are replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MIN_PRECISION, MAX_RULES, MAX_CONDITIONS, CUTS = 0.97, 24, 4, 48
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_distinct")
STATS = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])

_SPACE, _WORD = re.compile(r"[ \t-\r]+"), re.compile(r"[^ \t-\r]")


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split("\n")
    if len(lines) == len(set(lines)):
        return 0
    full = [x for x in lines if _WORD.search(x)]
    return len(full) - len(set(full))


def repeated_words(words: pa.Array, bounds: np.ndarray) -> np.ndarray:
    """For each text the words that lie in a window of three words found twice or more in that text."""
    n = len(bounds) - 1
    code = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(n), np.diff(bounds))
    if len(code) < 3:
        return np.zeros(n, np.int64)
    start = np.flatnonzero(doc[2:] == doc[:-2])
    key = (code[start] << 32) | code[start + 1]
    for more in (code[start + 2], doc[start]):  # each step numbers distinct prefixes exactly
        _, key = np.unique(key, return_inverse=True)
        key = key << 32 | more
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    twice = start[count[inverse] > 1]
    hit = np.zeros(len(code) + 2, bool)
    for k in range(3):
        hit[twice + k] = True
    return np.bincount(doc, hit[: len(code)], n).astype(np.int64)


def statistics(texts: pa.Array) -> list[pa.Array]:
    words, bounds = common.words_of(texts)
    n = len(texts)
    doc = np.repeat(np.arange(n), np.diff(bounds))
    per = lambda v: np.bincount(doc, v, n).astype(np.int64)
    coded = words.dictionary_encode()
    index = coded.indices.to_numpy(zero_copy_only=False)
    distinct = coded.dictionary.to_pylist()
    table = np.array([[len(w), sum(map(w.count, SYMBOLS)), sum(map(str.isupper, w)), sum(map(str.isdigit, w)), sum(map(w.count, "!?,.;:"))] for w in distinct], np.int64).reshape(-1, 5)
    chars, symbols, upper, digits, marks = (per(table[index, k]) for k in range(5))
    kinds = np.bincount(np.unique(doc * max(1, len(distinct)) + index) // max(1, len(distinct)), minlength=n).astype(np.int64)
    raw = texts.to_pylist()
    lines = np.fromiter((t.count("\n") + 1 for t in raw), np.int64, n)
    dups = np.fromiter(map(duplicate_lines, raw), np.int64, n)
    return [pa.array(x, pa.int64()) for x in (np.diff(bounds), chars, symbols, dups, repeated_words(words, bounds), lines, upper, digits, marks, kinds)]


def measured(docs: DataFrame, text: str = "text", drop_text: bool = True) -> DataFrame:
    """Add the counts named in COUNTS."""
    return common.map_texts(docs, lambda: statistics, STATS, text, drop_text)


def ratios() -> dict[str, Column]:
    """What conditions compare with thresholds, by name."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "n_words": F.col("n_words").cast("double"), "word_length": F.col("word_chars") / words, "symbol_ratio": F.col("n_symbols") / words, "dup_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), "repeat_ratio": F.col("n_repeat_words") / words,
        "line_words": F.col("n_words") / F.greatest(F.col("n_lines"), F.lit(1)), "upper_ratio": F.col("n_upper") / chars, "digit_ratio": F.col("n_digits") / chars, "mark_ratio": F.col("n_marks") / words, "distinct_ratio": F.col("n_distinct") / words,
    }


def grow(x: np.ndarray, bad: np.ndarray) -> list[tuple[int, str, float]]:
    """Conditions (column, operator, threshold) that each raise the precision of the rule most, by FOIL gain."""
    rule, on = [], np.ones(len(x), bool)
    while len(rule) < MAX_CONDITIONS and (on & ~bad).any():
        p, n = (on & bad).sum(), (on & ~bad).sum()
        best = (1e-9, None, None)
        for k in range(x.shape[1]):
            for cut in np.unique(np.quantile(x[on & bad, k], np.linspace(0, 1, CUTS))):
                for op, hit in ((">=", on & (x[:, k] >= cut)), ("<=", on & (x[:, k] <= cut))):
                    a, b = (hit & bad).sum(), (hit & ~bad).sum()
                    if a and (gain := a * (np.log2(a / (a + b)) - np.log2(p / (p + n)))) > best[0]:
                        best = (gain, (k, op, float(cut)), hit)
        if best[1] is None:
            break
        rule.append(best[1])
        on = best[2]
    return rule


def covers(rule: list, x: np.ndarray) -> np.ndarray:
    on = np.ones(len(x), bool)
    for k, op, cut in rule:
        on &= x[:, k] >= cut if op == ">=" else x[:, k] <= cut
    return on


def prune(rule: list, x: np.ndarray, bad: np.ndarray) -> list:
    """The rule without final conditions as long as (covered bad - covered good) / covered doesn't fall."""
    def worth(r):
        on = covers(r, x)
        return ((on & bad).sum() - (on & ~bad).sum()) / max(1, on.sum())

    while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
        rule = rule[:-1]
    return rule


def learn(x: np.ndarray, bad: np.ndarray, pick: np.ndarray) -> list[list[tuple[int, str, float]]]:
    """Ordered rules for bad rows. pick: which rows prune (others grow)."""
    rules, left = [], np.ones(len(x), bool)
    while len(rules) < MAX_RULES and (left & bad & ~pick).any():
        rule = grow(x[left & ~pick], bad[left & ~pick])
        if not rule:
            break
        if (left & pick).any():
            rule = prune(rule, x[left & pick], bad[left & pick])
        on = covers(rule, x) & left
        if on.sum() < 3 or (on & bad).sum() < MIN_PRECISION * on.sum():
            break
        rules.append(rule)
        left &= ~on
    return rules


def fit(sample: DataFrame) -> list[list[tuple[str, str, float]]]:
    """Rules from doc_id, text, label rows (label 1: good) of bounded number."""
    names = list(ratios())
    got = measured(sample).select("doc_id", "label", *(c.alias(k) for k, c in ratios().items())).toPandas().sort_values(["doc_id", *names])
    x, bad = got[names].to_numpy(float), (got["label"] == 0).to_numpy()
    if not len(got) or bad.all() or not bad.any():
        return []
    return [[(names[k], op, cut) for k, op, cut in rule] for rule in learn(x, bad, np.arange(len(got)) % 3 == 2)]


def verdict(rules: list[list[tuple[str, str, float]]]) -> Column:
    """One conditional expression: null where no rule fires, else the number of the first that does."""
    of, out = ratios(), F.lit(None).cast("int")
    for number in range(len(rules), 0, -1):
        test = F.lit(True)
        for name, op, cut in rules[number - 1]:
            test = test & (of[name] >= cut if op == ">=" else of[name] <= cut)
        out = F.when(test, F.lit(number)).otherwise(out)
    return out


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def quality(docs: DataFrame, labels: DataFrame, rows: int = common.SAMPLE_ROWS, drop_text: bool = True) -> DataFrame:
    """Add the counts, base_failed, rule (the number of the learned rule that fires, else null) and kept."""
    rules = fit(common.labelled_sample(docs, labels, "quality", rows))
    out = measured(docs, drop_text=drop_text).withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
