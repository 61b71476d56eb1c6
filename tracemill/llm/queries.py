"""The registered queries over the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, media, mixing, quality, secrets, simhash, substrings, toxicity, urls
from .common import table

RANKS = "byte_bpe_multi_50k.tiktoken"


#: The list that op1 applies.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = urls.judge(table(spark, sf_dir, "pages"), URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict", "confidence")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, decode=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.toxicity(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.quality(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.copies(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(chat.probe(spark))
    return chat.digest(chat.render(chat.fold(chat.as_events(talks))))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = media.media(docs)
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", media.feature().alias("feature"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    forest = secrets.fit(secrets.labelled_findings(spark))
    out = secrets.scan(table(spark, sf_dir, "documents"), forest)
    return out.select("doc_id", "ordinal", F.length("candidate").alias("length"), F.sha2("candidate", 256).alias("candidate_sha256"), "score", "is_secret")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_url_filters, op2_byte_bpe, op3_toxicity, op4_quality_rules, op5_mixing, op6_chat_formatting, op7_substring_dedup, op8_media_columns, op9_simhash, op10_secret_scans)
}

def _substring_sql(window: int = substrings.WINDOW) -> str:
    """Windows by plain grouping of their words."""
    space = r"[\x20\x09-\x0D]+"
    parts = [
        f"w AS (SELECT doc_id, [x FOR x IN string_split_regex(COALESCE(text, ''), '{space}') IF x <> ''] AS words FROM documents)",
        f"p AS (SELECT doc_id, words, unnest(range(1, len(words) - {window} + 2)) AS s FROM w WHERE len(words) >= {window})",
        f"a AS (SELECT doc_id, s, md5(array_to_string(list_slice(words, s, s + {window} - 1), ' ')) AS h FROM p)", "f AS (SELECT h, min(doc_id) AS first FROM a GROUP BY h HAVING min(doc_id) < max(doc_id))",
        f"gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + {window})) AS i FROM a JOIN f USING (h) WHERE doc_id > first)", "n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)",
        "each AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w)",
        "k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)",
    ]
    return "WITH " + ", ".join(parts) + " SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(COALESCE(n, 0) AS BIGINT) AS n_removed, sha256(COALESCE(kept, '')) AS kept_sha256 FROM w LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)"


ORACLES: dict[str, str] = {
    "op7_substring_dedup": _substring_sql(),
    "op6_chat_formatting": r"""WITH t AS (SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
 UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
 e AS (SELECT *, replace(replace(replace(replace(replace(replace(text, '\', '\\'), '<|', '<\|'), '</s>', '<\/s>'), '<s>', '<\s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]') AS body FROM t),
 c AS (SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
 COALESCE(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss, CAST(sum(8 + length(role) + 1 + length(body) + 7) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id)
 SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM c""",
}
