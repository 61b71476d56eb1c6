"""Secret scans: candidates by pattern, false positives removed by a random forest.

Candidates are long runs of key characters with a digit, shorter ones right behind NAME=, and quoted values behind an equals
sign or colon. An equals sign ends a run, but for padding; if the name of a value is a candidate itself, it counts as text
before the value too. Their features are length, shares and changes of character classes, the share of letter pairs that words have, the share
covered by dictionary words, whether they stand in a path, and the words around. Spark ML trains the forest on labelled findings; its trees are compiled into one
conditional expression, so a scan is a projection over the text without a shuffle.

Cases: a null or empty text has no candidates; any number of candidates of a text, equal ones too, is judged each in its place;
repeated rows have equal results; a score at the threshold is a secret; empty tables have none; redact() keeps all columns,
whatever their names, and scan() the id alone.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

FINDINGS, TREES, DEPTH, SEED, THRESHOLD, MASK = 4000, 24, 6, 29, 0.5, "[SECRET]"
#: What candidates look like, and a quick test for texts that may have one.
_RUN = "A-Za-z0-9+/_-"
_KEY = rf"(?:(?<=[A-Za-z0-9_]=)(?=[{_RUN}]{{8}})|(?<![{_RUN}])(?=[{_RUN}]{{16}}))(?=[A-Za-z+/_-]*+[0-9])[{_RUN}]++(?:={{1,2}}+(?![\"']?[={_RUN}]))?+"
CANDIDATE = rf"(?<=[:=] {{0,2}}[\"'])[^\s\"']{{8,}}+|{_KEY}"
MAYBE = rf"[:=] {{0,2}}[\"'][^\s\"']{{8}}|{_KEY}"
#: Fixed value: what stands between a name and its value.
SIGN = "^[:=] {0,2}[\"']?$"
#: Words that a key hardly holds, and words before keys and before other long strings.
DICTIONARY = "about account after agent build button class color content data date default document download email example file first float format guide header height home html http image index info install issue item label large last line link list local login mail main manual media menu message model module month name news note number object order page photo picture post price print product profile project public query release report sample script search section server service size small source standard start state static status store style summary system table test text thumb time title type update user value version video view width window world year"
SECRET_WORDS = r"(?i)(?:key|token|secret|passw|pwd|auth|credential|bearer|private|access)"
OTHER_WORDS = r"(?i)(?:sha|commit|hash|md5|checksum|digest|uuid|guid|etag|build|order|isbn|phone|image|revision|base64|see|page)"
#: Pairs of letters that the dictionary holds, as a pattern that matches in front of each.
_PAIRS = {a: "".join(sorted({w[i + 1] for w in DICTIONARY.split() for i in range(len(w) - 1) if w[i] == a})) for a in "abcdefghijklmnopqrstuvwxyz"}
USUAL = "(?=" + "|".join(f"{a}[{b}]" for a, b in _PAIRS.items() if b) + ")"
KNOWN = r"^(?:AKIA|ASIA|gh[pousr]_|xox[abprs]-|sk[-_]|AIza|glpat-|eyJ)"


def features(c: Column, before: Column, after: Column) -> dict[str, Column]:
    """Numbers that describe a candidate and its place."""
    size = F.length(c).cast("double")
    share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / size
    rest = F.regexp_replace(F.lower(c), "(?:" + "|".join(sorted(DICTIONARY.split(), key=len, reverse=True)) + ")", "")
    flag = lambda test: test.cast("double")
    return {
        "length": size, "digits": share("[0-9]"), "upper": share("[A-Z]"), "lower": share("[a-z]"), "vowels": share("[aeiouAEIOU]"),
        "changes": (F.regexp_count(c, F.lit("[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+")) - 1) / size, "distinct": F.size(F.array_distinct(F.split(c, ""))) / F.least(size, F.lit(64.0)),
        "usual": F.regexp_count(F.lower(c), F.lit(USUAL)) / size, "covered": 1 - F.length(rest) / size, "marks": share("[-/_.]"), "hex": flag(c.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")), "uuid": flag(c.rlike("^[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}$")), "known": flag(c.rlike(KNOWN)),
        "path": flag(before.rlike(r"(?:[/@.#?&]|://[^\s]*)$") | c.contains("/") & after.rlike(r"^\.[a-z]")), "assigned": flag(before.rlike("[:=]\\s*[\"']?$")), "quoted": flag(before.rlike("[\"']$") & after.rlike("^[\"']")),
        "secret_word": flag(F.right(before, F.lit(28)).rlike(SECRET_WORDS)), "other_word": flag(F.right(before, F.lit(28)).rlike(OTHER_WORDS)),
    }


def labelled_findings(spark: SparkSession, rows: int = FINDINGS, without: tuple[int, ...] = (), only: tuple[int, ...] = ()) -> DataFrame:
    """A table before, candidate, after, label (1: a secret) made from seeded hashes: keys of common forms in
    assignments and headers; and commits, checksums, identifiers, paths, dates, data and plain words that look like them.
    without, only: numbers of the forms to leave out or to take alone, so that a forest can be tried on forms it never saw."""
    base = spark.range(0, rows, 1, 4)
    hexes = F.sha2(F.concat(F.lit(f"{SEED}:"), F.col("id").cast("string")), 256)
    raw = F.base64(F.unhex(F.concat(hexes, F.sha2(hexes, 256))))
    plain = F.regexp_replace(raw, "[+/=]", "")
    cut = lambda s, n: F.substring(s, 1, n)
    size = (F.pmod(F.xxhash64("id"), F.lit(24)) + 16).cast("int")
    some = F.split(F.lit(DICTIONARY), " ")
    word = lambda k: F.element_at(some, (F.pmod(F.xxhash64("id", F.lit(k)), F.size(some)) + 1).cast("int"))
    digits = lambda n: cut(F.regexp_replace(F.concat(hexes, F.sha2(hexes, 224)), "[a-f]", ""), n)
    name = F.element_at(F.array(*map(F.lit, ("token", "api_key", "secret", "access_token", "auth", "SECRET_KEY", "TOKEN", "client_secret", "private_key"))), (F.pmod(F.xxhash64("id", F.lit(3)), F.lit(9)) + 1).cast("int"))
    sign = F.element_at(F.array(*map(F.lit, (' = "', ": ", '="', " = ", ": '"))), (F.pmod(F.xxhash64("id", F.lit(4)), F.lit(5)) + 1).cast("int"))
    close = F.regexp_extract(sign, "[\"']$", 0)
    empty = F.lit("")
    cases = [
        (F.concat(name, sign), cut(hexes, 40), close, 1), (F.concat(name, sign), cut(plain, size), close, 1), (F.lit("aws_access_key_id = "), F.concat(F.lit("AKIA"), F.upper(cut(plain, 16))), empty, 1),
        (F.concat(name, sign), F.concat(F.lit("ghp_"), cut(plain, 36)), close, 1), (F.lit('password = "'), F.concat(cut(plain, 9), F.lit("!"), digits(3)), F.lit('"'), 1), (F.lit("Authorization: Bearer "), F.concat(F.lit("eyJ"), cut(plain, 60)), empty, 1),
        (F.concat(F.upper(name), F.lit(' = "')), F.upper(cut(hexes, 40)), F.lit('"'), 1), (F.lit("the secret is "), cut(hexes, 64), empty, 1), (F.concat(name, sign), F.concat(F.lit("xoxb-"), digits(11), F.lit("-"), cut(plain, 24)), close, 1), (F.lit("aws_secret_access_key="), cut(raw, 40), empty, 1),
        (F.lit("commit "), cut(hexes, 40), empty, 0), (F.concat(F.lit("https://www."), word(5), F.lit(".org/")), cut(hexes, 32), F.lit(".html"), 0), (F.lit("uuid "), F.regexp_replace(cut(hexes, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), empty, 0),
        (F.lit("sha256:"), hexes, empty, 0), (F.lit("md5 checksum "), cut(hexes, 32), empty, 0), (F.concat(F.lit("the "), word(6), F.lit(" ")), F.concat(word(7), F.lit("-"), word(8), F.lit("-"), digits(4), F.lit("-"), word(9)), F.lit(" "), 0),
        (F.lit("on "), F.concat(F.lit("2024-01-1"), digits(1), F.lit("T10-2"), digits(1), F.lit("-"), digits(2)), empty, 0), (F.lit('src="/'), F.concat(F.lit("static/"), word(7), F.lit("/"), word(8), F.lit("-"), digits(5)), F.lit(".png"), 0), (F.concat(word(9), F.lit(' = "')), F.concat(word(7), F.lit("-"), word(8)), F.lit('"'), 0),
        (F.lit("order "), digits(18), F.lit("."), 0), (F.lit("data:image/png;base64,"), raw, empty, 0), (F.concat(word(8), F.lit(": ")), F.concat(word(5), word(6), digits(3), word(7)), empty, 0), (F.lit(" mail to 12@"), F.concat(word(5), digits(1), F.lit("-"), word(6), F.lit("-"), word(7)), F.lit(".com"), 0), (F.concat(word(3), F.lit(" ")), F.concat(F.lit("v1-"), digits(9), F.lit("-"), word(8)), F.lit(" "), 0),
    ]
    cases = [x for k, x in enumerate(cases) if k not in without and (not only or k in only)]
    out = F.lit(None).cast("struct<before:string,candidate:string,after:string,label:double>")
    for k, (before, candidate, after, label) in enumerate(cases):
        out = F.when(F.col("id") % len(cases) == k, F.struct(before.alias("before"), candidate.alias("candidate"), after.alias("after"), F.lit(float(label)).alias("label"))).otherwise(out)
    return base.select(out.alias("x")).select("x.*")


def _tree(node, names: list[str]) -> str:
    """SQL of a tree of a fitted forest: the share of secrets in the leaf."""
    if node.getClass().getSimpleName() == "LeafNode":
        stats = list(node.impurityStats().stats())
        return repr(float(stats[1] / sum(stats))) + "D"
    split = node.split()
    return f"CASE WHEN f.{names[split.featureIndex()]} <= {split.threshold()!r}D THEN {_tree(node.leftChild(), names)} ELSE {_tree(node.rightChild(), names)} END"


def fit(findings: DataFrame, trees: int = TREES, depth: int = DEPTH) -> str:
    """SQL over a struct f of features: the mean of the trees of a forest trained on before, candidate, after, label."""
    columns = features(F.col("candidate"), F.col("before"), F.col("after"))
    names = list(columns)
    rows = findings.select("label", *(c.alias(k) for k, c in columns.items()))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED).fit(VectorAssembler(inputCols=names, outputCol="features").transform(rows))
    return "(" + " + ".join(_tree(t._java_obj.rootNode(), names) for t in forest.trees) + f") / {trees}D"


def scanned(docs: DataFrame, forest: str, text: str = "text", parts: str = "_parts") -> DataFrame:
    """Add findings (array of candidate and score) and the column named by `parts`, the text between candidates."""
    found, numbers, scores = common.free([*docs.columns, parts], "_found", "_numbers", "_scores")
    said = F.col(f"`{text}`")
    hit = F.coalesce(said.rlike(MAYBE), F.lit(False))
    rows = docs.drop("findings").withColumn(parts, F.when(hit, F.split(said, CANDIDATE))).withColumn(found, F.when(hit, F.regexp_extract_all(said, F.lit(CANDIDATE), F.lit(0))))
    part = lambda i: F.get(parts, i)
    before = lambda i: F.when((i > 0) & part(i).rlike(SIGN), F.concat(F.get(found, i - 1), part(i))).otherwise(part(i))
    around = lambda c, i: F.struct(c.alias("c"), F.right(before(i), F.lit(48)).alias("b"), F.left(part(i + 1), F.lit(8)).alias("a"))
    rows = rows.withColumn(found, F.transform(found, around))
    rows = rows.withColumn(numbers, F.transform(found, lambda x: F.struct(*(c.alias(k) for k, c in features(x["c"], x["b"], x["a"]).items()))))
    rows = rows.withColumn(scores, F.expr(f"transform({numbers}, f -> {forest})"))
    return rows.withColumn("findings", F.zip_with(found, scores, lambda x, s: F.struct(x["c"].alias("candidate"), s.alias("score")))).drop(found, numbers, scores)


def scan(docs: DataFrame, forest: str, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each candidate: id, ordinal (its number in the text), candidate, score, is_secret."""
    rows = scanned(docs.select(F.col(f"`{id}`").alias("_id"), F.col(f"`{text}`").alias("text")), forest).select("_id", F.posexplode("findings").alias("ordinal", "x"))
    return rows.select(F.col("_id").alias(id), "ordinal", F.col("x.candidate").alias("candidate"), F.col("x.score").alias("score"), (F.col("x.score") >= threshold).alias("is_secret"))


def redact(docs: DataFrame, forest: str, text: str = "text", threshold: float = THRESHOLD, mask: str = MASK) -> DataFrame:
    """The documents with each secret in the text replaced by the mask; all else, null texts and all other columns, stays."""
    said, parts, clean = common.free([*docs.columns, "findings"], "_said", "_parts", "_clean")
    found = scanned(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{text}`").alias(said)), forest, said, parts)
    masked = F.transform("findings", lambda x: F.when(x["score"] >= threshold, F.lit(mask)).otherwise(x["candidate"]))
    whole = F.array_join(F.flatten(F.zip_with(parts, masked, lambda p, s: F.array(p, F.coalesce(s, F.lit(""))))), "")
    rows = found.withColumn(clean, F.when(F.size("findings") > 0, whole).otherwise(F.col(said)))
    return rows.select(*(F.col(clean).alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns))
