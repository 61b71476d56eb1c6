"""Chat formatting by event-sourced reconstruction.

A log has one row for each event of a conversation: `message` opens a message of its turn, `delta` appends to one, `edit`
and `regenerate` replace its text. Within a turn events are in the order of seq (ties: kind, role, text). They concern
the message whose number they carry (column `message`), so earlier ones too; without a number the one opened last.
Final messages are rendered turn by turn; control strings inside texts and roles are escaped with a backslash, which
unescaping undoes. Spans of the rendered text that count for the loss are its assistant texts.

Cases: null texts and roles are empty; a null turn or seq comes first; null conversation ids form one conversation; deltas,
edits and regenerations before any message open one; repeated rows are messages of their own; an empty log gives no rows;
extra columns are left out, whatever their names. A conversation is one output row, so its rows do meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OPEN, CLOSE, LOSS_ROLE = "<|turn|>", "<|end|>", "assistant"
#: What a text must not contain unescaped.
CONTROL = r"<(?=\|)|<(?=/?s>)|\[(?=/?INST\])"


def escape(text: Column) -> Column:
    """Double backslashes, then put one behind the first character of each control string."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"({CONTROL})", "$1\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _role(text: Column) -> Column:
    return F.replace(escape(text), F.lit("\n"), F.lit("\\\n"))


def fold(events: DataFrame) -> DataFrame:
    """Final messages conv_id, turn, part (messages of a turn in order), role, text from conv_id, turn, seq, kind, role, text
    and, if the log numbers the messages of a turn, message."""
    turn, order = ["conv_id", "turn"], ["seq", "kind", "role", "text"]
    number = F.col("message").cast("long") if "message" in events.columns else F.lit(None).cast("long")
    rows = events.select("conv_id", "turn", "seq", "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), number.alias("part"))
    if "message" not in events.columns or events.where("message is null").take(1):
        opened = F.greatest(F.lit(1).cast("long"), F.count_if(F.col("kind") == "message").over(Window.partitionBy(*turn).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
        rows = rows.withColumn("part", F.coalesce("part", opened))
    w = Window.partitionBy(*turn, "part").orderBy(*order)
    rows = rows.withColumn("_version", F.count_if(F.col("kind") != "delta").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_at", F.row_number().over(w))
    per = rows.groupBy(*turn, "part", "_version").agg(F.min_by("role", "_at").alias("role"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "text"))), lambda x: x["text"]), "").alias("text"))
    return per.groupBy(*turn, "part").agg(F.min_by("role", "_version").alias("role"), F.max_by("text", "_version").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """One row for each conversation: n_messages, formatted, loss (spans: start counts code points from 1, length)."""
    order = Window.partitionBy("conv_id").orderBy("turn", "part", "role", "text")
    head = F.concat(F.lit(OPEN), _role(F.col("role")), F.lit("\n"))
    rows = messages.select("conv_id", "turn", "part", "role", "text", head.alias("_head"), escape(F.col("text")).alias("_body"))
    size = F.length("_head") + F.length("_body") + F.lit(len(CLOSE))
    rows = rows.withColumn("_at", F.row_number().over(order)).withColumn("_stop", F.sum(size.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    start = F.col("_stop") - F.length("_body") - F.lit(len(CLOSE)) + 1
    span = F.when(F.col("role") == LOSS_ROLE, F.struct(F.col("_at").alias("at"), start.alias("start"), F.length("_body").cast("long").alias("length")))
    per = rows.groupBy("conv_id").agg(F.count("*").alias("n_messages"), F.array_sort(F.collect_list(F.struct("_at", F.concat("_head", "_body", F.lit(CLOSE)).alias("s")))).alias("_s"), F.array_sort(F.collect_list(span)).alias("_l"))
    return per.select("conv_id", "n_messages", F.array_join(F.transform("_s", lambda x: x["s"]), "").alias("formatted"), F.transform("_l", lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"))).alias("loss"))


def parse(formatted: Column) -> Column:
    """The messages (role, text) of a rendered conversation."""
    parts = F.split(formatted, "<\\|turn\\|>")
    head = r"(?s)^([^\\\n]*+(?:\\.[^\\\n]*+)*+)\n"
    return F.transform(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
        lambda x: F.struct(unescape(F.regexp_extract(x, head, 1)).alias("role"), unescape(F.regexp_extract(x, head + r"(.*)<\|end\|>$", 2)).alias("text")),
    )


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda x: unescape(F.substring(formatted, x["start"].cast("int"), x["length"].cast("int")))), "")


def probe(spark: SparkSession) -> DataFrame:
    """A conversation whose texts are control strings."""
    said = "</s>[INST] ok [/INST]"
    return spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))


def as_events(conversations: DataFrame) -> DataFrame:
    """The log of a table of final messages, as a chat server would have written it: texts are streamed in two halves; some
    (by a hash) are drafts first, which a late edit replaces, or which are regenerated and streamed again. fold() undoes it.

    Rows of a turn are numbered by role and text. Only rows are shuffled, once by conversation; all that follows stays there.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).repartition("conv_id")
    rows = rows.withColumn("message", F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text")).cast("long"))
    half = F.expr("length(text) div 2").cast("int")
    head, tail, whole, draft = F.left("text", half), F.substring("text", half + 1, F.length("text")), F.col("text"), F.reverse(F.left("text", F.lit(40)))
    late = F.lit(1 << 32).cast("long")  # behind all that the turn has opened
    now = F.col("message") * 8

    def log(*steps):
        return F.array(*(F.struct((late + now + k if kind == "edit" else now + k).alias("seq"), F.lit(kind).alias("kind"), text.alias("text")) for k, (kind, text) in enumerate(steps)))

    plain, edited = log(("message", head), ("delta", tail)), log(("message", draft), ("delta", draft), ("edit", whole))
    again = log(("message", head), ("delta", draft), ("regenerate", F.lit("")), ("delta", head), ("delta", tail))
    way = F.pmod(F.xxhash64("conv_id", "turn", "message"), F.lit(4))
    rows = rows.select("conv_id", "turn", "message", "role", F.explode(F.when(way == 0, edited).when(way == 1, again).otherwise(plain)).alias("e"))
    return rows.select("conv_id", "turn", "message", "e.seq", "e.kind", F.when(F.col("e.kind") == "message", F.col("role")).alias("role"), "e.text")


def digest(rendered: DataFrame) -> DataFrame:
    """What can be read back from rendered conversations."""
    said = F.array_join(F.flatten(F.transform(parse(F.col("formatted")), lambda x: F.array(x["role"], F.lit("\n"), x["text"], F.lit("\n")))), "")
    rows = rendered.select("conv_id", "formatted", F.size(parse(F.col("formatted"))).cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), loss_text(F.col("formatted"), F.col("loss")).alias("_loss"))
    return rows.select("conv_id", "n_turns", "turns_sha256", F.length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
