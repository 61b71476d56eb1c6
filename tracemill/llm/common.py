"""What the corpus operators share: tables, checkpoints, bounded samples and Arrow text slices."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text handed to one vectorised step, in bytes; a longer document makes a slice of its own.
SLICE_BYTES = 1 << 20
#: Largest estimated size of a side that may be broadcast.
BROADCAST_BYTES = 8 << 20
#: Upper bound of labelled rows that a model is fitted on.
SAMPLE_ROWS = 16_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage in the shared folder that the session names. Where it names none, a session on one machine gets a
    folder of its own; on a cluster that would be lost with its executor, so there it is an error."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp("-checkpoints"))
    return df.checkpoint()


def free(columns: Iterable[str], *names: str) -> list[str]:
    """The names, each with as many underscores behind as keep it apart from the columns (without regard to case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Hint a broadcast when rows of that width stay below BROADCAST_BYTES; else leave the join to a shuffle."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, rows: int = SAMPLE_ROWS, keep=None) -> DataFrame:
    """Documents with a label, as doc_id, text, label: at most `rows` of them, the first by a hash of their id.

    Null ids, null labels and labels other than 0 and 1 are left out; an id with several labels takes the largest, one
    with several texts the text of the least hash, so an id is one row. The choice depends on ids and texts alone, so it
    agrees between runs. A broadcast of the ids is bounded by `rows`.
    """
    ids = labels.select(F.col("doc_id").alias("_id"), F.col(target).cast("int").alias("label")).where("_id is not null and label in (0, 1)")
    if keep is not None:
        ids = ids.where(keep(F.col("_id")))
    ids = ids.groupBy("_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("_id"), "_id").limit(rows)
    said = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(small(ids, rows, 12), F.col("doc_id") == F.col("_id"))
    one = said.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x"))
    return one.select("doc_id", F.col("x.text").alias("text"), "label")


def slices(batch: pa.RecordBatch, text: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts stay near `limit` bytes; no row is cut."""
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part, at = (np.cumsum(size) - size) // limit, 0
    for end in [*(np.flatnonzero(np.diff(part)) + 1), len(size)]:
        if end > at:
            yield batch.slice(at, end - at)
        at = end


def map_texts(df: DataFrame, make: Callable[[], Callable[[pa.Array], list]], added: T.StructType, text: str = "text", drop_text: bool = True) -> DataFrame:
    """Add columns computed from whole texts, a slice at a time. make() runs once in each worker; its result maps
    an array of texts (null: empty) to one Arrow array for each added column. An input column with the name of an
    added one is replaced."""
    names = {f.name.lower() for f in added}
    kept = [c for c in df.columns if c.lower() not in names and (c != text or not drop_text)]
    (said,) = free(kept, "_text")
    src = df.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text}`").cast("string").alias(said))

    def run(batches):
        f = make()
        for batch in batches:
            at = batch.num_columns - 1
            for part in slices(batch, at):
                texts = pc.fill_null(part.column(at), "")
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(at)] + f(texts), names=out.names)

    out = T.StructType(list(src.schema)[:-1] + list(added))
    return src.mapInArrow(run, out)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words [^\\x20\\x09-\\x0D]+ of the texts in one array, and where each text's words begin (one more at the end)."""
    lists = pc.ascii_split_whitespace(texts)
    flat, bounds = lists.flatten(), np.asarray(lists.offsets, dtype=np.int64)
    bounds = bounds - bounds[0]
    full = pc.not_equal(flat, "")
    if not pc.all(full).as_py() and len(flat):
        mask = full.to_numpy(zero_copy_only=False)
        bounds = np.concatenate([[0], np.cumsum(mask)])[bounds]
        flat = flat.filter(full)
    return flat, bounds


def offsets_of(strings: pa.Array) -> np.ndarray:
    """Byte offsets of a string or binary array without nulls, from its first value."""
    kind = np.int64 if pa.types.is_large_string(strings.type) or pa.types.is_large_binary(strings.type) else np.int32
    if not len(strings):
        return np.zeros(1, np.int64)
    return np.frombuffer(strings.buffers()[1], kind, len(strings) + 1, strings.offset * np.dtype(kind).itemsize).astype(np.int64)


def bytes_of(strings: pa.Array) -> memoryview:
    """The data buffer that offsets_of() points into."""
    data = strings.buffers()[2]
    return memoryview(data) if data is not None else memoryview(b"")
