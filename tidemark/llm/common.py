"""What the operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch that a Python worker unpacks at once.
SLICE_ROWS = 256
#: Characters of text in one such slice, where texts are long.
SLICE_BYTES = 4_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, shared by the driver and all executors. Where it is unset: a temporary one, if this machine is the only one; else an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, cut from its lineage and stored in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}.parquet"


def delete(spark: SparkSession, *paths: str) -> None:
    """Deletes folders of any store that Spark writes to."""
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def dealt(df: DataFrame, parts: int) -> list[DataFrame]:
    """df in so many parts by the files that its rows come from, so that each part reads its own files alone; as a whole where it doesn't come from files."""
    if not df.inputFiles():
        return [df]
    try:
        of = F.pmod(F.xxhash64(F.col("_metadata.file_path")), F.lit(parts))
        return [df.where(of == k) for k in range(parts)]
    except AnalysisException:  # computed rows of files don't know their file
        return [df]


def written(df: DataFrame, name: str, compression: str = "snappy", path: str | None = None) -> DataFrame:
    """df, written to the shared folder (or path) as Parquet and read again."""
    path = path or new_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bits of a sieve and words of 64 that hold them: at most so many rows of two numbers are sent to every executor.
SIEVE_BITS = 24


def sieve(ids: DataFrame, column: str) -> DataFrame:
    """(w, bits): a bit for each hash of an id, 64 in a word; at most 2 ** (SIEVE_BITS - 6) rows, however many ids there are."""
    h = F.shiftrightunsigned(F.xxhash64(column), 64 - SIEVE_BITS)
    return ids.select(F.shiftright(h, 6).alias("__tm_w"), F.expr("1L").alias("one"), h.bitwiseAND(F.lit(63)).cast("int").alias("b")).groupBy("__tm_w").agg(F.bit_or(F.expr("shiftleft(one, b)")).alias("__tm_bits"))


def sieved(rows: DataFrame, ids: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """rows whose column is surely not among the ids, and the others: those that are and, as far as the sieve is full, some that aren't. No row is moved."""
    h = F.shiftrightunsigned(F.xxhash64(column), 64 - SIEVE_BITS)
    marked = rows.withColumn("__tm_w", F.shiftright(h, 6)).join(F.broadcast(sieve(ids, column)), "__tm_w", "left")
    maybe = F.coalesce(F.getbit("__tm_bits", h.bitwiseAND(F.lit(63)).cast("int")), F.lit(0)) == 1
    own = [F.col(f"`{c}`") for c in rows.columns]
    return marked.where(~maybe).select(*own), marked.where(maybe).select(*own)


def without(rows: DataFrame, gone: DataFrame, column: str) -> DataFrame:
    """rows whose column (a number, never null) is not among gone, a narrow table of as many ids as there may be.

    A sieve of fixed size goes to every executor. What it lets pass is surely to stay and isn't moved; only the rest, the rows that go and a few
    others, meets the ids in a join. With so many ids that the sieve is full, all rows meet them: slower, and the same rows.
    """
    gone = checkpointed(gone.select(column).distinct())
    stay, maybe = sieved(rows, gone, column)
    return stay.unionAll(maybe.join(gone, column, "left_anti").select(*(F.col(f"`{c}`") for c in rows.columns)))


def shipped(spark: SparkSession) -> None:
    """Sends this package to executors that can't import it by path; once a session."""
    sc, root = spark.sparkContext, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    if sc.master.startswith("local") or root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_tidemark_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="tidemark-"), "tidemark.zip")
    with zipfile.ZipFile(path, "w") as z:
        for top, _, names in os.walk(os.path.join(root, "tidemark")):
            for n in names:
                if n.endswith(".py"):
                    z.write(full := os.path.join(top, n), os.path.relpath(full, root))
    sc.addPyFile(path)
    sc._tidemark_shipped = True


def slices(batches: Iterator[pa.RecordBatch], text: str | int = "text") -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows, and of one row where texts are very long."""
    for b in batches:
        at, column = 0, b.column(text)
        while at < b.num_rows:
            n = min(SLICE_ROWS, b.num_rows - at)
            while n > 1 and column.slice(at, n).get_total_buffer_size() and _bytes(column, at, n) > SLICE_BYTES:
                n = max(1, n // 2)
            yield b.slice(at, n)
            at += n


def _bytes(column: pa.Array, at: int, n: int) -> int:
    """Bytes of the n strings from at on, read off the offsets."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    step = 8 if wide else 4
    offsets = memoryview(column.buffers()[1])
    first = (column.offset + at) * step
    last = first + n * step
    return int.from_bytes(offsets[last : last + step], "little") - int.from_bytes(offsets[first : first + step], "little")


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts; null is the empty text."""
    return [t or "" for t in batch.column(column).to_pylist()]


def crc_mod(column, m: int):
    """crc32 of the id as text, modulo m; null counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(m))
