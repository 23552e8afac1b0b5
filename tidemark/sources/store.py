"""Stored rows that change by batches of signed rows.

Rows lie in folders of Parquet files, parted into buckets by a hash of some columns; the number of buckets grows with the bytes stored. A batch is written
as it is, beside them, and read together with them. After PENDING batches the buckets that they touch, and no others, are rewritten. Files that nothing refers
to any longer are deleted one rewriting later, so that frames made before the last one can still be read.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.relational import WEIGHT

#: Batches that are merged when read, at most.
PENDING = 6
#: Folders of rows at most; with more, all buckets are rewritten into one.
FOLDERS = 8
#: Bytes stored for each bucket; their number is a power of two.
BUCKET_BYTES = 64 << 20
#: Keys that are named in a filter, which Parquet's page indices can use: rows lie in the order of their key in each bucket.
FEW_KEYS = 200
_NAMED = (T.IntegralType, T.StringType, T.DateType, T.DecimalType)
KEYED, BAG, APPEND = "keyed", "bag", "append"
_BUCKET = "__b"


def shared(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, shared by all machines. Where it is unset: a temporary one of this machine, if that is the only one; else an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-"))
    return sc._jsc.sc().getCheckpointDir().get()


def place(spark: SparkSession, folder: str | None = None) -> str:
    """A new path in the folder, or in the shared one."""
    return f"{(folder or shared(spark)).rstrip('/')}/v-{uuid.uuid4().hex}.parquet"


def stored(df: DataFrame, folder: str | None = None, path: str | None = None) -> DataFrame:
    """df as a table in a folder that all machines share: its lineage ends there."""
    path = path or place(df.sparkSession, folder)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Frames that are stored for as long as a step takes."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder, self.paths = spark, folder, []

    def stored(self, df: DataFrame) -> DataFrame:
        self.paths.append(place(self.spark, self.folder))
        df.write.parquet(self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def clear(self) -> None:
        Files(self.spark).delete(self.paths)
        self.paths = []


def matching(df: DataFrame, keys: DataFrame, by: Sequence[str], how: str = "left_semi") -> DataFrame:
    """Rows of df whose columns by are among the keys (left_semi) or aren't (left_anti); null is a key like any other."""
    if not by:
        return df if how == "left_semi" else df.limit(0)
    own = keys.select(*(F.col(f"`{c}`").alias(f"__m{i}") for i, c in enumerate(by)))
    return df.join(own, reduce(lambda a, b: a & b, (df[f"`{c}`"].eqNullSafe(own[f"__m{i}"]) for i, c in enumerate(by))), how)


def signed(df: DataFrame, weight: int = 1) -> DataFrame:
    return df.withColumn(WEIGHT, F.lit(weight).cast("long"))


def consolidated(change: DataFrame) -> DataFrame:
    """Equal rows as one, their weights added; what cancels out goes."""
    names = [c for c in change.columns if c != WEIGHT]
    return change.groupBy(*names).agg(F.sum(F.col(WEIGHT).cast("long")).alias(WEIGHT)).where(F.col(WEIGHT) != 0)


def expanded(change: DataFrame) -> DataFrame:
    """Each row as often as its weight says; rows of no positive weight go."""
    return change.where(F.col(WEIGHT) > 0).withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col(WEIGHT)))).drop("__copy", WEIGHT)


class Files:
    """Small files and whole folders of any store that Spark can write to."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, spark._jvm.org.apache.hadoop.fs.Path

    def _at(self, path: str):
        at = self.paths(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def bytes(self, path: str) -> int:
        fs, at = self._at(path)
        return fs.getContentSummary(at).getLength()

    def exists(self, path: str) -> bool:
        fs, at = self._at(path)
        return fs.exists(at)

    def delete(self, paths: Iterable[str]) -> None:
        for p in paths:
            fs, at = self._at(p)
            fs.delete(at, True)

    def put(self, path: str, text: str) -> None:
        """Writes a whole new file."""
        fs, at = self._at(path)
        out = fs.create(at, True)
        out.write(bytearray(text.encode()))
        out.close()

    def get(self, path: str) -> str:
        fs, at = self._at(path)
        stream = fs.open(at)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def names(self, folder: str) -> list[str]:
        fs, at = self._at(folder)
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


@dataclass(frozen=True)
class Folder:
    """Files of one writing: its path, the columns in it, and the buckets there that still count (None: it isn't parted into buckets)."""

    path: str
    schema: T.StructType
    live: frozenset[int] | None = None


@dataclass(frozen=True)
class State:
    """All that a store is, but for its files. fill: what columns hold in files written before they were added."""

    schema: T.StructType
    folders: tuple[Folder, ...] = ()
    pending: tuple[Folder, ...] = ()
    garbage: tuple[str, ...] = ()
    buckets: int = 1
    fill: Mapping[str, Any] = field(default_factory=dict)
    outside: DataFrame | None = None

    def to_json(self) -> dict:
        if self.outside is not None:
            raise ValueError("rows that lie elsewhere can't be named here")
        parts = lambda fs: [{"path": f.path, "schema": f.schema.jsonValue(), "live": None if f.live is None else sorted(f.live)} for f in fs]
        return {"schema": self.schema.jsonValue(), "folders": parts(self.folders), "pending": parts(self.pending), "garbage": list(self.garbage), "buckets": self.buckets, "fill": {k: v if v is None or isinstance(v, (int, float, str)) else str(v) for k, v in self.fill.items()}}

    @classmethod
    def from_json(cls, d: dict) -> State:
        parts = lambda fs: tuple(Folder(f["path"], T.StructType.fromJson(f["schema"]), None if f["live"] is None else frozenset(f["live"])) for f in fs)
        return cls(T.StructType.fromJson(d["schema"]), parts(d["folders"]), parts(d["pending"]), tuple(d["garbage"]), d["buckets"], d["fill"])


class Store:
    """Rows that change by batches. mode: keyed (one row for each key; of a batch's rows under a key the positive one counts), bag (equal rows count) or append.

    by: the columns that the buckets go by. rows given from outside stay where they are until they are first rewritten, unless own says otherwise.
    """

    def __init__(self, rows: DataFrame, mode: str, key: Sequence[str] = (), by: Sequence[str] | None = None, folder: str | None = None, own: bool = False, bucket_bytes: int = BUCKET_BYTES, state: State | None = None):
        self.spark, self.mode, self.key, self.folder, self.bucket_bytes = rows.sparkSession, mode, tuple(key), folder, bucket_bytes
        self.by = tuple(by if by is not None else key)
        self.state = state or State(rows.schema, outside=rows)
        self.made: dict[str, DataFrame] = {}
        if own and state is None:
            path = place(self.spark, folder)
            rows.write.parquet(path)
            self.state = State(rows.schema, (Folder(path, rows.schema),))
            if self._unparted():
                self.compact()

    def _bytes(self) -> int:
        """Bytes stored; of rows outside, what Spark takes them to have, if it has any idea."""
        s, files = self.state, Files(self.spark)
        outside = 0 if s.outside is None else int(str(s.outside._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        return (outside if outside < 1 << 62 else 0) + sum(files.bytes(f.path) for f in (*s.folders, *s.pending))

    def _unparted(self) -> bool:
        """Whether rows that aren't in buckets are more than one bucket holds."""
        s = self.state
        return self.mode != APPEND and (s.outside is not None or any(f.live is None for f in s.folders)) and self._bytes() > self.bucket_bytes

    @property
    def names(self) -> list[str]:
        return self.state.schema.names

    @property
    def rows(self) -> DataFrame:
        return self.of()

    def bucket(self):
        return F.pmod(F.hash(*(F.col(f"`{c}`") for c in (self.by or self.names))), F.lit(self.state.buckets))

    def touched(self, keys: DataFrame) -> set[int] | None:
        """The buckets that the keys (columns by) fall into; None where there's but one."""
        return {r[0] for r in keys.select(self.bucket().alias("b")).distinct().collect()} if self.state.buckets > 1 else None

    def _read(self, f: Folder, only: set[int] | None, more: Sequence[str] = ()) -> DataFrame:
        if f.path not in self.made:
            schema = T.StructType([*f.schema, T.StructField(_BUCKET, T.IntegerType())]) if f.live is not None else f.schema
            self.made[f.path] = self.spark.read.schema(schema).parquet(f.path)
        df, live = self.made[f.path], f.live
        if live is not None:
            live = live if only is None else live & only
            if only is not None or len(live) < self.state.buckets:
                df = df.where(F.col(_BUCKET).isin(sorted(live)) if live else F.lit(False))
        elif only is not None:
            df = df.where(self.bucket().isin(sorted(only)))
        return df.select(*(self._column(c, f.schema) for c in self.state.schema), *more)

    def _column(self, c: T.StructField, there: T.StructType):
        if c.name not in there.names:
            return F.lit(self.state.fill.get(c.name)).cast(c.dataType).alias(c.name)
        x = F.col(f"`{c.name}`")
        return x if there[c.name].dataType == c.dataType else x.cast(c.dataType).alias(c.name)

    def _base(self, only: set[int] | None) -> DataFrame:
        s = self.state
        parts = [] if s.outside is None else [s.outside.select(*(self._column(c, s.outside.schema) for c in s.schema))]
        parts += [self._read(f, only) for f in s.folders]
        return reduce(DataFrame.unionAll, parts) if parts else self.spark.createDataFrame([], s.schema)

    def changes(self, only: set[int] | None = None) -> DataFrame | None:
        """The pending batches, with their number as __layer."""
        parts = [self._read(f, only, [WEIGHT]).withColumn("__layer", F.lit(i)) for i, f in enumerate(self.state.pending)]
        return reduce(DataFrame.unionAll, parts) if parts else None

    def of(self, only: set[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets."""
        base, changes, names = self._base(only), self.changes(only), [f"`{c}`" for c in self.names]
        if changes is None:
            return base
        if self.mode == APPEND:
            return base.unionAll(changes.select(*names))
        if self.mode == KEYED:
            if not self.key:  # one row at most
                last = changes.where(F.col("__layer") == len(self.state.pending) - 1)
                return last.where(F.col(WEIGHT) > 0).select(*names)
            return self._merged(base, changes)
        net = consolidated(changes.drop("__layer"))
        again = expanded(consolidated(signed(matching(base, net, self.names)).unionAll(net)))
        return matching(base, net, self.names, "left_anti").unionAll(again.select(*names))

    def under(self, keys: DataFrame) -> DataFrame:
        """Rows of a keyed store whose key is among the keys: both what lies in buckets and the batches are cut down to them before they are merged."""
        if not self.key:
            return self.of()
        keys = keys.select(*(F.col(f"`{c}`") for c in self.key)).distinct()
        only, named = self.touched(keys), None
        if len(self.key) == 1 and isinstance(self.state.schema[self.key[0]].dataType, _NAMED):
            few = [r[0] for r in keys.limit(FEW_KEYS + 1).collect()]
            if len(few) <= FEW_KEYS:
                c, some = F.col(f"`{self.key[0]}`"), [v for v in few if v is not None]
                named = (c.isin(some) if some else F.lit(False)) | (c.isNull() if len(some) < len(few) else F.lit(False))
        cut = lambda df: matching(df, keys, self.key) if named is None else df.where(named)
        base, changes = cut(self._base(only)), self.changes(only)
        return base if changes is None else self._merged(base, cut(changes))

    def _merged(self, base: DataFrame, changes: DataFrame) -> DataFrame:
        """Of each key the last batch's row, of other keys the base's."""
        names = [f"`{c}`" for c in self.names]
        keys = [F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(self.key)]
        last = changes.groupBy(*keys).agg(F.max_by(F.struct(*names, WEIGHT), F.struct("__layer", WEIGHT)).alias("__row")).select("__row.*")
        return matching(base, last, self.key, "left_anti").unionAll(last.where(F.col(WEIGHT) > 0).select(*names))

    def write(self, change: DataFrame) -> DataFrame:
        """Takes in signed rows, which are stored; returns them as stored. The rows are as after the batch from then on."""
        change = change.select(*(F.col(f"`{c}`") for c in self.names), F.col(WEIGHT).cast("long").alias(WEIGHT))
        path = place(self.spark, self.folder)
        change.write.parquet(path)
        self.made[path] = out = self.spark.read.schema(change.schema).parquet(path)
        self.state = replace(self.state, pending=(*self.state.pending, Folder(path, T.StructType([f for f in change.schema if f.name != WEIGHT] + [T.StructField(WEIGHT, T.LongType())]))))
        return out

    def settle(self) -> None:
        """Rewrites the buckets that batches touch, if there are very many batches; all rows, once, where many aren't in buckets yet."""
        if len(self.state.pending) > PENDING or (self.state.pending and self._unparted()):
            self.compact()

    def compact(self) -> None:
        s = self.state
        whole = s.outside is not None or any(f.live is None for f in s.folders) or len(s.folders) > FOLDERS
        if self.mode == APPEND and s.outside is None:
            self._append()
            return
        size = self._bytes()
        wanted = max(s.buckets, 1 << max(0, (size // self.bucket_bytes).bit_length()))
        changes = self.changes()
        touched = None if whole or s.buckets == 1 or wanted > s.buckets or changes is None else self.touched(changes)
        rows = self.of(touched)
        if touched is None:
            self.state = replace(s, buckets=wanted)
        path = place(self.spark, self.folder)
        # rebalanced by bucket: files of a good size, and a bucket with very many rows is split
        rows.withColumn(_BUCKET, self.bucket()).hint("rebalance", F.col(_BUCKET)).sortWithinPartitions(_BUCKET, *(f"`{c}`" for c in self.by)).write.partitionBy(_BUCKET).parquet(path)
        new = Folder(path, s.schema, frozenset(range(wanted) if touched is None else touched))
        left = [] if touched is None else [replace(f, live=f.live - touched) for f in s.folders]
        self._now((*(f for f in left if f.live), new), gone=[*(f.path for f in s.folders if f.path not in {x.path for x in left if x.live}), *(f.path for f in s.pending)])

    def _append(self) -> None:
        """Batches become one folder; with it go the last folders that are no larger, so that few are left and each row is written again few times."""
        s, files = self.state, Files(self.spark)
        size, n = sum(files.bytes(f.path) for f in s.pending), len(s.folders)
        while n and (own := files.bytes(s.folders[n - 1].path)) <= size:
            size, n = size + own, n - 1
        parts = [self._read(f, None) for f in (*s.folders[n:], *s.pending)]
        path = place(self.spark, self.folder)
        reduce(DataFrame.unionAll, parts).hint("rebalance").write.parquet(path)
        self._now((*s.folders[:n], Folder(path, s.schema)), gone=[f.path for f in (*s.folders[n:], *s.pending)])

    def _now(self, folders: tuple[Folder, ...], gone: Sequence[str]) -> None:
        old, self.state = self.state.garbage, replace(self.state, folders=folders, pending=(), garbage=tuple(gone), outside=None)
        Files(self.spark).delete(old)
        self.made = {p: df for p, df in self.made.items() if p not in old}

    def add_column(self, name: str, kind: T.DataType, default: Any = None) -> None:
        """Rows there hold the default."""
        s = self.state
        self.state = replace(s, schema=T.StructType([*s.schema, T.StructField(name, kind)]), fill={**s.fill, name: default})

    def drop_column(self, name: str) -> None:
        s, without = self.state, lambda schema: T.StructType([f for f in schema if f.name != name])
        parts = lambda fs: tuple(replace(f, schema=without(f.schema)) for f in fs)
        self.made = {}
        self.state = replace(s, schema=without(s.schema), folders=parts(s.folders), pending=parts(s.pending), outside=None if s.outside is None else s.outside.drop(name), fill={k: v for k, v in s.fill.items() if k != name})

    def convert(self, name: str, kind: T.DataType) -> None:
        """The column's type from now on; what is stored is cast when read."""
        s = self.state
        self.state = replace(s, schema=T.StructType([T.StructField(f.name, kind if f.name == name else f.dataType) for f in s.schema]))

    def drop(self) -> None:
        """Deletes all own files."""
        s = self.state
        Files(self.spark).delete([*(f.path for f in (*s.folders, *s.pending)), *s.garbage])


def manifest(folder: str) -> str:
    return f"{folder.rstrip('/')}/manifests"


def save(spark: SparkSession, folder: str, state: dict, number: int) -> None:
    """The folder's state from now on, under a number above all before: a new file, so a writing that fails leaves the last one."""
    files = Files(spark)
    text = json.dumps(state)
    files.put(f"{manifest(folder)}/{number:012d}.tmp", text)
    fs, at = files._at(f"{manifest(folder)}/{number:012d}.tmp")
    if not fs.rename(at, files.paths(f"{manifest(folder)}/{number:012d}.json")):
        raise OSError(f"manifest {number} is there already: another engine writes to {folder}")
    files.delete(f"{manifest(folder)}/{n}" for n in files.names(manifest(folder)) if n.endswith(".json") and int(n[:12]) < number - 1)


def load(spark: SparkSession, folder: str) -> tuple[dict, int] | None:
    """The last state saved in the folder, and its number."""
    files = Files(spark)
    found = sorted(n for n in files.names(manifest(folder)) if n.endswith(".json"))
    return (json.loads(files.get(f"{manifest(folder)}/{found[-1]}")), int(found[-1][:12])) if found else None
