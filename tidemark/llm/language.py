"""Language identification by interpolated Kneser-Ney character models, one for each language.

Letters count in lower case, and each run of anything else is one blank. Counts of 4 characters in a row over all training documents are
summed by Spark; the lower orders' continuation counts and all probabilities follow from them in Spark too. No n-gram is left out. What goes
to the executors is a file that they map into memory: hashed n-grams in sorted order with a row of log-probabilities for each, one
column a language. The driver passes it on in parts and never holds all of it. The language with the lowest
cross-entropy a character wins; a document is accepted if that isn't above what nearly all documents have that were kept aside for this in each language.
"""

from __future__ import annotations

import atexit
import math
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common

ORDER = 4
#: Cells (n-grams times languages) that one task works on at once.
CELLS_AT_ONCE = 1_000_000
#: Bytes of n-grams that the driver reads by one job.
BYTES_AT_ONCE = 16_000_000
#: One training document in so many, by a hash of its id, only sets its language's limit of acceptance; the share of them that is accepted.
CALIBRATION, ACCEPTED = 20, 0.995
#: A language with fewer such documents learns from all its documents, and these set its limit.
LEAST_CALIBRATION = 20
#: Characters whose agreement makes a score certain.
CERTAIN = 40

_U = np.uint64
_TOP = _U(1 << 63)
_ODD = _U(0x9E3779B97F4A7C15)
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts' characters in one row, where each text starts in it, and its number of letters. Each text begins with a blank and ends with one.

    A character is a UTF-16 unit, so that four fit 64 bits: letters beyond U+FFFF are two, and no two letters are alike.
    """
    points = np.frombuffer(("\n" + "\n\n".join(texts) + "\n").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    lengths = np.array([len(t.lower()) + 2 for t in texts])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[starts] = True
    letters = np.add.reduceat(letter.astype(np.int64), starts)
    x = np.where(letter, points, 0)[keep]
    wide = x > 0xFFFF
    places = np.cumsum(keep) - keep
    if not wide.any():
        return x.astype(np.uint64), places[starts], letters
    at = np.cumsum(1 + wide) - (1 + wide)
    out = np.repeat(np.where(wide, 0xD800 + ((x - np.minimum(x, 0x10000)) >> 10), x), 1 + wide).astype(np.uint64)
    out[at[wide] + 1] = 0xDC00 + (x[wide] & 0x3FF)
    return out, at[places[starts]], letters


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ORDER characters that end at each place (blanks before a text's start), the texts' starts, their numbers of letters."""
    x, starts, letters = characters(texts)
    out, n = x.copy(), np.arange(len(x))
    own = n - np.repeat(starts, np.diff(np.append(starts, len(x))))
    for k in range(1, ORDER):
        before = np.zeros_like(x)
        before[k:] = x[:-k]
        before[own < k] = 0
        out |= before << _U(16 * k)
    return out, starts, letters


@dataclass
class Hashed:
    """n-grams by hash, in sorted order; first holds where each range of hashes starts. All three lie in a file, from offset on."""

    keys: np.ndarray
    rows: np.ndarray
    bits: int
    first: np.ndarray

    @staticmethod
    def shapes(size: int, wide: int) -> list[tuple[type, tuple[int, ...]]]:
        """Of keys, rows and first, for size n-grams."""
        return [(np.uint64, (size + 1,)), (np.float32, (size + 1, wide)), (np.int64, ((1 << Hashed.bits_of(size)) + 1,))]

    @staticmethod
    def bits_of(size: int) -> int:
        return max(8, size.bit_length() + 1)

    @classmethod
    def at(cls, path: str, offset: int, size: int, wide: int, mode: str = "r") -> Hashed:
        arrays = []
        for kind, shape in cls.shapes(size, wide):
            arrays.append(np.asarray(np.memmap(path, kind, mode, offset, shape)))
            offset += arrays[-1].nbytes
        return cls(arrays[0], arrays[1], cls.bits_of(size), arrays[2])

    @classmethod
    def write(cls, path: str, hashed: DataFrame, size: int, wide: int) -> int:
        """Appends hashed (h, row), whose size is known, to the file; its offset there."""
        offset = os.path.getsize(path)
        with open(path, "r+b") as f:
            f.truncate(offset + sum(np.dtype(kind).itemsize * math.prod(shape) for kind, shape in cls.shapes(size, wide)))  # zeros: the last row stays so
        own, done = cls.at(path, offset, size, wide, "r+"), 0
        parts = hashed.orderBy("h").mapInArrow(_packed, "h binary, row binary").rdd
        n = parts.getNumPartitions()
        step = max(1, BYTES_AT_ONCE * n // (max(1, size) * (8 + 4 * wide)))  # partitions read by one job
        for r in (r for a in range(0, n, step) for r in parts.context.runJob(parts, lambda rows: rows, range(a, min(n, a + step)))):
            keys = np.frombuffer(r.h, np.int64).view(np.uint64) ^ _TOP
            own.keys[done : done + len(keys)] = keys
            own.rows[done : done + len(keys)] = np.frombuffer(r.row, np.float32).reshape(-1, wide)
            done += len(keys)
        assert done == size, (done, size)
        for k in range(0, 1 << own.bits, CELLS_AT_ONCE):
            some = np.arange(k, min(k + CELLS_AT_ONCE, 1 << own.bits), dtype=np.uint64)
            own.first[k : k + len(some)] = np.searchsorted(own.keys[:-1], some << _U(64 - own.bits))
        own.first[-1] = size
        return offset

    def find(self, grams: np.ndarray) -> np.ndarray:
        """The rows' numbers; the last, a row of zeros, where there's none."""
        h = grams * _ODD
        near = (h >> _U(64 - self.bits)).astype(np.int64)
        at, end = self.first[near], self.first[near + 1]
        none = len(self.keys) - 1
        out = np.full(len(h), none, np.int64)
        todo = np.nonzero(at < end)[0]
        at = at[todo]
        while len(todo):
            hit = self.keys[at] == h[todo]
            out[todo[hit]] = at[hit]
            at = at + 1
            on = ~hit & (at < end[todo])
            todo, at = todo[on], at[on]
        return out


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each batch."""
    for b in batches:
        if b.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array([b.column("h").to_numpy().tobytes()], pa.binary()), pa.array([b"".join(b.column("row").to_pylist())], pa.binary())], names=["h", "row"])


@dataclass
class Stored:
    """A model in a file; grams and contexts: offset and size by order from 1. limits: cross-entropy above which a language isn't accepted."""

    languages: list[str]
    path: str
    grams: list[tuple[int, int]]
    contexts: list[tuple[int, int]]
    floor: np.ndarray
    limits: np.ndarray
    sent: bool = False

    def open(self) -> Model:
        """The model from the file, on the driver or, once sent, on an executor."""
        path = SparkFiles.get(os.path.basename(self.path)) if self.sent else self.path
        grams, contexts = ([Hashed.at(path, *x, len(self.languages)) for x in part] for part in (self.grams, self.contexts))
        return Model(self.languages, grams, contexts, self.floor, self.limits)

    def send(self, spark: SparkSession) -> None:
        if self.languages and not self.sent:
            spark.sparkContext.addFile(self.path)
            self.sent = True


@dataclass
class Model:
    languages: list[str]
    grams: list[Hashed]  # by order from 1: log-probabilities, backed off where a language lacks the n-gram
    contexts: list[Hashed]  # by order from 1: log of what the order leaves to the lower
    floor: np.ndarray  # log-probability of a character never seen
    limits: np.ndarray  # cross-entropy above which a language isn't accepted

    def totals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text: log-likelihood in each language, characters, letters."""
        c, starts, letters = codes(texts)
        out = np.zeros((len(c), len(self.languages)), np.float32)
        todo = np.arange(len(c))
        for n in range(ORDER, 0, -1):
            part = c[todo] & _U((1 << (16 * n)) - 1)
            table = self.grams[n - 1]
            at = table.find(part)
            out[todo] += table.rows[at]
            left = at == len(table.keys) - 1
            todo = todo[left]
            if not len(todo):
                break
            if n > 1:
                context = self.contexts[n - 1]
                out[todo] += context.rows[context.find(part[left] >> _U(16))]
            else:
                out[todo] += self.floor
        return np.add.reduceat(out.astype(np.float64), starts), np.diff(np.append(starts, len(c))), letters

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, cross-entropy and acceptance of each text."""
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts), bool)
        total, n, letters = self.totals(texts)
        mean = total / n[:, None]
        best = mean.argmax(1)
        lead = (mean - mean.max(1, keepdims=True)) * np.minimum(letters, CERTAIN)[:, None]
        known = letters > 0
        score = np.where(known, 1 / np.exp(lead).sum(1), 0.0)
        entropy = np.where(known, -mean.max(1), 0.0)
        return [self.languages[k] if y else "und" for k, y in zip(best, known, strict=True)], score, entropy, known & (entropy <= self.limits[best])


def counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n): how often each row of ORDER characters stands in all documents (columns lang, text) of a language."""
    common.shipped(docs.sparkSession)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def summed(parts):
            grams, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            some, at = np.unique(grams, return_inverse=True)
            return some, np.bincount(at, n, len(some)).astype(np.int64)

        for b in common.slices(batches):
            t = np.array(common.texts(b), object)
            langs = np.array(b.column("lang").to_pylist(), object)
            for lang in set(langs):
                some, n = np.unique(codes(list(t[langs == lang]))[0], return_counts=True)
                parts = held.setdefault(lang, [])
                parts.append((some, n))
                if len(parts) > 16:
                    parts[:] = [summed(parts)]
        for lang, parts in held.items():
            some, n = summed(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int64)), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    return docs.select("lang", "text").mapInArrow(made, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def build(grams: DataFrame) -> Model:
    """The models from counts()."""
    return store(grams).open()


def store(grams: DataFrame) -> Stored:
    """The models from counts(): continuation counts and probabilities by Spark, order by order, written to a file of the driver."""
    spark = grams.sparkSession
    common.shipped(spark)
    grams = common.checkpointed(grams)
    languages = sorted(r[0] for r in grams.select("lang").distinct().collect())
    if not languages:
        return Stored([], "", [], [], np.zeros(0), np.zeros(0))
    wide = len(languages)
    folder = os.path.realpath(tempfile.mkdtemp(prefix="tidemark-language-"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, f"language-{uuid.uuid4().hex}")
    open(path, "wb").close()
    number = F.broadcast(spark.createDataFrame(list(enumerate(languages)), "k int, lang string"))
    levels = [grams.join(number, "lang").select("k", "gram", "n")]
    for n in range(ORDER - 1, 0, -1):
        levels.insert(0, common.checkpointed(levels[0].select("k", F.col("gram").bitwiseAND(F.lit((1 << (16 * n)) - 1)).alias("gram")).groupBy("k", "gram").agg(F.count(F.lit(1)).alias("n"))))
    # a character never seen has as much of what the lowest order leaves as each that was seen
    floor = np.full(wide, -math.log(levels[0].select("gram").distinct().count() + 1), np.float64)
    grams_at, contexts_at, lower = [], [], None
    for n, level in enumerate(levels, 1):
        ones = {r.k: (r.a, r.b) for r in level.groupBy("k").agg(F.count_if(F.col("n") == 1).alias("a"), F.count_if(F.col("n") == 2).alias("b")).collect()}
        discount = np.array([min(0.95, max(0.1, a / (a + 2 * b))) if a + b else 0.5 for a, b in (ones.get(x, (0, 0)) for x in range(wide))])
        contexts = level.groupBy("k", F.shiftrightunsigned("gram", 16).alias("context")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds"))
        contexts = common.checkpointed(contexts.groupBy("context").agg(F.collect_list(F.struct("k", "n", "kinds")).alias("c")))
        left = contexts.select(F.col("context").alias("gram"), "c").mapInArrow(_left(wide, discount), "h long, row binary")
        own = level.groupBy("gram").agg(F.collect_list(F.struct("k", "n")).alias("g")).withColumn("context", F.shiftrightunsigned("gram", 16)).join(contexts, "context")
        if lower is None:
            own = own.withColumn("lower", F.lit(np.exp(floor).tobytes()))
            floor = floor + np.frombuffer(left.first().row, np.float32).astype(np.float64)  # of the one context, the empty
        else:  # each n-gram's last n - 1 characters are one of the order below
            own = own.withColumn("suffix", F.col("gram").bitwiseAND(F.lit((1 << (16 * (n - 1))) - 1))).join(lower.select(F.col("gram").alias("suffix"), F.col("p").alias("lower")), "suffix")
        lower = common.checkpointed(own.select("gram", "g", "c", "lower").mapInArrow(_mixed(wide, discount), "gram long, h long, p binary, row binary"))
        size = lower.count()
        grams_at.append((Hashed.write(path, lower.select("h", "row"), size, wide), size))
        size = contexts.count()
        contexts_at.append((Hashed.write(path, left, size, wide), size))
    return Stored(languages, path, grams_at, contexts_at, floor, np.full(wide, np.inf))


def _hashes(grams: pa.Array) -> pa.Array:
    """As signed numbers in the order of the unsigned ones."""
    return pa.array((grams.to_numpy().astype(np.uint64) * _ODD ^ _TOP).view(np.int64))


def _few(batches: Iterator[pa.RecordBatch], wide: int) -> Iterator[pa.RecordBatch]:
    step = max(1, CELLS_AT_ONCE // wide)
    for b in batches:
        for k in range(0, b.num_rows, step):
            yield b.slice(k, step)


def _dense(column: pa.Array, wide: int, *names: str) -> list[np.ndarray]:
    """Lists of (k, named fields) as arrays of a row for each list and a column for each k."""
    at, flat = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy())), column.flatten()
    out = [np.zeros((len(column), wide)) for _ in names]
    for x, name in zip(out, names, strict=True):
        x[at, flat.field("k").to_numpy()] = flat.field(name).to_numpy()
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _left(wide: int, discount: np.ndarray):
    """(h, row): log of what contexts (gram, c) leave to the lower order."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _few(batches, wide):
            total, kinds = _dense(b.column("c"), wide, "n", "kinds")
            left = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            yield pa.RecordBatch.from_arrays([_hashes(b.column("gram")), _binary(np.log(left).astype(np.float32))], names=["h", "row"])

    return made


def _mixed(wide: int, discount: np.ndarray):
    """(gram, h, p, row): probabilities in all languages and their logs, from counts g, those of the context c, and probabilities at the order below."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _few(batches, wide):
            (seen,), (total, kinds) = _dense(b.column("g"), wide, "n"), _dense(b.column("c"), wide, "n", "kinds")
            lower = np.frombuffer(b"".join(b.column("lower").to_pylist())).reshape(-1, wide)
            left = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            p = np.maximum(seen - discount, 0) / np.maximum(total, 1) + left * lower
            yield pa.RecordBatch.from_arrays([b.column("gram"), _hashes(b.column("gram")), _binary(p), _binary(np.log(p).astype(np.float32))], names=["gram", "h", "p", "row"])

    return made


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Stored:
    """Models of the languages of documents whose crc32 of the id modulo 4 isn't 2 and whose language isn't null."""
    spark = docs.sparkSession
    own = docs.where(F.col(lang_col).isNotNull() & (common.crc_mod(id_col, 4) != 2))
    aside = F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(CALIBRATION)) == 0
    own = own.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), aside.alias("aside")).where("text is not null")
    small = [r.lang for r in own.groupBy("lang").agg(F.count_if("aside").alias("n")).where(F.col("n") < LEAST_CALIBRATION).collect()]
    of_small = F.col("lang").isin(small) if small else F.lit(False)
    model = store(counts(own.where(~F.col("aside") | of_small)))
    model.send(spark)
    if model.languages:
        shared = spark.sparkContext.broadcast(model)

        def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = shared.value.open()
            for b in common.slices(batches):
                total, n, letters = m.totals(common.texts(b))
                at = [m.languages.index(x) for x in b.column("lang").to_pylist()]
                h = -total[np.arange(len(at)), at] / n
                yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array(np.where(letters > 0, h, np.nan))], names=["lang", "h"])

        some = own.where(F.col("aside") | of_small).select("lang", "text").mapInArrow(made, "lang string, h double")
        limit = {r.lang: r.h for r in some.where("not isnan(h)").groupBy("lang").agg(F.percentile_approx("h", ACCEPTED, 10_000).alias("h")).collect()}
        model.limits = np.array([limit.get(x, np.inf) for x in model.languages])
    return model


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, cross_entropy, accepted) for every document, by models learned from the documents that aren't held out.

    lang_pred is `und`, with score 0 and not accepted, where text is null or has no letter, or nothing could be learned. accepted is false where
    the winning language's cross-entropy is above its limit. The earlier language in sorted order wins a tie. Ids may be null or repeat; documents that
    repeat, or whose language is named by few others, count like any other.
    No documents: no rows. Further columns are left out.
    """
    model = train(docs, id_col, text_col, lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value.open()
        for b in common.slices(batches):
            lang, score, entropy, ok = m.predict(common.texts(b))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(lang, pa.string()), pa.array(score), pa.array(entropy), pa.array(ok)], names=["doc_id", "held_out", "lang_pred", "score", "cross_entropy", "accepted"])

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), (common.crc_mod(id_col, 4) == 2).alias("held_out"), F.col(text_col).alias("text"))
    return d.mapInArrow(made, "doc_id long, held_out boolean, lang_pred string, score double, cross_entropy double, accepted boolean")
