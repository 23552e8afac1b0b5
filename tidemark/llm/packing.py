"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Pieces above a third of the capacity pair at most twice in a bin: the longest takes the longest partner
that fits. Shorter pieces then go, longest first, to the tightest gap that holds them. Equal lengths are
exchangeable, so all of this is done on counts by length (as many numbers as the capacity, whatever the corpus)
and gives runs of bins of one shape; a piece finds its run by its length and its rank among equals.
A gap at least halves with each visit of the packer, so there are a few runs for each length at most.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import common

#: Pieces of equal length are ranked in buckets of about so many rows; each length has buckets of its own number.
RANK_ROWS = 20_000
#: Chunks of text whose ids a worker keeps, and the longest that is kept.
CACHED, CACHED_CHARS = 500_000, 48

_ENCODERS: dict[str, ChunkEncoder] = {}


class _Chunks(dict):
    """Ids of chunks as little-endian 32-bit numbers, made when first asked for."""

    def __init__(self, path: str):
        import json

        import regex
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__({"": b""})
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            own = json.load(f)
        pattern = next(p["pattern"]["Regex"] for p in own["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(pattern).findall
        #: Characters whose case folds and composes as here in every library.
        self.plain = regex.compile(r"[\x21-\x7e\u00a1-\u00b4\u00b6-\u00ff]*").fullmatch
        #: Merging by ids gives the merge list's tokens only if ids rise with it; else all goes to the tokenizer itself.
        self.merges_rise = ids_rise(own["model"])
        self.specials = [t["content"] for t in own["added_tokens"]]
        self.pairs = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=byte_ranks(own["model"]), special_tokens={})._core_bpe.encode_single_piece
        self.stops: dict = {c: self.pairs(c.encode() + WORD_END) for c in ",.!;:?"}
        self.long: list[str] = []

    def __missing__(self, chunk: str) -> bytes:
        word = chunk[:-1] if chunk[-1] in self.stops else chunk
        if not self.merges_rise:
            ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
        elif word.isalpha() and len(word) <= 200 and self.plain(word):
            ids = self.pairs(word.lower().encode() + WORD_END)
            if word is not chunk:
                ids += self.stops[chunk[-1]]
        elif self.plain(chunk) and len(chunk) <= 200 and not ("<" in chunk and any(x in chunk for x in self.specials)):
            ids = [i for piece in self.split(chunk.lower()) for i in self.pairs(piece.encode() + WORD_END)]
        else:
            ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
        self[chunk] = made = array("I", ids).tobytes()
        if len(chunk) > CACHED_CHARS:
            self.long.append(chunk)
        return made


#: Stands for the end of a word; the byte is in no UTF-8 text.
WORD_END = b"\xff"


def ids_rise(model: dict) -> bool:
    """Whether each merge of the list makes a token of its own, with an id above those of all merges before it."""
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    ids = [model["vocab"].get(a + b, -1) for a, b in merges]
    return all(x < y for x, y in zip(ids, ids[1:], strict=False)) and min(ids, default=0) >= 0


def byte_ranks(model: dict) -> dict[bytes, int]:
    """The vocabulary by bytes. Ids rise with the merges' order, and each token comes of one pair, so merging by ids gives the tokens of the merge list."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    to_byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    end = model["end_of_word_suffix"]
    return {bytes(to_byte[c] for c in t.removesuffix(end)) + WORD_END * t.endswith(end): i for t, i in model["vocab"].items()}


class ChunkEncoder:
    """Token ids of whole texts by way of the chunks between spaces, which repeat.

    The vocabulary's normaliser and splitter never join or look across a space or a newline, so the ids of chunks, in a row, are the ids of the text.
    Chunks of plain Latin characters are merged by a fast byte-pair library over the same vocabulary, all others by the tokenizer itself.
    """

    def __init__(self, path: str):
        self.chunks = _Chunks(path)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers."""
        chunks = self.chunks
        if len(chunks) > CACHED:
            chunks.clear()
            chunks[""] = b""
        out = [b"".join(map(chunks.__getitem__, t.replace("\n", " ").split(" "))) for t in texts]
        for chunk in chunks.long:
            chunks.pop(chunk, None)
        chunks.long.clear()
        return out


def encoder(path: str) -> ChunkEncoder:
    if path not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Each document's tokens and end_id, cut where longer than capacity: doc_id, piece, start, length, ids_crc32 and, if asked for, ids."""
    end = np.array([end_id], "<u4").tobytes()
    common.shipped(docs.sparkSession)
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    fields += [("ids", pa.list_(pa.int64()))] if with_ids else []
    schema = pa.schema(fields)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in common.slices(batches):
            rows: list[tuple] = []
            for doc, ids in zip(b.column("doc_id").to_pylist(), enc.encode(common.texts(b)), strict=True):
                whole = memoryview(ids + end)
                for k, at in enumerate(range(0, len(whole), 4 * capacity)):
                    own = whole[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(own) // 4, zlib.crc32(own)) + ((np.frombuffer(own, "<u4").astype(np.int64),) if with_ids else ()))
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], schema=schema)

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, ddl)


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Runs (length, first rank, first bin, pieces a bin, offset), by length and first rank, for counts by length.

    The piece of a length with rank r in its run is number i = r - first rank there; it goes to bin first bin + i // pieces a bin,
    at offset + (i % pieces a bin) * length.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} tokens does not fit {capacity}")
        left[length] += n
    ranks, runs, bins = np.zeros(capacity + 1, np.int64), [], 0
    gaps: dict[int, list[tuple[int, int]]] = {}
    there = 0  # bit g: some bins have gap g

    def put(length: int, n: int, first: int, each: int, offset: int) -> None:
        runs.append((length, int(ranks[length]), first, each, offset))
        ranks[length] += n
        left[length] -= n

    def gap(size: int, first: int, n: int) -> None:
        nonlocal there
        if size > 0 and n > 0:
            gaps.setdefault(size, []).append((first, n))
            there |= 1 << size

    least = capacity // 3 + 1  # of the large pieces: 3 * length > capacity
    large = [x for x in range(capacity, least - 1, -1) if left[x]]
    for a in large:
        b = min(a, capacity - a)
        while left[a] and b >= least:
            if not left[b] or (b == a and left[a] < 2):
                b -= 1
                continue
            n = int(left[a] // 2 if a == b else min(left[a], left[b]))
            if a == b:
                put(a, 2 * n, bins, 2, 0)
            else:
                put(a, n, bins, 1, 0)
                put(b, n, bins, 1, a)
            gap(capacity - a - b, bins, n)
            bins += n
        if n := int(left[a]):
            put(a, n, bins, 1, 0)
            gap(capacity - a, bins, n)
            bins += n
    for s in range(least - 1, 0, -1):
        while n := int(left[s]):
            fits = there >> s
            if not fits:
                each = capacity // s
                full, rest = divmod(n, each)
                if full:
                    put(s, full * each, bins, each, 0)
                    gap(capacity - each * s, bins, full)
                if rest:
                    put(s, rest, bins + full, each, 0)
                    gap(capacity - rest * s, bins + full, 1)
                bins += full + (rest > 0)
                break
            g = s + (fits & -fits).bit_length() - 1
            first, m = gaps[g].pop()
            if not gaps[g]:
                there &= ~(1 << g)
            each = g // s
            full, rest = (m, 0) if n >= m * each else divmod(n, each)
            put(s, full * each + rest, first, each, capacity - g)
            gap(g - each * s, first, full)
            if rest:
                gap(g - rest * s, first + full, 1)
            gap(g, first + full + (rest > 0), m - full - (rest > 0))
    return np.array(sorted(runs), np.int64).reshape(-1, 5)


def layout(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """pieces with sequence_id and offset (each replaced if there is such a column).

    Only counts by length reach the driver, and only the runs (a few for each length) go to the executors.
    """
    spark, columns = pieces.sparkSession, [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    rows = common.checkpointed(pieces.select(*columns).withColumn("__tm_row", F.monotonically_increasing_id()))
    counts = {r[0]: r[1] for r in rows.groupBy("length").count().collect()}
    runs = plan(counts, capacity)
    buckets = F.lit([counts.get(n, 0) // RANK_ROWS + 1 for n in range(capacity + 1)]).cast("array<int>")
    rows = rows.withColumn("__tm_bucket", F.pmod(F.xxhash64("__tm_row"), F.get(buckets, F.col("length").cast("int"))))
    before = Window.partitionBy("length").orderBy("__tm_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("length", "__tm_bucket").agg(F.count(F.lit(1)).alias("__tm_n")).select("length", "__tm_bucket", F.coalesce(F.sum("__tm_n").over(before), F.lit(0)).alias("__tm_before"))
    own = Window.partitionBy("length", "__tm_bucket").orderBy("__tm_row")
    ranked = rows.withColumn("__tm_own", F.row_number().over(own) - 1).join(starts, ["length", "__tm_bucket"]).select(*columns, (F.col("__tm_before") + F.col("__tm_own")).alias("__tm_rank"))
    shared = spark.sparkContext.broadcast(runs)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        table = shared.value
        n, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        at = np.searchsorted((table[:, 0] << 44) + table[:, 1], (n << 44) + r, "right") - 1
        i = r - table[at, 1]
        return pd.DataFrame({"sequence_id": table[at, 2] + i // table[at, 3], "offset": table[at, 4] + i % table[at, 3] * n})

    return ranked.withColumn("__tm_place", place("length", "__tm_rank")).select(*columns, "__tm_place.sequence_id", "__tm_place.offset")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """All documents in sequences of at most capacity tokens; with_ids: each piece's token ids too.

    Null text is the empty text, which is one piece of the end id alone. A null doc_id stays null, and rows that repeat are packed as often as
    they stand. Ties between equal lengths are broken by the row's place. No documents: no rows. Further columns of docs are left out.
    """
    return layout(pieces(docs, tokenizer, capacity, end_id, id_col, text_col, with_ids), capacity)
